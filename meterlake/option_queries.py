"""Queries that go through what other queries leave at its default: names of accounts, running runs, home folders, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import bindings as b
from meterlake.functions import scalars
from meterlake.operators import attribution, identity, trends, upserts
from meterlake.plans import capacity, usage
from meterlake.registry import query

_DAY = 86_400_000


def _accounts(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'acct' || id AS account_key, IF(id < 2, 'Team ' || id, NULL) AS label, IF(id = 3, NULL, 'prov') AS provider FROM range(4)")


_ACCOUNTS = "accounts AS (SELECT 'acct' || i AS account_key, CASE WHEN i < 2 THEN 'Team ' || i END AS label, CASE WHEN i <> 3 THEN 'prov' END AS provider FROM range(4) t(i))"
_LATEST = """lab AS (SELECT *, CASE WHEN stream_key::BIGINT % 2 = 0 THEN 'acct' || (stream_key::BIGINT % 5) END AS account FROM cap),
    newest AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY source, stream_key, "window" ORDER BY observed_at DESC, event_id DESC) = 1),
    best AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY coalesce(account, ''), CASE WHEN account IS NULL THEN source ELSE '' END, "window" ORDER BY observed_at DESC, source DESC, stream_key DESC) = 1)"""


def _one_a_time(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "stream_key", "window", "observed_at").agg(F.max_by(F.struct("used_pct", "resets_at", "status", "confidence"), "event_id").alias("_v")).select("source", "stream_key", "window", "observed_at", "_v.*")


@query(f"""WITH {b.CAPACITY}, {_LATEST}, {_ACCOUNTS}
    SELECT account, "window", used_pct, CASE WHEN account IS NULL THEN 'unattributed (' || source || ')' ELSE coalesce(label, coalesce(provider, 'unknown') || ' account ' || substr(account, 1, 6)) END AS account_label
    FROM best LEFT JOIN accounts ON account = account_key""")
def pools_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by their own name, else by provider and key; one has no provider, one is not known."""
    rows = _one_a_time(b.capacity(spark, sf_dir))
    s = F.col("stream_key").cast("long")
    own = rows.select("source", "stream_key", "window", "observed_at", F.when(s % 2 == 0, "attributed").otherwise("unattributed").alias("state"), F.when(s % 2 == 0, F.concat(F.lit("acct"), s % 5)).alias("value"))
    now = rows.agg(F.max("observed_at")).first()[0] or 0
    return capacity.pools(rows, now, own, _accounts(spark)).select("account", "window", "used_pct", "account_label")


@query(f"""WITH {b.OBSERVATIONS}, {_ACCOUNTS}, e AS (SELECT *, CASE WHEN split_part(session_key, ':', 3) <> '4' THEN 'acct' || (split_part(session_key, ':', 2)::BIGINT % 5) END AS account FROM obs WHERE "primary")
    SELECT account AS key, CASE WHEN account IS NULL THEN '(unattributed)' ELSE coalesce(label, account) END AS label, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS requests FROM e LEFT JOIN accounts ON account = account_key GROUP BY ALL""")
def usage_by_account_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.observations(spark, sf_dir).filter("primary")
    part = F.split("session_key", ":")
    keys = events.filter("session_key IS NOT NULL").select("session_key").distinct().filter(part[2] != "4")
    effective = keys.select(F.lit("session").alias("subject_kind"), F.col("session_key").alias("subject_id"), F.lit("account").alias("dimension"), F.lit("attributed").alias("state"), F.concat(F.lit("acct"), part[1].cast("long") % 5).alias("value"))
    none = attribution.evidence_windows(b.evidence(spark, sf_dir).limit(0))
    found = usage.usage(events, "account", effective=effective, evidence=none, labels=_accounts(spark)).rows
    return found.select("key", "label", "output_tokens", "requests")


@query(f"""WITH {b.EVENTS}, r AS (SELECT event_id AS run_id, observed_at AS started_at, k = 7 AS running FROM events_)
    SELECT * FROM r WHERE running UNION ALL SELECT * FROM (SELECT * FROM r WHERE NOT running ORDER BY started_at DESC, run_id DESC LIMIT 20)""")
def keep_running_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = b.events(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.col("observed_at").alias("started_at"), (F.col("k") == 7).alias("running"))
    return upserts.keep_last_runs(runs, 20, running="running")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(replace('at /home/me/x: ' || text || ' /home/me', '/home/me', '~'), '"request_id":"[^"]+"', '"request_id":"req_REDACTED"', 'g'), '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+', 'user@example.com', 'g') AS text FROM documents""")
def redact_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("at /home/me/x: "), "text", F.lit(" /home/me"))
    return b.table(spark, sf_dir, "documents").select("doc_id", scalars.redact(text, "/home/me").alias("text"))


@query(f"""WITH {b.EVENTS}, c AS (SELECT event_id, observed_at AS now, CASE WHEN k % 9 <> 0 THEN observed_at + (k - 10) * v * 60000 END AS t FROM events_),
    s AS (SELECT *, floor((t - now) / 1000)::BIGINT AS s, timezone('Asia/Tokyo', to_timestamp(t / 1000.0)) AS there, timezone('Asia/Tokyo', to_timestamp(now / 1000.0)) AS here FROM c)
    SELECT event_id, CASE WHEN t IS NULL THEN '' WHEN s <= 0 THEN 'now' WHEN s >= 86400 THEN (s // 86400) || 'd' || (s // 3600 % 24) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' ELSE (s // 60) || 'm' END AS countdown,
           CASE WHEN t IS NULL THEN '-' WHEN there::DATE = here::DATE THEN strftime(there, '%H:%M') ELSE strftime(there, '%a %H:%M') END AS clock FROM s""")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    at = F.when(F.col("k") % 9 != 0, F.col("observed_at") + (F.col("k") - 10) * F.col("v") * 60_000)
    return e.select("event_id", scalars.until_text(at, F.col("observed_at")).alias("countdown"), scalars.clock_text(at, F.col("observed_at"), "Asia/Tokyo").alias("clock"))


@query(f"""WITH {b.CAPACITY}, o AS (SELECT source, stream_key, "window", observed_at, arg_max(used_pct, event_id) AS used_pct, (observed_at // {3 * _DAY} + 1) * {3 * _DAY} AS resets_at FROM cap GROUP BY ALL),
    p AS (SELECT *, used_pct - lag(used_pct) OVER w AS used, observed_at - lag(observed_at) OVER w AS ms, resets_at IS NOT DISTINCT FROM lag(resets_at) OVER w AS same FROM o WINDOW w AS (PARTITION BY stream_key, "window" ORDER BY observed_at)),
    r AS (SELECT *, CASE WHEN same AND used >= 0 AND ms > 0 THEN used * 3600000 / ms END AS pace FROM p QUALIFY row_number() OVER (PARTITION BY stream_key, "window" ORDER BY observed_at DESC) = 1),
    t AS (SELECT max(observed_at) AS now FROM cap)
    SELECT stream_key, "window", observed_at, used_pct, resets_at, round(pace, 6) AS pct_per_hour FROM r, t WHERE resets_at > now AND pace > 0 AND (100 - used_pct) / pace - (now - observed_at) / 3600000 < (resets_at - now) / 3600000""")
def burn_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one_a_time(b.capacity(spark, sf_dir)).withColumn("resets_at", F.expr(f"(observed_at div {3 * _DAY} + 1) * {3 * _DAY}"))
    now = rows.agg(F.max("observed_at")).first()[0] or 0
    found = trends.burn_alerts(rows, ["stream_key", "window"], now)
    return found.select("stream_key", "window", "observed_at", "used_pct", "resets_at", F.round("pct_per_hour", 6).alias("pct_per_hour"))


@query(f"""WITH {b.EVENTS}, e AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN 'acct' || (v % 4) ELSE 'alias:p' || (k % 2) || ':login:h' || (user_id % 30) || ':x' END AS value, CASE WHEN k % 10 = 3 THEN 'branch' ELSE 'account' END AS dimension,
        'p' || (k % 2) || ':login' AS kind, 'h' || (user_id % 30) || ':x' AS hash FROM events_),
    registry AS (SELECT 'p0:login' AS kind, 'h' || i || ':x' AS hash, 'known' || (i // 2) AS account FROM range(10) t(i) UNION ALL SELECT 'p0:login', 'h4:x', 'known9'),
    accounts AS (SELECT kind, hash, count(DISTINCT root) AS n, min(root) AS root FROM (SELECT kind, hash, CASE WHEN account = 'known1' THEN 'known0' ELSE account END AS root FROM registry) GROUP BY ALL)
    SELECT event_id, dimension, CASE WHEN dimension <> 'account' OR NOT starts_with(value, 'alias:') THEN value ELSE coalesce(a.root, substr(sha256('s' || chr(31) || e.kind || chr(31) || e.hash), 1, 32)) END AS value
    FROM e LEFT JOIN accounts a ON a.kind = e.kind AND a.hash = e.hash WHERE dimension <> 'account' OR NOT starts_with(value, 'alias:') OR coalesce(n, 1) = 1""")
def resolve_alias_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some aliases are known, one of them to two accounts that are not merged, and refused; the others make accounts."""
    e, k = b.events(spark, sf_dir), F.col("k")
    alias = identity.alias_value(F.concat(F.lit("p"), k % 2), F.lit("login"), F.concat(F.lit("h"), F.col("user_id") % 30, F.lit(":x")))
    evidence = e.select("event_id", F.when(k % 10 == 3, "branch").otherwise("account").alias("dimension"), F.when(k % 4 == 0, F.concat(F.lit("acct"), F.col("v") % 4)).otherwise(alias).alias("value"), F.col("observed_at").alias("last_confirmed_at"))
    registry = spark.sql("""SELECT 'p0:login' AS alias_kind, concat('h', id, ':x') AS alias_hash, 'reported' AS asserted_by, concat('known', id DIV 2) AS account_key, 0L AS last_confirmed, CAST(NULL AS LONG) AS revoked_at FROM range(10)
                            UNION ALL SELECT 'p0:login', 'h4:x', 'reported', 'known9', 0L, NULL""")
    roots = spark.sql("SELECT 'known1' AS node, 'known0' AS root UNION ALL SELECT 'known0', 'known0'")
    return identity.resolve_alias_values(evidence, registry, roots, "s")[0].select("event_id", "dimension", "value")
