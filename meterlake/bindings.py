"""Deterministic projections of the driver's tables to canonical columns, each with the SQL that
states the same projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` of their properties and milliseconds."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.floor("value").cast("long").alias("v"), F.floor(F.col("value") * 3).cast("long").alias("v3"), F.floor(F.col("value") / 2).cast("long").alias("v2"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("observed_at"))


EVENTS = """events_ AS (
    SELECT event_id, user_id, event_type, floor(value)::BIGINT AS v, floor(value * 3)::BIGINT AS v3, floor(value / 2)::BIGINT AS v2,
           (props->>'$.k')::BIGINT AS k, epoch_us(ts) // 1000 AS observed_at
    FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    source = F.when(kind.isin("click", "view"), "log.a").when(kind == "purchase", "log.b").when(kind == "error", "otel").otherwise("aux")
    return e.select(
        F.col("event_id").alias("observation_id"), F.col("event_id").alias("event_key"), source.alias("source"), (source != "otel").alias("primary"), (source == "aux").alias("auxiliary"),
        F.when(F.col("k") % 11 != 0, F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 5)).alias("session_key"), "observed_at", F.col("v").alias("uncached_input_tokens"),
        F.col("v3").alias("cache_read_input_tokens"), F.when(F.col("k") % 7 != 0, F.col("k")).alias("cache_write_input_tokens"), F.col("v2").alias("output_tokens"),
        (F.col("k") % 10).alias("reasoning_output_tokens"), F.concat(F.lit("m"), F.col("k") % 4).alias("model"), source.alias("harness"),
        F.when(F.col("k") % 13 != 0, F.concat(F.lit("p"), F.col("k") % 3)).alias("provider"), F.concat("user_id", F.lit(":"), "k").alias("provider_request_key"))


OBSERVATIONS = f"""{EVENTS}, obs AS (
    SELECT event_id AS observation_id, event_id AS event_key,
           CASE WHEN event_type IN ('click', 'view') THEN 'log.a' WHEN event_type = 'purchase' THEN 'log.b' WHEN event_type = 'error' THEN 'otel' ELSE 'aux' END AS source,
           event_type <> 'error' AS "primary", event_type NOT IN ('click', 'view', 'purchase', 'error') AS auxiliary,
           CASE WHEN k % 11 <> 0 THEN 's:' || user_id || ':' || (k % 5) END AS session_key, observed_at, v AS uncached_input_tokens, v3 AS cache_read_input_tokens,
           CASE WHEN k % 7 <> 0 THEN k END AS cache_write_input_tokens, v2 AS output_tokens, k % 10 AS reasoning_output_tokens, 'm' || (k % 4) AS model,
           CASE WHEN event_type IN ('click', 'view') THEN 'log.a' WHEN event_type = 'purchase' THEN 'log.b' WHEN event_type = 'error' THEN 'otel' ELSE 'aux' END AS harness,
           CASE WHEN k % 13 <> 0 THEN 'p' || (k % 3) END AS provider, user_id || ':' || k AS provider_request_key
    FROM events_)"""


def evidence(spark: SparkSession, sf_dir: str, dimension: str = "account") -> DataFrame:
    """Session evidence of an account, a branch or a billing route, in the order of events."""
    e = events(spark, sf_dir)
    rank = F.col("k") % 3
    live = F.col("event_type") == "error"
    value = F.when(F.col("v") % 4 < 3, "api_key").otherwise("subscription") if dimension == "billing_route" else F.concat(F.lit("acct" if dimension == "account" else "branch"), F.col("v") % 4)
    return e.select(
        F.lit("session").alias("subject_kind"), F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 5).alias("subject_id"), F.lit(dimension).alias("dimension"),
        value.alias("value"), F.concat(F.lit("by-"), F.col("event_type")).alias("method"), F.lit("events").alias("source"),
        F.when(rank == 0, "authoritative").when(rank == 1, "observed").otherwise("inferred").alias("confidence"), F.when(live, "live").otherwise("historical").alias("validity"),
        F.when(F.col("event_type") == "signup", 0).otherwise(F.col("observed_at")).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"),
        F.col("observed_at").alias("first_observed_at"), (F.col("observed_at") + F.when(live, 86_400_000).otherwise(0)).cast("long").alias("last_confirmed_at"), F.col("event_id").alias("arrival_seq"))


def evidence_sql(dimension: str = "account") -> str:
    """``ev``: evidence, and ``windows``: the same with its windows closed."""
    value = "CASE WHEN v % 4 < 3 THEN 'api_key' ELSE 'subscription' END" if dimension == "billing_route" else f"'{'acct' if dimension == 'account' else 'branch'}' || (v % 4)"
    return f"""ev AS (
    SELECT 's:' || user_id || ':' || (k % 5) AS subject_id, {value} AS value, 'by-' || event_type AS method,
           CASE k % 3 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'observed' ELSE 'inferred' END AS confidence, CASE WHEN event_type = 'error' THEN 'live' ELSE 'historical' END AS validity,
           CASE WHEN event_type = 'signup' THEN 0 ELSE observed_at END AS valid_from, observed_at AS first_observed_at,
           observed_at + CASE WHEN event_type = 'error' THEN 86400000 ELSE 0 END AS last_confirmed_at, event_id AS seq
    FROM events_),
    own AS (
    SELECT subject_id, method, value, valid_from, min(seq) AS evidence_id, max(last_confirmed_at) AS last_confirmed_at, arg_min(confidence, seq) AS confidence,
           arg_min(validity, seq) AS validity, arg_min(first_observed_at, seq) AS first_observed_at
    FROM ev GROUP BY ALL),
    windows AS (
    SELECT o.*, (SELECT CASE WHEN n.valid_from <> 0 THEN n.valid_from ELSE n.first_observed_at END FROM own n
                 WHERE n.subject_id = o.subject_id AND n.method = o.method AND n.value <> o.value AND n.evidence_id > o.evidence_id
                 ORDER BY n.evidence_id LIMIT 1) AS valid_to,
           CASE confidence WHEN 'authoritative' THEN 3 WHEN 'observed' THEN 2 ELSE 1 END AS rank
    FROM own o)"""


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    window = F.when(kind.isin("click", "view"), "session").when(kind == "purchase", "weekly").otherwise(F.concat(F.lit("other:"), kind))
    return e.select(F.concat(F.lit("src"), F.col("user_id") % 3).alias("source"), F.col("user_id").cast("string").alias("stream_key"), window.alias("window"),
                    F.least(F.lit(100), F.expr("v div 5")).cast("double").alias("used_pct"), (F.col("observed_at") + F.col("k") * 3_600_000).alias("resets_at"), F.lit("ok").alias("status"),
                    F.lit("observed").alias("confidence"), "observed_at", "event_id")


CAPACITY = f"""{EVENTS}, cap AS (
    SELECT 'src' || (user_id % 3) AS source, user_id::VARCHAR AS stream_key,
           CASE WHEN event_type IN ('click', 'view') THEN 'session' WHEN event_type = 'purchase' THEN 'weekly' ELSE 'other:' || event_type END AS "window",
           least(100, v // 5)::DOUBLE AS used_pct, observed_at + k * 3600000 AS resets_at, 'ok' AS status, 'observed' AS confidence, observed_at, event_id
    FROM events_)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    state = F.when(kind == "error", "stalled").when(kind == "signup", "unknown").when(kind == "click", "busy").when(kind == "view", "idle").otherwise("resuming")
    return e.select(F.col("user_id").alias("pane"), "observed_at", F.col("event_id").alias("seq"), state.alias("state"), F.when(kind == "error", F.concat(F.lit("e"), F.col("k") % 3)).alias("error_key"),
                    F.expr("event_id div 5000").alias("pane_pid"), F.when(F.col("k") % 5 == 0, F.col("observed_at") + 3_600_000).alias("reset_hint"), F.expr("observed_at div 86400000").alias("pass_no"), (F.col("k") * 1000).alias("retry_after_ms"),
                    F.lit("h").alias("harness"), F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 5).alias("session_key"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("note"))


STATES = f"""{EVENTS}, st AS (
    SELECT user_id AS pane, observed_at, event_id AS seq,
           CASE event_type WHEN 'error' THEN 'stalled' WHEN 'signup' THEN 'unknown' WHEN 'click' THEN 'busy' WHEN 'view' THEN 'idle' ELSE 'resuming' END AS state,
           CASE WHEN event_type = 'error' THEN 'e' || (k % 3) END AS error_key, event_id // 5000 AS pane_pid, k * 1000 AS retry_after_ms,
           CASE WHEN k % 5 = 0 THEN observed_at + 3600000 END AS reset_hint, observed_at // 86400000 AS pass_no, 's:' || user_id || ':' || (k % 5) AS session_key
    FROM events_)"""


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of merges over customers: each goes into half its key, but for every seventh."""
    c = table(spark, sf_dir, "customer").filter("c_custkey >= 1").select(F.col("c_custkey").cast("long").alias("from_key"))
    return c.select("from_key", F.expr("from_key div 2").alias("into_key"), F.when(F.col("from_key") % 7 == 0, F.lit(1)).cast("long").alias("revoked_at"))


MERGES = """merges AS (
    SELECT c_custkey::BIGINT AS from_key, (c_custkey // 2)::BIGINT AS into_key, CASE WHEN c_custkey % 7 = 0 THEN 1 END AS revoked_at
    FROM customer WHERE c_custkey >= 1)"""
#: ``roots``: the root of every node, walking up.
ROOTS = f"""{MERGES}, live AS (SELECT from_key, into_key FROM merges WHERE revoked_at IS NULL),
    walk(node, up) AS (SELECT from_key, into_key FROM live UNION ALL SELECT walk.node, live.into_key FROM walk JOIN live ON walk.up = live.from_key),
    tops AS (SELECT node, min(up) AS root FROM walk GROUP BY node),
    roots AS (SELECT node, root FROM tops UNION SELECT DISTINCT root, root FROM tops)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as folders: ``/host/part/part`` without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", bare.alias("path"))


PAGE_PATHS = """paths AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages)"""
