"""Rules of identity, attribution, writing, health and quality over the driver's tables, with the SQL that
states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import bindings as b
from meterlake.functions import scalars, screens
from meterlake.lineage import cut
from meterlake.operators import attribution, identity, linking, paths, quality, sequences, trends, upserts
from meterlake.plans import agents, bookmarks, health
from meterlake.registry import query

_DAY = 86_400_000


def _newest(rows: DataFrame) -> int:
    """The newest time of a table: one number."""
    return rows.agg(F.max("observed_at")).first()[0] or 0


# -- identity --------------------------------------------------------------------------------------

_REGISTRY = f"""{b.ROOTS}, registry AS (
        SELECT 'mail' AS alias_kind, (o_orderkey % 1500)::VARCHAR AS alias_hash, CASE WHEN o_orderkey % 4 = 0 THEN 'login' ELSE 'reported' END AS asserted_by, o_custkey::VARCHAR AS account_key,
               max(o_orderkey)::BIGINT AS last_confirmed, min(CASE WHEN o_orderkey % 6 = 0 THEN 1::BIGINT END) AS revoked_at FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2, 3, 4),
    seen AS (SELECT 'mail' AS alias_kind, (o_orderkey % 2500)::VARCHAR AS alias_hash, CASE WHEN o_orderkey % 8 = 0 THEN 'login' ELSE 'reported' END AS asserted_by, max(o_orderkey)::BIGINT AS seen_at
             FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2, 3),
    own AS (SELECT alias_kind, alias_hash, asserted_by, min(account_key) AS own, count(DISTINCT account_key) AS n FROM registry GROUP BY 1, 2, 3),
    reported AS (SELECT alias_kind, alias_hash, min(coalesce(root::VARCHAR, account_key)) AS lo, max(coalesce(root::VARCHAR, account_key)) AS hi
                 FROM registry LEFT JOIN roots ON node::VARCHAR = account_key WHERE revoked_at IS NULL AND asserted_by = 'reported' GROUP BY 1, 2),
    j AS (SELECT seen.*, own, lo, coalesce(coalesce(n, 0) <> 1 AND lo <> hi, false) AS clash, n FROM seen LEFT JOIN own USING (alias_kind, alias_hash, asserted_by) LEFT JOIN reported USING (alias_kind, alias_hash))"""


def _asserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = b.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = o.filter("o_orderkey % 3 = 0").select(F.lit("mail").alias("alias_kind"), (key % 1500).cast("string").alias("alias_hash"), F.when(key % 4 == 0, "login").otherwise("reported").alias("asserted_by"),
                                                  F.col("o_custkey").cast("string").alias("account_key"), key.cast("long").alias("at"), F.when(key % 6 == 0, F.lit(1)).cast("long").alias("gone"))
    registry = kept.groupBy("alias_kind", "alias_hash", "asserted_by", "account_key").agg(F.max("at").alias("last_confirmed"), F.min("gone").alias("revoked_at"))
    seen = o.filter("o_orderkey % 5 <> 0").select(F.lit("mail").alias("alias_kind"), (key % 2500).cast("string").alias("alias_hash"), F.when(key % 8 == 0, "login").otherwise("reported").alias("asserted_by"), key.cast("long").alias("seen_at"))
    roots = identity.canonical_accounts(b.merges(spark, sf_dir)).select(F.col("node").cast("string").alias("node"), F.col("root").cast("string").alias("root"))
    return identity.assert_aliases(seen, registry, roots, "secret")


@query(f"""WITH RECURSIVE {_REGISTRY}, all_ AS (
        SELECT alias_kind, alias_hash, asserted_by, account_key, last_confirmed, revoked_at, 0 AS new FROM registry
        UNION ALL SELECT alias_kind, alias_hash, asserted_by, coalesce(CASE WHEN n = 1 THEN own END, lo, substr(sha256('secret' || chr(31) || alias_kind || chr(31) || alias_hash), 1, 32)), seen_at, NULL, 1 FROM j WHERE NOT clash)
    SELECT alias_kind, alias_hash, asserted_by, account_key, max(last_confirmed) AS last_confirmed, arg_max_null(revoked_at, new) AS revoked_at FROM all_ GROUP BY 1, 2, 3, 4""")
def assert_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asserted(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_REGISTRY} SELECT alias_kind, alias_hash, asserted_by FROM j WHERE clash")
def refused_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asserted(spark, sf_dir)[1]


_WILD = """wild AS (SELECT c_custkey::BIGINT AS from_key, CASE WHEN c_custkey % 13 = 0 THEN c_custkey WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey // 2 END::BIGINT AS into_key,
        CASE WHEN c_custkey % 2 = 0 THEN 'evidence' ELSE 'user' END AS evidence, CASE WHEN c_custkey % 7 = 0 THEN 1::BIGINT END AS revoked_at, c_custkey::BIGINT AS merge_id FROM customer
        UNION ALL SELECT c_custkey, 1, 'user', NULL, c_custkey + 1000000000 FROM customer WHERE c_custkey % 17 = 3)"""


def _wild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges that break every rule here and there."""
    c, key = b.table(spark, sf_dir, "customer"), F.col("c_custkey").cast("long")
    into = F.when(key % 13 == 0, key).when(key % 5 == 0, key + 1).otherwise(F.expr("c_custkey div 2")).cast("long")
    first = c.select(key.alias("from_key"), into.alias("into_key"), F.when(key % 2 == 0, "evidence").otherwise("user").alias("evidence"), F.when(key % 7 == 0, F.lit(1)).cast("long").alias("revoked_at"), key.alias("merge_id"))
    second = c.filter("c_custkey % 17 = 3").select(key.alias("from_key"), F.lit(1).cast("long").alias("into_key"), F.lit("user").alias("evidence"), F.lit(None).cast("long").alias("revoked_at"), (key + 1_000_000_000).alias("merge_id"))
    return first.unionByName(second)


@query(f"""WITH {_WILD}, live AS (SELECT * FROM wild WHERE revoked_at IS NULL), known AS (SELECT c_custkey AS account_key FROM customer WHERE c_custkey % 11 <> 0)
    SELECT from_key, into_key, 'equal ends' AS problem FROM live WHERE from_key = into_key
    UNION ALL SELECT DISTINCT from_key, into_key, 'unknown account' FROM live WHERE from_key NOT IN (SELECT account_key FROM known) OR into_key NOT IN (SELECT account_key FROM known)
    UNION ALL SELECT from_key, min(into_key), 'several outgoing merges' FROM live GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT from_key, into_key, 'evidence merges into the larger key' FROM live WHERE evidence = 'evidence' AND into_key > from_key""")
def merge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = b.table(spark, sf_dir, "customer").filter("c_custkey % 11 <> 0").select(F.col("c_custkey").cast("long").alias("account_key"))
    return identity.merge_violations(_wild(spark, sf_dir), accounts)


@query(f"WITH {_WILD} SELECT merge_id, from_key, into_key, CASE WHEN merge_id IN (2, 3, 7, 14, 1000000003) AND revoked_at IS NULL THEN 99 ELSE revoked_at END::BIGINT AS revoked_at FROM wild")
def unmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unmerge(_wild(spark, sf_dir), [2, 3, 7, 14, 1_000_000_003], 99).select("merge_id", "from_key", "into_key", F.col("revoked_at").cast("long").alias("revoked_at"))


# -- attribution -----------------------------------------------------------------------------------

_OWN = f"""{b.EVENTS}, {b.evidence_sql()}, mine AS (SELECT event_id, 'acct' || (k % 4) AS value, k % 20 <> 1 AS holds FROM events_ WHERE k % 10 = 1)"""


@query(f"""WITH {_OWN}, t AS (SELECT max(observed_at) AS now FROM events_),
    valid AS (SELECT w.* FROM windows w, t WHERE (validity <> 'live' OR now BETWEEN first_observed_at AND last_confirmed_at) AND now >= valid_from AND (valid_to IS NULL OR now <= valid_to)),
    top AS (SELECT * FROM valid QUALIFY rank = max(rank) OVER (PARTITION BY subject_id)),
    told AS (SELECT subject_id, count(DISTINCT value) = 1 AS one, min(value) AS value FROM top GROUP BY 1),
    s AS (SELECT event_id, CASE WHEN k % 11 <> 0 THEN 's:' || user_id || ':' || (k % 5) END AS session_key FROM events_)
    SELECT s.event_id::VARCHAR AS event_key, CASE WHEN mine.event_id IS NOT NULL THEN CASE WHEN holds THEN 'attributed' ELSE 'unattributed' END WHEN one THEN 'attributed' WHEN one IS NOT NULL THEN 'ambiguous' ELSE 'unattributed' END AS state,
           CASE WHEN mine.event_id IS NOT NULL THEN CASE WHEN holds THEN mine.value END WHEN one THEN told.value END AS value,
           CASE WHEN session_key IS NULL AND mine.event_id IS NULL THEN 'no-session-id' END AS note
    FROM s LEFT JOIN mine USING (event_id) LEFT JOIN told ON session_key = subject_id""")
def event_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's account now: by evidence of its own where there is any, else by its session's."""
    e = b.events(spark, sf_dir)
    now = _newest(e)
    sessions = attribution.evidence_windows(b.evidence(spark, sf_dir))
    start = F.when(F.col("k") % 20 != 1, 0).otherwise(now + 1).cast("long")
    own = e.filter("k % 10 = 1").select(
        F.lit("usage_event").alias("subject_kind"), F.col("event_id").cast("string").alias("subject_id"), F.lit("account").alias("dimension"), F.concat(F.lit("acct"), F.col("k") % 4).alias("value"), F.lit("told").alias("method"),
        F.lit("events").alias("source"), F.lit("observed").alias("confidence"), F.lit("historical").alias("validity"), start.alias("valid_from"), F.lit(None).cast("long").alias("valid_to"),
        F.col("observed_at").alias("first_observed_at"), F.col("observed_at").alias("last_confirmed_at"), F.col("event_id").alias("arrival_seq"))
    evidence = cut(sessions.unionByName(attribution.evidence_windows(own), allowMissingColumns=True), "evidence")
    times = evidence.select("subject_kind", "subject_id", "dimension").distinct().withColumn("subject_time", F.lit(now).cast("long"))
    resolved = attribution.resolve(evidence, times)
    asked = e.select(F.col("event_id").alias("event_key"), F.when(F.col("k") % 11 != 0, F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 5)).alias("session_key"))
    return attribution.effective(asked, resolved.filter("subject_kind = 'usage_event'"), resolved.filter("subject_kind = 'session'"), evidence, "account")


@query(f"""WITH {b.EVENTS}, {b.evidence_sql()}, merged AS (SELECT * REPLACE ('acct' || (right(value, 1)::BIGINT % 2) AS value) FROM windows),
    e AS (SELECT event_id, observed_at, 's:' || user_id || ':' || (k % 5) AS session_key FROM events_),
    valid AS (SELECT event_id, m.* FROM e JOIN merged m ON session_key = subject_id WHERE CASE WHEN validity = 'live' THEN observed_at BETWEEN first_observed_at AND last_confirmed_at + 120000 ELSE observed_at >= valid_from AND (valid_to IS NULL OR observed_at <= valid_to) END),
    top AS (SELECT * FROM valid QUALIFY rank = max(rank) OVER (PARTITION BY event_id)),
    told AS (SELECT event_id, count(DISTINCT value) = 1 AS one, min(value) AS value FROM top GROUP BY 1)
    SELECT event_id, CASE WHEN one IS NULL THEN 'unattributed' WHEN one THEN 'attributed' ELSE 'ambiguous' END AS state, CASE WHEN one THEN value END AS value FROM e LEFT JOIN told USING (event_id)""")
def account_at_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of requests where merged accounts count as one: acct2 went into acct0, acct3 into acct1."""
    evidence = attribution.evidence_windows(b.evidence(spark, sf_dir))
    roots = b.evidence(spark, sf_dir).select(F.col("value").alias("node")).distinct().withColumn("root", F.concat(F.lit("acct"), F.substring("node", -1, 1).cast("long") % 2))
    asked = b.events(spark, sf_dir).select("event_id", F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 5).alias("session_key"), "observed_at")
    return attribution.account_at(asked, evidence, key="event_id", roots=roots).select("event_id", "state", "value")


@query(f"""WITH {b.EVENTS} SELECT DISTINCT 's:' || user_id || ':' || (k % 10) AS subject_id, 'account' AS dimension, 'unattributed' AS state, 'no login' AS note FROM events_
    WHERE 's:' || user_id || ':' || (k % 10) NOT IN (SELECT 's:' || user_id || ':' || (k % 5) FROM events_)""")
def failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = b.events(spark, sf_dir).select(F.lit("session").alias("subject_kind"), F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 10).alias("subject_id"), F.lit("account").alias("dimension"), F.lit("no login").alias("reason")).distinct()
    return attribution.failed_attempts(tried, b.evidence(spark, sf_dir)).select("subject_id", "dimension", "state", "note")


# -- linking ---------------------------------------------------------------------------------------


@query(f"""WITH {b.OBSERVATIONS} SELECT observation_id, sha256(source || chr(31) || session_key || chr(31) || provider_request_key) AS event_key FROM obs WHERE "primary" AND session_key IS NOT NULL""")
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir).filter("session_key IS NOT NULL").withColumn("stream_key", F.col("session_key")).withColumn("source_request_key", F.col("provider_request_key"))
    return linking.usage_events(o.drop("event_key")).select("observation_id", "event_key")


@query(f"""WITH {b.OBSERVATIONS} SELECT event_key, CASE WHEN event_key % 2 = 0 THEN observed_at - 1000 ELSE observed_at END AS observed_at,
    CASE WHEN event_key % 6 = 0 THEN NULL WHEN event_key % 2 = 0 THEN 'old' ELSE session_key END AS session_key, output_tokens FROM obs WHERE "primary" AND coalesce(event_key % 3, 0) < 2""")
def refreshed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events recomputed by a newer rule, where every second was stored before."""
    o = b.observations(spark, sf_dir).filter("primary")
    stored = o.filter("event_key % 2 = 0").select("event_key", (F.col("observed_at") - 1000).alias("observed_at"), F.when(F.col("event_key") % 6 != 0, "old").alias("session_key"))
    due = linking.below_version(o.withColumn("rule_version", F.col("event_key") % 3), 2).drop("rule_version")
    return linking.refreshed_events(stored, due).select("event_key", "observed_at", "session_key", "output_tokens")


_CANDIDATES = f"""{b.OBSERVATIONS}, c AS (SELECT observation_id % 500 AS event_key, CASE WHEN observation_id % 3 = 0 THEN 'model' ELSE 'provider' END AS field, source, observation_id, observation_id % 1000 AS seq FROM obs),
    chosen AS (SELECT event_key, field, arg_min((source, observation_id), (seq, observation_id)) AS x FROM c GROUP BY 1, 2)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("observation_id")
    return b.observations(spark, sf_dir).select((number % 500).alias("event_key"), F.when(number % 3 == 0, "model").otherwise("provider").alias("field"), "source", "observation_id", (number % 1000).alias("seq"))


@query(f"WITH {_CANDIDATES} SELECT event_key, field, x[1] AS source, x[2] AS observation_id FROM chosen")
def metadata_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.metadata_links(_candidates(spark, sf_dir))[0]


@query(f"WITH {_CANDIDATES} SELECT c.* FROM c JOIN chosen USING (event_key, field) WHERE c.source <> x[1]")
def refused_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.metadata_links(_candidates(spark, sf_dir))[1]


# -- agents, checkouts, bookmarks, health ----------------------------------------------------------


@query(f"""WITH {b.EVENTS}, s AS (SELECT user_id AS pane, 's:' || user_id || ':' || (k % 4) AS session_key, CASE WHEN event_type IN ('click', 'view') THEN 'open_session_file' ELSE 'process' END AS method, observed_at // 21600000 AS pass_no, observed_at FROM events_),
    weak AS (SELECT * FROM s WHERE method = 'open_session_file' AND (pane, pass_no) NOT IN (SELECT (pane, pass_no) FROM s WHERE method <> 'open_session_file')),
    kept AS (SELECT * FROM s WHERE method <> 'open_session_file' UNION ALL SELECT * FROM weak WHERE (pane, pass_no) IN (SELECT (pane, pass_no) FROM weak GROUP BY pane, pass_no HAVING count(DISTINCT session_key) = 1)),
    once AS (SELECT session_key, pane, method, pass_no, min(observed_at) AS lo, max(observed_at) AS hi FROM kept GROUP BY 1, 2, 3, 4),
    i AS (SELECT *, pass_no - row_number() OVER (PARTITION BY session_key, pane, method ORDER BY pass_no) AS island FROM once)
    SELECT session_key, pane, method, min(lo) AS first_observed_at, max(hi) AS last_confirmed_at, count(*) AS passes FROM i GROUP BY session_key, pane, method, island""")
def live_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select(F.col("user_id").alias("pane"), F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 4).alias("session_key"),
        F.when(F.col("event_type").isin("click", "view"), "open_session_file").otherwise("process").alias("method"), F.expr("observed_at div 21600000").alias("pass_no"), "observed_at")
    return sequences.live_pairings(rows)


@query(f"""WITH {b.STATES}, {b.evidence_sql()}, t AS (SELECT max(observed_at) AS now FROM st),
    newest AS (SELECT pane, state, CASE WHEN seq % 2 = 0 THEN session_key END AS own FROM st, t WHERE observed_at >= now - {3 * _DAY} QUALIFY row_number() OVER (PARTITION BY pane ORDER BY observed_at DESC, seq DESC) = 1),
    pair AS (SELECT user_id AS pane, 's:' || user_id || ':' || (k % 5) AS s, observed_at // 21600000 * 21600000 AS told_at, CASE WHEN k % 4 = 0 THEN observed_at // 21600000 * 21600000 END AS valid_to FROM events_ WHERE event_type = 'click'),
    live AS (SELECT pair.*, max(told_at) OVER (PARTITION BY pane) AS last FROM pair, t WHERE told_at >= now - {3 * _DAY} AND (valid_to IS NULL OR valid_to >= now - {3 * _DAY})),
    paired AS (SELECT pane, count(DISTINCT s) AS n, min(s) AS s FROM live WHERE told_at = last GROUP BY pane),
    joined AS (SELECT pane, state, coalesce(own, CASE WHEN n = 1 THEN s END) AS session_key, CASE WHEN own IS NOT NULL THEN 'sample' WHEN n = 1 THEN 'pane_evidence' WHEN n > 1 THEN 'ambiguous' END AS session_join FROM newest LEFT JOIN paired USING (pane)),
    valid AS (SELECT pane, w.* FROM joined JOIN windows w ON session_key = subject_id, t WHERE CASE WHEN validity = 'live' THEN now BETWEEN first_observed_at AND last_confirmed_at + 120000 ELSE now >= valid_from AND (valid_to IS NULL OR now <= valid_to) END),
    top AS (SELECT * FROM valid QUALIFY rank = max(rank) OVER (PARTITION BY pane)),
    told AS (SELECT pane, count(DISTINCT value) = 1 AS one, min(value) AS value FROM top GROUP BY 1)
    SELECT pane, state, session_key, session_join, CASE WHEN session_key IS NULL THEN NULL WHEN one IS NULL THEN 'unattributed' WHEN one THEN 'attributed' ELSE 'ambiguous' END AS account_state, CASE WHEN one THEN value END AS account FROM joined LEFT JOIN told USING (pane)""")
def agents_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents whose samples name a session or take that of their pane, with the account in use now."""
    samples = b.states(spark, sf_dir).withColumn("session_key", F.when(F.col("seq") % 2 == 0, F.col("session_key")))
    six = F.expr("observed_at div 21600000 * 21600000")
    pairs = b.events(spark, sf_dir).filter("event_type = 'click'").select(F.col("user_id").alias("pane"), F.concat(F.lit("s:"), F.col("user_id"), F.lit(":"), F.col("k") % 5).alias("session_key"), six.alias("last_confirmed_at"), F.when(F.col("k") % 4 == 0, six).alias("valid_to"))
    found = agents.agents(samples, _newest(samples), pairs, attribution.evidence_windows(b.evidence(spark, sf_dir)), 3 * _DAY)
    return found.select("pane", "state", "session_key", "session_join", "account_state", "account")


@query(f"""WITH {b.EVENTS} SELECT user_id AS session_key, max(CASE WHEN k % 3 <> 0 THEN observed_at END) AS last_seen_at,
    coalesce((SELECT max(observed_at) FROM events_) - max(CASE WHEN k % 3 <> 0 THEN observed_at END) <= {_DAY}, false) AS live FROM events_ GROUP BY user_id""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    seen = e.groupBy(F.col("user_id").alias("session_key")).agg(F.max(F.when(F.col("k") % 3 != 0, F.col("observed_at"))).alias("last_seen_at"))
    return agents.live_sessions(seen, _newest(e), _DAY)


@query(f"""WITH {b.PAGE_PATHS}, s AS (SELECT 'c' || (page_id // 2) AS checkout_id, 'r' || (page_id % 9) AS repository_id, CASE WHEN page_id % 5 <> 0 THEN path END AS local_path, page_id % 7 = 0 AS non_repo, page_id FROM paths),
    once AS (SELECT checkout_id, arg_min((repository_id, local_path, non_repo), page_id) AS x FROM s GROUP BY 1),
    n AS (SELECT checkout_id, x[1] AS repository_id, x[2] AS local_path, x[3] AS non_repo, list_filter(string_split(x[2], '/'), lambda p: p <> '') AS parts FROM once)
    SELECT checkout_id, repository_id, local_path, non_repo, CASE WHEN local_path IS NULL THEN NULL WHEN count(local_path) OVER (PARTITION BY parts[-1]) > 1 THEN array_to_string(parts[-2:], '/') ELSE parts[-1] END AS display_name FROM n""")
def checkout_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id")
    rows = b.page_paths(spark, sf_dir).select(F.concat(F.lit("c"), F.expr("page_id div 2")).alias("checkout_id"), F.concat(F.lit("r"), number % 9).alias("repository_id"), F.when(number % 5 != 0, F.col("path")).alias("local_path"), (number % 7 == 0).alias("non_repo"), number.alias("observed_at"))
    return paths.checkout_sightings(rows)


@query(f"""WITH {b.EVENTS}, a AS (SELECT user_id AS who, event_type AS "view", event_id AS seq, observed_at AS done_at, CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'touch' ELSE 'close' END AS action FROM events_ WHERE k % 10 < 4),
    g AS (SELECT who, "view", arg_max(done_at, seq) FILTER (WHERE action = 'open') AS opened, arg_max(done_at, seq) AS seen, arg_max(done_at, seq) FILTER (WHERE action = 'close') AS closed,
                 max(seq) FILTER (WHERE action = 'open') AS o, max(seq) FILTER (WHERE action = 'close') AS c FROM a GROUP BY 1, 2),
    old AS (SELECT DISTINCT user_id AS who, 'click' AS "view" FROM events_ WHERE user_id % 2 = 0)
    SELECT who, "view", coalesce(opened, CASE WHEN old.who IS NOT NULL THEN 1 END) AS opened_at, coalesce(seen, 2) AS last_seen_at,
           CASE WHEN coalesce(c, -1) < o THEN NULL ELSE coalesce(closed, CASE WHEN old.who IS NOT NULL THEN 3 END) END AS closed_at FROM g FULL JOIN old USING (who, "view")""")
def record_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    old = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("who")).distinct().select("who", F.lit("click").alias("view"), *[F.lit(n).cast("long").alias(c) for n, c in ((1, "opened_at"), (2, "last_seen_at"), (3, "closed_at"))])
    action = F.when(F.col("k") % 3 == 0, "open").when(F.col("k") % 3 == 1, "touch").otherwise("close")
    actions = e.filter("k % 10 < 4").select(F.col("user_id").alias("who"), F.col("event_type").alias("view"), action.alias("action"), F.col("observed_at").alias("at"), F.col("event_id").alias("seq"))
    return bookmarks.record_looks(old, actions)


@query(f"""WITH {b.EVENTS}, r AS (SELECT arg_max({{'id': event_id, 'beat': observed_at + k * 1000, 'stop': CASE WHEN k % 2 = 0 THEN observed_at END}}, (observed_at, event_id)) AS x FROM events_)
    SELECT x.id AS run_id, CASE WHEN x.stop IS NOT NULL THEN 'stopped' WHEN (SELECT max(observed_at) + 60000 FROM events_) - x.beat < 30000 THEN 'running' ELSE 'stalled' END AS state, x.beat AS heartbeat_at,
           (SELECT max(observed_at) FROM events_ WHERE k % 8 <> 0) AS data_as_of FROM r""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    runs = e.groupBy(F.col("observed_at").alias("started_at")).agg(F.max_by(F.struct(F.col("event_id").alias("run_id"), (F.col("observed_at") + F.col("k") * 1000).alias("heartbeat_at"), F.when(F.col("k") % 2 == 0, F.col("observed_at")).alias("stopped_at")), "event_id").alias("r")).select("started_at", "r.*")
    return health.pipeline_health(runs, _batches(spark, sf_dir), _newest(e) + 60_000)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir).join(b.events(spark, sf_dir).select(F.col("event_id").alias("observation_id"), "k"), "observation_id")
    return health.batch_status(o.select("source", F.col("observed_at").alias("at"), (F.col("k") % 5).alias("items"), F.when(F.col("k") % 8 == 0, "Timeout").alias("error_kind")))


@query(f"""WITH {b.OBSERVATIONS}, links AS (SELECT DISTINCT s.observation_id FROM obs s JOIN obs p ON s.provider_request_key = p.provider_request_key AND s.source <> p.source WHERE NOT s."primary" AND p."primary"),
    orphan AS (SELECT source, count(*) AS n FROM obs WHERE NOT "primary" AND observation_id NOT IN (SELECT observation_id FROM links) GROUP BY 1)
    SELECT source, max(observed_at) AS last_run_at, max(observed_at) FILTER (WHERE k % 8 <> 0) AS last_success_at, coalesce(any_value(n), 0)::BIGINT AS orphans
    FROM obs JOIN (SELECT event_id AS observation_id, k FROM events_) USING (observation_id) LEFT JOIN orphan USING (source) GROUP BY source""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir)
    return health.source_report(_batches(spark, sf_dir), linking.orphan_counts(o, linking.link_secondary(o))).select("source", "last_run_at", "last_success_at", "orphans")


# -- quality and values ----------------------------------------------------------------------------


@query(f"""WITH {b.EVENTS}, q AS (SELECT *, CASE k % 3 WHEN 0 THEN 'attributed' WHEN 1 THEN 'ambiguous' ELSE 'unattributed' END AS state, CASE WHEN k % 6 < 3 THEN 'a' END AS value, k % 2 = 0 AS listed, k % 5 = 0 AS priced, k % 4 = 0 AS meta, k % 8 < 4 AS named FROM events_)
    SELECT 'attribution' AS rule, count(*) FILTER (WHERE (state = 'attributed') <> (value IS NOT NULL)) AS n FROM q UNION ALL SELECT 'price', count(*) FILTER (WHERE listed = NOT priced) FROM q
    UNION ALL SELECT 'link', count(*) FILTER (WHERE meta <> named) FROM q UNION ALL SELECT 'account key', count(*) FILTER (WHERE k % 7 = 0) FROM q UNION ALL SELECT 'session', count(*) FILTER (WHERE k % 9 = 0) FROM q""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = b.events(spark, sf_dir).select(
        "k", F.when(k % 3 == 0, "attributed").when(k % 3 == 1, "ambiguous").otherwise("unattributed").alias("state"), F.when(k % 6 < 3, "a").alias("value"), F.when(k % 2 == 0, "list_price").otherwise("reported").alias("basis"),
        F.when(k % 5 == 0, "v1").otherwise("").alias("price_version"), F.when(k % 4 == 0, "metadata").otherwise("support").alias("role"), F.when(k % 8 < 4, "model").otherwise("").alias("field"),
        F.when(k % 7 == 0, "no key").otherwise(F.md5(F.col("event_id").cast("string"))).alias("account_key"), F.lit("h").alias("harness"), F.col("event_id").cast("string").alias("session_id"),
        F.when(k % 9 == 0, "g:1").otherwise(F.concat(F.lit("h:"), "event_id")).alias("session_key"))
    rules = {"attribution": quality.attribution_rule(), "price": quality.price_rule(), "link": quality.link_rule(), "session": quality.session_rule(), **quality.key_rules()}
    return quality.violations(rows, rules)


@query(f"""WITH {b.OBSERVATIONS} SELECT count(*) FILTER (WHERE session_key IS NULL) AS session_key, count(*) FILTER (WHERE provider IS NULL) AS provider, count(*) FILTER (WHERE model IS NULL) AS model FROM obs""")
def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_keys(b.observations(spark, sf_dir), ["session_key", "provider", "model"])


@query(f"""WITH {b.EVENTS}, s AS (SELECT *, v * k * 7 AS s FROM events_)
    SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END AS age,
           CASE WHEN k % 3 = 0 THEN 'label' ELSE coalesce(CASE WHEN k % 2 = 0 THEN 'p' || (k % 4) END, 'unknown') || ' account ' || substr(md5(event_id::VARCHAR), 1, 6) END AS account_label,
           substr(sha1(user_id || chr(10) || event_type), 1, 12) AS key_of, CASE event_type WHEN 'click' THEN 'pointer' WHEN 'view' THEN 'screen' END AS family, CASE WHEN k % 4 <> 0 THEN '%' || k END AS pane,
           CASE k % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'weekly' ELSE CASE WHEN k % 2 = 0 THEN 'other:x' ELSE 'other:unstated' END END || CASE WHEN k % 5 = 0 THEN ':big' ELSE '' END AS "window",
           CASE WHEN v = 0 THEN NULL WHEN k % 2 = 0 THEN v * 1000 ELSE v + 100000000000 END AS at, CASE WHEN k % 6 <> 0 THEN user_id || '|' || event_type END AS subject FROM s""")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = b.events(spark, sf_dir), F.col("k")
    label = scalars.account_label(F.when(k % 3 == 0, "label"), F.when(k % 2 == 0, F.concat(F.lit("p"), k % 4)), F.md5(F.col("event_id").cast("string")))
    window = scalars.window_of_limit(F.when(k % 3 == 0, 18_000_000).when(k % 3 == 1, 604_800_000), F.when(k % 2 == 0, "x"), F.when(k % 5 == 0, "BIG").otherwise(""))
    return e.select("event_id", scalars.age_text(F.col("v") * k * 7).alias("age"), label.alias("account_label"), scalars.key_of(F.col("user_id").cast("string"), F.col("event_type")).alias("key_of"),
                    scalars.model_family(F.upper("event_type"), {"pointer": "cl.ck", "screen": "^view$"}).alias("family"), scalars.pane_id(F.concat(F.lit("main:"), F.when(k % 4 != 0, "@3.%").otherwise("3.%"), k)).alias("pane"),
                    window.alias("window"), scalars.epoch_ms(F.when(k % 2 == 0, F.col("v")).otherwise(F.when(F.col("v") > 0, F.col("v") + 100_000_000_000))).alias("at"),
                    scalars.subject_key(F.col("user_id").cast("string"), F.when(k % 6 != 0, F.col("event_type"))).alias("subject"))


@query(f"""WITH {b.EVENTS}, c AS (SELECT user_id % 5 AS team, CASE WHEN event_type = 'signup' THEN 'session' ELSE 'request' END AS scope_kind, k % 40 AS scope_id, user_id AS session_key, CASE WHEN k % 2 = 0 THEN 'list' ELSE 'told' END AS basis,
        event_id AS price_version, CASE WHEN k % 7 <> 0 THEN v END AS cost FROM events_),
    newest AS (SELECT team, scope_kind, scope_id, session_key, basis, arg_max_null(cost, price_version) AS cost FROM c GROUP BY 1, 2, 3, 4, 5),
    kept AS (SELECT * FROM newest WHERE scope_kind = 'request' UNION ALL SELECT * FROM newest WHERE scope_kind = 'session' AND (session_key, basis) NOT IN (SELECT (session_key, basis) FROM newest WHERE scope_kind = 'request'))
    SELECT team, basis, coalesce(sum(cost), 0)::BIGINT AS cost_micro_usd, count(*) FILTER (WHERE cost IS NULL) AS unknown_costs FROM kept GROUP BY 1, 2""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    costs = b.events(spark, sf_dir).select((F.col("user_id") % 5).alias("team"), F.when(F.col("event_type") == "signup", "session").otherwise("request").alias("scope_kind"), (k % 40).alias("scope_id"), F.col("user_id").alias("session_key"),
                                           F.when(k % 2 == 0, "list").otherwise("told").alias("basis"), F.col("event_id").alias("price_version"), F.when(k % 7 != 0, F.col("v")).alias("cost_micro_usd"))
    return trends.cost_rollup(costs, ["team"])


@query(f"WITH {b.EVENTS} SELECT event_id, observed_at FROM events_ WHERE observed_at < (SELECT max(observed_at) FROM events_) - {10 * _DAY}")
def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir).select("event_id", "observed_at")
    return upserts.expired(e, _newest(e), 10)


# -- clocks and screens ----------------------------------------------------------------------------


@query(f"""WITH {b.EVENTS}, c AS (SELECT event_id, observed_at, k, v, timezone('Asia/Tokyo', to_timestamp(observed_at / 1000.0)) AS local, 1 + k % 12 AS h, v % 60 AS m, k % 2 * 12 AS pm FROM events_),
    w AS (SELECT *, (h % 12 + pm) * 60 + CASE WHEN event_id % 4 < 2 THEN m ELSE 0 END AS minutes FROM c),
    t AS (SELECT *, date_trunc('day', local) + to_minutes(minutes) AS today, make_date(2026, 1 + k % 12, 1 + v % 28)::TIMESTAMP + to_minutes(minutes) AS dated FROM w)
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_ms(timezone('Asia/Tokyo', dated)) ELSE epoch_ms(timezone('Asia/Tokyo', CASE WHEN today > local THEN today ELSE today + INTERVAL 1 DAY END)) END AS resets_at FROM t""")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times with minutes, with a date, of whole hours, and texts that are none."""
    e, k = b.events(spark, sf_dir), F.col("k")
    hour, minute, half = (1 + k % 12).cast("string"), F.lpad((F.col("v") % 60).cast("string"), 2, "0"), F.when(k % 2 == 1, "PM").otherwise("AM")
    months = F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")])
    clock = F.concat(hour, F.lit(":"), minute, F.lit(" "), half)
    dated = F.concat(F.element_at(months, (k % 12 + 1).cast("int")), F.lit(" "), 1 + F.col("v") % 28, F.lit(", 2026 "), clock)
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, clock).when(kind == 1, dated).when(kind == 2, F.concat(hour, F.when(k % 2 == 1, " p.m.").otherwise("am"))).otherwise("soon")
    return e.select("event_id", scalars.next_clock_time(text, F.col("observed_at"), "Asia/Tokyo").alias("resets_at"))


#: What stands below a document on each layout's screen: typed text, an empty input line, and so on.
_SCREENS = {
    "ruled": ("\n──────────\n❯ hello\n──────────\n Opus 4.1", "\n──────────\n❯ \n──────────\n Opus 4.1", "\n✻ Pondering… (12s · esc to interrupt)\n──────────\n❯ \n──────────\n Opus 4.1",
              "\nYou've hit your usage limit, resets 3:15pm\n──────────\n❯ \n──────────\n Opus 4.1", "\nYou've hit your usage limit\ncontinuing automatically\n──────────\n❯ \n──────────\n Opus 4.1", "\n❯ "),
    "arrow": ("\n› hello", "\n› ", "\n• Working\n› ", "\nYou've hit your usage limit for m-1. try again at 10:29 PM.\n› ", "\n› ", "\nnothing"),
    "boxed": ("\n╭── π > ◒ Large > x\n│ hello\n╰──", "\n╭── π > ◒ Large > x\n╰──", "\n╭── ✻ > ◒ Large > x\n╰──", "\nError: 429 usage limit retry-after-ms=5000\n╭── π > ◒ Large > x\n╰──", "\n╭── π > ◒ Large > x\n╰──", "\nnothing")}


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS t, doc_id // 6 % 3 AS l FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, CASE t WHEN 0 THEN CASE WHEN doc_id // 18 % 2 = 0 THEN 'idle' ELSE 'typing' END WHEN 1 THEN 'idle' WHEN 2 THEN 'busy' WHEN 3 THEN 'stalled' WHEN 4 THEN CASE l WHEN 0 THEN 'resuming' ELSE 'idle' END ELSE 'unknown' END AS st FROM d),
    r AS (SELECT doc_id, l, CASE WHEN l = 2 AND t = 0 THEN 'typing' ELSE st END AS state FROM s)
    SELECT doc_id, state, CASE WHEN state = 'unknown' THEN NULL WHEN l = 0 THEN 'Opus 4.1' WHEN l = 2 THEN 'Large' WHEN state = 'stalled' THEN 'm-1.' END AS model,
           CASE WHEN state = 'stalled' THEN CASE l WHEN 0 THEN substr(sha1('h0' || chr(10) || 'You''ve hit your usage limit, resets 3:15pm'), 1, 12)
                WHEN 1 THEN substr(sha1('h1' || chr(10) || 'You''ve hit your usage limit for m-1. try again at 10:29 PM.'), 1, 12) ELSE substr(sha1('Error: 429 usage limit retry-after-ms=5000'), 1, 12) END END AS error_key,
           CASE WHEN state = 'stalled' AND l < 2 THEN CASE l WHEN 0 THEN '3:15pm' ELSE '10:29 PM' END END AS reset_text,
           CASE WHEN state = 'stalled' THEN CASE l WHEN 0 THEN 1788275700000 WHEN 1 THEN 1788301740000 END END AS reset_hint, CASE WHEN state = 'stalled' AND l = 2 THEN 5000::BIGINT END AS retry_after_ms FROM r""")
def screen_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a screen whose state is known. On every second screen with typed text under a rule
    or an arrow the text is a dim hint, which counts as nothing typed."""
    number = F.col("doc_id")
    layout = F.element_at(F.array(*[F.lit(name) for name in _SCREENS]), (F.expr("doc_id div 6") % 3 + 1).cast("int"))
    feet = F.create_map(*[x for name, feet in _SCREENS.items() for x in (F.lit(name), F.array(*[F.lit(foot) for foot in feet]))])
    shown = b.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        "doc_id", layout.alias("layout"), F.concat("text", F.element_at(F.element_at(feet, layout), (number % 6 + 1).cast("int"))).alias("plain"),
        F.concat(F.lit("h"), F.expr("doc_id div 6") % 3).alias("program"), F.lit(1_788_220_800_000).alias("taken_at"))
    dim = (number % 6 == 0) & (F.expr("doc_id div 18") % 2 == 0)
    mark = F.when(F.col("layout") == "ruled", "❯").when(F.col("layout") == "arrow", "›")
    shown = shown.withColumn("styled", F.when(dim, F.concat(mark, F.lit(" \x1b[2mhello\x1b[0m"))))
    return screens.classify(shown, harness="program", at="taken_at").select("doc_id", "reading.state", "reading.model", "reading.error_key", "reading.reset_text", "reading.reset_hint", "reading.retry_after_ms")
