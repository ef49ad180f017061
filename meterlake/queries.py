"""Queries over the driver's tables, one for each operator, with the SQL that states the same rows. Those
that write logs and read them back, and those of the rules, stand in modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import bindings as b
from meterlake import file_queries, log_queries, option_queries, rule_queries, telemetry_queries  # noqa: F401  (they register their queries)
from meterlake.functions import scalars, screens
from meterlake.lineage import cut
from meterlake.operators import attribution, counting, identity, linking, measures, paths, quality, sequences, trends, upserts
from meterlake.plans import agents, bookmarks, capacity, health, usage
from meterlake.registry import ORACLES, QUERIES, keyed_hash_sql, query  # noqa: F401
from meterlake.schemas import TOKEN_FIELDS
from meterlake.sources import session_log, transcript

# -- counting ------------------------------------------------------------------------------------


@query(f"""WITH {b.EVENTS}, s AS (
        SELECT user_id || '+' || k AS request_key, v AS output_tokens, event_id AS seq, 's' || (event_id % 9) AS session_key, observed_at FROM events_)
    SELECT request_key, arg_max(output_tokens, (output_tokens, -seq)) AS output_tokens, arg_min(session_key, seq) AS session_key,
           arg_max(observed_at, (output_tokens, -seq)) AS observed_at, count(*) AS snapshots
    FROM s GROUP BY request_key""")
def collapse_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select(F.concat_ws("+", "user_id", "k").alias("request_key"), F.col("v").alias("output_tokens"), F.col("event_id").alias("seq"),
                                          F.concat(F.lit("s"), F.col("event_id") % 9).alias("session_key"), "observed_at")
    return counting.collapse_snapshots(rows, ["request_key"], "output_tokens", "seq", "session_key").drop("seq")


@query(f"""WITH {b.EVENTS}, c AS (
        SELECT user_id AS file, event_id AS line, v AS total, CASE WHEN k % 5 <> 0 THEN v2 END AS part FROM events_ WHERE k % 17 <> 0),
    p AS (SELECT *, lag(total) OVER w AS t0, lag(part) OVER w AS p0, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY file ORDER BY line))
    SELECT file, line, part - CASE WHEN n = 1 THEN 0 ELSE p0 END AS part, total - coalesce(t0, 0) AS total
    FROM p WHERE total <> coalesce(t0, 0) AND NOT coalesce(total < t0, total < 0, false) AND NOT coalesce(part < CASE WHEN n = 1 THEN 0 ELSE p0 END, false)""")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.when(F.col("k") % 5 != 0, F.col("v2")).alias("part"), F.when(F.col("k") % 17 != 0, F.col("v")).alias("total"))
    return counting.counter_delta(rows, "file", "line", ["part"], "total")


@query(f"""WITH {b.CAPACITY}, p AS (
        SELECT *, lag((used_pct, k0)) OVER w AS before FROM (SELECT stream_key, "window", event_id, floor(used_pct / 20)::BIGINT AS used_pct, event_id % 2 AS k0 FROM cap)
        WINDOW w AS (PARTITION BY stream_key, "window" ORDER BY event_id))
    SELECT stream_key, "window", event_id, used_pct, k0 FROM p WHERE before IS NULL OR before IS DISTINCT FROM (used_pct, k0)""")
def emit_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir).select("stream_key", "window", "event_id", F.floor(F.col("used_pct") / 20).cast("long").alias("used_pct"), (F.col("event_id") % 2).alias("k0"))
    return counting.emit_on_change(rows, ["stream_key", "window"], ["event_id"], ["used_pct", "k0"])


@query(f"""WITH {b.EVENTS}
    SELECT event_id, user_id, last_value(CASE WHEN k % 6 = 0 THEN 'm' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS model FROM events_""")
def model_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select("event_id", "user_id", F.when(F.col("k") % 6 == 0, F.concat(F.lit("m"), F.col("k") % 4)).alias("model"))
    return counting.carry_forward(rows, "user_id", "event_id", "model")


@query(f"""WITH {b.EVENTS}
    SELECT event_type, count(*) FILTER (WHERE v = 0) AS empty_values, count(*) FILTER (WHERE k % 17 = 0) AS null_totals FROM events_ GROUP BY event_type""")
def read_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.read_counters(b.events(spark, sf_dir), ["event_type"], empty_values=F.col("v") == 0, null_totals=F.col("k") % 17 == 0)


# -- usage ---------------------------------------------------------------------------------------

_KNOWN = "uncached_input_tokens IS NOT NULL AND cache_read_input_tokens IS NOT NULL AND cache_write_input_tokens IS NOT NULL"
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}, count(*) FILTER (WHERE {c} IS NULL) AS unknown_{c}" for c in TOKEN_FIELDS) + f""",
    coalesce(sum(CASE WHEN {_KNOWN} THEN uncached_input_tokens + cache_read_input_tokens + cache_write_input_tokens END), 0)::BIGINT AS total_input_tokens,
    count(*) FILTER (WHERE NOT ({_KNOWN})) AS unknown_total_input, count(*) FILTER (WHERE NOT ({_KNOWN}) OR output_tokens IS NULL) AS unknown_requests, count(*) AS requests"""
_PRIMARY = f"""{b.OBSERVATIONS}, e AS (SELECT * FROM obs WHERE "primary")"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.observations(spark, sf_dir).filter("primary")


def _grouped_sql(key: str) -> str:
    return f"WITH {_PRIMARY} SELECT {key} AS key, 'value' AS state, coalesce({key}, 'unknown') AS label, {_SUMS} FROM e GROUP BY 1"


@query(_grouped_sql("harness"))
def usage_by_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_events(spark, sf_dir), "harness").rows


@query(_grouped_sql("provider"))
def usage_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_events(spark, sf_dir), "provider").rows


@query(_grouped_sql("model"))
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_events(spark, sf_dir), "model").rows


@query(_grouped_sql("session_key"))
def usage_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_events(spark, sf_dir), "session").rows


@query(f"""WITH {_PRIMARY} SELECT key, 'value' AS state, key AS label, {_SUMS}
    FROM (SELECT strftime(timezone('America/New_York', to_timestamp(observed_at / 1000.0)), '%Y-%m-%d') AS key, * FROM e) GROUP BY key""")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_events(spark, sf_dir), "day", zone="America/New_York").rows


@query(f"WITH {_PRIMARY} SELECT {_SUMS} FROM e WHERE NOT auxiliary AND observed_at >= (SELECT min(observed_at) + 86400000 FROM e) AND observed_at < (SELECT min(observed_at) + 10 * 86400000 FROM e)")
def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    begin = events.agg(F.min("observed_at")).first()[0] or 0
    return usage.usage(events, "model", begin + 86_400_000, begin + 10 * 86_400_000, include_auxiliary=False).total


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose folder is a page's path, of the page whose number the user's is."""
    page = b.page_paths(spark, sf_dir).select(F.col("page_id").alias("_p"), F.col("path").alias("cwd"))
    n = b.table(spark, sf_dir, "pages").count()
    keys = _events(spark, sf_dir).filter("session_key IS NOT NULL").select("session_key", (F.split("session_key", ":")[1].cast("long") % n).alias("_p")).distinct()
    return keys.join(page, "_p").select("session_key", "cwd")


def _checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkouts at the hosts of every second page and at the first folder of every third."""
    p = b.page_paths(spark, sf_dir)
    parts = F.split("path", "/")
    host = p.filter("page_id % 2 = 0").select(F.concat(F.lit("/"), parts[1]).alias("local_path"))
    deep = p.filter("page_id % 3 = 0").select(F.concat_ws("/", F.lit(""), parts[1], parts[2]).alias("local_path"))
    return host.unionByName(deep).distinct().withColumn("display_name", F.lit(None).cast("string"))


_CHECKOUTS = f"""{b.PAGE_PATHS}, checkouts AS (
    SELECT local_path, regexp_extract(local_path, '([^/]+)$', 1) AS display_name FROM (
        SELECT '/' || split_part(path, '/', 2) AS local_path FROM paths WHERE page_id % 2 = 0
        UNION SELECT '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) FROM paths WHERE page_id % 3 = 0))"""
_PROJECTS = f"""{_PRIMARY}, {_CHECKOUTS}, sessions AS (
        SELECT DISTINCT session_key, path AS cwd FROM e JOIN paths ON split_part(session_key, ':', 2)::BIGINT % (SELECT count(*) FROM pages) = page_id WHERE session_key IS NOT NULL),
    project AS (SELECT session_key, arg_max(display_name, length(local_path)) AS project FROM sessions JOIN checkouts ON cwd = local_path OR starts_with(cwd, local_path || '/') GROUP BY 1)"""


@query(f"""WITH {_PROJECTS}
    SELECT project AS key, CASE WHEN project IS NULL THEN 'unattributed' ELSE 'attributed' END AS state, coalesce(project, '(unattributed)') AS label, {_SUMS}
    FROM e LEFT JOIN project USING (session_key) GROUP BY project""")
def usage_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage(_events(spark, sf_dir), "project", sessions=_sessions(spark, sf_dir), checkouts=_checkouts(spark, sf_dir)).rows


_VALID = """(validity <> 'live' OR t BETWEEN first_observed_at AND last_confirmed_at) AND t >= valid_from AND (valid_to IS NULL OR t <= valid_to)"""


def _resolved_sql(dimension: str) -> str:
    """``resolved``: each subject at the first sight of its last evidence."""
    return f"""{b.evidence_sql(dimension)},
    times AS (SELECT subject_id, max(first_observed_at) AS t FROM windows GROUP BY 1),
    valid AS (SELECT * FROM windows JOIN times USING (subject_id) WHERE {_VALID}),
    top AS (SELECT * FROM valid QUALIFY rank = max(rank) OVER (PARTITION BY subject_id)),
    decided AS (SELECT subject_id, count(DISTINCT value) = 1 AS one, min(value) AS value, any_value(confidence) AS confidence,
                       arg_max(evidence_id, (last_confirmed_at, evidence_id)) AS evidence_id FROM top GROUP BY 1),
    resolved AS (SELECT subject_id, CASE WHEN one IS NULL THEN 'unattributed' WHEN one THEN 'attributed' ELSE 'ambiguous' END AS state,
                        CASE WHEN one THEN value END AS value, confidence, CASE WHEN one THEN evidence_id END AS evidence_id
                 FROM times LEFT JOIN decided USING (subject_id))"""


#: ``asked``: each request of an ambiguous session at its own time.
_AT = """valid_then AS (SELECT event_key, w.* FROM e JOIN windows w ON session_key = subject_id
        WHERE CASE WHEN validity = 'live' THEN observed_at BETWEEN first_observed_at AND last_confirmed_at + 120000
                   ELSE observed_at >= valid_from AND (valid_to IS NULL OR observed_at <= valid_to) END),
    top_then AS (SELECT * FROM valid_then QUALIFY rank = max(rank) OVER (PARTITION BY event_key)),
    asked AS (SELECT event_key, CASE WHEN count(DISTINCT value) = 1 THEN 'attributed' ELSE 'ambiguous' END AS state,
                     CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, any_value(confidence) AS confidence FROM top_then GROUP BY 1)"""


def _resolved(spark: SparkSession, sf_dir: str, dimension: str) -> tuple[DataFrame, DataFrame]:
    closed = cut(attribution.evidence_windows(b.evidence(spark, sf_dir, dimension)), "evidence")
    times = closed.groupBy("subject_kind", "subject_id", "dimension").agg(F.max("first_observed_at").alias("subject_time"))
    return closed, attribution.resolve(closed, times)


_BY_ACCOUNT = f"""WITH {_PRIMARY}, {_resolved_sql("account")}, {_AT},
    s AS (SELECT e.*, CASE WHEN r.state = 'ambiguous' THEN coalesce(a.state, 'unattributed') ELSE coalesce(r.state, 'unattributed') END AS state,
                 CASE WHEN r.state = 'ambiguous' THEN a.value ELSE r.value END AS key
          FROM e LEFT JOIN resolved r ON session_key = subject_id LEFT JOIN asked a USING (event_key))"""


@query(f"""{_BY_ACCOUNT} SELECT key, state, CASE WHEN state = 'attributed' THEN key ELSE '(' || state || ')' END AS label, {_SUMS} FROM s GROUP BY key, state""")
def usage_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, resolved = _resolved(spark, sf_dir, "account")
    return usage.usage(_events(spark, sf_dir), "account", effective=resolved, evidence=closed).rows


@query(f"""WITH {_PRIMARY}, {_resolved_sql("branch")},
    s AS (SELECT e.*, coalesce(r.state, 'unattributed') AS state, r.value AS key FROM e LEFT JOIN resolved r ON session_key = subject_id)
    SELECT key, state, CASE WHEN state = 'attributed' THEN key ELSE '(' || state || ')' END AS label, {_SUMS} FROM s GROUP BY key, state""")
def usage_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, resolved = _resolved(spark, sf_dir, "branch")
    return usage.usage(_events(spark, sf_dir), "branch", effective=resolved, evidence=closed).rows


@query(f"""WITH {_PRIMARY}, {_resolved_sql("billing_route")},
    s AS (SELECT e.*, coalesce(r.state, 'unattributed') AS state, r.value AS key FROM e LEFT JOIN resolved r ON session_key = subject_id)
    SELECT key, state, CASE state WHEN 'attributed' THEN key WHEN 'unattributed' THEN 'unknown' ELSE '(' || state || ')' END AS label, {_SUMS} FROM s GROUP BY key, state""")
def usage_by_billing_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, resolved = _resolved(spark, sf_dir, "billing_route")
    return usage.usage(_events(spark, sf_dir), "billing_route", effective=resolved, evidence=closed).rows


@query(f"""WITH {_PRIMARY}, {_resolved_sql("billing_route")},
    c AS (SELECT CASE event_key % 3 WHEN 0 THEN 'actual_billed' WHEN 1 THEN 'harness_estimate' ELSE 'list_price' END AS basis, output_tokens * 15 AS cost, CASE WHEN state = 'attributed' THEN value END AS route FROM e LEFT JOIN resolved ON session_key = subject_id)
    SELECT CASE WHEN basis = 'actual_billed' THEN 'spend' WHEN route = 'api_key' THEN 'estimated bill' WHEN route = 'subscription' THEN 'list-price equivalent' ELSE 'list-price value, billing route unknown' END AS shown_as,
           sum(cost)::BIGINT AS cost_micro_usd, count(*) FILTER (WHERE cost IS NULL) AS unknown_costs FROM c GROUP BY 1""")
def costs_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of requests under the name that their basis and their session's billing route give them."""
    _, resolved = _resolved(spark, sf_dir, "billing_route")
    route = resolved.filter("state = 'attributed'").select(F.col("subject_id").alias("session_key"), F.col("value").alias("route"))
    kind = F.col("event_key") % 3
    costs = _events(spark, sf_dir).join(route, "session_key", "left").withColumn("basis", F.when(kind == 0, "actual_billed").when(kind == 1, "harness_estimate").otherwise("list_price"))
    return costs.groupBy(trends.shown_as(F.col("basis"), F.col("route")).alias("shown_as")).agg(F.sum(F.col("output_tokens") * 15).alias("cost_micro_usd"), F.count_if(F.col("output_tokens").isNull()).alias("unknown_costs"))


@query(f"""{_BY_ACCOUNT} SELECT round(count(*) FILTER (WHERE state = 'attributed') / count(*), 9) AS attributed, round(count(*) FILTER (WHERE state = 'ambiguous') / count(*), 9) AS ambiguous,
    round(count(*) FILTER (WHERE state = 'unattributed') / count(*), 9) AS unattributed FROM s""")
def usage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, resolved = _resolved(spark, sf_dir, "account")
    shares = usage.usage(_events(spark, sf_dir), "account", effective=resolved, evidence=closed).shares
    return shares.select(*[F.round(c, 9).alias(c) for c in shares.columns])


@query(f"WITH {_PRIMARY} SELECT model, coalesce(sum(cache_write_input_tokens), 0)::BIGINT AS cache_write_input_tokens, count(*) FILTER (WHERE cache_write_input_tokens IS NULL) AS unknown_cache_write_input_tokens, bool_and(cache_write_input_tokens IS NOT NULL) AS complete FROM e GROUP BY model")
def partial_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("model").agg(*measures.partial_sum("cache_write_input_tokens"))


# -- reconciliation ------------------------------------------------------------------------------

_LINKS = f"""{b.OBSERVATIONS}, links AS (
    SELECT s.observation_id, min(p.event_key) AS event_key FROM obs s JOIN obs p ON s.provider_request_key = p.provider_request_key AND s.source <> p.source
    WHERE NOT s."primary" AND p."primary" GROUP BY 1)"""


@query(f"WITH {_LINKS} SELECT observation_id, event_key FROM links")
def link_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_secondary(b.observations(spark, sf_dir))


_DIFFS = ", ".join(f"nullif(max(abs(s.{c} - p.{c})), 0) AS {c}" for c in TOKEN_FIELDS)


@query(f"""WITH {_LINKS}, d AS (SELECT l.event_key, {_DIFFS} FROM links l JOIN obs s USING (observation_id) JOIN obs p ON p.event_key = l.event_key AND p."primary" GROUP BY 1)
    SELECT * FROM d WHERE coalesce({", ".join(TOKEN_FIELDS)}) IS NOT NULL""")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir)
    return linking.disagreement(o, linking.link_secondary(o))


@query(f"""WITH {_LINKS} SELECT source, count(*) AS orphans FROM obs WHERE NOT "primary" AND observation_id NOT IN (SELECT observation_id FROM links) GROUP BY source""")
def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir)
    return linking.orphan_counts(o, linking.link_secondary(o))


@query(f"""WITH {_LINKS} SELECT observation_id, CASE WHEN "primary" THEN 'primary' WHEN l.event_key IS NOT NULL THEN 'linked' ELSE 'orphan' END AS link_state
    FROM obs LEFT JOIN links l USING (observation_id)""")
def link_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir)
    return linking.link_state(o, linking.link_secondary(o))


@query(f"""WITH {_LINKS} SELECT p.source AS counted_source, s.source AS supporting_source, count(*) AS links, count(*) FILTER (WHERE s.output_tokens <> p.output_tokens) AS differing
    FROM links l JOIN obs s USING (observation_id) JOIN obs p ON p.event_key = l.event_key AND p."primary" GROUP BY 1, 2""")
def disagreement_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.observations(spark, sf_dir)
    return linking.disagreement_by_pair(o, linking.link_secondary(o))


@query(f"""WITH {b.OBSERVATIONS} SELECT source, count(DISTINCT provider_request_key) AS uncovered FROM obs
    WHERE NOT "primary" AND provider_request_key NOT IN (SELECT provider_request_key FROM obs WHERE "primary") GROUP BY source""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.coverage_gaps(b.observations(spark, sf_dir))


# -- attribution ---------------------------------------------------------------------------------


@query(f"WITH {b.EVENTS}, {b.evidence_sql()} SELECT subject_id, method, value, evidence_id, valid_from, valid_to, first_observed_at, last_confirmed_at FROM windows")
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.evidence_windows(b.evidence(spark, sf_dir)).select("subject_id", "method", "value", "evidence_id", "valid_from", "valid_to", "first_observed_at", "last_confirmed_at")


@query(f"WITH {b.EVENTS}, {_resolved_sql('account')} SELECT subject_id, state, value, confidence, evidence_id FROM resolved")
def resolve_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "account")[1].select("subject_id", "state", "value", "confidence", "evidence_id")


@query(f"""WITH {_PRIMARY}, {b.evidence_sql()}, {_AT}
    SELECT e.event_key, e.session_key, coalesce(a.state, 'unattributed') AS state, a.value, a.confidence FROM e LEFT JOIN asked a USING (event_key)""")
def account_at_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.account_at(_events(spark, sf_dir), attribution.evidence_windows(b.evidence(spark, sf_dir)))


# -- identity ------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {b.ROOTS} SELECT node, root FROM roots")
def canonical_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_accounts(b.merges(spark, sf_dir))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    return o.select(F.lit("mail").alias("alias_kind"), (F.col("o_orderkey") % 400).cast("string").alias("alias_hash"), F.col("o_custkey").cast("long").alias("account_key"),
                    F.when(F.col("o_orderkey") % 5 == 0, "login").otherwise("reported").alias("asserted_by"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).cast("long").alias("revoked_at"))


_ALIASES = f"""{b.ROOTS}, aliases AS (
    SELECT 'mail' AS alias_kind, (o_orderkey % 400)::VARCHAR AS alias_hash, o_custkey::BIGINT AS account_key, CASE WHEN o_orderkey % 5 = 0 THEN 'login' ELSE 'reported' END AS asserted_by,
           CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS revoked_at FROM orders),
    known AS (SELECT aliases.*, coalesce(root, account_key) AS account FROM aliases LEFT JOIN roots ON account_key = node WHERE revoked_at IS NULL)"""


@query(f"""WITH RECURSIVE {_ALIASES} SELECT alias_kind, alias_hash, string_agg(DISTINCT account::VARCHAR, ',' ORDER BY account::VARCHAR) AS accounts, count(DISTINCT account) AS n
    FROM known WHERE asserted_by = 'reported' GROUP BY 1, 2 HAVING count(DISTINCT account) > 1""")
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.alias_conflicts(_aliases(spark, sf_dir), identity.canonical_accounts(b.merges(spark, sf_dir)))
    return found.select("alias_kind", "alias_hash", F.array_join(F.sort_array(F.col("accounts").cast("array<string>")), ",").alias("accounts"), F.size("accounts").cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_ALIASES}, first AS (SELECT alias_kind, alias_hash, min(account) AS into_key FROM known GROUP BY 1, 2)
    SELECT account AS from_key, into_key, count(DISTINCT (alias_kind, alias_hash)) AS shared_aliases FROM known JOIN first USING (alias_kind, alias_hash) WHERE account <> into_key GROUP BY 1, 2""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.merge_candidates(_aliases(spark, sf_dir), identity.canonical_accounts(b.merges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {b.ROOTS}, links AS (SELECT o_custkey::BIGINT AS a, (o_orderkey % 500)::BIGINT AS b FROM orders WHERE o_orderkey % 4 = 0),
    pairs AS (SELECT coalesce(x.root, a) AS x, coalesce(y.root, b) AS y FROM links LEFT JOIN roots x ON a = x.node LEFT JOIN roots y ON b = y.node),
    refused AS (SELECT from_key, into_key FROM merges WHERE revoked_at IS NOT NULL),
    edge AS (SELECT DISTINCT greatest(x, y) AS x, least(x, y) AS y FROM pairs WHERE x <> y AND (greatest(x, y), least(x, y)) NOT IN (SELECT (from_key, into_key) FROM refused)),
    both_ AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
    reach(node, o) AS (SELECT x, x FROM both_ UNION SELECT reach.node, both_.y FROM reach JOIN both_ ON reach.o = both_.x)
    SELECT node AS from_key, min(o) AS into_key FROM reach GROUP BY node HAVING node <> min(o) AND (node, min(o)) NOT IN (SELECT (from_key, into_key) FROM refused)""")
def merges_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = b.merges(spark, sf_dir)
    links = b.table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") % 500).cast("long").alias("b"))
    return identity.merges_of_links(links, identity.canonical_accounts(merges), merges.filter("revoked_at IS NOT NULL"))


# -- capacity, agents, alerts --------------------------------------------------------------------


def _now(rows: DataFrame) -> int:
    """The newest time of a table: one number."""
    return rows.agg(F.max("observed_at")).first()[0] or 0


def _labelled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Attribution of samples: every second stream to one of five accounts, every seventh ambiguous."""
    s = F.col("stream_key").cast("long")
    return rows.select("source", "stream_key", "window", "observed_at", F.when(s % 7 == 0, "ambiguous").when(s % 2 == 0, "attributed").otherwise("unattributed").alias("state"), F.when((s % 2 == 0) & (s % 7 != 0), F.concat(F.lit("acct"), s % 5)).alias("value")).distinct()


_LABELLED = """lab AS (SELECT *, CASE WHEN stream_key::BIGINT % 7 = 0 THEN 'ambiguous' WHEN stream_key::BIGINT % 2 = 0 THEN 'attributed' ELSE 'unattributed' END AS account_state,
    CASE WHEN stream_key::BIGINT % 2 = 0 AND stream_key::BIGINT % 7 <> 0 THEN 'acct' || (stream_key::BIGINT % 5) END AS account FROM cap)"""


@query(f"""WITH {b.CAPACITY}, {_LABELLED}, newest AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY source, stream_key, "window" ORDER BY observed_at DESC, event_id DESC) = 1),
    best AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY coalesce(account, ''), CASE WHEN account IS NULL THEN source ELSE '' END, "window" ORDER BY observed_at DESC, source DESC, stream_key DESC) = 1)
    SELECT account, account_state, "window", used_pct, round(100 - used_pct, 2) AS remaining_pct, resets_at, source, observed_at,
           (SELECT max(observed_at) FROM cap) - observed_at > CASE WHEN source = 'src0' THEN 3600000 ELSE 900000 END AS stale
    FROM best""")
def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir)
    # Equal times of a series are told apart by the event, as a store's row order would.
    rows = rows.groupBy("source", "stream_key", "window", "observed_at").agg(F.max_by(F.struct("used_pct", "resets_at", "status", "confidence"), "event_id").alias("_v")).select("source", "stream_key", "window", "observed_at", "_v.*")
    found = capacity.pools(rows, _now(rows), _labelled(spark, sf_dir, rows), ages={"src0": 3_600_000})
    return found.select("account", "account_state", "window", "used_pct", "remaining_pct", "resets_at", "source", "observed_at", "stale")


@query(f"""WITH {b.CAPACITY}, {_LABELLED}, t AS (SELECT max(observed_at) AS now FROM cap)
    SELECT event_id, account, account_state, "window", 100 - used_pct AS remaining_pct, resets_at > now AS "current", source <> 'src2' AND now - observed_at <= 86400000 AS fresh
    FROM lab, t WHERE observed_at >= now - 5 * 86400000""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir)
    now = _now(rows)
    found = capacity.anchors(rows, now, now - 5 * 86_400_000, _labelled(spark, sf_dir, rows), {"src0": 86_400_000, "src1": 86_400_000})
    return found.select("event_id", "account", "account_state", "window", "remaining_pct", "current", "fresh")


@query(f"""WITH {b.CAPACITY}, {_LABELLED}, t AS (SELECT max(observed_at) AS now FROM cap),
    newest AS (SELECT lab.*, now FROM lab, t WHERE account IS NOT NULL AND now - observed_at <= 30 * 86400000::BIGINT
               QUALIFY row_number() OVER (PARTITION BY account, "window" ORDER BY observed_at DESC, source DESC, stream_key DESC) = 1)
    SELECT account, "window", min(threshold)::INTEGER AS threshold, any_value(100 - used_pct) AS remaining_pct FROM newest, unnest([60, 90, 99]) AS x(threshold)
    WHERE 100 - used_pct <= threshold AND resets_at > now GROUP BY 1, 2""")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir)
    now, day = _now(rows), 86_400_000
    found = capacity.anchors(rows, now, now - 30 * day, _labelled(spark, sf_dir, rows), {f"src{i}": 30 * day for i in range(3)})
    return capacity.threshold_alerts(found, now, (60, 90, 99))[0].select("account", "window", "threshold", "remaining_pct")


@query(f"""WITH {b.STATES}, t AS (SELECT max(observed_at) AS now FROM st)
    SELECT pane, observed_at, state, session_key, error_key, round((now - observed_at) / 1000, 1) AS age_s FROM st, t WHERE observed_at >= now - 3 * 86400000
    QUALIFY row_number() OVER (PARTITION BY pane ORDER BY observed_at DESC, seq DESC) = 1""")
def latest_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.states(spark, sf_dir)
    return agents.agents(rows, _now(rows), window_ms=3 * 86_400_000).select("pane", "observed_at", "state", "session_key", "error_key", "age_s")


@query(f"""WITH {b.STATES}, g AS (SELECT *, pass_no - lag(pass_no) OVER (PARTITION BY pane ORDER BY observed_at, seq) > 1 AS gone FROM st),
    p AS (SELECT *, count(*) FILTER (WHERE gone) OVER (PARTITION BY pane ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING) AS presence FROM g),
    k AS (SELECT *, lag((state, error_key, pane_pid, presence)) OVER w AS before FROM p WHERE state <> 'unknown' WINDOW w AS (PARTITION BY pane ORDER BY observed_at, seq)),
    i AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR before IS DISTINCT FROM (state, error_key, pane_pid, presence)) OVER (PARTITION BY pane ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING) AS island FROM k)
    SELECT pane, min(observed_at) AS onset, max(observed_at) AS last_seen, any_value(error_key) AS error_key, any_value(pane_pid) AS pane_pid,
           coalesce(arg_min_null(reset_hint, (observed_at, seq)), min(observed_at) + arg_min(retry_after_ms, (observed_at, seq))) AS resets_at, count(*) AS samples
    FROM i WHERE state = 'stalled' GROUP BY pane, island""")
def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.stalls(b.states(spark, sf_dir), pass_no="pass_no")


@query(f"""WITH {b.EVENTS}, p AS (SELECT *, lag(v % 3) OVER (PARTITION BY user_id ORDER BY observed_at, event_id) AS before FROM events_ WHERE k % 4 <> 0)
    SELECT user_id, 'b' || (v % 3) AS branch, CASE WHEN before IS NULL THEN 0 ELSE observed_at END AS valid_from FROM p WHERE before IS NULL OR before <> v % 3""")
def branch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).withColumn("branch", F.when(F.col("k") % 4 != 0, F.concat(F.lit("b"), F.col("v") % 3)))
    return sequences.change_points(rows, ["user_id"], ["observed_at", "event_id"], "branch", first_from_zero=True)


@query(f"""WITH {b.EVENTS}, m AS (SELECT *, 'a' || (k % 2) AS account FROM events_ WHERE k % 6 < 4),
    p AS (SELECT *, lag(account) OVER (PARTITION BY user_id ORDER BY observed_at, event_id) AS before FROM m)
    SELECT user_id, account, observed_at AS valid_from FROM p WHERE before IS NULL OR before <> account""")
def login_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).withColumn("credential_id", F.col("k") % 6)
    lookup = rows.select("credential_id").distinct().filter("credential_id < 4").withColumn("account", F.concat(F.lit("a"), F.col("credential_id") % 2))
    return sequences.login_switches(rows, lookup, ["user_id"], ["observed_at", "event_id"])


@query(f"""WITH {b.EVENTS}, s AS (SELECT user_id, k % 2 AS pane, observed_at // 86400000 AS pass_no, min(observed_at) AS lo, max(observed_at) AS hi FROM events_ GROUP BY 1, 2, 3),
    i AS (SELECT *, pass_no - row_number() OVER (PARTITION BY user_id, pane ORDER BY pass_no) AS island FROM s)
    SELECT user_id, pane, min(lo) AS first_observed_at, max(hi) AS last_confirmed_at, count(*) AS passes FROM i GROUP BY user_id, pane, island""")
def pairing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select("user_id", (F.col("k") % 2).alias("pane"), F.expr("observed_at div 86400000").alias("pass_no"), "observed_at")
    return sequences.sighting_windows(rows, ["user_id", "pane"])


@query(f"""WITH {b.EVENTS}, s AS (SELECT event_type, observed_at AS "at", 1 AS step FROM events_ UNION ALL SELECT event_type, observed_at + v * 60000, -1 FROM events_),
    n AS (SELECT *, sum(step) OVER (PARTITION BY event_type ORDER BY "at", step DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM s)
    SELECT event_type, max(n) AS peak, arg_min("at", (-n, "at")) AS "at" FROM n GROUP BY event_type""")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select("event_type", F.col("observed_at").alias("lo"), (F.col("observed_at") + F.col("v") * 60_000).alias("hi"))
    return sequences.peak_concurrency(rows, ["event_type"], "lo", "hi")


@query(f"""WITH {b.EVENTS}, logins AS (
        SELECT user_id % 10 AS state_file, observed_at, arg_max(CASE WHEN k % 7 <> 0 THEN 'a' || (k % 3) ELSE '' END, event_id) AS account FROM events_ WHERE event_type = 'click' GROUP BY 1, 2),
    seen AS (SELECT DISTINCT user_id % 10 AS state_file, 's:' || user_id AS session_key, observed_at FROM events_ WHERE event_type <> 'click'),
    told AS (SELECT s.session_key, s.observed_at, l.account AS value FROM seen s ASOF JOIN logins l ON s.state_file = l.state_file AND s.observed_at >= l.observed_at),
    t AS (SELECT *, lag(value) OVER (PARTITION BY session_key ORDER BY observed_at, value) AS before FROM told WHERE value <> ''),
    r AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR before <> value) OVER (PARTITION BY session_key ORDER BY observed_at, value ROWS UNBOUNDED PRECEDING) AS run FROM t)
    SELECT session_key AS subject_id, value, 'inferred' AS confidence, 'live' AS validity, min(observed_at) AS valid_from, max(observed_at) AS last_confirmed_at FROM r GROUP BY session_key, run, value""")
def login_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir).withColumn("state_file", F.col("user_id") % 10)
    logins = e.filter("event_type = 'click'").groupBy("state_file", "observed_at").agg(F.max_by(F.struct(F.when(F.col("k") % 7 != 0, F.concat(F.lit("a"), F.col("k") % 3)).alias("account")), "event_id").alias("_l"))
    seen = e.filter("event_type <> 'click'").select("state_file", F.concat(F.lit("s:"), "user_id").alias("session_key"), "observed_at").distinct()
    found = sequences.login_evidence(seen, logins.select("state_file", "observed_at", "_l.account"))
    return found.select("subject_id", "value", "confidence", "validity", "valid_from", "last_confirmed_at")


# -- paths and text ------------------------------------------------------------------------------


@query(f"""WITH {_CHECKOUTS}
    SELECT page_id, arg_max(display_name, length(local_path)) AS project FROM paths LEFT JOIN checkouts ON path = local_path OR starts_with(path, local_path || '/') GROUP BY page_id""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.longest_prefix(b.page_paths(spark, sf_dir), "path", ["page_id"], _checkouts(spark, sf_dir))


@query(f"""WITH {b.PAGE_PATHS}, n AS (SELECT page_id, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM paths)
    SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY parts[-1]) > 1 THEN array_to_string(parts[-2:], '/') ELSE parts[-1] END AS display_name FROM n""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.display_names(b.page_paths(spark, sf_dir), "page_id", "path")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#]*@)?([^:/?#]*)', 1) || '/' || trim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/')) AS remote FROM pages
    WHERE trim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') <> ''""")
def normalise_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", scalars.normalise_remote(F.col("url")).alias("remote")).filter("remote IS NOT NULL")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '"request_id":"[^"]+"', '"request_id":"req_REDACTED"', 'g'), '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+', 'user@example.com', 'g') AS text FROM documents""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", scalars.redact(F.col("text")).alias("text"))


@query(f"""WITH {b.EVENTS} SELECT user_id, event_id, k % 3 = 0 AS is_worktree,
    CASE WHEN k % 3 = 0 THEN 'lane' WHEN bool_or(k % 3 = 0) OVER (PARTITION BY user_id) THEN 'orchestrator' ELSE 'standalone' END AS role FROM events_""")
def member_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.roles(b.events(spark, sf_dir).select("user_id", "event_id", (F.col("k") % 3 == 0).alias("is_worktree")), "user_id")


# -- writes, quality, trends ---------------------------------------------------------------------


@query(f"""WITH {b.EVENTS}, rows_ AS (
        SELECT user_id, -1 AS seq, 'old' AS name, 0::BIGINT AS live, 7::BIGINT AS amount FROM (SELECT DISTINCT user_id FROM events_ WHERE user_id % 2 = 0)
        UNION ALL SELECT user_id, event_id, CASE WHEN k % 3 = 0 THEN event_type END, CASE WHEN k % 2 = 0 THEN v END, CASE WHEN k % 50 = 1 THEN v END FROM events_)
    SELECT user_id, arg_max(name, seq) AS name, arg_max_null(live, seq) AS live, arg_max(amount, seq) AS amount FROM rows_ GROUP BY user_id""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    old = e.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit("old").alias("name"), F.lit(0).cast("long").alias("live"), F.lit(7).cast("long").alias("amount"))
    new = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("k") % 3 == 0, F.col("event_type")).alias("name"), F.when(F.col("k") % 2 == 0, F.col("v")).alias("live"), F.when(F.col("k") % 50 == 1, F.col("v")).alias("amount"))
    return upserts.upsert_coalesce(old, new, ["user_id"], always=("live",))


@query(f"""WITH {b.EVENTS} SELECT user_id, k, max(v2) AS output_tokens, arg_min(event_type, (-v2, event_id % 2, event_id)) AS event_type FROM events_ GROUP BY user_id, k""")
def upsert_max_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events, then odd ones: of equal outputs the stored row stays, then the earlier one."""
    e = b.events(spark, sf_dir).select("user_id", "k", F.col("event_id").alias("seq"), F.col("v2").alias("output_tokens"), "event_type")
    old = upserts.upsert_by_rule(e.drop("seq").limit(0), e.filter("seq % 2 = 0"), ["user_id", "k"], "max_output")
    return upserts.upsert_by_rule(old, e.filter("seq % 2 = 1"), ["user_id", "k"], "max_output")


@query(f"WITH {b.EVENTS} SELECT event_id AS run_id, observed_at AS started_at FROM events_ ORDER BY observed_at DESC, event_id DESC LIMIT 20")
def keep_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = b.events(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.col("observed_at").alias("started_at"))
    return upserts.keep_last_runs(runs, 20)


@query(f"""WITH {b.CAPACITY}, t AS (SELECT max(observed_at) - 10 * 86400000 AS cutoff FROM cap)
    SELECT source, stream_key, "window", observed_at, event_id FROM cap, t WHERE observed_at >= cutoff
    UNION ALL SELECT source, stream_key, "window", max(observed_at), arg_max(event_id, (observed_at, event_id)) FROM cap, t WHERE observed_at < cutoff GROUP BY 1, 2, 3, observed_at // 3600000""")
def thin_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir).groupBy("source", "stream_key", "window", "observed_at").agg(F.max("event_id").alias("event_id"), F.sort_array(F.collect_list("event_id")).alias("all"))
    now = _now(rows)
    kept = upserts.thin_capacity(rows, now, 10 * 86_400_000)
    recent = kept.filter(F.col("observed_at") >= now - 10 * 86_400_000).select("source", "stream_key", "window", "observed_at", F.explode("all").alias("event_id"))
    return recent.unionByName(kept.filter(F.col("observed_at") < now - 10 * 86_400_000).drop("all"))


@query(f"""WITH {b.EVENTS} SELECT user_id AS who, event_type AS view, coalesce(max(CASE WHEN k % 9 = 0 THEN observed_at END), max(CASE WHEN k % 2 = 0 THEN observed_at END), min(observed_at)) AS since_ms,
    CASE WHEN count(*) FILTER (WHERE k % 9 = 0) > 0 THEN 'closed' WHEN count(*) FILTER (WHERE k % 2 = 0) > 0 THEN 'last_seen' ELSE 'opened' END AS basis, count(*) FILTER (WHERE k % 9 = 0) = 0 AS assumed FROM events_ GROUP BY 1, 2""")
def since_last_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = b.events(spark, sf_dir).groupBy(F.col("user_id").alias("who"), F.col("event_type").alias("view")).agg(
        F.min("observed_at").alias("opened_at"), F.max(F.when(F.col("k") % 2 == 0, F.col("observed_at"))).alias("last_seen_at"), F.max(F.when(F.col("k") % 9 == 0, F.col("observed_at"))).alias("closed_at"))
    return bookmarks.since_last_look(looks)


@query(f"""WITH {b.CAPACITY} SELECT 'used_pct out of range' AS rule, count(*) FILTER (WHERE used_pct - 1 NOT BETWEEN 0 AND 100) AS n FROM cap
    UNION ALL SELECT 'window name', count(*) FILTER (WHERE NOT regexp_matches("window", '^(session|weekly|weekly:.+|other:.+)$')) FROM cap
    UNION ALL SELECT 'unknown source', count(*) FILTER (WHERE source NOT IN ('src0', 'src1')) FROM cap""")
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir).withColumn("used_pct", F.col("used_pct") - 1)
    return quality.violations(rows, {**quality.capacity_rules(), "unknown source": quality.not_in("source", ("src0", "src1"))})


@query(f"""WITH {b.EVENTS} SELECT user_id, k, count(*) AS n FROM events_ GROUP BY user_id, k HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(b.events(spark, sf_dir), ["user_id", "k"])


@query(f"""WITH {_PRIMARY}, part AS (SELECT {_SUMS} FROM e WHERE model <> 'm1'), whole AS (SELECT {_SUMS} FROM e)
    SELECT measure, p AS rows_sum, w AS total FROM (UNPIVOT part ON COLUMNS(*) INTO NAME measure VALUE p) JOIN (UNPIVOT whole ON COLUMNS(*) INTO NAME measure VALUE w) USING (measure) WHERE p <> w""")
def usage_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by model that lacks a group: every measure that then falls short of the total."""
    found = usage.usage(_events(spark, sf_dir), "model")
    return quality.usage_invariants(found.rows.filter("key <> 'm1'"), found.total)


@query(f"WITH {_PRIMARY} SELECT 'reasoning above output' AS rule, count(*) FILTER (WHERE reasoning_output_tokens > output_tokens) AS n FROM e")
def usage_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(_events(spark, sf_dir), quality.usage_rules())


@query(f"""WITH {_LINKS} SELECT p.event_key, count(DISTINCT s.source) AS n FROM links l JOIN obs s USING (observation_id) JOIN obs p ON p.event_key = l.event_key AND p."primary" GROUP BY 1 HAVING count(DISTINCT s.source) > 1
    UNION ALL SELECT k % 50, count(DISTINCT source) FROM obs JOIN (SELECT event_id, k FROM events_) ON event_id = observation_id WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def several_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that observations of several sources support, and made-up fields that several sources give."""
    o = b.observations(spark, sf_dir)
    links = linking.link_secondary(o).join(o.select("observation_id", "source"), "observation_id")
    fields = o.join(b.events(spark, sf_dir).select(F.col("event_id").alias("observation_id"), "k"), "observation_id").filter("k IS NOT NULL").select((F.col("k") % 50).alias("event_key"), "source")
    return quality.several(links, ["event_key"], "source").unionByName(quality.several(fields, ["event_key"], "source"))


@query(f"""WITH {_PRIMARY}, prices(model, a, r, w, o) AS (VALUES ('m0', 3000, 300, 3750, 15000), ('m1', 800, 80, 1000, 4000), ('m2', 15000, 1500, 18750, 75000))
    SELECT event_key, model, floor((uncached_input_tokens * a + cache_read_input_tokens * r + CASE WHEN cache_write_input_tokens = 0 THEN 0 ELSE cache_write_input_tokens * w END + output_tokens * o + 500000) / 1000000)::BIGINT AS cost_micro_usd
    FROM e LEFT JOIN prices USING (model)""")
def list_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit("v1").alias("price_version"), F.lit(a).alias("input"), F.lit(r).alias("cache_read"), F.lit(w).alias("cache_write"), F.lit(o).alias("output"))
                                                      for m, a, r, w, o in (("m0", 3000, 300, 3750, 15000), ("m1", 800, 80, 1000, 4000), ("m2", 15000, 1500, 18750, 75000))])))
    return trends.list_price(_events(spark, sf_dir), prices).select("event_key", "model", "cost_micro_usd")


@query(f"""WITH {b.CAPACITY}, r AS (SELECT *, used_pct - lag(used_pct) OVER w AS used, observed_at - lag(observed_at) OVER w AS ms, observed_at // 259200000 = lag(observed_at // 259200000) OVER w AS same FROM (SELECT * FROM cap QUALIFY count(*) OVER (PARTITION BY stream_key, "window", observed_at) = 1)
        WINDOW w AS (PARTITION BY stream_key, "window" ORDER BY observed_at))
    SELECT event_id, round(CASE WHEN same AND used >= 0 AND ms > 0 THEN used * 3600000 / ms END, 6) AS pct_per_hour FROM r""")
def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir).withColumn("resets_at", F.expr("observed_at div 259200000"))  # an instance of three days
    alone = rows.groupBy("stream_key", "window", "observed_at").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return trends.burn_rate(rows.join(alone, ["stream_key", "window", "observed_at"]), ["stream_key", "window"]).select("event_id", F.round("pct_per_hour", 6).alias("pct_per_hour"))


@query(f"""WITH {b.CAPACITY}, d AS (SELECT stream_key, "window", used_pct - min(used_pct) OVER (PARTITION BY stream_key, "window", observed_at // 259200000 ORDER BY observed_at RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW) AS d FROM cap)
    SELECT stream_key, "window", max(d) AS largest_drop FROM d GROUP BY 1, 2""")
def largest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.capacity(spark, sf_dir).withColumn("resets_at", F.expr("observed_at div 259200000"))
    return trends.largest_drop(rows, ["stream_key", "window"], 7_200_000)


@query(f"""WITH {b.EVENTS} SELECT event_type AS source, max(observed_at) AS last_run_at, max(CASE WHEN k % 8 <> 0 THEN observed_at END) AS last_success_at,
    max(CASE WHEN k % 8 <> 0 AND k % 5 > 0 THEN observed_at END) AS last_new_data_at FROM events_ GROUP BY event_type""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("observed_at").alias("at"), (F.col("k") % 5).alias("items"), F.when(F.col("k") % 8 == 0, "Timeout").alias("error_kind"))
    return health.batch_status(rows).drop("error_kind")


# -- logs written and read back ------------------------------------------------------------------


def _at(turn) -> object:
    return F.concat(F.lit("2026-09-01T00:00:"), F.lpad((turn % 60).cast("string"), 2, "0"), F.lit("Z"))


@query("""WITH c AS (SELECT conv_id, turn, conv_id || '-' || (turn // 2) AS id, length(text) % 1000 AS output FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
    SELECT id || '+' AS source_request_key, 'h:c' || any_value(conv_id) AS session_key, max(output)::BIGINT AS output_tokens, any_value(conv_id)::BIGINT AS uncached_input_tokens,
           1788220800000 + arg_min(turn % 60, (-output, turn)) * 1000 AS observed_at FROM c GROUP BY id""")
def parse_roundtrip_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    usage_ = F.struct(F.col("conv_id").alias("input_tokens"), (F.length("text") % 1000).alias("output_tokens"))
    message = F.struct(F.concat_ws("-", "conv_id", F.expr("turn div 2")).alias("id"), F.lit("m").alias("model"), usage_.alias("usage"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), _at(F.col("turn")).alias("timestamp"), message.alias("message")))
    lines = c.select(line.alias("value"), F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"))
    found = transcript.observations(transcript.parsed(cut(lines, "log-lines")), "log", "h", "p", b"0123456789abcdef")
    return found.select("source_request_key", "session_key", "output_tokens", "uncached_input_tokens", "observed_at")


@query("""SELECT CASE WHEN turn % 3 = 0 THEN 'aux:' ELSE '' END || conv_id || '-' || turn AS source_request_key, 'h:c' || conv_id AS session_key, turn % 3 = 0 AS auxiliary, (length(text) % 1000)::BIGINT AS output_tokens,
           CASE WHEN turn % 2 = 0 THEN turn::BIGINT END AS cache_read_input_tokens, 1788220800000 + (turn % 60) * 1000 AS observed_at FROM conversations WHERE role = 'assistant' AND text IS NOT NULL""")
def parse_roundtrip_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role = 'assistant'")
    usage_ = F.struct((F.length("text") % 1000).alias("output"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("cacheRead"))
    own, at, file = F.concat_ws("-", "conv_id", "turn"), _at(F.col("turn")), F.concat(F.lit("/logs/"), "conv_id", F.lit(".jsonl"))
    message = F.struct(F.lit("message").alias("type"), own.alias("id"), at.alias("timestamp"), F.struct(F.lit("assistant").alias("role"), F.lit("m").alias("model"), usage_.alias("usage"), F.col("text").alias("content")).alias("message"))
    call = F.struct(F.lit("model_usage").alias("type"), own.alias("id"), at.alias("timestamp"), F.lit("m").alias("model"), usage_.alias("usage"))
    lines = c.select(F.when(F.col("turn") % 3 == 0, F.to_json(call)).otherwise(F.to_json(message)).alias("value"), file.alias("file"), (F.col("turn") + 1).alias("line"))
    header = F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("c"), "conv_id").alias("id")))
    heads = c.select("conv_id").distinct().select(header.alias("value"), file.alias("file"), F.lit(0).cast("long").alias("line"))
    rows = transcript.parsed(cut(lines.unionByName(heads), "log-lines"), session_log.MUST_HOLD)
    return session_log.observations(rows, "log", "h").select("source_request_key", "session_key", "auxiliary", "output_tokens", "cache_read_input_tokens", "observed_at")


# -- hashing and screens -------------------------------------------------------------------------


@query(f"""WITH {b.OBSERVATIONS} SELECT observation_id, {keyed_hash_sql(b"0123456789abcdef0123456789abcdef", "request:p", "provider_request_key")} AS request_hash FROM obs""")
def keyed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.observations(spark, sf_dir).select("observation_id", scalars.keyed_hash(b"0123456789abcdef0123456789abcdef", "request:p", F.col("provider_request_key")).alias("request_hash"))


@query()
def classify_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shown as screens: their lines above an input line of each layout."""
    rows = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(F.array(F.lit("ruled"), F.lit("arrow"), F.lit("boxed")), (F.col("doc_id") % 3 + 1).cast("int")).alias("layout"), "text")
    notice = F.when(F.col("doc_id") % 5 == 0, "\nYou've hit your usage limit. try again at 10:29 PM.").otherwise("")
    foot = F.when(F.col("layout") == "ruled", "\n──────────\n❯ \n──────────\n Opus 4").when(F.col("layout") == "arrow", "\n› ").otherwise("\nError: 429 usage limit retry-after-ms=5000\n╭── π > ◒ Large > x\n╰──")
    shown = rows.select("doc_id", "layout", F.concat("text", notice, foot).alias("plain"), F.lit("").alias("styled"))
    return screens.classify(shown).select("doc_id", "layout", "reading.*")
