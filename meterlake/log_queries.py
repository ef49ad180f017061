"""Sources written as logs from the driver's tables and read back, with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake import bindings as b
from meterlake.functions.scalars import local_time
from meterlake.lineage import cut
from meterlake.registry import keyed_hash_sql, query
from meterlake.sources import rollout, session_log, snapshots, telemetry, transcript

_SECRET = b"0123456789abcdef"
_DAY = 86_400_000


def _iso(ms: Column) -> Column:
    """A time as ``2024-01-01T00:00:00.5Z``, whatever the session's zone."""
    return F.concat(F.replace(local_time(ms, "UTC").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


# -- rollout logs: one file a user -----------------------------------------------------------------

def _rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that grow by each event's value and fall to nothing now and then; headers at signups."""
    e = b.events(spark, sf_dir).withColumn("kind", F.when((F.col("event_type") == "signup") & (F.col("user_id") % 4 != 0), "session_meta").when(F.col("k") % 6 == 0, "turn_context").otherwise("event_msg"))
    total = F.when(F.col("k") % 23 != 0, F.sum("v").over(Window.partitionBy("user_id").orderBy("event_id"))).otherwise(0)
    e = e.withColumn("total", total)
    own = F.when(F.col("k") % 9 == 0, F.concat(F.lit("x"), "k")).otherwise(F.concat(F.lit("r"), "user_id"))
    head = F.struct(own.alias("id"), F.when(F.col("user_id") % 3 == 0, F.lit("up")).alias("forked_from_id"), F.concat(F.lit("/w/"), F.col("k") % 7).alias("cwd"),
                    F.struct(F.concat(F.lit("b"), F.col("v") % 3).alias("branch")).alias("git"), _iso(F.col("observed_at") - 5000).alias("timestamp"))
    turn = F.struct(F.concat(F.lit("m"), F.col("k") % 4).alias("model"))
    used = F.struct((F.col("total") * 2).alias("input_tokens"), F.col("total").alias("cached_input_tokens"), F.expr("total div 2").alias("output_tokens"), F.col("total").alias("total_tokens"))
    slot = lambda pct, minutes: F.struct(pct.cast("double").alias("used_percent"), minutes.alias("window_minutes"), F.expr(f"observed_at div {_DAY} * {_DAY // 1000}").alias("resets_at"))
    limits = F.struct(slot(F.col("k") % 3 * 10, F.lit(300)).alias("primary"), slot(F.col("k") % 2 * 50, F.when(F.col("k") % 5 == 0, 60).otherwise(10_080)).alias("secondary"))
    count = F.struct(F.lit("token_count").alias("type"), F.struct(used.alias("total_token_usage")).alias("info"), limits.alias("rate_limits"))
    line = lambda payload: F.to_json(F.struct(_iso(F.col("observed_at")).alias("timestamp"), F.col("kind").alias("type"), payload.alias("payload")))
    value = F.when(F.col("kind") == "session_meta", line(head)).when(F.col("kind") == "turn_context", line(turn)).otherwise(line(count))
    lines = e.select(value.alias("value"), F.concat(F.lit("/rollouts/"), "user_id", F.lit(".jsonl")).alias("file"), F.col("event_id").alias("line"))
    return transcript.parsed(cut(lines, "log-lines"), rollout.MUST_HOLD)


_ROLLOUT = f"""{b.EVENTS}, lines AS (
        SELECT *, '/rollouts/' || user_id || '.jsonl' AS file, event_type = 'signup' AND user_id % 4 <> 0 AS is_head, k % 6 = 0 AS is_turn,
               CASE WHEN k % 23 <> 0 THEN sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT ELSE 0 END AS total,
               CASE WHEN k % 9 = 0 THEN 'x' || k ELSE 'r' || user_id END AS own FROM events_),
    heads AS (SELECT * FROM lines WHERE is_head QUALIFY row_number() OVER (PARTITION BY file ORDER BY event_id) = 1)"""


@query(f"""WITH {_ROLLOUT} SELECT file, 'h:' || own AS session_key, CASE WHEN user_id % 3 = 0 THEN 'h:up' END AS parent_session_key, '/w/' || (k % 7) AS cwd, 'b' || (v % 3) AS branch, observed_at - 5000 AS started_at FROM heads""")
def rollout_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.session_headers(_rollout(spark, sf_dir), "h").select("file", "session_key", "parent_session_key", "cwd", "branch", "started_at")


@query(f"""WITH {_ROLLOUT}, carried AS (
        SELECT *, last_value(CASE WHEN is_turn AND NOT is_head THEN 'm' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS model FROM lines),
    counts AS (SELECT *, lag(total) OVER w AS t0, row_number() OVER w AS n FROM carried WHERE NOT is_head AND NOT is_turn WINDOW w AS (PARTITION BY file ORDER BY event_id))
    SELECT c.observed_at || '|' || c.total AS source_request_key, coalesce('h:' || heads.own, substr(sha256(file), 1, 16)) AS stream_key, 'h:' || heads.own AS session_key, c.model, c.observed_at,
           (c.total - coalesce(t0, 0))::BIGINT AS uncached_input_tokens, (c.total - coalesce(t0, 0))::BIGINT AS cache_read_input_tokens, 0::BIGINT AS cache_write_input_tokens,
           (c.total // 2 - coalesce(t0, 0) // 2)::BIGINT AS output_tokens, NULL::BIGINT AS reasoning_output_tokens
    FROM counts c LEFT JOIN heads USING (file) WHERE c.total <> coalesce(t0, 0) AND c.total >= coalesce(t0, 0)""")
def rollout_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollout.observations(_rollout(spark, sf_dir), "log", "h", "p")
    return found.select("source_request_key", "stream_key", "session_key", "model", "observed_at", "uncached_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")


@query(f"""WITH {_ROLLOUT}, slots AS (
        SELECT file, event_id, observed_at, 0 AS slot, (k % 3 * 10)::DOUBLE AS used_pct, 18000::BIGINT AS window_seconds FROM lines WHERE NOT is_head AND NOT is_turn
        UNION ALL SELECT file, event_id, observed_at, 1, (k % 2 * 50)::DOUBLE, CASE WHEN k % 5 = 0 THEN 3600 ELSE 604800 END FROM lines WHERE NOT is_head AND NOT is_turn),
    told AS (SELECT *, observed_at // {_DAY} * {_DAY} AS resets_at, CASE window_seconds WHEN 18000 THEN 'session' WHEN 604800 THEN 'weekly' ELSE 'other:' || window_seconds || 's' END AS "window" FROM slots),
    p AS (SELECT *, lag((used_pct, resets_at)) OVER (PARTITION BY file, "window" ORDER BY event_id, slot) AS before FROM told)
    SELECT substr(sha256(file), 1, 16) AS stream_key, "window", used_pct, window_seconds, resets_at, observed_at FROM p WHERE before IS NULL OR before IS DISTINCT FROM (used_pct, resets_at)""")
def rollout_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.capacity(_rollout(spark, sf_dir), "log").select("stream_key", "window", "used_pct", "window_seconds", "resets_at", "observed_at")


@query(f"""WITH {_ROLLOUT}, mine AS (SELECT l.*, 'h:' || h.own AS session_key, 'b' || (l.v % 3) AS branch FROM lines l JOIN heads h USING (file) WHERE l.is_head AND l.own = h.own),
    p AS (SELECT *, lag(branch) OVER (PARTITION BY session_key ORDER BY observed_at, file, event_id) AS before FROM mine)
    SELECT session_key, branch, CASE WHEN before IS NULL THEN 0 ELSE observed_at END AS valid_from FROM p WHERE before IS NULL OR before <> branch""")
def rollout_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.branches(_rollout(spark, sf_dir), "h")


# -- transcripts -----------------------------------------------------------------------------------

#: Notices by what an event's number leaves over: text, kind, window, and the clock time they name.
_NOTICES = (("You've hit your session limit, resets 3:15pm", "hit", "session", (15, 15)), ("Weekly limit reached at 7 a.m.", "hit", "weekly", (7, 0)),
            ("Your weekly limit has reset", "reset", "weekly", None), ("You have hit your daily limit", "hit", None, None), ("All is well", None, None, None))
_ZONE = "Asia/Tokyo"


def _pick(number: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session a user; even lines in the session's own file, odd ones in another."""
    e = b.events(spark, sf_dir)
    kind, session = F.col("event_type"), F.concat(F.lit("c"), "user_id")
    told = lambda *fields: F.to_json(F.struct(session.alias("sessionId"), _iso(F.col("observed_at")).alias("timestamp"), F.concat(F.lit("u"), "event_id").alias("uuid"), *fields))
    quota = F.struct(_pick(F.col("k"), ["five_hour", "seven_day", "one_hour"]).alias("rateLimitType"), F.expr("observed_at div 1000 + 60").alias("resetsAt"))
    error = told(F.lit("assistant").alias("type"), F.lit("rate_limit").alias("error"), quota.alias("quotaLimits"))
    notice = told(F.lit("system").alias("type"), F.lit("informational").alias("subtype"), _pick(F.col("event_id"), [n[0] for n in _NOTICES]).alias("content"))
    place = told(F.lit("user").alias("type"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("/w/"), F.col("k") % 7)).alias("cwd"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("b"), F.col("v") % 3)).alias("gitBranch"))
    owner = told(F.lit("bridge-session").alias("type"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("o"), F.col("k") % 3)).alias("ownerAccountUuid"), F.lit("org").alias("ownerOrganizationUuid"))
    value = F.when(kind == "error", error).when(kind == "view", notice).when(kind == "purchase", owner).otherwise(place)
    file = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/logs/"), session, F.lit(".jsonl"))).otherwise(F.lit("/logs/z-agent.jsonl"))
    return transcript.parsed(cut(e.select(value.alias("value"), file.alias("file"), F.col("event_id").alias("line")), "log-lines"))


_NOTICE_ROWS = ", ".join("({}, {}, {}, {}, {})".format(i, *("NULL" if x is None else repr(x) for x in (kind, window)), *(clock or ("NULL", "NULL"))) for i, (_, kind, window, clock) in enumerate(_NOTICES))


@query(f"""WITH {b.EVENTS}, notices(i, kind, "window", h, m) AS (VALUES {_NOTICE_ROWS}),
    n AS (SELECT e.*, notices.*, timezone('{_ZONE}', to_timestamp(observed_at // 60000 * 60)) AS shown FROM events_ e JOIN notices ON event_id % {len(_NOTICES)} = i WHERE event_type = 'view' AND kind IS NOT NULL),
    c AS (SELECT *, date_trunc('day', shown) + to_minutes((h * 60 + m)::BIGINT) AS wanted FROM n)
    SELECT 'u' || event_id AS source_key, 'c' || user_id AS stream_key, kind, observed_at, "window",
           epoch_ms(timezone('{_ZONE}', CASE WHEN wanted < shown THEN wanted + INTERVAL 1 DAY ELSE wanted END)) AS resets_at FROM c
    UNION ALL SELECT 'u' || event_id, 'c' || user_id, 'hit', observed_at, CASE k % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'weekly' END, (observed_at // 1000 + 60) * 1000 FROM events_ WHERE event_type = 'error'""")
def limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.limit_events(_transcript(spark, sf_dir), "log", _ZONE).select("source_key", "stream_key", "kind", "observed_at", "window", "resets_at")


_PLACES = f"""{b.EVENTS}, lines AS (
        SELECT *, CASE WHEN event_id % 2 = 0 THEN '/logs/c' || user_id || '.jsonl' ELSE '/logs/z-agent.jsonl' END AS file,
               CASE WHEN event_type IN ('click', 'signup') AND k % 3 <> 0 THEN '/w/' || (k % 7) END AS cwd, CASE WHEN event_type IN ('click', 'signup') AND k % 4 <> 0 THEN 'b' || (v % 3) END AS branch FROM events_)"""


@query(f"""WITH {_PLACES} SELECT 'h:c' || user_id AS session_key, min(observed_at) AS started_at, max(observed_at) AS last_seen_at,
    coalesce(arg_max(cwd, event_id) FILTER (WHERE event_id % 2 = 0 AND cwd IS NOT NULL), arg_max(cwd, (file, event_id)) FILTER (WHERE cwd IS NOT NULL)) AS cwd FROM lines GROUP BY user_id""")
def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.sessions(_transcript(spark, sf_dir), "h").select("session_key", "started_at", "last_seen_at", "cwd")


@query(f"""WITH {_PLACES}, p AS (SELECT *, lag(branch) OVER (PARTITION BY user_id ORDER BY observed_at, file, event_id) AS before FROM lines WHERE branch IS NOT NULL)
    SELECT 'h:c' || user_id AS session_key, branch, observed_at AS valid_from FROM p WHERE before IS NULL OR before <> branch""")
def transcript_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.branch_changes(_transcript(spark, sf_dir), "h")


@query(f"""WITH {b.EVENTS} SELECT DISTINCT 'h:c' || user_id AS session_key, 'alias:p:owner:' || {keyed_hash_sql(_SECRET, "alias:p", "('o' || (k % 3) || '/org')")} AS value
    FROM events_ WHERE event_type = 'purchase' AND k % 3 <> 0""")
def transcript_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.owners(_transcript(spark, sf_dir), "h", "p", _SECRET)


# -- session logs ----------------------------------------------------------------------------------


def _session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a user with a header; three of four name the file of half the number as their parent."""
    e = b.events(spark, sf_dir)
    path = lambda user: F.concat(F.lit("file:///logs/"), user, F.lit(".jsonl"))
    message = F.to_json(F.struct(F.lit("message").alias("type"), _iso(F.col("observed_at")).alias("timestamp"), F.struct(F.col("k").alias("credentialId")).alias("message")))
    users = e.groupBy("user_id").agg(F.min("observed_at").alias("observed_at"))
    parent = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("/logs/"), F.expr("user_id div 2"), F.lit(".jsonl")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("s"), "user_id").alias("id"), F.lit("/w").alias("cwd"), parent.alias("parentSession"), _iso(F.col("observed_at")).alias("timestamp")))
    lines = e.select(message.alias("value"), path(F.col("user_id")).alias("file"), F.col("event_id").alias("line")).unionByName(users.select(head.alias("value"), path(F.col("user_id")).alias("file"), F.lit(-1).cast("long").alias("line")))
    return transcript.parsed(cut(lines, "log-lines"), session_log.MUST_HOLD)


@query(f"""WITH {b.EVENTS}, u AS (SELECT user_id, min(observed_at) AS started_at FROM events_ GROUP BY 1)
    SELECT 'h:s' || u.user_id AS session_key, CASE WHEN u.user_id % 4 <> 0 THEN 'h:s' || up.user_id END AS parent_session_key, u.started_at, '/w' AS cwd FROM u LEFT JOIN u up ON up.user_id = u.user_id // 2""")
def session_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_log.headers(_session_logs(spark, sf_dir), "h").select("session_key", "parent_session_key", "started_at", "cwd")


@query(f"""WITH {b.EVENTS}, known AS (SELECT DISTINCT k, 'alias:p:login:' || {keyed_hash_sql(_SECRET, "alias:login", "('user' || (k % 5))")} AS account FROM events_ WHERE k % 2 = 0),
    p AS (SELECT user_id, event_id, observed_at, account, lag(account) OVER (PARTITION BY user_id ORDER BY observed_at, event_id) AS before FROM events_ JOIN known USING (k))
    SELECT 'h:s' || user_id AS session_key, account, observed_at AS valid_from FROM p WHERE before IS NULL OR before <> account""")
def session_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    credentials = b.events(spark, sf_dir).select(F.col("k").alias("id"), F.lit("p").alias("provider"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("user"), F.col("k") % 5)).alias("identity_key")).distinct()
    return session_log.account_evidence(_session_logs(spark, sf_dir), "h", cut(credentials, "credentials"), _SECRET)


# -- snapshots and telemetry -----------------------------------------------------------------------


@query(f"""WITH {b.EVENTS}, r AS (
        SELECT event_id, k, observed_at, 'session' AS "window", 18000::BIGINT AS window_seconds, (v2 % 100)::DOUBLE AS used_pct FROM events_ WHERE k % 4 <> 0
        UNION ALL SELECT event_id, k, observed_at, 'weekly:opus', 604800, (v % 100)::DOUBLE FROM events_)
    SELECT 'f' || event_id AS stream_key, "window", window_seconds, used_pct, CASE WHEN k % 3 <> 0 THEN observed_at + 60000 END AS resets_at, observed_at, CASE WHEN k % 5 <> 0 THEN 'a' || (k % 10) END AS account
    FROM r WHERE observed_at > (SELECT min(observed_at) + {_DAY} FROM events_)""")
def cached_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    reading = lambda pct: F.struct(pct.cast("double").alias("utilization"), F.when(F.col("k") % 3 != 0, _iso(F.col("observed_at") + 60_000)).alias("resets_at"))
    used = F.struct(F.when(F.col("k") % 4 != 0, reading(F.col("v2") % 100)).alias("five_hour"), reading(F.col("v") % 100).alias("seven_day_opus"), reading(F.lit(1)).alias("no_such_window"))
    shot = F.struct(F.col("observed_at").alias("fetchedAtMs"), F.concat(F.lit("a"), F.col("k") % 10).alias("accountUuid"), used.alias("utilization"))
    login = F.struct(F.when(F.col("k") % 5 != 0, F.concat(F.lit("a"), F.col("k") % 10)).otherwise("b").alias("accountUuid"))
    files = e.select(F.concat(F.lit("f"), "event_id").alias("stream_key"), F.to_json(F.struct(login.alias("oauthAccount"), shot.alias("cachedUsageUtilization"))).alias("value"))
    begin = e.agg(F.min("observed_at")).first()[0] or 0
    return snapshots.cached_utilization(files, "cache", begin + _DAY).select("stream_key", "window", "window_seconds", "used_pct", "resets_at", "observed_at", "account")


@query(f"""WITH {b.EVENTS}, r AS (
        SELECT *, 'session' AS "window", 18000::BIGINT AS window_seconds, (v2 % 100)::DOUBLE AS used_pct, CASE WHEN k % 3 <> 0 THEN (observed_at // 1000 + 60) * 1000 END AS resets_at FROM events_ WHERE k % 4 <> 0
        UNION ALL SELECT *, 'other:spend_limit', NULL, (k % 50)::DOUBLE, NULL FROM events_ WHERE k % 2 = 0)
    SELECT 's' || event_id AS stream_key, "window", window_seconds, used_pct, resets_at, observed_at FROM r
    WHERE event_type <> 'view' AND NOT (k % 10 = 1) AND NOT ("window" = 'session' AND used_pct IS NULL AND resets_at IS NULL)""")
def statusline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status files, of which views have no session and every tenth has not moved on since it was last seen."""
    e = b.events(spark, sf_dir).withColumn("file", F.concat(F.lit("/status/"), "event_id"))
    reading = lambda pct, at: F.struct(pct.cast("double").alias("used_percentage"), at.cast("long").alias("resets_at"))
    limits = F.struct(F.when(F.col("k") % 4 != 0, reading(F.col("v2") % 100, F.when(F.col("k") % 3 != 0, F.expr("observed_at div 1000 + 60")))).alias("five_hour"),
                      F.when(F.col("k") % 2 == 0, reading(F.col("k") % 50, F.lit(None))).alias("spend_limit"), reading(F.lit(None), F.lit(None)).alias("seven_day"))
    value = F.to_json(F.struct(F.when(F.col("event_type") != "view", F.concat(F.lit("s"), "event_id")).alias("session_id"), "observed_at", limits.alias("rate_limits")))
    seen = e.filter("k % 10 < 2").select("file", (F.col("observed_at") - F.when(F.col("k") % 10 == 0, 1).otherwise(0)).alias("observed_at"))
    return snapshots.statusline(e.select("file", value.alias("value")), "status", seen).select("stream_key", "window", "window_seconds", "used_pct", "resets_at", "observed_at")


@query(f"""WITH {b.EVENTS}, newest AS (SELECT * FROM (SELECT user_id, observed_at, arg_max({{'k': k, 'v': v}}, event_id) AS x FROM events_ GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY observed_at DESC) = 1),
    n AS (SELECT user_id, observed_at, x.k AS k, x.v AS v FROM newest)
    SELECT 'usage_cache:report:' || user_id AS stream_key, CASE WHEN k % 3 = 0 THEN 'session' ELSE 'other:w' || (k % 2) END AS "window", (v % 64 / 64.0 * 100)::DOUBLE AS used_pct,
           CASE WHEN k % 3 = 0 THEN 18000 ELSE 60 END::BIGINT AS window_seconds, observed_at + 1000 AS resets_at, CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'ok' END AS status, observed_at FROM n
    UNION ALL SELECT 'usage_cache:report:' || user_id, 'weekly:large', 25.0, 604800, NULL, 'ok', observed_at FROM n""")
def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each user at each event, every second in an envelope, beside keys that hold no report."""
    e = b.events(spark, sf_dir).groupBy("user_id", "observed_at").agg(F.max_by(F.struct("k", "v", "event_id"), "event_id").alias("_e")).select("user_id", "observed_at", "_e.*")
    empty = F.lit(None).cast("string")
    limit = lambda name, tier, ms, at, used, status: F.struct(F.struct(name.alias("windowId"), tier.alias("tier")).alias("scope"), F.struct(ms.cast("long").alias("durationMs"), at.cast("long").alias("resetsAt")).alias("window"), F.struct(used.cast("double").alias("usedFraction")).alias("amount"), status.cast("string").alias("status"))
    own = limit(F.concat(F.lit("w"), F.col("k") % 2), empty, F.when(F.col("k") % 3 == 0, 18_000_000).otherwise(60_000), F.col("observed_at") + 1000, F.col("v") % 64 / 64, F.when(F.col("k") % 2 == 0, "warning"))
    week = limit(empty, F.lit("LARGE"), F.lit(604_800_000), F.lit(None), F.lit(0.25), F.lit(None))
    report = F.to_json(F.struct(F.lit("p").alias("provider"), F.col("observed_at").alias("fetchedAt"), F.array(own, week).alias("limits")))
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"value":'), report, F.lit("}"))).otherwise(report)
    cache = e.select(F.concat(F.lit("usage_cache:report:"), "user_id").alias("key"), value.alias("value"))
    return snapshots.usage_reports(cache.unionByName(cache.withColumn("key", F.lit("usage_cache:other"))), "cache").select("stream_key", "window", "used_pct", "window_seconds", "resets_at", "status", "observed_at")


@query(f"""WITH {b.EVENTS} SELECT event_id::VARCHAR AS source_request_key, {keyed_hash_sql(_SECRET, "request:p", "('q' || k)")} AS provider_request_key, CASE WHEN k % 5 <> 0 THEN 'm' || (k % 4) END AS model,
    CASE WHEN k % 4 <> 0 THEN v END AS uncached_input_tokens, v2 AS output_tokens, observed_at FROM events_ WHERE event_type <> 'signup' AND k % 7 <> 0""")
def telemetry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request events with plain names of attributes and spans with dotted ones; signups are metrics."""
    e = b.events(spark, sf_dir)
    span = F.col("event_type") == "error"
    name = lambda plain, dotted: F.when(span, dotted).otherwise(plain)
    pairs = F.array(*[F.struct(name(plain, dotted).alias("key"), value.cast("string").alias("value")) for plain, dotted, value in (
        ("request_id", "gen_ai.response.id", F.when(F.col("k") % 7 != 0, F.concat(F.lit("q"), "k"))), ("model", "gen_ai.request.model", F.when(F.col("k") % 5 != 0, F.concat(F.lit("m"), F.col("k") % 4))),
        ("input_tokens", "gen_ai.usage.input_tokens", F.when(F.col("k") % 4 != 0, F.col("v"))), ("output_tokens", "gen_ai.usage.output_tokens", F.col("v2")))])
    rows = e.select("event_id", "observed_at", F.when(F.col("event_type") == "signup", "metric").when(span, "span").otherwise("event").alias("kind"), F.map_from_entries(pairs).alias("attributes"))
    return telemetry.observations(rows, "otel", "p", _SECRET).select("source_request_key", "provider_request_key", "model", "uncached_input_tokens", "output_tokens", "observed_at")
