"""Queries over traces, metrics, triggers, calibration, exports and deletion, with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake import bindings as b
from meterlake.lineage import cut
from meterlake.operators import calibration, deletion, metrics, traces, triggers
from meterlake.plans import export, investigate
from meterlake.registry import query

_HOUR, _DAY = 3_600_000, 86_400_000

# -- traces ----------------------------------------------------------------------------------------


def _span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the spans of a trace: the n-th hangs on the one before it or half its number, some parents are
    missing, some spans stay open, and every tenth came before as an open one."""
    e = b.events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    up = e.select("user_id", F.col("n").alias("_n"), F.col("event_id").alias("_up"))
    named = e.withColumn("_n", F.when(F.col("n") == 1, None).when(F.col("n") % 3 == 0, F.col("n") - 1).otherwise(F.expr("n div 2"))).join(up, ["user_id", "_n"], "left")
    k, n = F.col("k"), F.col("n")
    start = (n * 37 % 500 + n % 50 * 3).cast("long")
    spans = named.select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.when(n % 13 == 5, -F.col("event_id")).otherwise(F.col("_up")).alias("parent_id"),
        F.concat_ws("/", "event_type", (k % 4).cast("string")).alias("name"), F.col("event_type").alias("service"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.when(n == 1, 0).otherwise(start).cast("long").alias("start_ms"), F.when(k % 29 != 0, F.when(n == 1, 2000).otherwise(start + 200 + k)).cast("long").alias("end_ms"), F.lit(1).cast("long").alias("seq"))
    twice = F.when(F.col("span_id") % 10 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    early = F.col("_early")
    return spans.select("*", F.explode(twice).alias("_early")).withColumn("end_ms", F.when(~early, F.col("end_ms"))).withColumn("name", F.when(early, "early").otherwise(F.col("name"))).withColumn(
        "seq", F.when(early, F.col("span_id") % 3 * 2).otherwise(F.col("seq")).cast("long")).drop("_early")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.spans_once(_span_rows(spark, sf_dir)).drop("seq")


_SPANS = f"""{b.EVENTS}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events_),
    named AS (SELECT e.*, p.event_id AS up FROM e LEFT JOIN e p ON p.user_id = e.user_id AND e.n > 1 AND p.n = CASE WHEN e.n % 3 = 0 THEN e.n - 1 ELSE e.n // 2 END),
    raw AS (SELECT user_id AS trace_id, event_id AS span_id, CASE WHEN n % 13 = 5 THEN -event_id ELSE up END AS parent_id, event_type || '/' || (k % 4) AS name, event_type AS service,
                   CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN 0 ELSE n * 37 % 500 + n % 50 * 3 END AS start_ms,
                   CASE WHEN k % 29 <> 0 THEN CASE WHEN n = 1 THEN 2000 ELSE n * 37 % 500 + n % 50 * 3 + 200 + k END END AS end_ms FROM named),
    spans AS (SELECT trace_id, span_id, parent_id, CASE WHEN span_id % 10 = 0 AND end_ms IS NULL AND span_id % 3 > 0 THEN 'early' ELSE name END AS name, service, status, start_ms, end_ms FROM raw),
    linked AS (SELECT s.*, p.span_id AS up, s.parent_id IS NOT NULL AND p.span_id IS NULL AS missing FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id),
    chosen AS (SELECT trace_id, up, arg_min(span_id, (CASE WHEN end_ms IS NULL THEN -1e18 ELSE -end_ms END, span_id)) AS child FROM linked WHERE up IS NOT NULL GROUP BY ALL),
    walk(trace_id, span_id, root_id, depth, critical) AS (
        SELECT trace_id, span_id, span_id, 0, true FROM linked WHERE up IS NULL
        UNION ALL SELECT l.trace_id, l.span_id, w.root_id, w.depth + 1, w.critical AND c.child = l.span_id
        FROM walk w JOIN linked l ON l.trace_id = w.trace_id AND l.up = w.span_id JOIN chosen c ON c.trace_id = w.trace_id AND c.up = w.span_id),
    clipped AS (SELECT c.trace_id, c.up, greatest(c.start_ms, p.start_ms) AS lo, least(coalesce(c.end_ms, p.end_ms), p.end_ms) AS hi
                FROM linked c JOIN linked p ON p.trace_id = c.trace_id AND p.span_id = c.up AND p.end_ms IS NOT NULL),
    reach AS (SELECT *, max(hi) OVER (PARTITION BY trace_id, up ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM clipped WHERE lo < hi),
    inside AS (SELECT trace_id, up AS span_id, sum(greatest(0, hi - greatest(lo, coalesce(so_far, lo)))) AS child FROM reach GROUP BY ALL),
    timed AS (SELECT l.trace_id, l.span_id, end_ms - start_ms AS duration_ms, CASE WHEN end_ms IS NOT NULL THEN coalesce(child, 0)::BIGINT END AS child_ms,
                     CASE WHEN end_ms IS NOT NULL THEN (end_ms - start_ms - coalesce(child, 0))::BIGINT END AS self_ms FROM linked l LEFT JOIN inside i ON i.trace_id = l.trace_id AND i.span_id = l.span_id),
    placed AS (SELECT l.*, root_id, depth, critical, duration_ms, child_ms, self_ms FROM linked l JOIN walk USING (trace_id, span_id) JOIN timed USING (trace_id, span_id))"""


@query(f"WITH RECURSIVE {_SPANS} SELECT trace_id, span_id, root_id, depth::BIGINT AS depth, critical, missing, duration_ms, child_ms, self_ms FROM placed")
def trace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = cut(_spans(spark, sf_dir), "spans")
    return traces.tree(spans).join(traces.self_times(spans), ["trace_id", "span_id"])


@query(f"""WITH RECURSIVE {_SPANS},
    paths AS (SELECT trace_id, root_id, count(*) AS critical_spans, sum(self_ms)::BIGINT AS critical_self_ms FROM placed WHERE critical GROUP BY ALL),
    whole AS (SELECT trace_id, arg_min(span_id, (start_ms, span_id)) FILTER (root_id = span_id) AS root_id, arg_min(name, (start_ms, span_id)) FILTER (root_id = span_id) AS root_name,
                     string_agg(DISTINCT service, ',' ORDER BY service) AS services, min(start_ms) AS start_ms, max(end_ms) - min(start_ms) AS duration_ms, count(*) AS spans, count(*) FILTER (status = 'error') AS errors,
                     count(*) FILTER (missing) AS missing_parents, count(*) FILTER (root_id = span_id) AS roots, max(depth)::BIGINT AS depth FROM placed GROUP BY trace_id)
    SELECT whole.*, critical_spans, critical_self_ms FROM whole LEFT JOIN paths USING (trace_id, root_id)""")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.rollup(_spans(spark, sf_dir))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    return e.select(F.when(F.col("k") % 3 != 0, F.when(F.col("k") % 3 == 1, F.col("observed_at")).otherwise(0)).alias("time_ms"), (F.col("observed_at") + 5).alias("observed_ms"), (F.col("k") % 25).cast("long").alias("severity"),
                    F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("service"), F.concat(F.lit("log "), "k").alias("body"))


@query(f"""WITH RECURSIVE {_SPANS}
    SELECT 'span' AS kind, start_ms AS at_ms, trace_id, span_id, service, name AS message FROM spans WHERE status = 'error'
    UNION ALL SELECT 'log', CASE WHEN k % 3 = 1 THEN observed_at ELSE observed_at + 5 END, user_id, event_id, event_type, 'log ' || k FROM events_ WHERE k % 25 >= 17""")
def error_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.errors(_spans(spark, sf_dir), _logs(spark, sf_dir))


# -- metrics ---------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as sums: a third are deltas, a seventh may fall; starts change every nine days, some have none."""
    e, u = b.events(spark, sf_dir), F.col("user_id")
    return e.select(u.alias("series"), F.col("observed_at").alias("at_ms"), F.when(u % 5 != 0, F.expr(f"observed_at div {9 * _DAY} * {9 * _DAY}")).alias("start_ms"), F.when(F.col("k") % 17 != 0, F.col("v3")).alias("value"),
                    F.when(u % 3 == 0, "delta").otherwise("cumulative").alias("temporality"), (u % 7 != 0).alias("monotonic"))


_INCREASES = f"""{b.EVENTS}, p AS (SELECT user_id AS series, observed_at AS tm, max(v3) AS v, max(CASE WHEN user_id % 5 <> 0 THEN observed_at // {9 * _DAY} * {9 * _DAY} END) AS s, user_id % 3 = 0 AS d
                           FROM events_ WHERE k % 17 <> 0 AND user_id % 7 <> 0 GROUP BY ALL),
    q AS (SELECT *, lag(tm) OVER w AS at0, lag(v) OVER w AS v0, lag(s) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY series ORDER BY tm)),
    f AS (SELECT *, d OR at0 IS NULL OR s IS DISTINCT FROM s0 OR v < v0 AS fresh FROM q),
    inc AS (SELECT series, CASE WHEN fresh THEN greatest(s, at0) ELSE at0 END AS lo, tm AS hi, (CASE WHEN fresh THEN v ELSE v - v0 END)::DOUBLE AS increase FROM f)"""


@query(f"WITH {_INCREASES} SELECT series, lo AS from_ms, hi AS to_ms, increase FROM inc WHERE lo < hi")
def metric_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.increases(_points(spark, sf_dir), ["series"])


@query(f"""WITH {_INCREASES}, cells AS (SELECT series, g * {6 * _HOUR} AS step_ms, increase, lo, hi, least(hi, (g + 1) * {6 * _HOUR}) - greatest(lo, g * {6 * _HOUR}) AS ms
        FROM inc, unnest(generate_series(lo // {6 * _HOUR}, (hi - 1) // {6 * _HOUR})) AS t(g) WHERE lo < hi),
    summed AS (SELECT series, step_ms, sum(increase * ms / (hi - lo)) AS increase, sum(ms)::BIGINT AS covered_ms FROM cells GROUP BY ALL)
    SELECT series, step_ms, round(increase, 4) AS increase, covered_ms, round(increase * 1000 / covered_ms, 6) AS rate_per_s FROM summed""")
def metric_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.increase_by_step(_points(spark, sf_dir), ["series"], 6 * _HOUR)
    return out.withColumn("increase", F.round("increase", 4)).withColumn("rate_per_s", F.round("rate_per_s", 6))


def _micro(value: Column) -> Column:
    """In millionths, rounded where no bucket's share lies on the edge."""
    return F.floor(value * 1e6 + 0.3)


_QUANTILES = (0.0, 0.5, 0.9, 0.99, 1.0)


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = b.events(spark, sf_dir), F.col("k")
    near, far = F.array(*map(F.lit, (1.0, 2.0, 4.0))), F.array(*map(F.lit, (-5.0, 25.0, 50.0)))
    counts = F.array(F.col("v") % 4, F.col("v") % 7, k % 3, F.when(k % 2 == 0, F.col("v2") % 5).otherwise(0))
    return e.select("user_id", "event_type", F.when(k % 2 == 0, near).otherwise(far).alias("bounds"), F.when(k % 19 == 0, F.slice(counts, 1, 3)).otherwise(counts).alias("counts"))


def _hist_sql(q: float) -> str:
    return f"(SELECT CASE WHEN i > 3 THEN b[3] ELSE lower + (b[i] - lower) * (total * {q} - below) / n END FROM (SELECT i, n, below, CASE WHEN i > 1 THEN b[i - 1] ELSE least(0, b[1]) END AS lower FROM cum c WHERE c.user_id = t.user_id AND c.b = t.b AND upto >= total * {q} AND upto > 0 ORDER BY i LIMIT 1))"


@query(f"""WITH {b.EVENTS}, h AS (SELECT user_id, CASE WHEN k % 2 = 0 THEN [1.0::DOUBLE, 2, 4] ELSE [-5.0::DOUBLE, 25, 50] END AS b, [v % 4, v % 7, k % 3, CASE WHEN k % 2 = 0 THEN v2 % 5 ELSE 0 END] AS c FROM events_ WHERE k % 19 <> 0),
    cells AS (SELECT user_id, b, i, sum(c[i])::BIGINT AS n FROM h, unnest([1, 2, 3, 4]) AS t(i) GROUP BY ALL),
    cum AS (SELECT *, sum(n) OVER (PARTITION BY user_id, b ORDER BY i) AS upto, sum(n) OVER (PARTITION BY user_id, b ORDER BY i) - n AS below FROM cells),
    t AS (SELECT user_id, b, sum(n)::BIGINT AS total, string_agg(n, ',' ORDER BY i) AS told FROM cells GROUP BY ALL)
    SELECT user_id, b[1] AS first_bound, told, total AS count, {", ".join(f"floor({_hist_sql(q)} * 1e6 + 0.3)::BIGINT AS q{i}" for i, q in enumerate(_QUANTILES))} FROM t""")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged in two steps, as a store that keeps daily parts would."""
    parts = metrics.merged_histograms(_histograms(spark, sf_dir), ["user_id", "event_type"])
    whole = metrics.merged_histograms(parts, ["user_id"])
    values = [_micro(metrics.hist_quantile(F.col("bounds"), F.col("counts"), q)).alias(f"q{i}") for i, q in enumerate(_QUANTILES)]
    return whole.select("user_id", F.col("bounds")[0].alias("first_bound"), F.concat_ws(",", F.col("counts").cast("array<string>")).alias("told"), "count", *values)


def _exp_sql(q: float) -> str:
    return f"(SELECT CASE WHEN i IS NULL THEN 0.0 ELSE power(2.0, (i + (total * {q} - below) / n) / power(2.0, s)) END FROM cum c WHERE c.user_id = t.user_id AND upto >= total * {q} AND upto > 0 ORDER BY i NULLS FIRST LIMIT 1)"


@query(f"""WITH {b.EVENTS}, h AS (SELECT user_id, 1 + k % 3 AS scale, k % 5 - 2 AS off, [v % 3, v % 5, v2 % 4] AS c, k % 2 AS zeros FROM events_),
    least_ AS (SELECT user_id, min(scale) AS s, sum(zeros)::BIGINT AS zeros FROM h GROUP BY ALL),
    cells AS (SELECT user_id, floor((off + i - 1) / power(2.0, scale - s))::BIGINT AS i, s, sum(c[i])::BIGINT AS n FROM h JOIN least_ USING (user_id), unnest([1, 2, 3]) AS t(i) WHERE c[i] > 0 GROUP BY ALL),
    every AS (SELECT user_id, NULL::BIGINT AS i, s, zeros AS n FROM least_ UNION ALL SELECT * FROM cells),
    cum AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY user_id ORDER BY i NULLS FIRST) - n AS below FROM every),
    t AS (SELECT user_id, any_value(s)::BIGINT AS scale, sum(n)::BIGINT AS total, count(i) AS n_buckets FROM every GROUP BY ALL)
    SELECT user_id, scale, total AS count, n_buckets, {", ".join(f"floor({_exp_sql(q)} * 1e6 + 0.3)::BIGINT AS q{i}" for i, q in enumerate(_QUANTILES))} FROM t""")
def exp_histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = b.events(spark, sf_dir), F.col("k")
    points = e.select("user_id", (1 + k % 3).alias("scale"), (k % 5 - 2).alias("offset"), F.array(F.col("v") % 3, F.col("v") % 5, F.col("v2") % 4).alias("counts"), (k % 2).alias("zero_count"))
    whole = metrics.merged_exp_histograms(points, ["user_id"])
    values = [_micro(metrics.exp_hist_quantile(F.col("scale"), F.col("zero_count"), F.col("buckets"), q)).alias(f"q{i}") for i, q in enumerate(_QUANTILES)]
    return whole.select("user_id", F.col("scale").cast("long").alias("scale"), "count", F.size("buckets").cast("long").alias("n_buckets"), *values)


# -- triggers --------------------------------------------------------------------------------------

_HELD = f"""{b.EVENTS}, s AS (SELECT user_id, observed_at AS tm, bool_and(coalesce(v > 20, false)) AS holds FROM (SELECT user_id, observed_at, CASE WHEN k % 23 <> 0 THEN v END AS v FROM events_) GROUP BY ALL),
    c AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tm) AS clears FROM s),
    held AS (SELECT user_id, tm, min(tm) OVER (PARTITION BY user_id, clears) AS since FROM c WHERE holds)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.events(spark, sf_dir).select("user_id", "observed_at", F.when(F.col("k") % 23 != 0, F.col("v")).alias("v"))


@query(f"WITH {_HELD} SELECT user_id, since, max(tm) AS until, count(*) AS samples FROM held GROUP BY ALL")
def held_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.held_spans(_samples(spark, sf_dir), ["user_id"], F.col("v") > 20)


@query(f"""WITH RECURSIVE {_HELD}, ripe AS (SELECT user_id, since, tm FROM held WHERE tm - since >= {2 * _HOUR}),
    fire(user_id, since, tm) AS (
        SELECT user_id, arg_min(since, tm), min(tm) FROM ripe GROUP BY user_id
        UNION ALL SELECT f.user_id, n.since, n.tm FROM fire f, LATERAL (SELECT since, tm FROM ripe r WHERE r.user_id = f.user_id AND r.since > f.since AND r.tm - f.tm >= {_DAY} ORDER BY tm LIMIT 1) n)
    SELECT user_id, since, tm AS fired_at FROM fire""")
def trigger_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.firings(_samples(spark, sf_dir), ["user_id"], F.col("v") > 20, 2 * _HOUR, _DAY)


# -- what changed ----------------------------------------------------------------------------------

_DIMS = ("event_type", "model", "team")
_SETS = [s for s in ((), *[(d,) for d in _DIMS], ("event_type", "model"), ("event_type", "team"), ("model", "team"))]


@query(f"""WITH {b.EVENTS}, r AS (SELECT event_type, CASE WHEN k % 9 <> 0 THEN 'm' || (k % 4) END AS model, user_id % 20 AS team, v, observed_at AS tm FROM events_), m AS (SELECT max(tm) + 1 - {7 * _DAY} AS lo, max(tm) + 1 AS hi FROM r),
    w AS (SELECT r.*, tm >= lo AS late FROM r, m WHERE tm >= lo - {7 * _DAY} AND tm < hi),
    g AS ({" UNION ALL ".join(f'''SELECT '{",".join(s)}' AS "group", {", ".join(d if d in s else f"NULL AS {d}" for d in _DIMS)}, coalesce(sum(v) FILTER (NOT late), 0)::BIGINT AS before, coalesce(sum(v) FILTER (late), 0)::BIGINT AS after FROM w GROUP BY {", ".join(s) if s else "'x'"}''' for s in _SETS)}),
    ranked AS (SELECT *, after - before AS difference, row_number() OVER (PARTITION BY "group" ORDER BY abs(after - before) DESC, event_type NULLS FIRST, model NULLS FIRST, team NULLS FIRST) AS rank FROM g)
    SELECT event_type, model, team, "group", before, after, difference, round(difference::DOUBLE / nullif((SELECT difference FROM ranked WHERE "group" = ''), 0), 6) + 0.0 AS share, rank FROM ranked""")
def what_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.events(spark, sf_dir).select("event_type", F.when(F.col("k") % 9 != 0, F.concat(F.lit("m"), F.col("k") % 4)).alias("model"), (F.col("user_id") % 20).alias("team"), "v", "observed_at")
    end = (rows.agg(F.max("observed_at")).first()[0] or 0) + 1
    return investigate.contributions(rows, list(_DIMS), "v", end - 7 * _DAY, end).withColumn("share", F.round("share", 6))


# -- calibration -----------------------------------------------------------------------------------

_WEEK = 7 * _DAY
_PAIRS = f"""{b.EVENTS}, readings AS (
        SELECT 'acct' || (user_id % 5) AS account, CASE WHEN k % 2 = 0 THEN 'weekly' ELSE 'session' END AS "window", (observed_at // {_WEEK} + 1) * {_WEEK} AS resets_at, observed_at AS tm,
               max(observed_at % {_WEEK} * 100 // {_WEEK} + v % 3)::DOUBLE AS pct
        FROM events_ WHERE event_type IN ('click', 'view') AND k % 21 <> 0 GROUP BY ALL),
    usage AS (SELECT 'acct' || (user_id % 5) AS account, observed_at AS tm, v AS tokens FROM events_ WHERE event_type NOT IN ('click', 'view')),
    summed AS (SELECT account, tm, sum(sum(tokens)) OVER (PARTITION BY account ORDER BY tm) AS so_far FROM usage GROUP BY account, tm),
    read AS (SELECT r.*, coalesce(s.so_far, 0) AS so_far FROM readings r ASOF LEFT JOIN summed s ON r.account = s.account AND r.tm >= s.tm),
    pairs AS (SELECT account, "window", resets_at, tm AS from_at, lead(tm) OVER w AS to_at, pct AS from_pct, lead(pct) OVER w AS to_pct,
                     (coalesce(lead(so_far) OVER w, (SELECT max(s.so_far) FROM summed s WHERE s.account = read.account), 0) - so_far)::BIGINT AS tokens
              FROM read WINDOW w AS (PARTITION BY account, "window", resets_at ORDER BY tm)),
    x AS (SELECT *, (to_pct - from_pct) / tokens AS x FROM pairs WHERE to_at IS NOT NULL AND tokens > 0 AND to_pct > from_pct),
    middle AS (SELECT account, "window", median(x) AS ratio, count(*) AS n, max(to_at) AS calibrated_at FROM x GROUP BY ALL),
    spread AS (SELECT x.account, x."window", median(abs(x - ratio)) AS spread FROM x JOIN middle m ON m.account = x.account AND m."window" = x."window" GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir)
    read = F.col("event_type").isin("click", "view")
    account = F.concat(F.lit("acct"), F.col("user_id") % 5).alias("account")
    readings = e.filter(read & (F.col("k") % 21 != 0)).select(account, F.when(F.col("k") % 2 == 0, "weekly").otherwise("session").alias("window"), F.expr(f"(observed_at div {_WEEK} + 1) * {_WEEK}").alias("resets_at"), "observed_at",
                                                            F.expr(f"CAST(observed_at % {_WEEK} * 100 div {_WEEK} + v % 3 AS DOUBLE)").alias("used_pct"))
    return calibration.reading_pairs(readings, e.filter(~read).select(account, "observed_at", F.col("v").alias("tokens")))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def reading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""WITH {_PAIRS}, t AS (SELECT max(observed_at) AS now FROM events_)
    SELECT p.account, p."window", resets_at, from_at AS anchor_at, from_pct AS anchor_pct, tokens, CASE WHEN ratio IS NOT NULL THEN round(least(100, from_pct + tokens * ratio), 6) END AS estimate_pct, round(tokens * spread, 6) AS error_pct, calibrated_at,
           CASE WHEN ratio IS NOT NULL THEN 1 END AS estimator_version
    FROM pairs p LEFT JOIN middle m ON m.account = p.account AND m."window" = p."window" LEFT JOIN spread s ON s.account = p.account AND s."window" = p."window", t WHERE to_at IS NULL AND resets_at > now""")
def quota_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = b.events(spark, sf_dir).agg(F.max("observed_at")).first()[0] or 0
    return calibration.estimates(_pairs(spark, sf_dir), now).withColumn("estimate_pct", F.round("estimate_pct", 6)).withColumn("error_pct", F.round("error_pct", 6))


@query(f"""WITH {_PAIRS}, o AS (SELECT p.*, round(to_pct - from_pct - tokens * ratio, 6) AS unexplained_pct FROM pairs p JOIN middle m ON m.account = p.account AND m."window" = p."window" WHERE to_at IS NOT NULL)
    SELECT * FROM o WHERE abs(unexplained_pct) > 1""")
def quota_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.jumps(_pairs(spark, sf_dir), 1.0).withColumn("unexplained_pct", F.round("unexplained_pct", 6))


# -- exports and deletion --------------------------------------------------------------------------


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = b.events(spark, sf_dir), F.col("k")
    return e.select("event_type", F.when(k % 13 != 0, F.concat(F.lit("p"), k % 3)).alias("provider"), F.when(F.col("v") % 4 == 0, "acct-main").otherwise(F.concat(F.lit("acct"), "event_id")).alias("account"), F.concat(F.lit("proj"), F.col("event_id") % 977).alias("project"), "v", "v2")


@query(f"""WITH {b.EVENTS}, r AS (SELECT event_type, CASE WHEN k % 13 <> 0 THEN 'p' || (k % 3) END AS provider, CASE WHEN v % 4 = 0 THEN 'acct-main' ELSE 'acct' || event_id END AS account, v, v2 FROM events_),
    heavy AS (SELECT account FROM r GROUP BY account HAVING sum(v) > 0 AND sum(v) >= 0.05 * (SELECT sum(v) FROM r))
    SELECT event_type, CASE WHEN provider IS NULL OR provider IN ('p0', 'p2') THEN provider ELSE 'other' END AS provider, CASE WHEN account IN (FROM heavy) THEN account ELSE 'other' END AS account,
           sum(v)::BIGINT AS v, sum(v2)::BIGINT AS v2, count(*) AS requests FROM r GROUP BY ALL""")
def export_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few types go out whole, providers by a list, accounts by their weight, projects (too many, no list) not at all."""
    return export.rollup(_metric_rows(spark, sf_dir), ["event_type", "provider", "account", "project"], ["v", "v2"], limit=50, allowed={"provider": ["p0", "p2"]}, heavy={"account": 0.05})


@query(f"""WITH {b.EVENTS} SELECT event_type, CASE WHEN k % 13 <> 0 THEN 'p' || (k % 3) END AS provider, sum(v)::BIGINT AS v, count(*) AS requests FROM events_ WHERE k % 13 = 0 OR k % 3 = 1 GROUP BY ALL""")
def export_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not on the list is not exported."""
    return export.rollup(_metric_rows(spark, sf_dir), ["event_type", "provider"], ["v"], limit=50, allowed={"provider": ["p1"]}, rest="drop")


_FORGET = f"""{b.OBSERVATIONS}, first AS (SELECT provider_request_key, source, min(event_key) AS event_key FROM obs WHERE "primary" GROUP BY ALL),
    links AS (SELECT observation_id, min(f.event_key) AS event_key FROM obs o JOIN first f ON f.provider_request_key = o.provider_request_key AND f.source <> o.source WHERE NOT "primary" GROUP BY ALL),
    sess AS (SELECT DISTINCT session_key, split_part(session_key, ':', 2)::BIGINT AS u, split_part(session_key, ':', 3)::BIGINT AS j FROM obs WHERE session_key IS NOT NULL),
    last AS (SELECT session_key, max(observed_at) AS last_seen_at FROM obs WHERE session_key IS NOT NULL GROUP BY ALL),
    hit AS (SELECT u, j FROM sess JOIN last USING (session_key) WHERE u % 7 = 3 AND j = 1 OR last_seen_at < (SELECT min(observed_at) + {2 * _DAY} FROM obs)),
    doomed(u, j) AS (SELECT u, j FROM hit UNION SELECT s.u, s.j FROM doomed d JOIN sess s ON s.u = d.u AND s.j = d.j + 1),
    gone AS (SELECT 's:' || u || ':' || j AS session_key FROM doomed),
    gone_events AS (SELECT event_key FROM obs WHERE "primary" AND session_key IN (FROM gone)),
    gone_obs AS (SELECT observation_id FROM obs WHERE session_key IN (FROM gone) UNION SELECT observation_id FROM links WHERE event_key IN (FROM gone_events))"""


@query(f"""WITH RECURSIVE {_FORGET}
    SELECT 'events' AS tbl, event_key::VARCHAR AS key FROM obs WHERE "primary" AND (session_key IS NULL OR session_key NOT IN (FROM gone))
    UNION ALL SELECT 'observations', observation_id::VARCHAR FROM obs WHERE observation_id NOT IN (FROM gone_obs)
    UNION ALL SELECT 'links', observation_id::VARCHAR FROM links WHERE event_key NOT IN (FROM gone_events) AND observation_id NOT IN (FROM gone_obs)
    UNION ALL SELECT 'evidence', event_id::VARCHAR FROM events_ WHERE 's:' || user_id || ':' || (k % 5) NOT IN (FROM gone)
    UNION ALL SELECT 'sessions', session_key FROM sess WHERE session_key NOT IN (FROM gone)
    UNION ALL SELECT 'tombstones', session_key FROM gone""")
def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one account, and old ones, with their descendants and all that hangs on them."""
    from meterlake.operators import linking

    obs = b.observations(spark, sf_dir)
    number = F.split("session_key", ":")
    user, j = number[1], number[2].cast("int")
    sessions = obs.filter("session_key IS NOT NULL").groupBy("session_key").agg(F.max("observed_at").alias("last_seen_at")).withColumn(
        "parent_session_key", F.when(j > 0, F.concat(F.lit("s:"), user, F.lit(":"), j - 1)))
    effective = sessions.filter(j == 1).select(F.col("session_key").alias("subject_id"), F.lit("account").alias("dimension"), F.lit("attributed").alias("state"), F.concat(F.lit("acct"), user.cast("long") % 7).alias("value"))
    accounts = spark.sql("SELECT 'acct3' AS value")
    begin = obs.agg(F.min("observed_at")).first()[0] or 0
    doomed = deletion.doomed_sessions(sessions, effective, accounts, before_ms=begin + 2 * _DAY)
    events = obs.filter("primary")
    left = deletion.forget(doomed, events, obs, linking.link_secondary(obs), b.evidence(spark, sf_dir), sessions)
    stones = deletion.tombstones(begin + 100 * _DAY, doomed=doomed)
    keys = {"events": "event_key", "observations": "observation_id", "links": "observation_id", "evidence": "arrival_seq", "sessions": "session_key"}
    out = stones.select(F.lit("tombstones").alias("tbl"), F.col("value").alias("key"))
    for name, rows in left.items():
        out = out.unionByName(rows.select(F.lit(name).alias("tbl"), F.col(keys[name]).cast("string").alias("key")))
    return out
