"""Metric points: reset-aware increases over a grid of steps, and quantiles of merged histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(points: DataFrame, series: list[str]) -> DataFrame:
    """``series, from_ms, to_ms, increase``: what each point of a sum adds, and over which time.

    ``points`` have ``at_ms, start_ms, value, temporality`` (delta or cumulative) and ``monotonic``. A delta point is taken as it
    is, from its start (or the point before). A cumulative one adds its difference to the point before; a
    new start, or a value below the one before, restarts the series, so that it adds its own value, from that
    start if it lies behind the point before. The first cumulative point adds its value if it has a
    start, else nothing is known of it. Points without a value say nothing, and sums that may fall
    (``monotonic`` false) are never turned into increases. Of points at one time the largest counts."""
    known = points.filter("value IS NOT NULL AND monotonic").groupBy(*series, "temporality", "at_ms").agg(F.max_by(F.struct("value", "start_ms"), F.struct("value", "start_ms")).alias("p"))
    known = known.select(*series, "temporality", "at_ms", "p.value", "p.start_ms")
    w = Window.partitionBy(*series, "temporality").orderBy("at_ms")
    before = known.withColumn("_at", F.lag("at_ms").over(w)).withColumn("_value", F.lag("value").over(w)).withColumn("_start", F.lag("start_ms").over(w))
    delta = F.col("temporality") == "delta"
    reset = ~F.col("start_ms").eqNullSafe(F.col("_start")) | (F.col("value") < F.col("_value"))
    fresh = delta | F.col("_at").isNull() | reset
    since = F.when(fresh, F.greatest("start_ms", "_at")).otherwise(F.col("_at"))
    told = before.select(*series, since.alias("from_ms"), F.col("at_ms").alias("to_ms"), F.when(fresh, F.col("value")).otherwise(F.col("value") - F.col("_value")).cast("double").alias("increase"))
    return told.filter("from_ms < to_ms")


def increase_by_step(points: DataFrame, series: list[str], step_ms: int) -> DataFrame:
    """``series, step_ms`` (a step's beginning), ``increase, covered_ms, rate_per_s``: increases laid on a grid of steps.

    An increase is spread evenly over its time, so a step takes the part of each that lies in it, edges inside
    a step too, and steps without a sample take their part of what spans them. The parts add up to
    the whole. ``covered_ms`` is how much of the step is known; the rate is over that time. Steps of which
    nothing is known have no row."""
    told = increases(points, series)
    first, last = F.floor(F.col("from_ms") / step_ms), F.floor((F.col("to_ms") - 1) / step_ms)
    each = told.withColumn("_n", F.explode(F.sequence(first, last)))
    begin = F.col("_n") * step_ms
    inside = F.least(F.col("to_ms"), begin + step_ms) - F.greatest(F.col("from_ms"), begin)
    part = F.col("increase") * inside / (F.col("to_ms") - F.col("from_ms"))
    out = each.select(*series, begin.cast("long").alias("step_ms"), part.alias("_part"), inside.alias("_ms")).groupBy(*series, "step_ms").agg(F.sum("_part").alias("increase"), F.sum("_ms").cast("long").alias("covered_ms"))
    return out.withColumn("rate_per_s", F.col("increase") * 1000 / F.col("covered_ms"))


# -- histograms ------------------------------------------------------------------------------------


def merged_histograms(points: DataFrame, group: list[str]) -> DataFrame:
    """``group, bounds, counts, count``: bucket counts summed by position over the points of a group that share their
    bounds. Merging merged parts gives the merged whole. A point whose counts are not one more than its
    bounds is left out; null counts are none."""
    fit = points.filter("size(counts) = size(bounds) + 1")
    cells = fit.select(*group, "bounds", F.posexplode("counts").alias("_at", "_n")).groupBy(*group, "bounds", "_at").agg(F.sum(F.coalesce("_n", F.lit(0))).cast("long").alias("_n"))
    whole = cells.groupBy(*group, "bounds").agg(F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_cells"), F.sum("_n").cast("long").alias("count"))
    return whole.select(*group, "bounds", F.transform("_cells", lambda c: c["_n"]).alias("counts"), "count")


def _cumulative(counts: Column) -> Column:
    """Running sums. The fold keeps the array and goes over buckets, of which a histogram has few."""
    return F.aggregate(counts, F.array().cast("array<long>"), lambda done, n: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long")) + n)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def hist_quantile(bounds: Column, counts: Column, q: float) -> Column:
    """The value below which a share ``q`` of a histogram lies, spread evenly inside its bucket. The lowest bucket begins
    at 0, or at its bound if that is not positive; the open one at the top is taken at its lower bound.
    Null for an empty histogram or one without bounds."""
    def spread(sums: Column) -> Column:
        rank = F.element_at(sums, -1) * F.lit(float(q))
        at = F.array_position(F.transform(sums, lambda s: (s >= rank) & (s > 0)), F.lit(True)).cast("int")
        upper = F.try_element_at(bounds, at)
        lower = F.when(at > 1, F.try_element_at(bounds, F.greatest(at - 1, F.lit(1)))).otherwise(F.least(F.lit(0.0), F.try_element_at(bounds, F.lit(1))))
        below = F.when(at > 1, F.try_element_at(sums, F.greatest(at - 1, F.lit(1)))).otherwise(F.lit(0))
        inside = lower + (upper - lower) * (rank - below) / F.element_at(counts, at)
        return F.when((F.size(bounds) > 0) & (F.element_at(sums, -1) > 0), F.when(at > F.size(bounds), F.element_at(bounds, -1)).otherwise(inside))

    return _with(_cumulative(counts), spread)


def merged_exp_histograms(points: DataFrame, group: list[str]) -> DataFrame:
    """``group, scale, zero_count, buckets`` (index and count, by index) ``, count``: exponential histograms of positive values
    brought to the smallest scale of their group, where each bucket takes those it is halved into."""
    least = points.groupBy(*group).agg(F.min("scale").alias("_scale"), F.sum("zero_count").cast("long").alias("zero_count"))
    cells = points.select(*group, "scale", "offset", F.posexplode("counts").alias("_at", "_n")).filter("_n > 0").join(least.select(*group, "_scale"), group)
    index = F.floor((F.col("offset") + F.col("_at")) / F.pow(F.lit(2.0), F.col("scale") - F.col("_scale")))
    summed = cells.groupBy(*group, index.cast("long").alias("index")).agg(F.sum("_n").cast("long").alias("n"))
    buckets = summed.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("index", "n"))).alias("buckets"), F.sum("n").cast("long").alias("_n"))
    return least.join(buckets, group, "left").select(
        *group, F.col("_scale").alias("scale"), "zero_count", F.coalesce("buckets", F.array().cast("array<struct<index: long, n: long>>")).alias("buckets"),
        (F.col("zero_count") + F.coalesce("_n", F.lit(0).cast("long"))).alias("count"))


def exp_hist_quantile(scale: Column, zero_count: Column, buckets: Column, q: float) -> Column:
    """The quantile of a merged exponential histogram: 0 among the zeros, else spread in proportion inside the bucket
    from ``base ** index`` to ``base ** (index + 1)``, with ``base = 2 ** 2 ** -scale``. Null for an empty one."""
    def spread(sums: Column) -> Column:
        rank = F.element_at(sums, -1) * F.lit(float(q))
        at = F.array_position(F.transform(sums, lambda s: (s >= rank) & (s > 0)), F.lit(True)).cast("int")
        found = F.try_element_at(buckets, F.greatest(at - 1, F.lit(1)))
        share = (rank - F.try_element_at(sums, F.greatest(at - 1, F.lit(1)))) / found["n"]
        return F.when(F.element_at(sums, -1) > 0, F.when(at == 1, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (found["index"] + share) / F.pow(F.lit(2.0), scale))))

    return _with(_cumulative(F.concat(F.array(zero_count), F.transform(buckets, lambda b: b["n"]))), spread)
