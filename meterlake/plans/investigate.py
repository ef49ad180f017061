"""What changed between a period and the one before it, and where."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.lineage import cut


def contributions(rows: DataFrame, dims: list[str], value: str, begin_ms: int, end_ms: int, at: str = "observed_at", depth: int = 2, top: int | None = None) -> DataFrame:
    """``dims, group, before, after, difference, share, rank``: sums of ``value`` in [begin, end) and in the equal span before it, for the
    whole (``group`` is empty) and for every combination of up to ``depth`` dimensions (``group`` names them).

    ``difference`` is after less before; the differences of one group add up to that of the whole. ``share`` is a row's
    part of the whole difference (null if that is 0). ``rank`` goes by the size of the difference within a
    group, then by the dimensions' values; ``top`` keeps the first so many of each. A dimension's null is a value of
    its own, told from the null of a dimension that the group leaves out by ``group``; null values count as 0.

    Both periods are summed in one pass over the rows, once, by all dimensions; the combinations are summed
    from that."""
    length = end_ms - begin_ms
    late = F.col(at) >= begin_ms
    inside = rows.filter((F.col(at) >= begin_ms - length) & (F.col(at) < end_ms))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0).cast("long")).alias
    base = inside.groupBy(*dims).agg(total(~late)("before"), total(late)("after"))
    sets = [list(c) for n in range(min(depth, len(dims)) + 1) for c in combinations(dims, n)]
    # Each combination is a struct, so that a left-out dimension differs from a null one.
    parts = F.array(*[F.struct(F.lit(",".join(s)).alias("group"), *[(F.col(d) if d in s else F.lit(None).cast(base.schema[d].dataType)).alias(d) for d in dims]) for s in sets])
    each = base.select(F.explode(parts).alias("_s"), "before", "after").select("_s.*", "before", "after")
    summed = each.groupBy("group", *dims).agg(F.sum("before").alias("before"), F.sum("after").alias("after")).withColumn("difference", F.col("after") - F.col("before"))
    whole = base.agg(F.sum(F.col("after") - F.col("before")).alias("_whole"))
    # Differences stand in slots by their size, so that no task ranks a whole group: a rank is one in the slot, behind the
    # rows of the larger slots, of which a group has as many as a number has binary digits.
    slotted = cut(summed.withColumn("_slot", F.floor(F.log2(F.abs("difference").cast("double") + 1))), "contributions")
    sizes = slotted.groupBy("group", "_slot").agg(F.count("*").alias("_n"))
    larger = F.sum("_n").over(Window.partitionBy("group").orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1))
    order = Window.partitionBy("group", "_slot").orderBy(F.desc(F.abs("difference")), *[F.asc_nulls_first(d) for d in dims])
    placed = slotted.withColumn("_in_slot", F.row_number().over(order)).join(F.broadcast(sizes.select("group", "_slot", larger.alias("_larger"))), ["group", "_slot"])
    ranked = placed.withColumn("rank", (F.col("_in_slot") + F.coalesce("_larger", F.lit(0))).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    share = F.when(F.col("_whole") != 0, F.col("difference") / F.col("_whole"))
    return ranked.join(F.broadcast(whole)).select(*dims, "group", "before", "after", "difference", share.alias("share"), "rank")


def evidence(spans: DataFrame, logs: DataFrame, service: str, begin_ms: int, end_ms: int, slowest: int = 10, near_ms: int = 1000) -> dict[str, DataFrame]:
    """Evidence on a service in [begin, end): its ``errors`` by name with their first and last time, its ``slowest`` closed spans,
    and the ``logs`` of its traces within ``near_ms`` of an error span."""
    own = spans.filter((F.col("service") == service) & (F.col("start_ms") >= begin_ms) & (F.col("start_ms") < end_ms))
    failed = own.filter("status = 'error'")
    groups = failed.groupBy("name").agg(F.count("*").alias("errors"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"), F.countDistinct("trace_id").alias("traces"))
    slow = own.filter("end_ms IS NOT NULL").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).orderBy(F.desc("duration_ms"), "trace_id", "span_id").limit(slowest)
    at = F.coalesce(F.when(F.col("time_ms") != 0, F.col("time_ms")), F.col("observed_ms"))
    # Errors of a trace stand in slots of the reach, so a log meets those of three slots, not all of its trace.
    slots = failed.select("trace_id", "start_ms", F.explode(F.array(*[F.floor(F.col("start_ms") / near_ms) + d for d in (-1, 0, 1)])).alias("_slot"))
    timed = logs.withColumn("at_ms", at).withColumn("_slot", F.floor(F.col("at_ms") / near_ms))
    close = timed.join(slots, (timed["trace_id"] == slots["trace_id"]) & (timed["_slot"] == slots["_slot"]) & (F.abs(timed["at_ms"] - slots["start_ms"]) <= near_ms), "left_semi")
    return {"errors": groups, "slowest": slow, "logs": close.drop("_slot")}
