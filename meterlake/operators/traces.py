"""Traces out of spans: each span once, trees over parent ids, self times and critical paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.lineage import cut
from meterlake.operators.sequences import united

_SPAN = ["trace_id", "span_id"]


def spans_once(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each trace and span id: of repeated ones the last complete one, else the last."""
    value = [c for c in spans.columns if c not in _SPAN]
    return spans.groupBy(*_SPAN).agg(F.max_by(F.struct(*value), F.struct(F.col("end_ms").isNotNull(), F.col(seq))).alias("_v")).select(*_SPAN, *[F.col(f"_v.{c}").alias(c) for c in value])


def parents(spans: DataFrame, *more: str) -> DataFrame:
    """``trace_id, span_id, parent_id, missing`` and columns ``more``: the parent if it is among the spans, and whether one is
    named that is not. One equality join by trace and span."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_known"))
    named = spans.select(*_SPAN, "parent_id", *more).join(known, ["trace_id", "parent_id"], "left")
    return named.select(*_SPAN, F.when(F.col("_known"), F.col("parent_id")).alias("parent_id"), (F.col("parent_id").isNotNull() & F.col("_known").isNull()).alias("missing"), *more)


def tree(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, root_id, depth, critical, missing`` of each span.

    A trace may be partial: a span whose parent is missing is a root. ``critical`` is true on the path that leads
    from a root to its child that ends last (of equal ones the least id; open spans end last), and so on
    down. Every round doubles how far a span sees upwards, so rounds grow with the logarithm of the depth, and
    no trace is gathered in one task. Spans on a cycle of parents, and those below, have no root and
    no depth and are not critical."""
    linked = cut(parents(spans, "end_ms"), "span-links")
    last = F.struct(F.col("end_ms").isNotNull().alias("ended"), (-F.col("end_ms")).alias("end"), "span_id")
    chosen = linked.filter("parent_id IS NOT NULL").groupBy("trace_id", "parent_id").agg(F.min(last).alias("_last"))
    first = linked.join(chosen.select("trace_id", F.col("_last.span_id").alias("span_id"), F.lit(True).alias("_chosen")), _SPAN, "left")
    up = cut(first.select(
        *_SPAN, "missing", F.col("parent_id").alias("above"), F.coalesce("parent_id", "span_id").alias("root_id"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        (F.col("parent_id").isNull() | F.col("_chosen").isNotNull()).alias("critical")), "span-parents")
    longest = up.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < longest and not up.filter("above IS NOT NULL").isEmpty():
        higher = up.select("trace_id", F.col("span_id").alias("above"), F.col("above").alias("_above"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("critical").alias("_critical"))
        open_, done = up.filter("above IS NOT NULL"), up.filter("above IS NULL")
        moved = open_.join(higher, ["trace_id", "above"]).select(
            *_SPAN, "missing", F.col("_above").alias("above"), F.col("_root").alias("root_id"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("critical") & F.col("_critical")).alias("critical"))
        up, reach = cut(done.unionByName(moved), "span-parents"), reach * 2
    rooted = F.col("above").isNull()
    return up.select(*_SPAN, F.when(rooted, F.col("root_id")).alias("root_id"), F.when(rooted, F.col("depth")).alias("depth"), (rooted & F.col("critical")).alias("critical"), "missing")


def self_times(spans: DataFrame, slices: int = 64) -> DataFrame:
    """``trace_id, span_id, duration_ms, child_ms, self_ms``: how long some child ran inside the span (overlaps once), and
    the rest. Null for open spans; open children count to their parent's end.

    Children are first united within slices of their parent's time, then what is left is united over the
    slices, so no task orders all children of a busy span unless they are disjoint."""
    closed = spans.filter("end_ms IS NOT NULL").select(*_SPAN, "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"))
    above = closed.select("trace_id", F.col("span_id").alias("parent_id"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    inside = spans.filter("parent_id IS NOT NULL").select("trace_id", "parent_id", "start_ms", "end_ms").join(above, ["trace_id", "parent_id"])
    clipped = inside.select("trace_id", "parent_id", "_from", "_to", F.greatest("start_ms", "_from").alias("lo"), F.least(F.coalesce("end_ms", "_to"), "_to").alias("hi")).filter("lo < hi")
    sliced = clipped.withColumn("_slice", F.floor((F.col("lo") - F.col("_from")) * slices / (F.col("_to") - F.col("_from"))))
    pieces = united(united(sliced, ["trace_id", "parent_id", "_slice"]), ["trace_id", "parent_id"])
    covered = pieces.groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum(F.col("hi") - F.col("lo")).alias("_child"))
    length = F.col("end_ms") - F.col("start_ms")
    child = F.when(F.col("end_ms").isNotNull(), F.coalesce("_child", F.lit(0).cast("long")))
    # greatest() passes nulls over, so an open span's end stays null by the condition only.
    timed = spans.select(*_SPAN, "start_ms", F.when(F.col("end_ms").isNotNull(), F.greatest("start_ms", "end_ms")).alias("end_ms"))
    return timed.join(covered, _SPAN, "left").select(*_SPAN, length.alias("duration_ms"), child.alias("child_ms"), (length - child).alias("self_ms"))


def rollup(spans: DataFrame) -> DataFrame:
    """One row for each trace: its root (of several the one that starts first, then the least id), services, start,
    duration (from the first start to the last end; null if no span has ended), spans, errors, spans whose
    parent is missing, depth, and on the critical path of its root the spans and their self time."""
    spans = cut(spans, "spans")
    placed = spans.select(*_SPAN, "name", "start_ms").join(tree(spans), _SPAN).join(self_times(spans).select(*_SPAN, "self_ms"), _SPAN)
    is_root, root = F.col("root_id") == F.col("span_id"), ["start_ms", "span_id", "name"]
    trees = placed.groupBy("trace_id", "root_id").agg(
        F.min(F.when(is_root, F.struct(*root))).alias("_root"), F.count_if("missing").alias("_missing"), F.max("depth").alias("_depth"),
        F.count_if("critical").alias("_critical"), F.sum(F.when(F.col("critical"), F.col("self_ms"))).alias("_self"))
    first = F.min(F.when(F.col("_root").isNotNull(), F.struct(*[F.col(f"_root.{c}").alias(c) for c in root], "_critical", "_self"))).alias("_first")
    paths = trees.groupBy("trace_id").agg(first, F.sum("_missing").alias("missing_parents"), F.count("_root").alias("roots"), F.max("_depth").alias("depth"))
    whole = spans.groupBy("trace_id").agg(
        F.sort_array(F.collect_set("service")).alias("_services"), F.min("start_ms").alias("start_ms"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.count("*").alias("spans"),
        F.count_if(F.col("status") == "error").alias("errors"))
    return whole.join(paths, "trace_id").select(
        "trace_id", F.col("_first.span_id").alias("root_id"), F.col("_first.name").alias("root_name"), F.concat_ws(",", "_services").alias("services"), "start_ms", "duration_ms", "spans", "errors",
        "missing_parents", "roots", "depth", F.col("_first._critical").alias("critical_spans"), F.col("_first._self").alias("critical_self_ms"))


def errors(spans: DataFrame, logs: DataFrame, severe: int = 17) -> DataFrame:
    """``kind, at_ms, trace_id, span_id, service, message``: spans with an error, and logs of at least that severity at their
    own time, or where they have none (null or 0) when they were seen."""
    at = F.coalesce(F.when(F.col("time_ms") != 0, F.col("time_ms")), F.col("observed_ms"))
    failed = spans.filter("status = 'error'").select(F.lit("span").alias("kind"), F.col("start_ms").alias("at_ms"), *_SPAN, "service", F.col("name").alias("message"))
    return failed.unionByName(logs.filter(F.col("severity") >= severe).select(F.lit("log").alias("kind"), at.alias("at_ms"), *_SPAN, "service", F.col("body").alias("message")))
