"""Counting rules: from repetitive or cumulative logs to one row for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_snapshots(rows: DataFrame, key: list[str], output: str, seq: str, session: str | None = None) -> DataFrame:
    """Of the snapshots of a request the one with the largest output; a tie or a null keeps the earlier
    row, and the session stays that of the first. One aggregation, merged in the map tasks."""
    value = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*value), F.struct(F.coalesce(F.col(output), F.lit(-1)).alias("o"), (-F.col(seq)).alias("s")))
    aggs = [best.alias("_best"), F.count("*").alias("snapshots")]
    if session:
        aggs.append(F.min_by(F.col(session), F.col(seq)).alias("_session"))
    out = rows.groupBy(*key).agg(*aggs)
    return out.select(*key, *[F.col("_session").alias(c) if c == session else F.col(f"_best.{c}").alias(c) for c in value], "snapshots")


def counter_delta(rows: DataFrame, file: str, order: str, counters: list[str], total: str) -> DataFrame:
    """Differences of cumulative counters along each file.

    A row whose total is null is no reading. An unchanged total is skipped; if any counter falls, the
    row is a new baseline and gives nothing; else each difference is given, null where either side
    is. The first baseline is zero.
    """
    w = Window.partitionBy(file).orderBy(order)
    own = list(dict.fromkeys([*counters, total]))
    valid = rows.filter(F.col(total).isNotNull()).withColumn("_before", F.lag(F.struct(*own)).over(w))
    first = F.col("_before").isNull()
    before = {c: F.when(first, F.lit(0).cast("long")).otherwise(F.col(f"_before.{c}")) for c in own}
    fell = F.coalesce(F.greatest(*[F.coalesce((F.col(c) < before[c]).cast("int"), F.lit(0)) for c in own], F.lit(0)), F.lit(0)) == 1
    out = valid.filter(~(F.col(total) == before[total]) & ~fell)
    return out.select(*[c for c in rows.columns if c not in own], *[(F.col(c) - before[c]).alias(c) for c in own])


def emit_on_change(rows: DataFrame, series: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from the series' row before; nulls are equal."""
    w = Window.partitionBy(*series).orderBy(*order)
    now = F.struct(*values)
    return rows.withColumn("_before", F.lag(F.struct(now.alias("v"))).over(w)).filter(F.col("_before").isNull() | ~now.eqNullSafe(F.col("_before.v"))).drop("_before")


def carry_forward(rows: DataFrame, file: str, order: str, column: str) -> DataFrame:
    """The last known value of a column at or before each row of a file."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def read_counters(rows: DataFrame, group: list[str], **conditions: Column) -> DataFrame:
    """How many rows of each group meet each named condition."""
    return rows.groupBy(*group).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
