"""Triggers: a condition that must hold for a span before it fires, and clear before it fires again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _held(samples: DataFrame, series: list[str], condition: Column, at: str) -> DataFrame:
    """Samples at which the condition holds, with ``since``, the first of their stretch. A sample at which it is false or
    unknown ends a stretch; samples at one time count as one, at which it holds if it does in all."""
    once = samples.groupBy(*series, at).agg(F.min(F.coalesce(condition, F.lit(False))).alias("_holds"))
    w = Window.partitionBy(*series).orderBy(at)
    numbered = once.withColumn("_clears", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w)).filter("_holds")
    return numbered.withColumn("since", F.min(at).over(Window.partitionBy(*series, "_clears").orderBy(at))).drop("_clears", "_holds")


def held_spans(samples: DataFrame, series: list[str], condition: Column, at: str = "observed_at") -> DataFrame:
    """``series, since, until, samples``: stretches of samples at which the condition holds."""
    return _held(samples, series, condition, at).groupBy(*series, "since").agg(F.max(at).alias("until"), F.count("*").alias("samples"))


def firings(samples: DataFrame, series: list[str], condition: Column, hold_ms: int, cooldown_ms: int = 0, at: str = "observed_at") -> DataFrame:
    """``series, since, fired_at``: when a trigger fires. The condition must have held at every sample since ``since``, for at
    least ``hold_ms``, and the last firing of the series must lie ``cooldown_ms`` behind; then it fires at that
    sample, once until the condition has cleared.

    Stretches that never held long enough are gone before the cooldown is looked at; that goes through the samples
    of a series in their order, remembering one time, whatever their number."""
    ripe = _held(samples, series, condition, at).filter(F.col(at) - F.col("since") >= hold_ms)
    if cooldown_ms <= 0:
        return ripe.groupBy(*series, "since").agg(F.min(at).alias("fired_at"))
    ordered = ripe.select(*series, "since", F.col(at).alias("fired_at")).repartition(*series).sortWithinPartitions(*series, "fired_at")

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, since, last = None, None, None
        for batch in batches:
            kept = []
            for i, (*row_key, begun_at, now) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if row_key != key:
                    key, since, last = row_key, None, None
                if begun_at != since and (last is None or now - last >= cooldown_ms):
                    since, last = begun_at, now
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return ordered.mapInArrow(fire, ordered.schema)
