"""Keyed writes as set operations: the new state of a table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq", always: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with the batch's applied in order: a later null never erases a known value, except in
    the columns of ``always``, where the last row's value counts. One aggregation over both."""
    value = [c for c in new.columns if c not in (*keys, seq)]
    rows = old.withColumn(seq, F.lit(-1).cast("long")).unionByName(new.withColumn(seq, F.col(seq).cast("long")))
    kept = [F.max_by(F.col(c), F.col(seq) if c in always else F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in value]
    return rows.groupBy(*keys).agg(*kept)


def upsert_by_rule(old: DataFrame, new: DataFrame, keys: list[str], rule: str, seq: str = "seq", output: str = "output_tokens") -> DataFrame:
    """Old rows with the batch's applied by a counting rule: ``replace`` takes the last row, ``max_output``
    the one with the largest output, the earlier one where that is equal or null."""
    if rule not in ("replace", "max_output"):
        raise ValueError("rule must be replace or max_output")
    value = [c for c in new.columns if c not in (*keys, seq)]
    rows = old.withColumn(seq, F.lit(-1).cast("long")).unionByName(new.withColumn(seq, F.col(seq).cast("long")))
    order = F.struct(F.col(seq)) if rule == "replace" else F.struct(F.coalesce(F.col(output), F.lit(-1)).alias("o"), (-F.col(seq)).alias("s"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), order).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value])


def keep_last_runs(runs: DataFrame, n: int = 20, order: str = "started_at", running: str | None = None) -> DataFrame:
    """The newest ``n`` runs, and those that still run. The newest are found by a top-n, not by sorting
    the table in one task."""
    done = runs.filter(~F.col(running)) if running else runs
    newest = done.orderBy(F.desc(order), F.desc("run_id")).limit(n)
    return newest.unionByName(runs.filter(F.col(running))) if running else newest


def thin_capacity(samples: DataFrame, now_ms: int, after_ms: int = 30 * 86_400_000) -> DataFrame:
    """Samples older than ``after_ms`` thinned to the last of each source, stream, window and hour."""
    old = F.col("observed_at") < now_ms - after_ms
    key = ["source", "stream_key", "window"]
    value = [c for c in samples.columns if c not in key]
    hourly = samples.filter(old).groupBy(*key, F.floor(F.col("observed_at") / 3_600_000).alias("_hour")).agg(F.max_by(F.struct(*value), "observed_at").alias("_v"))
    return samples.filter(~old).unionByName(hourly.select(*key, *[F.col(f"_v.{c}").alias(c) for c in value]))


def expired(rows: DataFrame, now_ms: int, days: int, at: str = "observed_at") -> DataFrame:
    """Rows past their retention."""
    return rows.filter(F.col(at) < now_ms - days * 86_400_000)


