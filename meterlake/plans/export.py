"""Rollups that leave the store: only dimensions of few values, or values that are allowed by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What must never be a dimension of an exported metric, whatever its number of values.
NEVER = ("session_key", "pane", "request_key", "provider_request_key", "branch", "worktree", "task", "issue", "pull_request", "commit", "cwd")
OTHER = "other"


def cardinalities(rows: DataFrame, dims: list[str]) -> DataFrame:
    """``dimension, distinct``: how many values each dimension has, by one pass of mergeable sketches (under 2 % off at
    the default size). Nulls count as none."""
    sketched = rows.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(d).cast("string"), 12)).alias(d) for d in dims])
    return sketched.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*[F.coalesce(F.col(d), F.lit(0).cast("long")) for d in dims]))).alias("dimension", "distinct"))


def heavy_values(rows: DataFrame, dim: str, value: str, share: float) -> DataFrame:
    """The values of a dimension that hold at least ``share`` of the whole: at most ``1 / share`` of them."""
    sums = rows.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum(value).alias("_n"))
    whole = rows.agg(F.sum(value).alias("_whole"))
    return sums.join(F.broadcast(whole)).filter((F.col("_n") > 0) & (F.col("_n") >= F.lit(share) * F.col("_whole"))).select(dim)


def rollup(rows: DataFrame, dims: list[str], measures: list[str], limit: int = 100, allowed: dict[str, list[str]] | None = None, heavy: dict[str, float] | None = None, rest: str = "other") -> DataFrame:
    """Sums of ``measures`` by those of ``dims`` that may be exported, and ``requests``.

    A dimension of at most ``limit`` values goes out as it is. Of one with more, the values in ``allowed`` (a fixed list,
    by dimension) do, or those with at least the share of the first measure that ``heavy`` has for it; other rows become
    ``other``, so that totals stay as they are, or with ``rest="drop"`` are not exported. With neither such a dimension is
    left out. A list also binds a dimension of few values. Null is a value that always goes out."""
    refused = [d for d in dims if d in NEVER]
    if refused:
        raise ValueError(f"never a dimension of a metric: {', '.join(refused)}")
    if rest not in ("other", "drop"):
        raise ValueError("rest must be other or drop")
    counted = {r["dimension"]: r["distinct"] for r in cardinalities(rows, dims).collect()}  # a row for each dimension
    out, kept = rows, []
    for d in dims:
        names, share = (allowed or {}).get(d), (heavy or {}).get(d)
        if names is None and counted[d] <= limit:
            kept.append(d)
            continue
        if names is None and share is None:
            continue
        value = F.col(d).cast("string")
        if names is not None:
            known = value.isNull() | value.isin(names)
        else:
            few = heavy_values(out, d, measures[0], share).select(F.col(d).alias("_v"), F.lit(True).alias("_heavy"))
            out = out.join(F.broadcast(few), F.col(d) == F.col("_v"), "left")
            known = value.isNull() | F.col("_heavy").isNotNull()
        out = out.filter(known) if rest == "drop" else out.withColumn("_known", known).withColumn(d, F.when(F.col("_known"), value).otherwise(OTHER))
        out = out.drop("_v", "_heavy", "_known")
        kept.append(d)
    return out.groupBy(*kept).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures], F.count("*").alias("requests"))
