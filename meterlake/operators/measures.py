"""Null-honest sums: what is known, and how many requests are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.schemas import COMPONENTS, INPUT_PARTS, TOKEN_FIELDS


def partial_sum(column: str) -> list[Column]:
    """Known sum, count of unknowns, and whether all are known."""
    return [F.coalesce(F.sum(column), F.lit(0)).alias(column), F.count_if(F.col(column).isNull()).alias(f"unknown_{column}"), F.coalesce(F.bool_and(F.col(column).isNotNull()), F.lit(True)).alias("complete")]


def usage_measures() -> list[Column]:
    """Fourteen sums in one aggregation: each token field with its unknowns, total input, requests."""
    known = F.lit(True)
    for c in INPUT_PARTS:
        known = known & F.col(c).isNotNull()
    whole = F.lit(True)
    for c in COMPONENTS:
        whole = whole & F.col(c).isNotNull()
    total = F.when(known, sum((F.col(c) for c in INPUT_PARTS[1:]), F.col(INPUT_PARTS[0])))
    out = []
    for c in TOKEN_FIELDS:
        out += [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c), F.count_if(F.col(c).isNull()).alias(f"unknown_{c}")]
    return [*out, F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("total_input_tokens"), F.count_if(~known).alias("unknown_total_input"),
            F.count_if(~whole).alias("unknown_requests"), F.count("*").alias("requests")]


MEASURES = [x for c in TOKEN_FIELDS for x in (c, f"unknown_{c}")] + ["total_input_tokens", "unknown_total_input", "unknown_requests", "requests"]


def merged_measures() -> list[Column]:
    """Sums of partial measures."""
    return [F.sum(c).cast("long").alias(c) for c in MEASURES]


def in_range(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None, include_auxiliary: bool = True) -> DataFrame:
    """Events of ``[since, until)``; either bound may be open. Auxiliary requests can be left out."""
    if since_ms is not None:
        events = events.filter(F.col("observed_at") >= since_ms)
    if until_ms is not None:
        events = events.filter(F.col("observed_at") < until_ms)
    return events if include_auxiliary else events.filter(~F.col("auxiliary"))
