"""Constraints as queries: every function gives the rows or keys that break one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.measures import MEASURES
from meterlake.schemas import WINDOW_PATTERN


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def null_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])



def not_in(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)



def attribution_rule() -> Column:
    """A value stands exactly where the state is attributed."""
    return (F.col("state") == "attributed") != F.col("value").isNotNull()


def price_rule() -> Column:
    """A price version stands exactly where the cost is of a price list."""
    return (F.col("basis") == "list_price") != (F.col("price_version") != "")


def link_rule() -> Column:
    """Supporting links name no field, metadata links one."""
    return (F.col("role") == "metadata") != (F.col("field") != "")


def several(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that hold more than one known ``value``: of links, an observation that supports several events, or
    a field that several sources give."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("n")).filter("n > 1")


def usage_rules() -> dict[str, Column]:
    """Reasoning is part of the output."""
    return {"reasoning above output": F.col("reasoning_output_tokens") > F.col("output_tokens")}


def not_within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``measure, inner, outer`` of every measure of which a part (usage without auxiliary calls, say) is more
    than the whole; both are rows of totals."""
    sides = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"i.{c}").alias("inner"), F.col(f"o.{c}").alias("outer")) for c in MEASURES])
    # One row on either side.
    return inner.alias("i").crossJoin(outer.alias("o")).select(F.inline(sides)).filter("inner > outer")


def capacity_rules() -> dict[str, Column]:
    return {"used_pct out of range": F.col("used_pct").isNotNull() & ~F.col("used_pct").between(0, 100), "window name": ~F.col("window").rlike(WINDOW_PATTERN)}


def key_rules() -> dict[str, Column]:
    return {"account key": ~F.col("account_key").rlike("^[0-9a-f]{32}$")}


def session_rule() -> Column:
    return F.col("session_key") != F.concat_ws(":", "harness", "session_id")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n``: how many rows break each rule, in one pass."""
    counted = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules])
    return counted.select(F.inline(pairs))


def usage_invariants(rows: DataFrame, total: DataFrame) -> DataFrame:
    """``measure, rows_sum, total`` of every measure whose rows do not add up to the total."""
    summed = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in MEASURES])
    sides = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"r.{c}").alias("rows_sum"), F.col(f"t.{c}").alias("total")) for c in MEASURES])
    # One row on either side.
    return summed.alias("r").crossJoin(total.alias("t")).select(F.inline(sides)).filter("rows_sum <> total")
