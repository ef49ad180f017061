"""Costs and trends: beyond what the counting needs, from its specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CLASSES = {"uncached_input_tokens": "input", "cache_read_input_tokens": "cache_read", "cache_write_input_tokens": "cache_write", "output_tokens": "output"}


def list_price(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Micro-dollars of each event by a price table (model, price_version, and micro-dollars of a
    million tokens for input, cache_read, cache_write, output). An unknown model, count or price
    makes the cost unknown, never 0."""
    cost = F.lit(0).cast("long")
    for tokens, price in _CLASSES.items():
        cost = cost + F.when(F.col(tokens) == 0, F.lit(0)).otherwise(F.col(tokens) * F.col(f"_{price}"))
    known = prices.select("model", "price_version", *[F.col(p).cast("long").alias(f"_{p}") for p in _CLASSES.values()])
    return events.join(known, "model", "left").withColumn("cost_micro_usd", F.floor((cost + 500_000) / 1_000_000).cast("long")).drop(*[f"_{p}" for p in _CLASSES.values()])


def cost_rollup(costs: DataFrame, group: list[str]) -> DataFrame:
    """Known cost and unknown requests by basis: bases are never added together. Of several price
    versions of a scope the newest counts; a session's own figure counts only where its requests have
    none."""
    newest = costs.groupBy(*group, "scope_kind", "scope_id", "session_key", "basis").agg(F.max_by("cost_micro_usd", "price_version").alias("cost_micro_usd"))
    requests = newest.filter("scope_kind = 'request'")
    sessions = newest.filter("scope_kind = 'session'").join(requests.select("session_key", "basis").distinct(), ["session_key", "basis"], "left_anti")
    return requests.unionByName(sessions).groupBy(*group, "basis").agg(F.coalesce(F.sum("cost_micro_usd"), F.lit(0)).alias("cost_micro_usd"), F.count_if(F.col("cost_micro_usd").isNull()).alias("unknown_costs"))


def shown_as(basis: Column, route: Column) -> Column:
    """What a cost is called, by its basis and the billing route of its requests: only a real bill is spend."""
    return (
        F.when(basis == "actual_billed", "spend").when(route == "api_key", "estimated bill").when(route == "subscription", "list-price equivalent")
        .otherwise("list-price value, billing route unknown")
    )


def burn_rate(samples: DataFrame, series: list[str]) -> DataFrame:
    """Points of quota used between neighbouring readings of one window instance, per hour, and the
    hours until nothing is left at that pace. A reset or a fall gives no rate."""
    w = Window.partitionBy(*series).orderBy("observed_at")
    same = F.lag("resets_at").over(w).eqNullSafe(F.col("resets_at"))
    used, ms = F.col("used_pct") - F.lag("used_pct").over(w), F.col("observed_at") - F.lag("observed_at").over(w)
    rate = F.when(same & (used >= 0) & (ms > 0), used * 3_600_000 / ms)
    return samples.withColumn("pct_per_hour", rate).withColumn("hours_left", F.when(F.col("pct_per_hour") > 0, (100 - F.col("used_pct")) / F.col("pct_per_hour")))


def burn_alerts(samples: DataFrame, series: list[str], now_ms: int, least_pct_per_hour: float = 0.0) -> DataFrame:
    """``series, observed_at, used_pct, resets_at, pct_per_hour, hours_left, hours_to_reset``: running instances of which, at the pace
    between their last two readings, nothing is left before they reset. Without a reset time, a pace of at least
    ``least_pct_per_hour`` or a second reading nothing is said."""
    paced = burn_rate(samples, series)
    value = F.struct("observed_at", "used_pct", "resets_at", "pct_per_hour", "hours_left")
    newest = paced.groupBy(*series).agg(F.max_by(value, "observed_at").alias("_v")).select(*series, "_v.*")
    to_reset = (F.col("resets_at") - now_ms) / 3_600_000
    left = newest.filter((F.col("resets_at") > now_ms) & (F.col("pct_per_hour") > least_pct_per_hour)).withColumn("hours_to_reset", to_reset)
    return left.filter(F.col("hours_left") - (F.lit(now_ms) - F.col("observed_at")) / 3_600_000 < F.col("hours_to_reset"))


def largest_drop(samples: DataFrame, series: list[str], max_age_ms: int) -> DataFrame:
    """The largest fall of what is left between two readings of a window instance no further apart than
    ``max_age_ms``."""
    w = Window.partitionBy(*series, "resets_at").orderBy("observed_at").rangeBetween(-max_age_ms, 0)
    drop = F.col("used_pct") - F.min("used_pct").over(w)
    return samples.filter("resets_at IS NOT NULL AND used_pct IS NOT NULL").withColumn("_drop", drop).groupBy(*series).agg(F.max("_drop").alias("largest_drop"))


def rate_anomalies(rates: DataFrame, group: list[str], value: str, factor: float = 3.5) -> DataFrame:
    """Rows whose value lies far above their group's median, in units of its median deviation."""
    mid = rates.groupBy(*group).agg(F.percentile_approx(value, 0.5, 10_000).alias("_mid"))
    off = rates.join(mid, group).withColumn("_off", F.abs(F.col(value) - F.col("_mid")))
    spread = off.groupBy(*group).agg(F.percentile_approx("_off", 0.5, 10_000).alias("_spread"))
    return off.join(spread, group).filter((F.col(value) - F.col("_mid")) * 0.6745 > factor * F.col("_spread")).drop("_mid", "_off", "_spread")
