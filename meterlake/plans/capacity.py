"""What is left of each quota window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import account_label, age_text
from meterlake.schemas import DEFAULT_DISPLAY_AGE_MS

_SERIES = ["source", "stream_key", "window"]


def display_age(ages: dict[str, int] | None, default: int | None = DEFAULT_DISPLAY_AGE_MS) -> Column:
    """The display age of a source; the default (or null) for undeclared ones."""
    out = F.lit(default).cast("long")
    for source, ms in (ages or {}).items():
        out = F.when(F.col("source") == source, F.lit(ms).cast("long")).otherwise(out)
    return out


def with_account(samples: DataFrame, effective: DataFrame | None) -> DataFrame:
    """Samples with ``account`` and ``account_state`` of their own attribution, joined on the columns
    of the sample's key (source, stream_key, window, observed_at)."""
    if effective is None:
        return samples.withColumn("account", F.lit(None).cast("string")).withColumn("account_state", F.lit("unattributed"))
    known = effective.select(*_SERIES, "observed_at", F.col("state").alias("_s"), F.col("value").alias("_v"))
    out = samples.join(known, [*_SERIES, "observed_at"], "left")
    return out.withColumn("account", F.when(F.col("_s") == "attributed", F.col("_v"))).withColumn("account_state", F.coalesce("_s", F.lit("unattributed"))).drop("_s", "_v")


def pools(samples: DataFrame, now_ms: int, effective: DataFrame | None = None, accounts: DataFrame | None = None, ages: dict[str, int] | None = None) -> DataFrame:
    """The newest reading of each account and window; readings without an account stand by source.
    Series are reduced before any lookup, so the join sees one row for each."""
    value = [c for c in samples.columns if c not in _SERIES]
    newest = samples.groupBy(*_SERIES).agg(F.max_by(F.struct(*value), "observed_at").alias("_v")).select(*_SERIES, *[F.col(f"_v.{c}").alias(c) for c in value])
    rows = with_account(newest, effective)
    group = [F.coalesce("account", F.lit("")).alias("_account"), F.when(F.col("account").isNull(), F.col("source")).otherwise("").alias("_source"), F.col("window").alias("_window")]
    best = rows.groupBy(*group).agg(F.max_by(F.struct(*rows.columns), F.struct("observed_at", "source", "stream_key")).alias("_r")).select("_r.*")
    if accounts is not None:
        best = best.join(accounts.select(F.col("account_key").alias("account"), "label", "provider"), "account", "left")
    else:
        best = best.withColumn("label", F.lit(None).cast("string")).withColumn("provider", F.lit(None).cast("string"))
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.col("observed_at"))
    limit = display_age(ages)
    named = F.when(F.col("account").isNotNull(), account_label(F.col("label"), F.col("provider"), F.col("account"))).otherwise(F.concat(F.col("account_state"), F.lit(" ("), F.col("source"), F.lit(")")))
    return best.select("account", named.alias("account_label"), F.when(F.col("account").isNotNull(), "attributed").otherwise(F.col("account_state")).alias("account_state"),
                       "window", "used_pct", F.round(100 - F.col("used_pct"), 2).alias("remaining_pct"), "resets_at", "status", "source", "confidence", "observed_at",
                       F.round(age / 1000, 1).alias("age_s"), age_text(age / 1000).alias("age"), limit.alias("display_age_ms"), (age > limit).alias("stale"))


def ordered(pools_: DataFrame) -> DataFrame:
    """Attributed first, by label, then session, weekly and other windows."""
    rank = F.when(F.col("window") == "session", 0).when(F.col("window") == "weekly", 1).otherwise(2)
    return pools_.orderBy(F.col("account").isNull(), F.coalesce("account_label", F.lit("")), rank, "window")


def anchors(samples: DataFrame, now_ms: int, since_ms: int, effective: DataFrame | None = None, ages: dict[str, int] | None = None) -> DataFrame:
    """Readings since a time with what is left, whether their window still runs, and whether they are
    fresh. A reading without a reset time is not current; a source without a declared age is never
    fresh."""
    rows = with_account(samples.filter(F.col("observed_at") >= since_ms), effective)
    return rows.withColumn("remaining_pct", 100 - F.col("used_pct")).withColumn("current", F.coalesce(F.col("resets_at") > now_ms, F.lit(False))).withColumn(
        "fresh", F.coalesce(F.lit(now_ms) - F.col("observed_at") <= display_age(ages, None), F.lit(False)))


def threshold_alerts(anchors_: DataFrame, now_ms: int, thresholds: tuple[int, ...] = (20, 5), fired: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One alert for each account and window whose newest fresh reading is at or below a threshold: the
    most severe one crossed, unless every crossed one has fired for this window instance; and the new
    fired rows (account, window, resets_at, threshold). Ended instances say nothing."""
    fresh = anchors_.filter("fresh AND account IS NOT NULL")
    newest = fresh.groupBy("account", "window").agg(F.max_by(F.struct("remaining_pct", "resets_at", "source", "observed_at"), F.struct("observed_at", "source", "stream_key")).alias("a")).select("account", "window", "a.*")
    open_ = newest.filter(F.col("remaining_pct").isNotNull() & (F.col("resets_at").isNull() | (F.col("resets_at") > now_ms)))
    crossed = open_.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in sorted(thresholds)]))).filter("remaining_pct <= threshold")
    if fired is None:
        unfired = crossed
    else:
        old = fired.select(F.col("account").alias("_a"), F.col("window").alias("_w"), F.col("resets_at").alias("_r"), F.col("threshold").alias("_t"))
        unfired = crossed.join(old, (F.col("account") == F.col("_a")) & (F.col("window") == F.col("_w")) & F.col("resets_at").eqNullSafe(F.col("_r")) & (F.col("threshold") == F.col("_t")), "left_anti")
    some = unfired.select("account", "window").distinct()
    worst = crossed.join(some, ["account", "window"]).groupBy("account", "window").agg(F.min("threshold").alias("threshold"), F.first("remaining_pct").alias("remaining_pct"), F.first("resets_at").alias("resets_at"), F.first("source").alias("source"))
    return worst, unfired.select("account", "window", "resets_at", "threshold")
