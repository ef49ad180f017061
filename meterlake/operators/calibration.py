"""How much quota a token takes: pairs of readings, the usage between them, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.sequences import running_sums

#: Names the rule by which estimates are made; a change to the rule takes the next number.
ESTIMATOR_VERSION = 1


def reading_pairs(readings: DataFrame, usage: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """``account, window, resets_at, from_at, to_at, from_pct, to_pct, tokens``: each reading of an instance of a window and the one after
    it (``to_`` columns null for the last one), with the account's tokens after the first and up to the second,
    or up to the newest usage.

    ``readings`` have ``account, window, resets_at, observed_at, used_pct``, ``usage`` ``account, observed_at, tokens``. One sweep of both by
    time gives each reading the account's tokens so far; no reading is joined with a range of usage. Rows
    without an account or a percentage say nothing; of readings at one time the largest counts."""
    known = readings.filter("account IS NOT NULL AND used_pct IS NOT NULL").groupBy("account", "window", "resets_at", "observed_at").agg(F.max("used_pct").alias("used_pct"))
    marks = known.select("account", "observed_at", F.struct("window", "resets_at", "used_pct").alias("_r"), F.lit(None).cast("long").alias("tokens"))
    spent = usage.filter("account IS NOT NULL").select("account", "observed_at", F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"), F.col("tokens").cast("long").alias("tokens"))
    swept = running_sums(marks.unionByName(spent), ["account"], "observed_at", ["tokens"], bucket_ms).withColumnRenamed("tokens_so_far", "so_far")
    whole = spent.groupBy("account").agg(F.sum("tokens").alias("_whole"))
    read = swept.filter("_r IS NOT NULL").select("account", "_r.*", "observed_at", "so_far")
    w = Window.partitionBy("account", "window", "resets_at").orderBy("observed_at")
    after = read.withColumn("to_at", F.lead("observed_at").over(w)).withColumn("to_pct", F.lead("used_pct").over(w)).withColumn("_next", F.lead("so_far").over(w))
    told = after.join(whole, "account", "left")
    return told.select("account", "window", "resets_at", F.col("observed_at").alias("from_at"), "to_at", F.col("used_pct").alias("from_pct"), "to_pct",
                       (F.coalesce(F.when(F.col("to_at").isNull(), F.coalesce("_whole", F.lit(0))), F.col("_next")) - F.col("so_far")).cast("long").alias("tokens"))


def ratios(pairs: DataFrame) -> DataFrame:
    """``account, window, pct_per_token, spread, pairs, calibrated_at``: the median over an account's pairs in which both grew, and the median
    distance from it; a few pairs that other usage disturbed do not move it."""
    both = pairs.filter("to_at IS NOT NULL AND tokens > 0 AND to_pct > from_pct").withColumn("_x", (F.col("to_pct") - F.col("from_pct")) / F.col("tokens"))
    middle = both.groupBy("account", "window").agg(F.median("_x").alias("pct_per_token"), F.count("*").alias("pairs"), F.max("to_at").alias("calibrated_at"))
    off = both.join(middle, ["account", "window"]).groupBy("account", "window").agg(F.median(F.abs(F.col("_x") - F.col("pct_per_token"))).alias("spread"))
    return middle.join(off, ["account", "window"])


def estimates(pairs: DataFrame, now_ms: int) -> DataFrame:
    """What is used by now of each running instance of a window: ``account, window, resets_at, anchor_at, anchor_pct, tokens, estimate_pct,
    error_pct, calibrated_at, estimator_version``. It starts from the last reading and takes the tokens since at the account's
    ratio; 100 at most, null without a ratio. For views and alerts only: an estimate is no reading."""
    last = pairs.filter("to_at IS NULL").filter(F.col("resets_at") > now_ms)
    joined = last.join(ratios(pairs), ["account", "window"], "left")
    return joined.select("account", "window", "resets_at", F.col("from_at").alias("anchor_at"), F.col("from_pct").alias("anchor_pct"), "tokens",
                         F.when(F.col("pct_per_token").isNotNull(), F.least(F.lit(100.0), F.col("from_pct") + F.col("tokens") * F.col("pct_per_token"))).alias("estimate_pct"), (F.col("tokens") * F.col("spread")).alias("error_pct"),
                         "calibrated_at", F.when(F.col("pct_per_token").isNotNull(), F.lit(ESTIMATOR_VERSION)).alias("estimator_version"))


def jumps(pairs: DataFrame, tolerance_pct: float = 5.0) -> DataFrame:
    """Pairs between which a quota moved by more than ``tolerance_pct`` away from what the usage between them explains, with ``unexplained_pct``
    (positive: usage elsewhere; negative: given back). Without a ratio nothing is said."""
    both = pairs.filter("to_at IS NOT NULL").join(ratios(pairs), ["account", "window"])
    off = both.withColumn("unexplained_pct", F.col("to_pct") - F.col("from_pct") - F.col("tokens") * F.col("pct_per_token"))
    return off.filter(F.abs("unexplained_pct") > tolerance_pct).select(*pairs.columns, "unexplained_pct")
