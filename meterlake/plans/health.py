"""Whether the collecting jobs run, and what they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALLED_AFTER_MS = 30_000


def pipeline_health(runs: DataFrame, status: DataFrame, now_ms: int) -> DataFrame:
    """One row: ``running`` if the newest run's heartbeat is younger than thirty seconds, ``stopped`` if
    it ended, else ``stalled``; and up to when the data are, the newest success of any source."""
    newest = runs.agg(F.max_by(F.struct("run_id", "heartbeat_at", "stopped_at"), "started_at").alias("r")).select("r.*")
    state = F.when(F.col("run_id").isNull(), "never ran").when(F.col("stopped_at").isNotNull(), "stopped").when(F.lit(now_ms) - F.col("heartbeat_at") < STALLED_AFTER_MS, "running").otherwise("stalled")
    as_of = status.agg(F.max("last_success_at").alias("data_as_of"))
    return newest.select("run_id", state.alias("state"), "heartbeat_at").crossJoin(as_of)  # one row on either side


def batch_status(batches: DataFrame) -> DataFrame:
    """``source, last_run_at, last_success_at, last_new_data_at, error_kind`` from batch records (source,
    at, items, error_kind). New data are noted only where there were items; an error tells its kind and
    no values."""
    ok = F.col("error_kind").isNull()
    return batches.groupBy("source").agg(
        F.max("at").alias("last_run_at"), F.max(F.when(ok, F.col("at"))).alias("last_success_at"), F.max(F.when(ok & (F.col("items") > 0), F.col("at"))).alias("last_new_data_at"),
        F.max_by("error_kind", "at").alias("error_kind"))


def source_report(status: DataFrame, orphans: DataFrame) -> DataFrame:
    """Status of every source with its orphan observations."""
    return status.join(orphans, "source", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
