"""Since I last looked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.upserts import upsert_coalesce


def since_last_look(looks: DataFrame) -> DataFrame:
    """From when a reader (who, view) counts: the end of the last look; where that is unknown, when it
    was last seen or begun, and then ``assumed``; null without any."""
    basis = F.when(F.col("closed_at").isNotNull(), "closed").when(F.col("last_seen_at").isNotNull(), "last_seen").when(F.col("opened_at").isNotNull(), "opened").otherwise("none")
    return looks.select("who", "view", F.coalesce("closed_at", "last_seen_at", "opened_at").alias("since_ms"), basis.alias("basis"), basis.isin("last_seen", "opened").alias("assumed"))


def record_looks(looks: DataFrame, actions: DataFrame) -> DataFrame:
    """Bookmarks after ``open``, ``touch`` and ``close`` actions (who, view, action, at, seq). Opening
    forgets when the last look ended."""
    seen = actions.select("who", "view", "seq", F.when(F.col("action") == "open", F.col("at")).alias("opened_at"), F.col("at").alias("last_seen_at"), F.when(F.col("action") == "close", F.col("at")).alias("closed_at"))
    opened = actions.filter("action = 'open'").groupBy("who", "view").agg(F.max("seq").alias("_open"))
    kept = upsert_coalesce(looks, seen, ["who", "view"])
    closed = actions.filter("action = 'close'").groupBy("who", "view").agg(F.max("seq").alias("_close"))
    out = kept.join(opened, ["who", "view"], "left").join(closed, ["who", "view"], "left")
    return out.withColumn("closed_at", F.when(F.col("_open").isNotNull() & (F.coalesce("_close", F.lit(-1)) < F.col("_open")), F.lit(None)).otherwise(F.col("closed_at"))).drop("_open", "_close")
