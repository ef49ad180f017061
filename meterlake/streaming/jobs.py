"""Streaming writes: rows are appended exactly once by Spark's own file sink, and the current rows of a keyed table are
one reduction over what was appended.

No counted row is ever dropped for being late: an old batch merges as a new one does, as the rule that reduces
the rows looks at what they say and not at when they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.operators.upserts import upsert_by_rule, upsert_coalesce


def append(stream: DataFrame, path: str, checkpoint: str, name: str | None = None, once: bool = True) -> StreamingQuery:
    """Append a stream's rows to Parquet files. A batch is seen as a whole or not at all, and one that is run again
    replaces itself, by the sink's own log; ``once`` takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(appended: DataFrame, keys: list[str], seq: str, rule: str = "coalesce", always: tuple[str, ...] = ()) -> DataFrame:
    """The current rows of what was appended: ``coalesce`` (a later null erases nothing, but in the columns of ``always``),
    ``replace`` or ``max_output``; ``seq`` is the column that orders the rows of a key."""
    rows = appended if seq == "seq" else appended.withColumnRenamed(seq, "seq")
    none = rows.drop("seq").limit(0)
    return upsert_coalesce(none, rows, keys, "seq", always) if rule == "coalesce" else upsert_by_rule(none, rows, keys, rule)


def compacted(spark: SparkSession, path: str, into: str, keys: list[str], seq: str) -> DataFrame:
    """The newest whole row of each key of ``path``, written to a fresh path, from which a table whose rule is ``replace``
    may go on; readers of the old path are not disturbed."""
    rows = spark.read.parquet(path)
    value = [c for c in rows.columns if c not in keys]
    rows.groupBy(*keys).agg(F.max_by(F.struct(*value), seq).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value]).write.parquet(into)
    return spark.read.parquet(into)
