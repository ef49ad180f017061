"""The contract of a source of requests: a reader of logs, of which any number are collected as one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.upserts import upsert_by_rule
from meterlake.sources import session_log, transcript

#: What every reader's observations have; absent columns are null.
COLUMNS = (
    "source string, stream_key string, source_request_key string, provider_request_key string, confidence string, observed_at long, harness string, provider string, model string, "
    "session_key string, uncached_input_tokens long, cache_read_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, native map<string,double>, auxiliary boolean")
_KEY = ["source", "stream_key", "source_request_key"]


@runtime_checkable
class Reader(Protocol):
    """``primary``: its requests count; those of others only support them. ``rule`` says which of several rows of one request
    counts: ``replace`` (the last) or ``max_output`` (the one with most output)."""

    name: str
    primary: bool
    rule: str

    def observations(self, lines: DataFrame) -> DataFrame:
        """Requests out of parsed lines (``v, file, line``): a subset of :data:`COLUMNS`."""
        ...

    def wants(self) -> tuple[str, ...]:
        """Strings of which a line must hold one to be parsed; none for all lines."""
        ...


@dataclass
class Transcripts:
    """Transcript logs of one harness and provider."""

    name: str
    harness: str
    provider: str
    secret: bytes
    primary: bool = True
    rule: str = "max_output"

    def observations(self, lines: DataFrame) -> DataFrame:
        return transcript.observations(lines, self.name, self.harness, self.provider, self.secret)

    def wants(self) -> tuple[str, ...]:
        return ()


@dataclass
class SessionLogs:
    """Session logs of one harness; ``providers`` gives plain names to those in the log."""

    name: str
    harness: str
    providers: dict[str, str] = field(default_factory=dict)
    primary: bool = True
    rule: str = "replace"

    def observations(self, lines: DataFrame) -> DataFrame:
        return session_log.observations(lines, self.name, self.harness, self.providers)

    def wants(self) -> tuple[str, ...]:
        return session_log.MUST_HOLD


def collect(readers: Sequence[tuple[Reader, DataFrame]]) -> DataFrame:
    """Requests of all readers, each from its own lines (:func:`meterlake.sources.transcript.read_lines`), with ``primary``: one row for
    each source, stream and request key, by its reader's rule. Readers must have names of their own."""
    names = [reader.name for reader, _ in readers]
    if len(set(names)) < len(names) or not names:
        raise ValueError("readers need names, each its own")
    return reduce(DataFrame.unionByName, [_collected(reader, lines) for reader, lines in readers])


def _collected(reader: Reader, lines: DataFrame) -> DataFrame:
    found = reader.observations(transcript.parsed(lines, reader.wants()))
    fields = lines.sparkSession.createDataFrame([], COLUMNS).schema
    strange = set(found.columns) - set(fields.names)
    if strange:
        raise ValueError(f"{reader.name} gives unknown columns: {', '.join(sorted(strange))}")
    full = found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    one = upsert_by_rule(full.limit(0), full.withColumn("seq", F.col("observed_at")), _KEY, reader.rule)
    return one.withColumn("primary", F.lit(reader.primary))


def written_lines(lines: DataFrame, path: str) -> None:
    """Write lines (``value, file, line``) as text files of many logs each, a line behind the name of its log and a tab; those of a
    log lie in one file, in order. The number of files follows the amount of text, not the number of logs. A value that
    holds line breaks is as many lines; a null is an empty one."""
    ordered = lines.repartition("file").sortWithinPartitions("file", "line")
    texts = ordered.select(F.url_encode("file").alias("log"), F.explode(F.split(F.coalesce("value", F.lit("")), "\\r\\n|\\r|\\n")).alias("text"))
    texts.select(F.concat("log", F.lit("\t"), "text").alias("value")).write.text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Lines as :func:`written_lines` wrote them, with the names of their logs."""
    named = transcript.read_lines(spark, path, "*.txt")
    return named.select(F.expr("substring(value, instr(value, '\t') + 1)").alias("value"), F.url_decode(F.substring_index("value", "\t", 1)).alias("file"), "line")
