"""Logs that grow, as a stream: a data source that remembers how far each file was read.

An offset is ``{file: [inode, bytes]}``. A last line without its end waits; a file that was replaced or
became shorter is read from its start, which is safe because later writes are keyed. Files are listed
on the driver, which reads no more of them than the end of each; the lines are read in tasks, one
byte range each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_CHUNK = 65_536


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


def complete_length(file: str) -> int:
    """Bytes of a file up to the end of its last complete line."""
    with open(file, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            begin = max(0, at - _CHUNK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.split = int(options.get("splitbytes", 64_000_000))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for folder, _, names in os.walk(self.path):
            for name in sorted(names):
                if name.endswith(self.suffix):
                    file = os.path.join(folder, name)
                    found[file] = [os.stat(file).st_ino, complete_length(file)]
        return found

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for file, (inode, size) in sorted(end.items()):
            old_inode, done = start.get(file, [inode, 0])
            begin = 0 if inode != old_inode or size < done else done
            out += [_Range(file, at, min(at + self.split, size)) for at in range(begin, size, self.split)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        """Lines that begin in the range."""
        with open(part.file, "rb") as f:
            if part.start:
                f.seek(part.start - 1)
                if f.read(1) != b"\n":
                    f.readline()
            while (at := f.tell()) < part.end:
                line = f.readline()
                if line.endswith(b"\n"):
                    yield line.rstrip(b"\r\n").decode("utf-8", "replace"), part.file, at


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").option("path", folder)``: value, file, line (its byte)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "value string, file string, line long"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
