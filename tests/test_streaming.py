"""Streams give what the batch operators give, whatever the batches."""

import os

import pytest

from meterlake.sources import tail
from meterlake.streaming import jobs


def appended(spark, tmp_path, batches, schema):
    """What a stream appends that takes the batches one after the other, started again for each."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "table").awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_appended_rows_make_a_keyed_table(spark, tmp_path):
    schema = "k long, at long, name string, output_tokens long"
    rows = appended(spark, tmp_path, [[(1, 1, "a", 5), (2, 1, None, 1)], [(1, 2, None, 7), (3, 2, "c", None)]], schema)
    assert rows.count() == 4
    assert sorted(map(tuple, jobs.current(rows, ["k"], "at").select("k", "name", "output_tokens").collect())) == [(1, "a", 7), (2, None, 1), (3, "c", None)]
    small = jobs.compacted(spark, str(tmp_path / "out"), str(tmp_path / "small"), ["k"], "at")
    assert sorted(map(tuple, small.select("k", "at", "name", "output_tokens").collect())) == [(1, 2, None, 7), (2, 1, None, 1), (3, 2, "c", None)]


def test_max_output_never_regresses(spark, tmp_path):
    rows = appended(spark, tmp_path, [[(1, 1, "large", 120)], [(1, 2, "late and small", 2)]], "k long, seq long, name string, output_tokens long")
    assert [tuple(r) for r in jobs.current(rows, ["k"], "seq", "max_output").select("name", "output_tokens").collect()] == [("large", 120)]


def test_tail_waits_for_whole_lines_and_restarts(spark, tmp_path):
    tail.register(spark)
    log = tmp_path / "logs" / "a.jsonl"
    log.parent.mkdir()

    def lines():
        out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
        stream = spark.readStream.format("jsonl_tail").option("path", str(log.parent)).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    log.write_text("one\ntwo\nhal")
    assert lines() == ["one", "two"]
    with open(log, "a") as f:
        f.write("f\nlast\n")
    assert lines() == ["half", "last", "one", "two"]
    os.replace(log, tmp_path / "old")
    log.write_text("new\n")
    assert lines() == ["half", "last", "new", "one", "two"]


@pytest.mark.parametrize("split", [1, 3, 100])
def test_tail_ranges_cover_each_line_once(tmp_path, split):
    file = tmp_path / "x.jsonl"
    file.write_text("a\nbb\n\nccc\npartial")
    reader = tail._Reader({"path": str(tmp_path), "splitbytes": str(split)})
    parts = reader.partitions({}, reader.latestOffset())
    assert [v for p in parts for v, _, _ in reader.read(p)] == ["a", "bb", "", "ccc"]
