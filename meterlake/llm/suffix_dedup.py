"""Removal of repeated byte strings with sharded suffix arrays.

Equal strings must meet in one shard. Every window of ``length`` bytes is named by the least hash of
its k-grams; equal windows have equal names, and neighbouring windows mostly share one, so a text
falls into segments of consecutive windows with one name. Segments whose name stands alone and that
do not repeat within themselves hold no repeat. Of the others, segments with equal bytes are counted
as one: if there are several, all their windows are repeats. Names with different segments are put
into shards, and each shard's suffix array, with its common prefixes, shows which windows repeat.
Names whose segments outgrow a shard go window by window through a digest count instead, which gives
the same answer without any group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.staging import staged
from meterlake.llm.suffix_array import repeated_starts
from meterlake.llm.words import mix, slices

#: Bytes of a k-gram; bytes that one suffix array holds, and that one name may bring to a shard.
GRAM, SHARD_BYTES, NAME_BYTES = 32, 1_500_000, 6_000_000
#: Bytes of one text that are cut into segments at once.
PIECE = 2_000_000
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over every window of ``w``, by doubling."""
    size, n = 1, len(x) - w + 1
    while size * 2 <= w:
        x, size = pick(x[: len(x) - size], x[size:]), size * 2
    return pick(x[:n], x[w - size : w - size + n])


def _hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, ``k`` a power of two, by doubling."""
    h, base, size = _LETTER[raw], 0xD6E8FEB86659FD93, 1
    while size < k:
        h = h[: len(h) - size] * np.uint64(base) + h[size:]
        base, size = base * base % 2**64, size * 2
    return mix(h)


def segments(text: bytes, length: int, k: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of a text, piece by piece: their names, first windows, numbers of windows, and
    whether they might repeat within themselves."""
    w, raw = length - k + 1, np.frombuffer(text, np.uint8)
    for lo in range(0, len(raw) - length + 1, PIECE):
        grams = _hashes(raw[lo : lo + PIECE + length - 1], k)
        least = _sliding(grams, w, np.minimum)
        cuts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        names, counts = least[cuts], np.diff(np.append(cuts, len(least)))
        # A segment repeats within itself only if its least k-gram does, no further than a window apart.
        edge = np.zeros(w - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == grams)
        order = np.lexsort((chosen, grams[chosen]))
        value, place = grams[chosen][order], chosen[order]
        twin = (value[1:] == value[:-1]) & (np.diff(place) <= w)
        yield names.view(np.int64), cuts + lo, counts, np.isin(names, value[1:][twin])


def _row_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    # A row is known by identifier and text: a number given to it would not survive another reading.
    return rows.withColumn("row", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("mark", F.xxhash64("text"))


def _repeated(rows: DataFrame) -> bool:
    """Whether some row stands in the table more than once."""
    return rows.groupBy("row", "mark").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0


def _names(rows: DataFrame, length: int) -> DataFrame:
    """``name, n, own``: each name of a task's texts, how often, and whether it may repeat itself."""
    arrow = pa.schema([("name", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                names, own = [], []
                for text in texts:
                    for name, _, _, twin in segments(text, length):
                        names.append(name)
                        own.append(twin)
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(own))], schema=arrow)

    return rows.select("text").mapInArrow(run, "name long, own boolean")


def _segments(rows: DataFrame, length: int) -> DataFrame:
    """``name, row, mark, at, n, digest`` of every segment."""
    arrow = pa.schema([("name", pa.int64()), ("row", pa.int64()), ("mark", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for row, mark, text in zip(part.column("row").to_pylist(), part.column("mark").to_pylist(), texts, strict=True):
                    for name, at, n, _ in segments(text, length):
                        digests = [xxhash.xxh3_128_digest(text[a : a + m + length - 1]) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(at), row)), pa.array(np.full(len(at), mark)), pa.array(at), pa.array(n), pa.array(digests, pa.binary())], schema=arrow)

    return rows.select("row", "mark", "text").mapInArrow(_merged(run), "name long, row long, mark long, at long, n long, digest binary")


def _merged(run):
    """Gather the small batches of ``run`` into larger ones."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += len(batch)
            if size >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """``name, digest, bytes, large`` of the segments (``cuts``) of each text; a text is read once for all of its segments."""
    arrow = pa.schema([("name", pa.int64()), ("digest", pa.binary()), ("bytes", pa.binary()), ("large", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], arrow.field(i).type) for i in range(4)], schema=arrow)

        for batch in batches:
            for part, raw in slices(batch, "text"):
                for cuts, text in zip(part.column("cuts"), raw, strict=True):
                    for c in cuts.as_py():
                        piece = text[c["at"] : c["at"] + c["n"] + length - 1]
                        held.append((c["name"], c["digest"], piece, c["bytes"] > NAME_BYTES))
                        size += len(piece)
                        if size >= PIECE:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    return texts.select("text", "cuts").mapInArrow(run, "name long, digest binary, bytes binary, large boolean")


def _runs(flags: np.ndarray) -> list[dict]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]


_COVER = "name long, digest binary, runs array<struct<a: long, b: long>>"
_COVER_ARROW = pa.schema([("name", pa.int64()), ("digest", pa.binary()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])


def _sharded(parts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of segments (name, digest, bytes), in shards of whole names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def shard() -> pa.RecordBatch:
            found = repeated_starts([h[2] for h in held], length)
            out = [(h[0], h[1], _runs(f)) for h, f in zip(held, found, strict=True) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], _COVER_ARROW.field(i).type) for i in range(3)], schema=_COVER_ARROW)

        for batch in batches:
            for name, digest, part in zip(*(batch.column(c).to_pylist() for c in ("name", "digest", "bytes")), strict=True):
                if size >= SHARD_BYTES and name != last:
                    yield shard()
                    held, size = [], 0
                held.append((name, digest, part))
                size, last = size + len(part), name
        if held:
            yield shard()

    return parts.repartition("name").sortWithinPartitions("name").mapInArrow(run, _COVER)


def _windowed(parts: DataFrame, length: int) -> DataFrame:
    """The same of names too large for a shard: digests of all their windows are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digest, part in zip(*(batch.column(c).to_pylist() for c in ("name", "digest", "bytes")), strict=True):
                n = len(part) - length + 1
                windows = [xxhash.xxh3_128_digest(part[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array(windows, pa.binary())],
                                                 names=["name", "digest", "at", "window"])

    windows = parts.mapInArrow(_merged(run), "name long, digest binary, at long, window binary")
    often = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    hits = windows.join(often, "window").groupBy("name", "digest").agg(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))
    return hits.select("name", "digest", "runs")


def repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans`` (maximal ranges ``[start, end)`` of
    bytes covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another; overlaps count) and ``kept`` (the other bytes, as binary).

    Strings are judged on the input and never cross texts. A null text is empty; a text shorter than
    ``length`` has no spans; repeated rows are texts of their own, and so repeat each other; other
    columns are ignored.
    """
    rows = _row_texts(docs, id_col, text_col)
    names = _names(rows, length).groupBy("name").agg(F.count("*").alias("times"), F.max("own").alias("own")).filter("times > 1 OR own")
    parts = staged(_segments(rows, length).join(names.select("name"), "name"), "segments")

    # Segments of equal bytes are one; the least row and place stands for them.
    distinct = parts.groupBy("name", "digest").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.min(F.struct("row", "mark", "at")).alias("one"))
    distinct = staged(distinct, "distinct-segments")
    kinds = distinct.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes"))
    unlike = distinct.join(kinds, "name").filter("kinds > 1 OR times = 1")
    cut = unlike.groupBy(F.col("one.row").alias("row"), F.col("one.mark").alias("mark")).agg(F.collect_list(F.struct("name", "digest", F.col("one.at").alias("at"), "n", "bytes")).alias("cuts"))
    shown = _cut(cut.join(rows.select("row", "mark", "text"), ["row", "mark"]), length)
    shown = staged(shown.dropDuplicates(["name", "digest"]) if _repeated(rows) else shown, "segment-bytes")
    found = _sharded(shown.filter("NOT large").drop("large"), length).unionByName(_windowed(shown.filter("large").drop("large"), length))

    whole = distinct.filter("times > 1").select("name", "digest", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("runs"))
    single = distinct.filter("times = 1").select("name", "digest").join(found, ["name", "digest"])
    covered = parts.join(whole.unionByName(single), ["name", "digest"]).select("row", "mark", F.transform(
        "runs", lambda r: F.struct((r["a"] + F.col("at")).alias("start"), (r["b"] + F.col("at") + length - 1).alias("end"))).alias("spans"))
    spans = covered.groupBy("row", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                out, kept = [], []
                for ranges, text in zip(part.column("spans").to_pylist(), texts, strict=True):
                    merged: list[list[int]] = []
                    for r in sorted(ranges or (), key=lambda r: r["start"]):
                        if merged and r["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r["end"])
                        else:
                            merged.append([r["start"], r["end"]])
                    at, rest = 0, []
                    for a, b in merged:
                        rest.append(text[at:a])
                        at = b
                    kept.append(b"".join([*rest, text[at:]]))
                    out.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(out, span_type), pa.array(kept, pa.binary())],
                                                 names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(spans, ["row", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(keep, schema)
