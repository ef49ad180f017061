"""Benchmark decontamination by winnowing.

Both sides keep the least hash of every ``window - k + 1`` consecutive k-grams of words, so a span of
``window`` words that document and item share leaves at least one fingerprint in both at the same
place. Equal fingerprints are joined, and every hit is extended along its diagonal, word by word.
Items too short for a window are matched whole.

The benchmark is a stated query set, taken in blocks of bounded size against all documents: each
block is broadcast, and the documents pass by without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.staging import staged
from meterlake.llm.words import mix, slices, words

#: Text bytes of one broadcast block of the benchmark.
BLOCK_BYTES = 16_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram; one that holds a word unknown to the benchmark (0) has no hash."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        out = mix(out * np.uint64(31) + part.astype(np.uint64))
        known &= part > 0
    return np.where(known, out & ~np.uint64(1), _NONE)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    out = x[: len(x) - w + 1]
    for j in range(1, w):
        out = pick(out, x[j : len(x) - w + 1 + j])
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the fingerprints: k-grams that are least, ties included, in some window of ``w``."""
    if len(grams) < w:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = _sliding(grams, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, w, np.maximum) == grams) & (grams != _NONE))


class Block:
    """The fingerprints and words of some benchmark items, as they are broadcast."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, k: int) -> None:
        self.window, self.k, self.vocab = window, k, {}
        self.names, self.texts, self.short = [], [], {}
        prints: list[tuple[int, int, int]] = []
        for name, text in items:
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)], np.int64)
            if not len(ids):
                continue
            at = len(self.names)
            self.names.append(name)
            self.texts.append(ids)
            if len(ids) < window:
                self.short.setdefault(len(ids), {}).setdefault(ids.tobytes(), []).append(at)
                continue
            grams = _grams(ids, k)
            prints += [(int(grams[p]), at, int(p)) for p in winnow(grams, window - k + 1)]
        prints.sort()
        self.keys = np.array([p[0] for p in prints], np.uint64)
        self.items = np.array([p[1] for p in prints], np.int64)
        self.places = np.array([p[2] for p in prints], np.int64)
        self.short_keys = {n: np.unique(_grams(np.concatenate([np.frombuffer(b, np.int64) for b in group]), n)[::n]) for n, group in self.short.items()}

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its words, the covered ranges of word places, and the items found."""
        get, parts, starts, at = self.vocab.get, [], [], 0
        for text in texts:
            tokens = words(text)
            starts.append(at)
            parts.append(np.fromiter((get(x, 0) for x in tokens), np.int64, len(tokens)))
            parts.append(np.zeros(1, np.int64))  # nothing matches across texts
            at += len(tokens) + 1
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = [*starts[1:], at]
        spans: list[tuple[int, int, int]] = []

        grams = _grams(ids, self.k)
        places = winnow(grams, self.window - self.k + 1)
        lo, hi = np.searchsorted(self.keys, grams[places], "left"), np.searchsorted(self.keys, grams[places], "right")
        seen: set[tuple[int, int]] = set()
        for place, a, b in zip(places[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
            for item, own in zip(self.items[a:b], self.places[a:b], strict=True):
                if (key := (int(item), int(place - own))) not in seen:
                    seen.add(key)
                    spans += self._extend(ids, *key)
        for n, keys in self.short_keys.items():
            for place in np.flatnonzero(np.isin(_grams(ids, n), keys)):
                for item in self.short[n].get(ids[place : place + n].tobytes(), ()):
                    spans.append((int(place), int(place) + n, item))

        found: list[tuple[int, list, set]] = [(e - s - 1, [], set()) for s, e in zip(starts, ends, strict=True)]
        for (lo_, hi_, item), doc in zip(spans, np.searchsorted(starts, [s[0] for s in spans], "right") - 1, strict=True):
            found[doc][1].append((lo_ - starts[doc], hi_ - starts[doc]))
            found[doc][2].add(self.names[item])
        return [(n, union(ranges), items) for n, ranges, items in found]

    def _extend(self, ids: np.ndarray, item: int, shift: int) -> Iterator[tuple[int, int, int]]:
        """Maximal runs of equal words of the item laid at ``shift`` that hold a window."""
        own = self.texts[item]
        lo, hi = max(0, -shift), min(len(own), len(ids) - shift)
        same = np.concatenate([[0], own[lo:hi] == ids[lo + shift : hi + shift], [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(same))
        for a, b in zip(turns[::2], turns[1::2], strict=True):
            if b - a >= self.window:
                yield int(a + lo + shift), int(b + lo + shift), item


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int) -> Iterator[Block]:
    items, size = [], 0
    rows = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")), F.coalesce(benchmark[text_col].cast("string"), F.lit("")))
    for name, text in rows.toLocalIterator():
        items.append((name, text.encode()))
        size += len(items[-1][1])
        if size >= BLOCK_BYTES:
            yield Block(items, window, k)
            items, size = [], 0
    yield Block(items, window, k)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, hits, items``.

    ``hits`` are the maximal ranges ``[start, end)`` of word places that lie in an occurrence of a
    window of ``window`` item words, ``items`` the sorted names of the items with such windows. An
    item of fewer words, but not none, is one window; a null text has no words; a null item name is
    the empty string; repeated rows give repeated rows; other columns are ignored.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType()))])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    context = docs.sparkSession.sparkContext
    found, blocks = None, _blocks(benchmark, id_col=item_col, text_col=item_text_col, window=window, k=k)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    block = next(blocks)
    while block is not None:
        shared, later = context.broadcast(block), next(blocks, None)
        source = base if found is None else found

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=later is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    rows = shared.value.scan(texts)
                    if "hits" in part.schema.names:  # of earlier blocks
                        rows = [(n, union(r + [(h["start"], h["end"]) for h in old]), s | set(o)) for (n, r, s), old, o in zip(rows, part.column("hits").to_pylist(), part.column("items").to_pylist(), strict=True)]
                    out = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                           pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], arrow.field("hits").type),
                           pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(out if last else [*out, part.column("text")], schema=arrow if last else arrow.append(pa.field("text", pa.string())))

        found = source.mapInArrow(scan, schema if later is None else T.StructType([*schema.fields, T.StructField("text", T.StringType())]))
        if later is not None:  # one block at a time is held
            found = staged(found, "contamination")
            shared.destroy()
        block = later
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns kept. Options as :func:`contamination`."""
    context, kept = docs.sparkSession.sparkContext, docs
    names = {"id_col": options.get("item_col", "item_id"), "text_col": options.get("item_text_col", "text")}
    for block in _blocks(benchmark, window=options.get("window", 10), k=options.get("k", 5), **names):
        shared = context.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, text_col):
                    yield part.filter(pa.array([not ranges for _, ranges, _ in shared.value.scan(texts)], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
