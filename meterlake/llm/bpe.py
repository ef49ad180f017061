"""BPE encoding and decoding with a public vocabulary, through an index of pair occurrences.

The words that a task has not met before are laid out as one symbol array. Every adjacent pair of
symbols that has a merge rank is mapped to all its places; the active ranks are applied in
ascending order, each at all its places at once, and the lists of the pairs beside a merged place
are updated. A merge's parts are made by earlier merges, so a rank never becomes active after it
was passed, and the result is that of merging word by word.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.words import frugal, slices

#: White space as the vocabulary's own pattern engine has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed: the splitting pattern that the vocabulary file states.
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
#: Bytes of words and ids that a task remembers before it starts its memory anew, and what a word
#: takes besides its letters.
MEMORY_BYTES, WORD_BYTES = 48_000_000, 150


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _told(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _tokens(path: str, told: dict | None = None) -> np.ndarray:
    """The token of each id; None where an id is not given out."""
    told = told or _told(path)
    known = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
    tokens = np.full(max(known.values(), default=-1) + 1, None, object)
    for token, i in known.items():
        tokens[i] = token
    return tokens


def _joined(tokens: np.ndarray, ids) -> str:
    ids = np.asarray(ids, np.int64)
    if len(ids) and ids.min() < 0:
        raise IndexError("an id outside the vocabulary")
    return " ".join(tokens[ids])


class Vocabulary:
    """A tokenizer file of the kind that ends words with a suffix."""

    def __init__(self, path: str) -> None:
        told = _told(path)
        model = told["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = _tokens(path, told)
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + self.suffix] for c in letters], np.int64)
        self.ranks = {}
        self.made = np.zeros((len(model["merges"]), 3), np.int32)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 20 | ids[b]] = rank
            self.made[rank] = ids[a], ids[b], ids[a + b]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(_WORD).findall

    def text(self, ids) -> str:
        """The tokens of ``ids`` joined by one space."""
        return _joined(self.tokens, ids)

    def pieces(self, text: str) -> list[str]:
        """The words of ``text`` in order; special tokens stand as themselves behind a NUL mark."""
        if self.split_special and "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self.split_special.split(text)):
                out += ["\0" + part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Letter by letter, so a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct, non-empty words, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        n = len(symbol)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = n
        before[ends - sizes] = n  # n stands for none; the extra place absorbs updates
        following, before, symbol = np.append(following, n), np.append(before, n), np.append(symbol, -1)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            pairs = symbol[places] << 20 | symbol[following[places]]
            order = np.argsort(pairs, kind="stable")
            pairs, places = pairs[order], places[order]
            cuts = np.flatnonzero(np.diff(pairs)) + 1
            for pair, group in zip(pairs[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if (rank := self.ranks.get(pair)) is not None:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank].append(group)

        inside = np.flatnonzero(following[:n] < n)
        if len(inside):
            add(inside)
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.made[rank].tolist()
            places = np.unique(np.concatenate(index.pop(rank)))
            places = places[(symbol[places] == a) & (symbol[following[places]] == b)]
            if a == b and len(places) > 1:
                places = _disjoint(places, following)
            if not len(places):
                continue
            gone = following[places]
            after = following[gone]
            symbol[places], symbol[gone] = new, -2
            following[places] = after
            before[after] = places
            before[n] = n
            left = before[places]
            touched = np.concatenate([left[left < n], places[after < n]])
            if len(touched):
                add(np.unique(touched))
        kept = symbol[:n] >= 0
        return symbol[:n][kept], np.add.reduceat(kept.astype(np.int64), ends - sizes)


def _disjoint(places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol, those taken from the left."""
    taken, last = [], -1
    for p in places.tolist():
        if p != last:
            taken.append(p)
            last = int(following[p])
    return np.array(taken, np.int64)


class Encoder:
    """Encodes texts, remembering the words met; what it remembers is bounded in bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.held, self.used = 0, 0  # bytes of the words remembered, ids in use
        self.flat, self.start, self.count = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.slot)
        self.flat, self.start, self.count = _room(self.flat, self.used + len(ids)), _room(self.start, n + len(words)), _room(self.count, n + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(words)] = counts
        self.used += len(ids)
        self.held += sum(map(len, words)) + WORD_BYTES * len(words) + 4 * len(ids)
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the bounds of each text among them."""
        if self.held > MEMORY_BYTES:
            self._forget()
        split = [self.v.pieces(t) for t in texts]
        fresh = list({w for words in split for w in words if w not in self.slot})
        special = {w for w in fresh if w[0] == "\0" and w[1:] in self.v.special}
        if special:
            self._remember([*special], np.array([self.v.special[w[1:]] for w in special]), np.ones(len(special), np.int64))
        plain = [w for w in fresh if w not in special]
        if plain:
            self._remember(plain, *self.v.encode_words([w.encode() for w in plain]))
        slots = np.fromiter((s for words in split for s in map(self.slot.__getitem__, words)), np.int64)
        sizes = self.count[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slots] - (ends - sizes), sizes)
        per_text = np.cumsum([0, *map(len, split)])
        bounds = np.append(0, ends)[per_text]
        return self.flat[where], bounds


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """``array`` with room for ``n`` values; it grows by doubling."""
    return array if n <= len(array) else np.append(array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype))


_ENCODED = [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
_ARROW = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int32()))]


def _encoded(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    fields = [*_ENCODED, *([T.StructField("decoded", T.StringType())] if decoded else [])]
    arrow = pa.schema([*_ARROW, *([pa.field("decoded", pa.string())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(vocabulary_path))
            for part, texts in slices(batch, "text"):
                ids, bounds = encoder.encode([t.decode() for t in texts])
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array([encoder.v.text(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), T.StructType(fields))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, ids`` (array of int). A null text is empty and has no
    ids; other columns are ignored. The path must be readable on every executor (a shared or
    installed file, or one sent with the job)."""
    return _encoded(docs, vocabulary_path, id_col, text_col, False)


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` with a column ``decoded``, as :func:`decode` has it: the ids are decoded where
    they are made, so that a task needs one vocabulary."""
    return _encoded(docs, vocabulary_path, id_col, text_col, True)


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: its tokens, special ones too, joined by one space, as a
    vocabulary without a decoder has it. Null ids decode to the empty text; an id outside the
    vocabulary fails. A column already called ``decoded`` is replaced."""
    source = encoded.drop("decoded")
    names = source.columns
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = _tokens(vocabulary_path) if tokens is None else tokens
            column = batch.column(names.index(ids_col))
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                text = pa.array([_joined(tokens, ids or ()) for ids in column.slice(lo, 500).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*names, "decoded"])

    return source.mapInArrow(frugal(run), schema)


def digests(encoded: DataFrame, *also: str) -> DataFrame:
    """Digest columns of encoded and decoded rows: doc_id, n_tokens, ids_sha256, decoded_sha256, and the
    columns named in ``also``."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *also)
