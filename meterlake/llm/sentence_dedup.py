"""Substring deduplication over sliding sentence spans.

Every run of several consecutive sentences is hashed, equal hashes meet over the whole corpus in one
shuffle, and the sentences covered by a run that is not the first of its kind are removed. Runs that are
very common (a sample of the documents tells which) are dealt over several groups by their place, and
only the first place of each of these groups is looked at again.

A long stretch without sentence ends is cut by its content: of every ``WINDOW`` consecutive words the
one of least digest, the rightmost of equal ones, ends a piece. Where a stretch is cut therefore does
not depend on what stands before it, and of 50 words at least 32 are cut alike wherever they stand,
which makes three whole pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.staging import staged
from meterlake.llm.words import frugal, shingles, slices

#: Sentences of more words are cut into pieces; words of a window, each of which ends a piece.
LONG, WINDOW = 12, 8
#: White space, what closes a quotation behind a stop, and stops that need no white space behind them.
SPACE, CLOSERS, WIDE_STOPS = r"\t-\r ", r"\"'”’»」』）)\]", "。！？"
#: Where a sentence ends; it carries the white space behind it. Blanks before a line's end lie inside the sentence.
_END = re.compile(rf"[.!?][{CLOSERS}]*(?:[{SPACE}]+|\Z)|[{WIDE_STOPS}]+[{CLOSERS}]*[{SPACE}]*|\n[{SPACE}]*")
#: The same as one pattern of a sentence that needs no look ahead, for engines without it.
_WORD = rf"(?:[^{SPACE}{WIDE_STOPS}]*[^{SPACE}{WIDE_STOPS}.!?{CLOSERS}][{CLOSERS}]*|[{CLOSERS}]+)"
SENTENCE = rf"(?:{_WORD}[\t\v\f\r ]+)*(?:[^{SPACE}{WIDE_STOPS}]*[{WIDE_STOPS}]+[{CLOSERS}]*|[^{SPACE}{WIDE_STOPS}]+)[{SPACE}]*"
_PARTS = re.compile(rf"[^{SPACE}]+[{SPACE}]*")
_BLANKS = "\t\n\v\f\r "
#: One in so many documents is looked at for common runs. A run with more than one in HOT_KEYS of the
#: sample's places is common, so there are at most so many of them; rarer ones than LEAST are not.
SAMPLE, HOT_KEYS, LEAST = 32, 2000, 16


class Digests(dict):
    """The first 64 bits of the MD5 of words, white space behind them left out; filled as they are
    met, emptied at ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        plain = word.rstrip(_BLANKS).encode()
        self[word] = d = int.from_bytes(hashlib.md5(plain, usedforsecurity=False).digest()[:8], "big")
        return d


def _last_least(values: list[int], a: int, b: int) -> int:
    some = values[a:b]
    some.reverse()
    return b - 1 - some.index(min(some))


def _pieces(sentence: str, digests: Digests) -> list[str]:
    """A sentence, cut by its content if it is long."""
    # White space of any kind cuts at least where the parts are cut, so few words are few parts.
    if len(sentence) <= 2 * LONG or len(sentence.split(None, LONG)) <= LONG:
        return [sentence]
    parts = _PARTS.findall(sentence)
    n = len(parts)
    if n <= LONG:
        return [sentence]
    values = list(map(digests.__getitem__, parts))
    at = _last_least(values, 0, WINDOW)
    ends = [at + 1]
    while True:
        # The next to end a piece is the first as small while this one is in the window, else the least of the window behind it.
        least, out = values[at], at + WINDOW
        for i in range(at + 1, min(out, n)):
            if values[i] <= least:
                at = i
                break
        else:
            if out >= n:
                break
            at = _last_least(values, at + 1, out + 1)
        ends.append(at + 1)
    if ends[-1] != n:
        ends.append(n)
    return ["".join(parts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def sentences(text: str, digests: Digests) -> tuple[str, list[str]]:
    """The white space that a text begins with, and its sentences and pieces of long ones."""
    at = len(text) - len(text.lstrip(_BLANKS))
    lead, out = text[:at], []
    for end in _END.finditer(text, at):
        if end.end() > at:
            out += _pieces(text[at : end.end()], digests)
            at = end.end()
    return lead, out + (_pieces(text[at:], digests) if at < len(text) else [])


def _runs(rows: DataFrame, span: int) -> DataFrame:
    """``key, row, at, a, b`` of every run of ``span`` sentences: whose it is, where it begins, and its hash."""
    names = ["key", "row", "at", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                places, a, b = [], [], []
                for text in texts:
                    bare = [xxhash.xxh3_128_digest(s.rstrip(_BLANKS).encode()) for s in sentences(text.decode(), digests)[1]]
                    if len(bare) < span:
                        places.append(0)
                        continue
                    halves = np.frombuffer(b"".join(bare), np.uint64).reshape(-1, 2)
                    a.append(shingles(halves[:, 0], span))
                    b.append(shingles(halves[:, 1], span))
                    places.append(len(a[-1]))
                if a:
                    whose = np.repeat(np.arange(len(places)), places)
                    columns = [part.column("key").take(pa.array(whose)), part.column("row").take(pa.array(whose)), pa.array(np.concatenate([np.arange(n) for n in places]), pa.int32()),
                               pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("key", "row", "text").mapInArrow(frugal(run), "key long, row long, at int, a long, b long")


def _common(rows: DataFrame, span: int) -> DataFrame:
    """``a, b, groups``: runs that are common in a sample of the documents, HOT_KEYS of them at most, and
    into how many groups each is dealt. The sample decides how work is dealt, never what is found."""
    some = _runs(rows.filter(F.pmod(F.xxhash64("key", "row"), F.lit(SAMPLE)) == 0), span)
    often = staged(some.groupBy("a", "b").agg(F.count("*").alias("n")), "sampled-runs")
    bar = max(LEAST, (often.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    return often.filter(F.col("n") > bar).select("a", "b", F.ceil(F.col("n") / bar).alias("groups"))


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_sentences, n_removed, kept`` (the text that is left).

    A sentence ends at ``.``, ``!`` or ``?``, quotes and brackets behind it included, before white space, at
    a wide stop, or at a line's end; of more than ``LONG`` words it counts as several, see above. The
    first run is that of the least identifier (nulls last), then of the earlier place; repeats
    within one text count too. A text of fewer than ``span`` sentences has no runs and stays whole. A
    null text is empty; white space before the first sentence stays; text without white space is one
    word; rows that are equal in identifier and text are one text, and get one answer; other columns
    are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # A row is known by identifier and text: a number given to it would not survive another reading.
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("row", F.xxhash64("text"))
    place, run = ["key", "row", "at"], Window.partitionBy("a", "b")
    runs = _runs(rows, span).join(F.broadcast(_common(rows, span)), ["a", "b"], "left")
    dealt = runs.withColumn("group", F.when(F.col("groups") > 1, F.pmod(F.xxhash64(*place), F.col("groups"))).otherwise(0))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b", "group").orderBy(*place)))
    # Not the first of its group, or the first of one of several groups of a common run.
    open_ = staged(ranked.filter("rank > 1 OR groups > 1").select(*place, "a", "b", "rank"), "repeated-runs")
    tops = open_.filter("rank = 1").withColumn("top", F.row_number().over(run.orderBy(*place))).filter("top > 1")
    gone = open_.filter("rank > 1").select(*place).unionByName(tops.select(*place)).groupBy("key", "row").agg(F.collect_set("at").alias("starts"))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                out = []
                for text, starts in zip(texts, part.column("starts").to_pylist(), strict=True):
                    lead, all_ = sentences(text.decode(), digests)
                    covered = {i + j for i in starts or () for j in range(span)}
                    out.append((len(all_), len(covered), lead + "".join(s for i, s in enumerate(all_) if i not in covered)))
                columns = [part.column("doc_id"), *(pa.array([o[i] for o in out], arrow.field(i + 1).type) for i in range(3))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    joined = rows.join(gone, ["key", "row"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(frugal(cut), "doc_id long, n_sentences long, n_removed long, kept string")
