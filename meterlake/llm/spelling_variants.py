"""Spelling variants by permuterm rotations: words one edit apart, and the usual form of a rare spelling.

A word ``ac b`` with its end marked has the rotation ``b$ac``. Without its last letter it is ``b$a``: so have
all words with another letter in that place, and ``b$a`` is itself a rotation of ``ab``, the word without the
letter. Sorted by what is left when the edited letter is skipped, words one replacement, insertion or
deletion apart therefore stand together, in groups no larger than the alphabet and one, whatever the
size of the vocabulary. A scan of each group counts every member's neighbours and keeps the most
frequent ones, so no pairs are written. A letter taken from a row of equal ones leaves the same word
wherever it stood: only the row's first one meets the shorter word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.staging import staged
from meterlake.llm.words import frugal, slices

#: The end of a word in its rotations; no letter.
END = "$"
#: Longer rotations are known by their digest, so that a word of n letters takes n digests, not n texts.
SPELLED = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of a partition that are counted before their counts are handed on.
COUNTED = 200_000


def _misspelt(word: str, check: int) -> str:
    at = check % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters (A-Z as a-z) of at least ``least_letters`` code points that occur at least
    ``least_count`` times. With ``every``, a run whose CRC-32 with its document's id before it (``id:run``)
    is divisible by it counts as the run without the letter at that number modulo its length. A null
    text has no words, a null id is written as nothing; repeated rows count each."""
    runs = re.compile(f"[a-z\u00c0-\u00ff]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for name, text in zip(part.column("id").to_pylist(), texts, strict=True):
                    before = zlib.crc32(f"{name or ''}:".encode())
                    for word, n in Counter(runs.findall(text.translate(_LOWER).decode())).items():
                        if every is not None and not (check := zlib.crc32(word.encode(), before)) % every:
                            word = _misspelt(word, check)
                            if len(word) < least_letters:
                                continue
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
    counted = rows.mapInArrow(frugal(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, kind, at``: each rotation of each marked word, as it is (``whole``), and without its last
    letter (``skip``; ``first`` if the letter before it in the word is another one). ``at`` is where the
    skipped letter, or the rotation's beginning, is in the word."""
    size, at = F.length("word"), F.col("at")
    turned = words.withColumn("at", F.explode(F.sequence(F.lit(0), size)))
    behind, before = F.substring("word", at + 1, size), F.substring("word", F.lit(1), at)
    skipped = F.concat(F.substring("word", at + 2, size), F.lit(END), before)
    repeats = F.substring("word", at + 1, F.lit(1)) == F.substring("word", at, F.lit(1))
    kinds = F.array(
        F.struct(F.lit("whole").alias("kind"), F.concat(behind, F.lit(END), before).alias("key")),
        F.struct(F.when((at > 0) & repeats, "skip").otherwise("first").alias("kind"), F.when(at < size, skipped).alias("key")))
    out = turned.withColumn("r", F.explode(kinds)).select("word", "n", "at", "r.kind", "r.key").filter("key IS NOT NULL")
    return out.withColumn("key", F.when(F.length("key") > SPELLED, F.sha2("key", 256)).otherwise(F.col("key")))


def _best(n: Column, word: Column) -> Column:
    return F.struct((-n).alias("less"), word.alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, near, near_n`` for each word of ``word, n``: how many of the words are exactly one
    inserted, deleted or replaced code point away, and of those the one with the largest ``n`` (of equal
    ones the first in code-point order), null without any.

    ``word`` must be distinct, as :func:`vocabulary` has it; null words are dropped. An empty table gives
    no rows. Rotations are sorted by what is left of them and scanned group by group in windows; a group
    has at most one row for each letter of the alphabet, and the whole word."""
    words = words.select("word", "n").filter("word IS NOT NULL")
    group = Window.partitionBy("key")
    kind, best = F.col("kind"), _best(F.col("n"), F.col("word"))
    letters, first = kind != "whole", kind == "first"
    # Of the members with a letter the two most frequent are kept: one of them is not the row itself.
    scanned = rotations(words).select(
        "word", "kind", best.alias("self"), F.count(F.when(letters, 1)).over(group).alias("n_letters"), F.count(F.when(first, 1)).over(group).alias("n_first"),
        F.min(F.when(letters, best)).over(group).alias("top"), F.min(F.when(~letters, best)).over(group).alias("shorter"), F.min(F.when(first, best)).over(group).alias("longer"),
        F.lead(F.when(letters, best)).over(group.orderBy(F.asc_nulls_last(F.when(letters, best)))).alias("next"))
    is_top = F.col("self") == F.col("top")
    other = F.when(is_top, F.col("next")).otherwise(F.col("top"))
    n = F.when(kind == "whole", F.col("n_first")).otherwise(F.col("n_letters") - 1 + F.when(first & F.col("shorter").isNotNull(), 1).otherwise(0))
    met = F.when(kind == "whole", F.col("longer")).when(first, F.least(other, "shorter")).otherwise(other)
    found = scanned.select("word", n.alias("met"), met.alias("top")).filter("met > 0").groupBy("word").agg(F.sum("met").alias("n_near"), F.min("top").alias("top"))
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.word").alias("near"), (-F.col("top.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Follow ``word -> root`` to its end by doubling: a form is more frequent than its word, so there is
    no cycle, and rounds grow with the logarithm of the longest chain."""
    while True:
        up = forms.select(F.col("word").alias("root"), F.col("root").alias("up"))
        forms = staged(forms.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "spelling-roots")
        done = forms.filter("moved").isEmpty()
        forms = forms.drop("moved")
        if done:
            return forms


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``word, n``: its form is its nearest frequent word
    (see :func:`near_words`) if that occurs at least ``ratio`` (over 1) times as often, else null; its root
    is where forms lead in the end, the word itself without a form."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms may go round in a circle")
    near = near_words(staged(words, "vocabulary"))
    formed = F.col("near_n") >= ratio * F.col("n")
    near = staged(near.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "near-words")
    roots = _roots(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
