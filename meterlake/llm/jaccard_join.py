"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with equal shingle sets are one set from the start. MinHash values are banded, four to a band;
two sets that share a band are candidates. A candidate pair's MinHash values are compared step by
step, and the pair is dropped as soon as the posterior probability of reaching the threshold falls
below a tolerance; the rest is verified on the whole shingle sets.

No bucket is ever expanded into all its pairs. First every set is tried against the least set of its
buckets, which joins nearly all that belongs together; then, only in buckets that still hold several
classes, sets of different classes are tried against each other, in blocks of bounded size that give
at most one link for each set and other class. Classes
are the connected components of verified links. Links are counted within each class, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.components import components
from meterlake.llm.staging import staged
from meterlake.llm.words import Hashes, frugal, mix, shingles, slices, words

BANDS, ROWS = 32, 4
#: Sets of a class or bucket that one task compares with as many others at once.
BLOCK = 1024
#: Buckets of so many sets at most are paired by expressions; larger ones go block by block.
SMALL = 8
#: Steps after which a pair may be dropped.
STEPS = (16, 32, 64, 128)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, k: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words."""
    return np.unique(shingles(hashes.of(words(text)), k))


def signature(found: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits; four of them are a band of 64 bits."""
    least = np.full(len(_SEEDS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(found), 2048):
        part = (found[lo : lo + 2048, None] ^ _SEEDS[None, :]) * np.uint64(0x9FB21C651E98DF25)
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For each step, the matches below which the similarity is too unlikely to reach the threshold,
    under a uniform prior: P(similarity >= t | k of m match) = P(Binomial(m + 1, t) <= k)."""
    out = []
    for m in STEPS:
        k, p = 0, 0.0
        while True:
            p += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if p >= tolerance or k > m:
                break
            k += 1
        out.append((m, k))
    return out


def surviving(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (rows of two signature arrays) that no step drops."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for m, least in limits:
        matches = matches + (a[alive, done:m] == b[alive, done:m]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], m
    return alive


def _signatures(column) -> np.ndarray:
    """The 16-bit values of a column of bands."""
    flat = column.flatten() if isinstance(column, pa.ListArray) else np.concatenate(column) if len(column) else []
    return np.asarray(flat, dtype=np.int64).view(np.uint16).reshape(-1, BANDS * ROWS)


_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _features(docs: DataFrame, k: int) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("sid", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sids, bands = [], []
                for text in texts:
                    found = shingle_set(text, k, hashes)
                    sids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    bands.append(signature(found).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(sids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=arrow)

    return docs.mapInArrow(frugal(run), _SETS)


def _pruned(pairs: DataFrame, sets: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that Bayesian pruning leaves."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("bands").alias(f"{c}_bands"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_signatures(batch.column(c)) for c in ("a_bands", "b_bands"))
            yield batch.select(["a", "b"]).take(pa.array(surviving(left, right, limits)))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_bands", "b_bands").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose whole shingle sets are at least ``threshold`` similar."""
    side = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"{c}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, known = Hashes(), None, None
        for batch in batches:
            keep = []
            rows = zip(batch.column("b").to_pylist(), batch.column("a_text").cast(pa.binary()), batch.column("b_text").cast(pa.binary()), strict=True)
            for b, left, right in rows:
                if b != last:
                    last, known = b, shingle_set(right.as_py(), k, hashes)
                own = shingle_set(left.as_py(), k, hashes)
                both = np.intersect1d(own, known, assume_unique=True).size
                keep.append(both >= threshold * (len(own) + len(known) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(frugal(run), "a binary, b binary")


def _blocked(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Deal the rows of each ``key`` (of ``size`` rows) over blocks, and each row to every pair of
    blocks that holds its own, so that every two rows of a key meet in just one pair of blocks."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``: products of slices of the
    incidence matrix of the shingles that more than one set has."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    several = often[code] > 1
    _, code = np.unique(code[several], return_inverse=True)
    owner, order = owner[several], np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [start, start + 4096])
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[a:b], code[a:b] - start] = 1
        both += dense[left] @ dense[right].T
    return both


def _near(frame: pd.DataFrame, k: int, threshold: float, limits: list[tuple[int, int]], candidate: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a frame, and which pairs of them are similar: pairs that pruning
    leaves (``candidate``, or all) are decided on the whole shingle sets."""
    hashes, own = Hashes(), frame["own"].to_numpy()
    left, right = np.flatnonzero(own == frame["lo"].iat[0]), np.flatnonzero(own == frame["hi"].iat[0])
    same = frame["lo"].iat[0] == frame["hi"].iat[0]  # then every pair is met once, from its earlier row
    values, mask = _signatures(frame["bands"].tolist()), np.zeros((len(left), len(right)), bool)
    for i, row in enumerate(left):
        ask = np.flatnonzero(right > row if same else right >= 0) if candidate is None else np.flatnonzero(candidate[row, right])
        alive = surviving(np.broadcast_to(values[row], (len(ask), values.shape[1])), values[right[ask]], limits)
        mask[i, ask[alive]] = True
    used = np.unique(np.concatenate([left[mask.any(axis=1)], right[mask.any(axis=0)]]))
    if not len(used):
        return left, right, mask
    sets = [shingle_set(t.encode(), k, hashes) for t in frame["text"].iloc[used]]
    place, sizes = np.zeros(len(frame), np.int64), np.zeros(len(frame))
    place[used], sizes[used] = np.arange(len(used)), [len(s) for s in sets]
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    both = _shared(sets, place[left[rows]], place[right[columns]])
    close = both >= threshold * (sizes[left[rows]][:, None] + sizes[right[columns]][None, :] - both) - 1e-6
    mask[np.ix_(rows, columns)] &= close
    return left, right, mask


def _cross_links(buckets: DataFrame, k: int, threshold: float, limits: list[tuple[int, int]]) -> DataFrame:
    """Links between sets of different classes in a bucket, one at most for each set and other class.
    A pair that shares several bands is decided in the first of them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(frame["root"])[0]
        bands = np.array(frame["bands"].tolist(), dtype=np.int64)
        band = int(frame["band"].iat[0])
        candidate = label[:, None] != label[None, :]
        if frame["lo"].iat[0] == frame["hi"].iat[0]:
            candidate &= np.arange(len(frame))[:, None] < np.arange(len(frame))[None, :]
        for earlier in range(band):
            candidate &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
        left, right, near = _near(frame, k, threshold, limits, candidate)
        out = []
        for i in np.flatnonzero(near.any(axis=1)):
            hits = right[near[i]]
            _, first = np.unique(label[hits], return_index=True)
            out += [(frame["sid"].iat[left[i]], frame["sid"].iat[j]) for j in hits[first]]
        return pd.DataFrame(out, columns=["a", "b"])

    return _blocked(buckets, "key", "n").groupBy("band", "key", "lo", "hi").applyInPandas(run, "a binary, b binary")


def _small_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs of different classes within buckets of ``SMALL`` sets at most."""
    members = buckets.groupBy("band", "key").agg(F.collect_list(F.struct("sid", "root")).alias("m"))
    each = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x["sid"].alias("a"), y["sid"].alias("b"), (x["root"] != y["root"]).alias("apart"))))
    pairs = members.select(F.inline(F.filter(F.flatten(each), lambda p: p["apart"])))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _link_counts(members: DataFrame, k: int, threshold: float, limits: list[tuple[int, int]]) -> DataFrame:
    """For each set of a class the documents it is linked to, counted block by block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, near = _near(frame, k, threshold, limits, None)
        weight = frame["docs"].to_numpy()
        out = [(frame["sid"].iat[i], int(n)) for i, n in zip(left, near @ weight[right], strict=True) if n]
        out += [(frame["sid"].iat[i], int(n)) for i, n in zip(right, near.T @ weight[left], strict=True) if n]
        return pd.DataFrame(out, columns=["sid", "links"])

    counts = _blocked(members, "root", "n").groupBy("root", "lo", "hi").applyInPandas(run, "sid binary, links long")
    return counts.groupBy("sid").agg(F.sum("links").alias("links"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8,
                    tolerance: float = 1e-6, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links``.

    ``class_id`` is the least identifier of the connected component; ``n_links`` counts the other
    rows whose word shingles are at least ``threshold`` similar, copies included. A text of fewer
    than ``k`` words, but not none, is one shingle; a text without words (or null) is its own class
    and has no links. Rows with a null identifier take part, and have a null class only among
    themselves. Other columns are ignored; an empty table gives none.
    """
    marked = _classes(docs, id_col, text_col, k, threshold, tolerance, count_links)
    return marked.select("doc_id", "class_id", *(["n_links"] if count_links else []))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _key(ident: Column) -> Column:
    """Identifiers to join on, null ones too; a text's mark stands beside it."""
    return F.coalesce(ident.cast("long"), F.lit(-(2**63)))


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, tolerance: float, count_links: bool) -> DataFrame:
    """:func:`jaccard_classes` with ``mark``, a hash of each row's text."""
    limits = least_matches(threshold, tolerance)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), _mark(docs[text_col]).alias("mark"), docs[text_col].cast("string").alias("text"))
    rows = staged(_features(source, k), "features")
    sets = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("bands").alias("bands"), F.count("*").alias("docs"),
        F.min(F.struct(_key(F.col("doc_id")).alias("key"), "mark")).alias("one"))
    sets = staged(sets, "shingle-sets")

    banded = sets.select("sid", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("sid").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = staged(banded.join(hubs, ["band", "key"]), "buckets")
    stars = buckets.filter("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()

    # A set's text is that of one row, known by identifier and text, so rows without one do not meet all others.
    wanted = buckets.select("sid").distinct().join(sets.select("sid", "one.key", "one.mark"), "sid")
    fetched = source.withColumn("key", _key(F.col("doc_id"))).join(wanted, ["key", "mark"]).select("sid", "text")
    texts = staged(_of_set(fetched, k), "texts")
    first = staged(_verified(_pruned(stars, sets, limits), texts, k, threshold), "links")
    roots = components(first, "a", "b")

    classed = buckets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = classed.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key")
    open_ = classed.join(mixed, ["band", "key"])
    large = open_.filter(F.col("n") > SMALL).join(sets.select("sid", "bands"), "sid").join(texts, "sid").select("band", "key", "sid", "root", "bands", "text", "n")
    few = _verified(_pruned(_small_pairs(open_.filter(F.col("n") <= SMALL)), sets, limits), texts, k, threshold)
    second = _cross_links(large, k, threshold, limits).unionByName(few)
    every = staged(first.unionByName(second), "links")
    roots = staged(components(every, "a", "b"), "classes")

    linked = rows.select("doc_id", "mark", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = linked.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = linked.join(least, "root", "left").withColumn("class_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    if not count_links:
        return out.select("doc_id", "mark", "class_id")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    members = roots.join(sizes, "root").withColumnRenamed("node", "sid").join(sets.select("sid", "bands", "docs"), "sid").join(texts, "sid")
    counts = _link_counts(members, k, threshold, limits).join(sets.select("sid", "docs"), "sid", "right")
    counts = counts.select("sid", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    return out.join(counts, "sid", "left").select("doc_id", "mark", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _of_set(rows: DataFrame, k: int) -> DataFrame:
    """One text for each set: an identifier may stand on several rows with other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                keep = [xxhash.xxh3_128_digest(shingle_set(t, k, hashes).tobytes()) == s for t, s in zip(texts, part.column("sid").to_pylist(), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).dropDuplicates(["sid"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each class the row with the least identifier. A row
    is known by identifier and text; rows of one class that share the least identifier all stay, and
    so do rows without one, if their whole class has none."""
    classes = _classes(docs, id_col, text_col, k, threshold, tolerance, False)
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(_key(F.col("doc_id")).alias("_key"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (_key(docs[id_col]) == gone["_key"]) & (_mark(docs[text_col]) == gone["_mark"]), "left_anti")
