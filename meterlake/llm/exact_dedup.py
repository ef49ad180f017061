"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by their normalised bytes, Spark's external sort puts
equal texts side by side, and neighbouring rows are compared in full. A splitter is the shortest
beginning of a sampled text that sets it apart from the sampled text before it, and ends in the
identifier where two sampled texts are equal, so a text that a third of all rows share is cut over
many ranges, as is a beginning that they share. Runs that touch a range's edge are stitched by
comparing the edge texts, two for each range.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.staging import staged

#: Ranges for each partition, and sampled rows for each range: the sample is of about so many rows, whatever the input.
RANGES, SAMPLED = 4, 8
_LEAST_ID = -(2**63)

_RUNS = "id string, sha string, run string, edge string, again boolean"


def _beginning(before: str, text: str) -> str:
    """The shortest beginning of ``text`` that is larger than ``before``, which is smaller than it."""
    lo, hi = 0, min(len(before), len(text))  # characters that both are sure to share, and at most share
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if before[lo:mid] == text[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return text[: lo + 1]


def _splitters(rows: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Places in the order of (text, id) that cut a sample into about ``ranges`` equal parts. The sample, some
    ``ranges * SAMPLED`` rows by their hash, is sorted in one task, and only beginnings of its texts are
    sent to the driver."""
    share = ranges * SAMPLED / max(1, rows.count())
    keyed = rows.select("text", F.coalesce("id", F.lit(_LEAST_ID)).alias("id"))
    sample = staged(keyed.filter(F.pmod(F.xxhash64("id", "text"), F.lit(2**40)) < F.lit(int(min(1.0, share) * 2**40))), "exact-sample")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, n = None, 0
        for frame in frames:
            out = []
            for text, ident in zip(frame["text"], frame["id"].tolist(), strict=True):
                if n % SAMPLED == 0 and before is not None:
                    out.append((text, ident) if before == text else (_beginning(before, text), _LEAST_ID))
                before, n = text, n + 1
            yield pd.DataFrame(out, columns=["text", "id"]).astype({"id": "int64"})

    chosen = sample.repartition(1).sortWithinPartitions("text", "id").mapInPandas(pick, "text string, id long")
    return sorted((r.text, r.id) for r in chosen.collect())


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Name the runs of equal neighbours within each range; the first and the last row of a range carry
    their text. A run is left null where a row stands alone and away from the edges. ``again`` marks
    a row whose text and identifier are those of the row before."""
    number, held, starts, joined, again = 0, None, True, False, False

    def told(ends: bool, joins: bool) -> tuple:
        bucket, ident, sha, text = held
        edge = starts or ends
        return ident, sha, f"{bucket}-{number}" if edge or joined or joins else None, text if edge else None, again

    for frame in parts:
        out = []
        for row in zip(frame["bucket"], frame["id"], frame["sha"], frame["text"], strict=True):
            if held is not None:
                turns = row[0] != held[0]
                joins = not turns and row[3] == held[3]
                out.append(told(turns, joins))
                again = joins and row[1] == held[1]
                number, starts, joined = 0 if turns else number + (not joins), turns, joins
            held = row
        if out:
            yield _frame(out)
    if held is not None:
        yield _frame([told(True, False)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "sha", "run", "edge", "again"], dtype=object).astype({"again": bool})


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "min",
    partitions: int | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are byte for byte equal; a null text counts as
    empty. ``keep`` ("min" or "max") picks the identifier that stays. Of repeated rows that share
    the kept identifier exactly one is kept. Null identifiers stay only where their whole group has
    none. Other columns of ``docs``, whatever their names, are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"))
    splitters = spark.sparkContext.broadcast(_splitters(rows, n * RANGES))

    @F.pandas_udf("int")
    def bucket(texts: pd.Series, ids: pd.Series) -> pd.Series:
        cuts = splitters.value
        return pd.Series([bisect_right(cuts, row) for row in zip(texts, ids.tolist(), strict=True)], dtype="int32")

    placed = rows.withColumn("bucket", bucket("text", F.coalesce("id", F.lit(_LEAST_ID)))).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    ranged = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "text", "id")
    # As text, so that a null beside it takes nothing from a large identifier.
    named = ranged.select("bucket", F.col("id").cast("string").alias("id"), "sha", "text").mapInPandas(_runs, _RUNS)
    runs = staged(named.withColumn("id", F.col("id").cast("long")), "exact-runs")

    # Edge runs with equal whole texts are one run: two rows at most for each range.
    edges = runs.filter(F.col("edge").isNotNull()).groupBy("edge").agg(F.collect_set("run").alias("runs")).filter(F.size("runs") > 1)
    label = edges.select(F.explode("runs").alias("run"), F.array_min("runs").alias("whole"))
    alone = runs.filter(F.col("run").isNull()).select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rest = runs.filter(F.col("run").isNotNull()).drop("edge").join(label, "run", "left").withColumn("run", F.coalesce("whole", "run"))
    best = F.struct(F.col("id").isNull() if keep == "min" else F.col("id").isNotNull(), "id")
    groups = rest.groupBy("run").agg((F.min if keep == "min" else F.max)(best).alias("best"), F.count("*").alias("group_size"))
    shared = rest.select("id", "sha", "run", "again").join(groups, "run").select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & ~F.col("again")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(shared)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Options as :func:`exact_groups`. Rows that share
    identifier and text (equal as there) collapse to one of them."""
    normalise = options.get("normalise")
    gone = staged(exact_groups(docs, id_col, text_col, **options).filter(~F.col("kept")), "exact-copies")
    other = gone.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    sha = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    kept = docs.join(other, docs[id_col].cast("long").eqNullSafe(other["_gone"]) & (sha == other["_sha"]), "left_anti")
    repeated = gone.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).limit(1).count()
    if not repeated:
        return kept
    # Equal as the groups have it: null and empty texts, and texts of one normal form. The names can clash with no column.
    names = [f"_{n}{'_' * max(map(len, kept.columns))}" for n in ("id", "sha")]
    same = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    return kept.withColumns(dict(zip(names, (F.col(id_col).cast("long"), same), strict=True))).dropDuplicates(names).drop(*names)
