import random

import pytest

#: Columns that clash with names that operators use inside or return.
CLASHES = ["row", "id", "sha", "text_sha256", "keep_id", "hits", "items", "ids", "decoded", "name", "at", "sid", "bands", "features", "score", "_gone", "kept", "spans", "html", "payload"]


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, a passage in several texts."""
    base, passage = words(1, 120), words(2, 60)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, ""), (7, "a"), (8, "one two three"), (9, "one two three"), (9, "one two three"), (None, "no id"), (None, None),
        (10, words(3, 30) + ". " + passage + ". " + words(4, 30)), (11, words(5, 25) + ". " + passage + ". " + words(6, 9)), (12, words(7, 40_000)), (13, "x" * 50_000), (14, "Ünï çødé ﬁ İΣ 漢字 😀 " * 30), (15, "!!! ??? ..."),
        (16, "spam\n" * 400), (17, base.upper()), (18, base + " tail"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with extra columns, null ones too."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", None, None, *[None if n % 2 else "x" for n, _ in enumerate(CLASHES)]) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
