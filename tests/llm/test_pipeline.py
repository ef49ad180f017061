"""The pipeline's stages against a plain computation of the same decisions."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from meterlake.llm import toxicity
from meterlake.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_classes, brute_contamination

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_pipeline_decisions(spark, documents):
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(documents, toxicity.fit(documents, labels)).filter("predicted = 1").select("doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.doc_id not in toxic)
    last = {t or "": i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    rows = [row for row, (i, c, _) in zip(rows, brute_classes(rows)) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w) for _, t in items for w in _windows(t)}
    sizes = {len(w) for w in windows}
    rows = [(i, t) for i, t in rows if not any(tuple(v[j : j + n]) in windows for v in [_words(t)] for n in sizes for j in range(len(v) - n + 1))]
    library = Tokenizer.from_file(tokenizer_path())
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(want)
    assert all(list(got[i].ids) == want[i] and got[i].n_tokens == len(want[i]) for i in want)
    assert all(got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want[i])).encode()).hexdigest() for i in want)


def _words(text):
    from tests.llm.test_operators import low_words

    return low_words(text)


def _windows(text):
    v = _words(text)
    return [v[i : i + 10] for i in range(max(1, len(v) - 9))] if v else []


def test_stages_keep_the_columns(spark, docs, no_docs):
    """Odd rows and an empty table through each stage but the last."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "bpe"]
    for table in (docs, no_docs):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, kept, DATA)
            assert after.columns == table.columns
            kept = spark.createDataFrame(after.collect(), after.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, kept, DATA).count() == kept.count()


def test_contamination_windows_agree():
    text, item = "a b c d e f g h i j k l", "x b c d e f g h i j k y"
    assert brute_contamination(text, [(1, item)])[2] == ["1"] and Counter(map(len, _windows(item))) == Counter({10: 3})
