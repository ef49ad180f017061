"""Texts that once took a crash or a quadratic time, and rows that share an identifier."""

import time

import pytest

from meterlake.llm import dom, exact_dedup, licenses, sentence_dedup

N = 1_000_000
SIGNS = ["=", "-", "*", "#", ".", ",", "(", ")", "[", "<", "/", "\\", "\"", "_", " ", "\t", "\r", "\x0b", "©", "—", "!"]
LINES = ["Copyright 2020 x ", "Copyright 2020 x. ", "Foo copyright 2020 x ", "(c) ", "(c) x ", "(c)", "copyright [year ", "copyright\n", "copyright: ", "copyright the ", "all rights reserved. ", "all ", "© ", "c 2020 "]


def test_a_megabyte_of_each_sign_beside_a_copyright_line(spark):
    rows = [(-1, "Copyright 2020 Foo\nsome text")]
    for i, sign in enumerate(SIGNS):
        rows += [(2 * i, f"Copyright 2020 Foo\n{sign * N}\nsome text"), (2 * i + 1, f"{sign * N}copyright 2020 Foo\nsome text")]
    began = time.time()
    got = {r.doc_id: r.canonical_sha256 for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows) and time.time() - began < 120
    for i, sign in enumerate(SIGNS):  # but a sign that is spelt out
        assert got[2 * i] == got[-1] or sign == "©"


def test_a_megabyte_of_statements(spark):
    rows = [(i, (line * N)[:N]) for i, line in enumerate(LINES)]
    began = time.time()
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == len(rows)
    assert time.time() - began < 120


def test_statements_inside_lines_go_where_a_licence_goes_on(spark):
    rows = [(1, "Foo copyright 2020 Jane copyright 2021 Joe\nbar"), (2, "Foo Copyright 2020 Jane. Permission is hereby granted\nbar"), (3, "Foo Permission is hereby granted\nbar")]
    got = {r.doc_id: r.canonical_sha256 for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == got[3] and got[1] != got[3]


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" + " " * 5_000_000 + "b", "a. " + "\t" * 5_000_000 + "b\n", "a" + " \n" * 200_000 + "b", "." * N, ".)" * 300_000 + "x", "a." + ")" * N + "x"])
def test_sentence_ends_in_linear_time(text):
    began = time.time()
    lead, found = sentence_dedup.sentences(text, sentence_dedup.Digests())
    assert lead + "".join(found) == text and time.time() - began < 10


def test_sentence_ends_stay_where_they_were():
    cut = lambda text: sentence_dedup.sentences(text, sentence_dedup.Digests())
    assert cut("one  \n two \t\n\n three") == ("", ["one  \n ", "two \t\n\n ", "three"])
    assert cut(" a. b\n") == (" ", ["a. ", "b\n"])


def test_copies_that_share_an_identifier(spark):
    rows = [(1, None, "x"), (1, "", "y"), (2, "t", "x"), (2, "t", "y"), (3, "t", "z"), (None, None, "n"), (None, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dedup_sha string")
    kept = exact_dedup.drop_exact_copies(docs, keep="max")
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in exact_dedup.exact_groups(docs, keep="max").collect() if r.kept)
    assert sorted(r.doc_id for r in kept.collect()) == want == [1, 3]


def test_references_are_decoded_in_their_own_text():
    blocks = lambda page: [b[1] for b in dom.read(page).blocks]
    assert blocks("<p>&am<b>p;</b>lt; b &<!-- -->lt; &amp;lt; &eacute;&#233; &lt < &lt;</p>") == ["&amp;lt; b &lt; &lt; éé < < <"]
