"""Periodic runs, spelling variants and chat examples against brute-force versions."""

import random
import re
import zlib
from collections import Counter

import pytest

from meterlake.llm import chat_format, periodic_runs, spelling_variants
from meterlake.llm.queries import _PLANTED, ORACLES, QUERIES
from tests.llm.test_operators import as_bag

# -- 11 ------------------------------------------------------------------------------------------


def brute_runs(w, least):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any((i, j + q - i, d) in out for d in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randint(0, 60)
        w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(n)]
        if n > 5 and rng.random() < 0.5:
            a, p = rng.randint(0, n - 1), rng.randint(1, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 3, 6, 12])
        assert periodic_runs.runs_of(w, least) == brute_runs(w, least)
        [(_, found)] = periodic_runs._texts_runs([" ".join(w).encode()], least, periodic_runs.Hashes())
        assert found == brute_runs(w, least)


def test_stretches_of_equal_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x % 3)
    rng = random.Random(6)
    for _ in range(100):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 50))]
        [(_, found)] = periodic_runs._texts_runs([" ".join(w).encode()], 4, periodic_runs.Hashes())
        assert found == brute_runs(w, 4)


def test_long_periodic_text():
    w = [str(i % 700) for i in range(60_000)] + ["end"] + ["one"] * 30_000
    assert periodic_runs.runs_of(w, 12) == [(0, 60_000, 700), (60_001, 30_000, 1)]


def test_periodic_runs(spark, docs, rows):
    extra = [(30, "la " * 500), (31, "x y z " * 4 + "w " + "x y z " * 4), (32, " a b \x1cc\x1d " * 9), (33, "\t\n \r\x0b\x0c"), (33, "k l m n o p " * 2)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    found = periodic_runs.periodic_runs(docs.select("*").unionByName(more, allowMissingColumns=True), least=12).collect()
    want = []
    for i, t in [*rows, *extra]:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        if i != 12:
            want.append((i, brute_runs(w, 12), collapse(w, brute_runs(w, 12))))
    assert as_bag((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found if r.doc_id != 12) == as_bag(want)


def test_periodic_runs_of_nothing(no_docs):
    found = periodic_runs.periodic_runs(no_docs)
    assert found.count() == 0 and found.columns == ["doc_id", "runs", "collapsed"]


def test_planted_ends(spark):
    texts = {i: " ".join(f"w{(i * 7 + j) % 31}" for j in range(i % 90)) for i in range(400)}
    docs = spark.createDataFrame([*texts.items(), (None, "no id"), (-5, None), (-6, "")], "doc_id long, text string")
    for name, value in _PLANTED.items():
        docs = docs.selectExpr("*", f"{value} AS _new").drop(name).withColumnRenamed("_new", name)
    planted = 0
    for r in docs.collect():
        w = texts.get(r.doc_id, "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id in texts and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if r.doc_id in texts:
            assert (r.text or "").split() == w
    assert planted > 20


# -- 12 ------------------------------------------------------------------------------------------


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio):
    form, n_near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if x != w and near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, n_near[w], counts.get(form.get(w))))
    return out


@pytest.mark.parametrize("letters", ["ab", "aéÿ"])
def test_variants(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(250)}
    words |= {"a" * 100, "a" * 99, "a" * 99 + "b", "a" * 70 + "b" + "a" * 20, "a" * 70 + "c" + "a" * 20, "a" * 90}
    counts = {w: rng.choice([5, 6, 25, 30, 125, 700]) for w in sorted(words)}
    found = spelling_variants.variants(spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long").repartition(3), 5)
    assert as_bag(map(tuple, found.collect())) == as_bag(brute_variants(counts, 5))


def test_long_chain_of_forms(spark):
    counts = {"a" * i: 5**i for i in range(1, 20)}
    got = {r.word: r for r in spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), 5).collect()}
    assert all(r.root == "a" * 19 and r.form == ("a" * (len(w) + 1) if len(w) < 19 else None) for w, r in got.items())
    with pytest.raises(ValueError):
        spelling_variants.variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)


def test_vocabulary(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(spelling_variants, "COUNTED", 3)
    extra = [(40, "Ärger ÄRGER ärgerlich Ärgerlich×÷ straßenbahn STRAßENBAHN " * 5), (41, "z" * 30_000 + " " + "tail-ends " * 3), (41, "z" * 30_000), (None, "nameless " * 9), (42, "ﬁnally ŒUVRES")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    for every in (None, 1, 3):
        counts = Counter()
        for i, t in [*rows, *extra]:
            for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
                h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
                if every and h % every == 0:
                    r = r[: h % len(r)] + r[h % len(r) + 1 :]
                counts[r] += len(r) >= 6
        found = spelling_variants.vocabulary(docs.unionByName(more, allowMissingColumns=True), every=every, least_count=2)
        assert {r.word: r.n for r in found.collect()} == {w: n for w, n in counts.items() if n >= 2}
    none = spelling_variants.variants(spelling_variants.vocabulary(no_docs))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


# -- 13 ------------------------------------------------------------------------------------------

ODD = ["", None, "\\", "\\\\", "<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "[\\INST]", "</s>[INST] ok [/INST]", "<", "<<s>>", "<</SYS>>\n\n", "a\\<s>\\", "😀" * 50 + "<|im_sep|>", "x" * 200_000, "line\nline"]


def conversations():
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["user", "assistant", "assistant", "system", None, "<|im_sep|>\n\\role"]), rng.choice(ODD)) for i in range(40) for t in range(rng.randint(1, 9))]
    return [*rows, (50, 1, "user", "no reply"), (51, 1, "assistant", "twice"), (51, 1, "assistant", "twice"), (51, None, "user", None), (None, 1, "assistant", "no id"), (None, 1, "assistant", None), *[(52, t, "assistant", "go on") for t in range(300)]]


def in_order(rows):
    low = lambda x: (x is not None, x)
    return sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda row: (low(row[0]), row[1].encode(), row[2].encode()))


def written(role, text):
    def escape(x):
        x = x.replace("\\", "\\\\")
        for mark in chat_format.CONTROL:
            x = x.replace(mark, mark[0] + "\\" + mark[1:])
        return x

    return f"<|im_start|>{escape(role)}<|im_sep|>{escape(text)}<|im_end|>", len(escape(text))


def test_chat_examples(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", None) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns long").repartition(3)
    made = chat_format.examples(table).collect()
    want = []
    for i in {r[0] for r in rows}:
        turns, sofar, n = in_order(r[1:] for r in rows if r[0] == i), "", 0
        for k, (_, role, text) in enumerate(turns, 1):
            piece, size = written(role, text)
            sofar += piece
            if role == "assistant" or k == len(turns):
                end = len(sofar) - len(chat_format.END)
                want.append((i, n, k, hash(sofar), end - (size if role == "assistant" else 0), end, k == len(turns)))
                n += 1
    assert as_bag((r.conv_id, r.example, r.n_turns, hash(r.formatted), r.loss_start, r.loss_end, r.last) for r in made) == as_bag(want)
    for r in made:  # no control string but those of the template
        bare = re.sub(r"<\|im_start\|>((?:(?!<\|im_sep\|>).)*)<\|im_sep\|>((?:(?!<\|im_end\|>).)*)<\|im_end\|>", r"\1\2", r.formatted[:5000] if len(r.formatted) < 5000 else "", flags=re.S)
        assert not any(mark in bare for mark in chat_format.CONTROL)


def test_chat_round_trip(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    back = chat_format.read_back(chat_format.examples(table)).collect()
    assert len(back) == len({r[0] for r in rows})
    for r in back:
        turns = in_order(x[1:] for x in rows if x[0] == r.conv_id)
        assert [tuple(t) for t in r.turns] == [t[1:] for t in turns]
        assert r.learnt == [t[2] for t in turns if t[1] == "assistant"] + ([""] if turns[-1][1] != "assistant" else [])


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.examples(none).count() == 0 and chat_format.read_back(chat_format.examples(none)).count() == 0


def test_new_queries_have_sql():
    assert {"op11_periodic_runs", "op12_spelling_variants", "op13_chat_format"} <= set(ORACLES) & set(QUERIES)
