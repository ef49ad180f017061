"""Each operator against a brute-force version on a small table with every odd case."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import bpe, components, decontaminate, exact_dedup, html_extract, jaccard_join, licenses, sentence_dedup, suffix_array, suffix_dedup, toxicity, warc
from meterlake.llm.queries import tokenizer_path
from tests.llm.conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def as_bag(rows):
    return sorted(map(repr, rows))


# -- 1 -------------------------------------------------------------------------------------------


def brute_contamination(text, items, n=10):
    w, hit, found = low_words(text), set(), set()
    for name, item in items:
        v = low_words(item)
        for i in range(max(1, len(v) - n + 1) if v else 0):
            window = v[i : i + n]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(name) if name is not None else "")
    return len(w), hit, sorted(found)


@pytest.fixture(scope="module")
def items(rows):
    passage = rows[12][1].split(". ")[1]
    return [(1, passage), (2, "one two"), (3, None), (4, ""), (5, " ".join(passage.split()[20:45])), (5, "absent entirely from all of the texts that are here today"), (None, "no ID"), (7, rows[14][1][:3000])]


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_contamination(spark, docs, rows, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, hits string")
    got = decontaminate.contamination(docs, bench).collect()
    want = [(i, *brute_contamination(t, items)) for i, t in rows if i != 12]
    have = [(r.doc_id, r.n_words, {p for h in r.hits for p in range(h.start, h.end)}, r.items) for r in got if r.doc_id != 12]
    assert as_bag(have) == as_bag(want)
    long = next(r for r in got if r.doc_id == 12)
    assert long.n_words == 40_000 and "7" in long.items
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert as_bag(r.doc_id for r in clean.select("doc_id").collect()) == as_bag([r.doc_id for r in got if not r.hits])


def test_contamination_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).count() == 0
    assert all(not r.hits for r in decontaminate.contamination(docs, none).collect())


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice("abcdef").encode() for _ in range(rng.randint(10, 40))]
        at = rng.randint(0, len(item) - 10)
        doc = [b"z"] * rng.randint(0, 5) + item[at : at + 10] + [rng.choice("abcz").encode() for _ in range(5)]
        block = decontaminate.Block([("i", b" ".join(item))], 10, 5)
        assert block.scan([b" ".join(doc)])[0][2] == {"i"}


# -- 2 -------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        out.append(np.cumsum(cover)[: len(t)] > 0)
    return out


@pytest.mark.parametrize("large", [6_000_000, 300])
def test_suffix_dedup(spark, docs, rows, large, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "NAME_BYTES", large)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    some = [r for r in rows if r[0] != 12]
    got = suffix_dedup.repeated_bytes(docs.filter("doc_id IS NULL OR doc_id <> 12"), 200).collect()
    texts = [(t or "").encode() for _, t in some]
    want = [(i, len(t), bytes(np.frombuffer(t, np.uint8)[~c]) if t else b"", int(c.sum())) for (i, _), t, c in zip(some, texts, brute_repeats(texts, 200))]
    assert as_bag((r.doc_id, r.n_bytes, bytes(r.kept), sum(s.end - s.start for s in r.spans)) for r in got) == as_bag(want)


def test_suffix_dedup_random(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for _ in range(40)] + ["ab" * 200, "c" * 300, "c" * 41]
    got = suffix_dedup.repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40)
    want = brute_repeats([t.encode() for t in texts], 40)
    for r in got.collect():
        cover = np.zeros(r.n_bytes, bool)
        for s in r.spans:
            cover[s.start : s.end] = True
        assert (cover == want[r.doc_id]).all()


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0


def suffixes(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("step", [0, 64, 10**9])
def test_suffix_array(step, monkeypatch):
    monkeypatch.setattr(suffix_array, "STEP", step)
    rng = random.Random(1)
    for _ in range(200):
        t = bytes(97 + rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(1, 50)))
        s = np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0)
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array_of_long_repeats():
    rng = random.Random(2)
    part = bytes(97 + rng.randrange(20) for _ in range(3000))
    t = part + b"ab" * 700 + part[:2500] + b"z" * 900 + part + b"\0"
    s = np.frombuffer(t, np.uint8).astype(np.int64)
    assert suffix_array.suffix_array(s).tolist() == suffixes(t)


def test_common_prefixes():
    rng = random.Random(3)
    for n in [1, 2, 5, 40, 300, 3000]:
        for letters in (1, 2, 26):
            t = bytes(97 + rng.randrange(letters) for _ in range(n)) * 2 + b"\0"
            order = suffixes(t)
            got = suffix_array.common_prefixes(np.frombuffer(t, np.uint8).astype(np.int64), np.array(order))
            for a, b in zip(order, order[1:]):
                want = next(i for i in range(len(t)) if t[a + i] != t[b + i])
                assert got[b] == want
            assert got[order[0]] == 0


# -- 3 -------------------------------------------------------------------------------------------


def brute_classes(rows, k=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = low_words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(near[i])))
    return out


@pytest.mark.parametrize("block,small", [(1024, 8), (2, 1)])
def test_jaccard_classes(spark, docs, rows, block, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    got = jaccard_join.jaccard_classes(docs)
    assert as_bag(tuple(r) for r in got.collect()) == as_bag(brute_classes(rows))
    stays = jaccard_join.one_of_each(docs)
    assert stays.columns == docs.columns
    want = [i for i, c, _ in brute_classes(rows) if i == c]
    assert as_bag(r.doc_id for r in stays.select("doc_id").collect()) == as_bag(want)


@pytest.mark.parametrize("small", [8, 1])
def test_jaccard_chains(spark, small, monkeypatch):
    """Near copies in chains, so that a class is more than a star."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(6):
        text = [f"w{rng.randrange(10_000)}" for _ in range(80)]
        for _ in range(12):
            text[rng.randrange(80)] = f"w{rng.randrange(10_000)}"
            rows.append((n, " ".join(text)))
            n += 1
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_bag(tuple(r) for r in got.collect()) == as_bag(brute_classes(rows))


def test_one_of_each_knows_rows_by_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (2, "another text that stands alone here"), (None, base), (None, "no identifier but words of its own"), (None, "no identifier and others again here")]
    left = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_bag(tuple(r) for r in left.collect()) == as_bag([rows[0], rows[2], rows[4], rows[5]])


def test_jaccard_of_nothing(no_docs):
    assert jaccard_join.jaccard_classes(no_docs).count() == 0


def test_pruning_keeps_likely_pairs():
    limits = jaccard_join.least_matches(0.8, 1e-6)
    assert [m for m, _ in limits] == list(jaccard_join.STEPS) and all(0 < k < 0.8 * m for m, k in limits)
    a = np.zeros((3, 128), np.uint16)
    b = a.copy()
    b[1, ::5] = 1  # 80 % equal
    b[2, ::2] = 1  # half
    assert jaccard_join.surviving(a, b, limits).tolist() == [0, 1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for x in root}


# -- 4 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(8)
    calm = ["river", "stone", "window", "garden", "paper", "letter", "winter", "summer", "bread", "table"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 1 or i % 7 == 2
        text = [rng.choice(calm) + rng.choice(["", "s", "er"]) for _ in range(40)] + ([rng.choice(["vilething", "nastyword"])] * 2 if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, None, None), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, toxic, docs):
    table, labels = toxic
    model = toxicity.fit(table, labels)
    got = toxicity.score(table, model).join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic").distinct(), "doc_id").withColumn("held", toxicity.in_held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert len(held) > 50 and np.mean([r.predicted == r.toxic for r in held]) > 0.97
    odd = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[4].score == odd[5].score
    disguised = spark.createDataFrame([(1, "river v1leth1ng stone"), (2, "n.a.s.t.y.w.o.r.d window"), (3, "garden v i l e t h i n g"), (4, "nastyyyyyword"), (5, "river stone window")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(disguised, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 0]
    clean = toxicity.clean(disguised, model)
    assert clean.columns == disguised.columns and [r.doc_id for r in clean.collect()] == [5]


def test_toxicity_disguised_in_any_length(spark, toxic):
    model = toxicity.fit(*toxic)
    spaced = lambda text, sign="", gap=" ": " ".join(gap.join(c + sign for c in w) for w in text.split())
    bad = [
        spaced("vilething", "."), "river is a " + spaced("vilething") + " stone", spaced("river stone a nastyword window"), "river\n" + spaced("nasty", ",") + " " + spaced("word", ","),
        "a.n.a.s.t.y.w.o.r.d window", "river/" + "window=garden&" * 9 + "n4styw0rd&stone=1", "r1ver" * 13 + "n4styw0rd" + "st0ne" * 900, "river  " + spaced("garden nastyword").replace("n n", "n   n"),
        spaced("winter summer bread " * 2) + " " + spaced("vilething"), *(spaced(f"{'garden'[:n]}nastyword") for n in range(7)),
    ]
    good = [spaced("river stone window"), "a b c", spaced("summer", "."), "r1ver" * 900, "1 2 3 4 5 6 7 8"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(table, model).orderBy("doc_id").collect()] == [1] * len(bad) + [0] * len(good)
    reader = toxicity.Reader(model.letters)
    assert "windows" in reader._words("window5") and {"to", "us"} <= {*reader.read("t o"), *reader.read("u s")}


def test_likely_words_against_every_cut(toxic):
    letters = toxicity.letter_model(toxicity.letter_counts(toxic[0]))
    cost = lambda a, b, c: letters[(a * 64 + b) * 64 + c]
    for run in ("ariverstone", "vilea", "x", "tt"):
        ways = {}
        for mask in range(2 ** (len(run) - 1)):
            cut = "".join(c + (" " if mask >> i & 1 else "") for i, c in enumerate(run)) + " "
            codes = [0, 0, *(0 if c == " " else toxicity._CODE[c] for c in cut)]
            ways[cut] = sum(cost(*((codes[i - 2], 0, codes[i]) if codes[i - 1] == 0 else codes[i - 2 : i + 1])) for i in range(2, len(codes)))
        most = max(ways.values())
        assert toxicity.likely_words(run, letters) == {w for cut, s in ways.items() if s >= most - toxicity._SLACK for w in cut.split()}


def test_toxicity_never_learns_from_held_out(spark, toxic):
    table, labels = toxic
    flipped = labels.withColumn("toxic", F.when(toxicity.in_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(table, labels).strength == toxicity.fit(table, flipped).strength


def test_toxicity_without_labels(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(no_docs, none)
    assert toxicity.score(no_docs, model).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())


# -- 5 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(docs, rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_groups(docs, keep=keep).collect()
    want = []
    for i, t in rows:
        known = [x for x in groups[t or ""] if x is not None]
        want.append((i, (min if keep == "min" else max)(known) if known else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    assert as_bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == as_bag(want)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_runs_over_partitions(spark):
    """A text that fills many partitions is one group."""
    table = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(600)], "doc_id long, text string")
    got = exact_dedup.exact_groups(table, partitions=16, keep="max").collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(599, 400)}
    assert sum(r.kept for r in got) == 201


def test_exact_splitters_follow_the_content(spark):
    """Ranges in the order of (text, id), also where texts begin alike; repeated rows keep one."""
    long = "the same opening " * 40
    rows = [(i, long + f"{i % 50:03d}" + "x" * (i % 3)) for i in range(900)] + [(5, long + "005xx")] * 3 + [(None, long)] * 3 + [(i, "z") for i in range(200)] + [(2**60 + 1, "big"), (2**60, "big"), (None, "big")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = exact_dedup._splitters(table.withColumnRenamed("doc_id", "id"), 8)
    assert cuts == sorted(cuts) and len(cuts) >= 6 and all(len(t) < len(long) + 6 for t, _ in cuts)
    got = exact_dedup.exact_groups(table, partitions=4, keep="max").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = [(i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in rows]
    assert as_bag((r.doc_id, r.keep_id, r.group_size) for r in got) == as_bag(want)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def test_exact_beginnings():
    for a, b in (("", "a"), ("a", "ab"), ("abc", "abd"), ("abc", "b"), ("x" * 999, "x" * 1000)):
        p = exact_dedup._beginning(a, b)
        assert a < p <= b and b.startswith(p) and not (len(p) > 1 and p[:-1] > a)


def test_drop_exact_copies(docs, rows, no_docs):
    left = exact_dedup.drop_exact_copies(docs, keep="max")
    assert left.columns == docs.columns
    assert left.count() == len({t or "" for _, t in rows})
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0


def test_exact_normalised(spark):
    table = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    got = exact_dedup.exact_groups(table, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


# -- 6 -------------------------------------------------------------------------------------------


def test_sentence_dedup(spark, docs, rows, no_docs):
    got = {r.doc_id: r for r in sentence_dedup.repeated_sentences(docs).collect() if r.doc_id is not None}
    assert got[2].n_removed == got[2].n_sentences > 3 and got[2].kept == "" and got[1].n_removed == 0
    assert got[10].n_removed == 0 and got[11].n_removed >= 4
    passage = rows[12][1].split(". ")[1]
    assert passage[20:-20] not in got[11].kept and rows[13][1].split(". ")[0] in got[11].kept
    assert got[16].n_removed > 390 and got[4].n_sentences == got[5].n_sentences == 0
    assert got[12].kept == rows[14][1]
    assert sentence_dedup.repeated_sentences(docs).count() == len(rows) and sentence_dedup.repeated_sentences(no_docs).count() == 0


def test_sentences_are_those_of_the_pattern(rows):
    rng, digests = random.Random(12), sentence_dedup.Digests()
    odd = ["", " \n", "  a b", "a.b c. d", 'He said "no." Then "yes!" (Really?) Fine', "一。二」三！四", "a\n\nb \n c", "...", "a ...) b", ")))", "x" * 5000 + ")" * 5000, "wait... what?! no. \t", "a。」 b", "a\x0bb\x0cc\x85d\xa0e. f"]
    texts = [t or "" for _, t in rows] + odd + ["".join(rng.choice("ab .!?)\"\n。」") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for text in texts:
        lead, pieces = sentence_dedup.sentences(text, digests)
        assert lead + "".join(pieces) == text and all(p.strip(sentence_dedup._BLANKS) for p in pieces)
        whole = [p for s in re.findall(sentence_dedup.SENTENCE, text) for p in sentence_dedup._pieces(s, digests)]
        assert pieces == whole, text[:80]


def test_long_sentences_are_cut_by_content():
    digests = sentence_dedup.Digests()
    for text in (words(31, 300), "spam " * 100, words(32, 13)):
        w, values = text.split(), [digests[x] for x in text.split()]
        ends = {max(j for j in range(i, i + 8) if values[j] == min(values[i : i + 8])) + 1 for i in range(len(w) - 7)} | {len(w)}
        pieces = sentence_dedup._pieces(text, digests)
        assert [len(p.split()) for p in pieces] == np.diff([0, *sorted(ends)]).tolist()


@pytest.mark.parametrize("length", [50, 120])
def test_passages_are_found_at_every_offset(spark, length):
    passage = words(40, length)
    table = spark.createDataFrame([(i, f"Start here. {words(50 + i, i)} {passage} {words(90 + i, 20)}") for i in range(16)], "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_dedup.repeated_sentences(table).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed >= 3 for i in range(1, 16))
    assert all(len(got[i].kept.split()) <= 2 + i + length + 20 - (length - 34) for i in range(1, 16))


@pytest.mark.parametrize("sample,least", [(32, 16), (1, 1)])
def test_sentence_dedup_is_the_sql(spark, docs, sample, least, monkeypatch, tmp_path):
    """Repeated rows, null ids and all: equal to the SQL, with common runs dealt and without."""
    import duckdb

    from meterlake.llm import queries

    monkeypatch.setattr(sentence_dedup, "SAMPLE", sample)
    monkeypatch.setattr(sentence_dedup, "LEAST", least)
    extra = [(30, "  lead. Two of them. Three of them. Four."), (31, "\n lead. Two of them. Three of them. Four."), (31, "\n lead. Two of them. Three of them. Four."), (32, " \n ")]
    table = docs.select("doc_id", "text").filter("doc_id IS NULL OR doc_id <> 12").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_sentence_dedup(spark, str(tmp_path)).collect()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = base.execute(queries.ORACLES["op6_sentence_dedup"]).fetchall()
    assert as_bag(tuple(r) for r in got) == as_bag(want)


# -- 7 -------------------------------------------------------------------------------------------


def test_bpe_is_the_library(docs, rows, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert as_bag((r.doc_id, list(r.ids), r.decoded) for r in got) == as_bag(want)
    assert as_bag((r.doc_id, list(r.ids), r.decoded) for r in bpe.round_trip(docs, path).collect()) == as_bag(want)
    assert bpe.decode(bpe.encode(no_docs, path), path).count() == 0 and bpe.round_trip(no_docs, path).count() == 0


def test_bpe_memory_starts_anew(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(), random.Random(5)
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 20_000)
    encoder, most = bpe.Encoder(bpe.Vocabulary(path)), 0
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdefgé<|>") for _ in range(rng.randint(1, 9))) for _ in range(60)) + "<|endoftext|>" for _ in range(3)]
        ids, bounds = encoder.encode(texts)
        most = max(most, encoder.held)
        for i, t in enumerate(texts):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want and encoder.v.text(want) == library.decode(want, skip_special_tokens=False)
    assert most < 100_000


def test_bpe_special_and_odd_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))
    texts = ["<|endoftext|>hi<|startoftext|><|endoftext|>", "\0<|endoftext|>", "I'll we've DON'T İΣΑΣ", "aaaa aaaaaaa", "a​b \x00\x01\x1c", "½①٣", "", " \n\t"]
    ids, bounds = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


# -- 8 -------------------------------------------------------------------------------------------


def test_licenses(spark, docs, no_docs):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    table = spark.createDataFrame([
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "   ")), (3, mit.replace("sublicense", "sub-license").replace("License", "Licence")), (4, mit + " more"),
        (5, "Text.\nReleased under the MIT Licence!\nAll rights reserved.\nLicensed under CC BY-NC 4.0"), (6, None), (7, "© 2020 x")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert [got[i].license for i in (1, 2, 3, 4)] == ["MIT", "MIT", "MIT", None]
    assert got[5].notices == ["CC-BY-NC-4.0", "MIT"] and got[5].n_notices == 2 and got[5].license is None
    assert got[6].canonical_sha256 is None and got[7].canonical_sha256 is None
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_docs).count() == 0


# -- 9 -------------------------------------------------------------------------------------------


def test_licenses_behind_copyright_statements(spark):
    mit, flat = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission")), lambda t: " ".join(t.split())
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause" and t.startswith("Redistribution"))
    apache = (licenses.TEXTS / "Apache-2.0.txt").read_text()
    wholes = [
        ("MIT", "Copyright 2020 X " + flat(mit)), ("MIT", "© 2019-2021 Foo Inc. and others. All rights reserved. " + flat(mit)), ("MIT", "MIT License Copyright (c) 2020 Jane Q. Roe " + flat(mit)),
        ("MIT", " * Copyright Foo Corp.\n" + mit.replace(" OR COPYRIGHT", " OR\nCOPYRIGHT")), ("MIT", "(c) 2001 A. B. Cee <a@b.org>\nCopyright (c) 2002 Dee, Inc.\nAll rights reserved.\n\n" + mit), ("MIT", "Copyright <YEAR> <COPYRIGHT HOLDER>\n" + mit),
        ("BSD-3-Clause", "Copyright (c) 2020, The Authors. All rights reserved. " + flat(bsd)), ("BSD-3-Clause", "Copyright the authors\n" + bsd.replace(" COPYRIGHT", "\nCOPYRIGHT")), ("Apache-2.0", flat(apache)), ("Apache-2.0", re.sub(r" copyright(?! owner])", "\ncopyright", apache)),
    ]
    lines = [("MIT", "Copyright (c) 2024 Foo. Released under the MIT License."), ("MIT", "x\n# Copyright 2020 Foo Inc. Released under the MIT License."), ("CC-BY-4.0", "© Foo Bar. Licensed under CC BY 4.0."), ("CC-BY-4.0", "(c) Foo Bar. Licensed under CC BY 4.0."), ("MIT", "All rights reserved. Released under the MIT License.")]
    kept = ["Copyright law in Europe protects works.", "Copyright holders agree.", "copyright notices stay", "C is a language", "(c) You must keep all of the notices", "Copyright Law in Europe protects works."]
    none = ["Copyright (c) 2020 Someone", "© 2020 x", "All rights reserved.", "Copyright Foo Bar", "(C) Foo", "// Copyright 2020-2021, Foo Ltd. All Rights Reserved", "copyright: 2020 foo", "Copyright (c) 2020 A. Copyright (c) 2021 B."]
    table = spark.createDataFrame(list(enumerate([t for _, t in wholes + lines] + kept + none)), "doc_id long, text string")
    got = licenses.scan(table).orderBy("doc_id").collect()
    a, b, c = len(wholes), len(wholes + lines), len(wholes + lines + kept)
    assert [r.license for r in got[:a]] == [n for n, _ in wholes]
    assert [r.notices for r in got[a:b]] == [[n] for n, _ in lines]
    canonical = [" ".join(re.sub(r"\W+", " ", t.lower().replace("(c)", "copyright")).split()).replace("copyright holders", "copyright owners") for t in kept]
    assert [r.canonical_sha256 for r in got[b:c]] == [hashlib.sha256(t.encode()).hexdigest() for t in canonical]
    assert [r.canonical_sha256 for r in got[c:]] == [None] * len(none)


def test_licenses_wherever_lines_break(spark):
    import textwrap

    texts = [(n, t) for n, t in licenses.KNOWN if len(t) > 400] + [(n, t) for n, t in licenses.full_texts() if n == "MPL-2.0"]
    wrapped = [(n, w, "\n".join(textwrap.wrap(" ".join(t.split()), w, break_long_words=False, break_on_hyphens=False))) for n, t in texts for w in (58, *range(60, 90, 3), 200)]
    table = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(wrapped)] + [(-1, "licence licence licences favour favour")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert [(n, w) for i, (n, w, _) in enumerate(wrapped) if got[i].license != n] == []
    assert got[-1].canonical_sha256 == hashlib.sha256(b"license license licenses favor favor").hexdigest()


def test_licenses_full_texts(spark):
    texts = dict(licenses.full_texts()[::-1])
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"} <= {*texts}
    whole = [(n, (licenses.TEXTS / f"{n}.txt").read_text()) for n in texts]
    table = spark.createDataFrame([*whole, *((n, t.upper()) for n, t in whole), ("Apache-2.0", dict(whole)["Apache-2.0"].split("   APPENDIX")[0]), (None, "more " + dict(whole)["MPL-2.0"])], "license string, text string")
    got = licenses.scan(table.select(F.monotonically_increasing_id().alias("doc_id"), "text")).join(table.select(F.monotonically_increasing_id().alias("doc_id"), F.col("license").alias("want")), "doc_id").collect()
    assert [(r.license, r.want) for r in got if r.license != r.want] == []


def test_warc(spark, docs, rows, no_docs, tmp_path):
    pages = docs.drop("html").select(F.col("doc_id").alias("page_id"), F.lit("http://x/y").alias("url"), F.col("text").alias("html"), "payload", "row", "id")
    got = warc.round_trip(pages).collect()
    want = {}
    for i, t in rows:
        want.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.page_id and len((t or "").encode()) == r.payload_bytes)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        least = min((i for i in want[text] if i is not None), default=None)
        assert r.refers_to == (least if r.record_type == "revisit" else None)
    assert sum(r.record_type == "response" for r in got) == len(want)
    path = warc.write_archive(pages, str(tmp_path / "a"))
    back = warc.reconstruct(spark, path).collect()
    assert as_bag((r.page_id, bytes(r.payload)) for r in back) == as_bag((i, (t or "").encode()) for i, t in rows)
    for r in back:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body == (b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n"
    assert spark.read.parquet(f"{path}/payloads").count() == len(want)
    assert warc.round_trip(no_docs.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit(None))).count() == 0


@pytest.mark.parametrize("harm", ["payload", "address", "gone"])
def test_warc_damage_is_found(spark, tmp_path, harm):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abcd")], "page_id long, url string, html string")
    path = warc.write_archive(pages, str(tmp_path / "c"))
    stored = spark.read.parquet(f"{path}/payloads").withColumn("bad", F.octet_length("payload") == 4)
    stored = {
        "payload": stored.withColumn("payload", F.when(F.col("bad"), F.lit(b"abXd")).otherwise(F.col("payload"))),
        "address": stored.withColumn("address", F.when(F.col("bad"), F.sha2(F.lit("x"), 256)).otherwise(F.col("address"))),
        "gone": stored.filter(~F.col("bad")),
    }[harm].drop("bad")
    other = str(tmp_path / "d")
    stored.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    for read in (warc.record_table, warc.reconstruct):
        assert read(spark, path).count() == 2
        with pytest.raises(Exception, match="missing|damaged"):
            read(spark, other).collect()


def test_warc_odd_urls(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u\r\nWARC-Type: revisit", "abc"), (2, "", "b"), (3, None, "c")], "page_id long, url string, html string")
    got = warc.reconstruct(spark, warc.write_archive(pages, str(tmp_path / "e"))).orderBy("page_id").collect()
    assert [(r.url, r.record_type) for r in got] == [("u%0D%0AWARC-Type: revisit", "response"), ("", "response"), (None, "response")]


def test_warc_short_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = warc.write_archive(pages, str(tmp_path / "b"), min_revisit_bytes=5)
    assert sorted((r.page_id, r.record_type) for r in warc.record_table(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


# -- 10 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return html_extract.fit(pages)


def test_html_articles(pages, trees):
    import html

    bad = 0
    for r in html_extract.main_text(pages, trees).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        bad += r.text != "\n".join(p for p in parts if p) or r.n_chars != len(r.text)
    assert bad == 0


def test_html_other_layouts(spark, pages, trees):
    """Held-out layouts: text blocks that are judged right."""
    rng, known = random.Random(99), {}
    from meterlake.llm import dom

    sentences = [s for r in html_extract.main_text(pages, trees).limit(20).collect() for s in re.split(r"(?<=[.])\s", r.text) if s]
    right = total = 0
    for _ in range(120):
        page = dom.read(html_extract.rebuilt(sentences, rng))
        inside = [0] * len(page.tags)
        for i in range(1, len(page.tags)):
            mark = re.search(r'data-main="(\d)"', page.attrs[i])
            inside[i] = int(mark[1]) if mark else inside[page.parents[i]]
        page.attrs = [re.sub(r' ?data-main="\d"', "", a) for a in page.attrs]
        forest = html_extract.Forest([page])
        kept = forest.decode(trees.log_odds(forest.features(known)))
        right += sum(bool(inside[b[0]]) == bool(kept[b[0]]) for b in page.blocks)
        total += len(page.blocks)
    assert right / total > 0.95


def test_html_odd_pages(spark, trees):
    odd = ["", None, "plain text only", "<p>unclosed <b>bold", "<!-- never closed", "<div" * 50, "<script>var a='</p>'", "&lt;p&gt; &amp;amp; &#65; &nbsp; x", "<" * 1000, "<a><b></a></b>" * 200, "<div>" * 3000 + "deep", "<td><li><p>" * 100]
    table = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    got = html_extract.main_text(table, trees).collect()
    assert len(got) == len(odd) and all(r.text is not None and r.n_chars == len(r.text) and r.url == "u" for r in got)
    assert html_extract.fit(table.limit(0)) is None
    untaught = {r.page_id: r.text for r in html_extract.main_text(table, None).collect()}
    assert untaught[2] == "plain text only" and untaught[3] == "unclosed bold" and untaught[1] == ""


def test_html_broken_pages_keep_their_text():
    from meterlake.llm import dom

    told = {
        "<p>one</p><button>go<p>two</p><p>three</p>": ["one", "go", "two", "three"],
        "<p class=foo's>Hello it's <b>fine</b>": ["Hello it's fine"],
        '<a title="x > y">b</a> c': ["b c"],
        '<p title="never closed>one</p><p>two': ["one", "two"],
        "<svg><svg>a</svg>b</svg>c <noscript>d<p>e": ["abc d", "e"],
        "<p>x <math><mi>y</mi></math> <object>z</object></p>": ["x y z"],
        "<title>no<p>yes": ["no", "yes"],
        "<title>no</title><textarea>no</textarea><iframe>no</iframe>yes<style>no</style>!<script>if (a<b) '</p>'</SCRIPT >?": ["yes!?"],
        "<p>a<script>var b": ["a"],
        "a<!-->b<!--->c<!-- d --!>e<!-- f -->g<!DOCTYPE x>h<?i?>j</ k>l</>m": ["abceghjlm"],
        "a < b <3 &lt;i&gt; &amp;amp; &#x41;&nbsp;&nbsp;B": ["a < b <3 <i> &amp; A B"],
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": ["a", "b", "c", "d", "e"],
        "<h2>a</h3>b<p>c<div>d</p>e": ["a", "b", "c", "d", "e"],
        "<head><meta x><link y>a<body>b</head>c": ["a", "bc"],
        "<form><select><option>a<option>b</select>c</form>": ["a", "b", "c"],
        "one <b": ["one"],
        "one <b two <i three": ["one"],
    }
    for source, blocks in told.items():
        assert [b[1] for b in dom.read(source).blocks] == blocks, source


@pytest.mark.parametrize("unit", ['<a href="b ', "<a x='\">", '<a x="><" ', "<div>", "<b><div></b>", "<head>", "</head", "<title>", "<!--", "<p>x", "</p>", "<td><li>", "<", "<a ", "<a>", "x='", "<table><tr><p>", "</b></i>"])
def test_html_reader_is_linear(unit):
    import time

    from meterlake.llm import dom

    began = time.process_time()
    page = dom.read("start " + unit * (1_000_000 // len(unit)))
    forest = html_extract.Forest([page])
    assert forest.depth.max() <= dom.DEEPEST and page.blocks[0][1].startswith("start")
    assert time.process_time() - began < 6, unit


#: Hand-written pages whose names stand in no list of features: html, and the main text's blocks.
FOREIGN = [
    ("""<html><body><div class="wrap"><div class="lnks"><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>Shop</a> <a href=/d>Help</a></div>
     <div class="c7"><h1>How the bridge was built</h1><p>The first stones were laid in the spring, when the river was low and the masons could stand in its bed.</p>
     <p>By the autumn the piers stood well above the water, and the carpenters began to raise the frames on which the arches would rest.</p></div>
     <div class="zz"><h4>Hot</h4><ul><li><a href=1>Ten tips</a></li><li><a href=2>Best hats</a></li><li><a href=3>Win now</a></li></ul></div>
     <div class="btm">&copy; 2020 Bridge Press | <a href=/imprint>Imprint</a></div></div></body></html>""",
     ["How the bridge was built", "The first stones were laid in the spring, when the river was low and the masons could stand in its bed.",
      "By the autumn the piers stood well above the water, and the carpenters began to raise the frames on which the arches would rest."]),
    ("""<body><table><tr><td><a href=x>Start</a><br><a href=y>Archive</a><br><a href=z>Guestbook</a></td><td><h2>A walk along the coast</h2>
     We set out before dawn, with bread and cheese in our bags, and reached the lighthouse as the sun came up over the bay.<p>The keeper, an old man with a grey beard, showed us the lamp and told us of the storms that he had seen.</td></tr>
     <tr><td colspan=2>Last changed in 1999. <a href=m>Mail me</a></td></tr></table></body>""",
     ["A walk along the coast", "We set out before dawn, with bread and cheese in our bags, and reached the lighthouse as the sun came up over the bay.",
      "The keeper, an old man with a grey beard, showed us the lamp and told us of the storms that he had seen."]),
    ("""<body><header><a href=/>Kitchen</a><nav><ul><li><a href=1>Soups</a><li><a href=2>Cakes</a></ul></nav></header><main><h1>Onion soup</h1><p>Cut six onions into thin rings and cook them slowly in butter until they are soft and brown.</p>
     <ul><li>six large onions, peeled and cut</li><li>two spoons of butter and one of flour</li></ul><p>Pour in the stock, let it boil for half an hour, and serve it with toasted bread and grated cheese.</p></main>
     <section id="u9"><h3>Anna</h3><p>Tried it, loved it!</p><h3>Bob</h3><p>Too salty for me.</p></section><footer>Kitchen Ltd.</footer></body>""",
     ["Onion soup", "Cut six onions into thin rings and cook them slowly in butter until they are soft and brown.", "six large onions, peeled and cut", "two spoons of butter and one of flour",
      "Pour in the stock, let it boil for half an hour, and serve it with toasted bread and grated cheese."]),
    ("""<body><div><div><div><span>We store small files on your device.</span> <button>Fine</button></div></div><div><div><div><p>The committee met on Tuesday to discuss the new timetable for the ferry between the islands.</p>
     <blockquote>Nobody who lives here can do without the late boat, said one of the members.</blockquote><p>A vote will be held next month, after the harbour master has given his report on the winter tides.</p></div></div></div>
     <div><a href=q>Terms</a><a href=r>Press</a><a href=s>Jobs</a></div></div></body>""",
     ["The committee met on Tuesday to discuss the new timetable for the ferry between the islands.", "Nobody who lives here can do without the late boat, said one of the members.",
      "A vote will be held next month, after the harbour master has given his report on the winter tides."]),
]


def test_html_foreign_layouts(spark, trees):
    """Blocks of main text on hand-written pages: precision and recall."""
    table = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(FOREIGN)], "page_id long, url string, html string")
    right = given = wanted = 0
    for r in html_extract.main_text(table, trees).collect():
        have, want = Counter(r.text.split("\n")) - Counter([""]), Counter(FOREIGN[r.page_id][1])
        right, given, wanted = right + (have & want).total(), given + have.total(), wanted + want.total()
        print(r.page_id, (have - want), (want - have))
    print(f"precision {right / max(1, given):.2f}, recall {right / wanted:.2f}")
    assert right / wanted >= 0.9 and right / given >= 0.7
