"""Toxicity scores with noisy-channel deobfuscation.

A character trigram model is counted over every document. A token that looks disguised (digits or
signs among its letters, letters three in a row, single letters spaced out) is a lattice: each sign
stands for one of several letters or for nothing, each repeated letter for itself or for nothing.
Viterbi decoding finds the likeliest plain word. The restored words are then scored by what labelled
rows say of them and of their beginnings, and a logistic model turns a document's summed
evidence and its strongest word into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.staging import staged
from meterlake.llm.words import frugal, slices

#: Labelled rows that a model is fitted to at most; the rows are those of least hash of doc_id.
MAX_TRAINING_ROWS = 20_000
#: Log odds from which a term counts as evidence.
LEAST_STRENGTH = 0.7
#: Fixed: what a sign may stand for in disguised writing.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
         "|": "il", "(": "c", "+": "t", "€": "e", "£": "l"}
_ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}  # 0 is a word's edge
_OTHER, _SIDE = len(_ALPHABET) + 1, 64
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S[.\-_*,;:!?/|~]*(?:\s+\S[.\-_*,;:!?/|~]*)+(?!\S)")
_WIDE = re.compile(r"\s{2,}|[^\S ]")
_DOTTED = re.compile(r"(?<![^\W_])[^\W_][.\-_*~^][^\W_][.\-_*~^][^\W_](?![^\W_])")
_TRIM = ".,;:?'\"…»«”“‘’)]}>%&#~"
_SPLIT = re.compile(r"[./\\_=<>&%#,;:?\"]")
_DISGUISED = re.compile(r"[^\W\d_][0-9@$!|(+€£*^~.\-_]+[^\W\d_]|^[0-9@$!|(+€£][^\W\d_]|^[^*].*(?<=[^\W\d_])[0-9@$!|(+€£*]+$")
_MASK = "*"
#: Signs that are decoded at once; windows overlap by the longest word looked for.
_WINDOW, _LONGEST = 4096, 64
#: Nats by which a reading of a run may fall short of the likeliest one and its words still count.
_SLACK = 4.0
_DROP, _MASKED, _STAND, _REPEAT = -8.0, math.log(1 / 26), math.log(0.5), math.log(0.5)
_EDGE_CODES = np.array([_CODE.get(bytes([b]).decode("latin-1").lower(), _OTHER if b >= 128 and chr(b).isalpha() else 0) for b in range(256)], np.int64)


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents: of 64 cubed at most, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SIDE**3, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                raw = b" ".join(texts).decode().encode("latin-1", "replace").replace(b"?", b" ")
                c = np.concatenate([[0], _EDGE_CODES[np.frombuffer(raw, np.uint8)], [0, 0]])
                grams = (c[:-2] * _SIDE + c[1:-1]) * _SIDE + c[2:]
                total += np.bincount(grams[(c[1:-1] > 0) | (c[2:] > 0)], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(count, "gram long, n long")
    out = np.zeros(_SIDE**3, np.int64)
    for gram, n in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[gram] = n
    return out


def letter_model(counts: np.ndarray) -> list[float]:
    """Log probability of a letter after two others, backing off to one and to none."""
    three = counts.reshape(_SIDE, _SIDE, _SIDE).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 4 * p2) / (three.sum(2, keepdims=True) + 4)
    return np.log(p3).reshape(-1).tolist()


def restore(token: str, model: list[float], gaps: bool = False, repeats: bool = True) -> str:
    """The likeliest plain word behind a disguised token, by Viterbi over its letter lattice. With
    ``gaps`` a word may end after any letter, so that the result may be several words; without
    ``repeats`` no repeated letter is dropped."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    previous, run = "", 0
    signs = token.lower()
    for at, ch in enumerate(signs):
        run = run + 1 if ch == previous else 1
        if ch in _CODE:
            ways = [(ch, 0.0)] + ([(None, _REPEAT)] if repeats and run > 1 else [])
        elif ch == _MASK and signs[at - 1 : at].isalpha() and (at + 1 == len(signs) or signs[at + 1].isalpha()):
            ways = [(c, _MASKED) for c in _ALPHABET[:26]] + [(None, _DROP)]
        elif ch in SIGNS:
            ways = [(c, _STAND) for c in SIGNS[ch]] + [(None, _DROP)]
        else:
            ways = [(ch, 0.0)] if ch.isalpha() else [(None, 0.0)]
        previous, after = ch, {}
        for (a, b), (score, out) in states.items():
            for letter, cost in ways:
                if letter is None:
                    key, value, path = (a, b), score + cost, out
                else:
                    c = _CODE.get(letter, _OTHER)
                    key, value, path = (b, c), score + cost + model[(a * _SIDE + b) * _SIDE + c], (letter, out)
                if key not in after or value > after[key][0]:
                    after[key] = (value, path)
        if gaps:
            for (a, b), (score, out) in [x for x in after.items() if x[0][1]]:
                value = score + model[(a * _SIDE + b) * _SIDE]
                if (b, 0) not in after or value > after[b, 0][0]:
                    after[b, 0] = (value, (" ", out))
        states = after
    ends = ((s if gaps and not b else s + model[(a * _SIDE + b) * _SIDE], p) for (a, b), (s, p) in states.items())
    _, path = max(ends, key=lambda x: x[0])
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters)).strip()


def likely_words(letters: str, model: list[float]) -> set[str]:
    """The words of every way to cut a run of letters that is nearly as likely as the likeliest way."""
    n = len(letters)
    if not n:
        return set()
    c = np.array([0, 0, *(_CODE.get(x, _OTHER) for x in letters)])
    p = lambda a, b, x: np.array([model[i] for i in (a * _SIDE + b) * _SIDE + x])
    begin, second, inner = p(c[1:-1], c[2:] * 0, c[2:]), p(c[2:] * 0, c[1:-1], c[2:]), np.cumsum(p(c[:-2], c[1:-1], c[2:]))
    single, end = p(c[2:] * 0, c[2:], c[2:] * 0), p(c[1:-1], c[2:], c[2:] * 0)
    # A word's letters after its first two depend on nothing before it: sums of them are differences.
    two = np.concatenate([begin[:-1] + second[1:] - inner[1:], [0.0]])

    def ending(j: int) -> np.ndarray:
        """Of the words that end before ``j``, by their first letters' places."""
        lo = max(0, j - _LONGEST)
        return np.append(two[lo : j - 1] + inner[j - 1] + end[j - 1], begin[j - 1] + single[j - 1])

    costs = [ending(j) for j in range(1, n + 1)]
    best, rest = np.zeros(n + 1), np.full(n + 1, -np.inf)
    for j in range(1, n + 1):
        best[j] = (best[max(0, j - _LONGEST) : j] + costs[j - 1]).max()
    rest[n], found = 0.0, set()
    for j in range(n, 0, -1):
        lo = max(0, j - _LONGEST)
        ways = costs[j - 1] + rest[j]
        rest[lo:j] = np.maximum(rest[lo:j], ways)
        found.update(letters[lo + i : j] for i in np.flatnonzero(best[lo:j] + ways >= best[n] - _SLACK).tolist())
    return found


class Reader:
    """Splits texts into restored words, remembering the tokens met."""

    def __init__(self, model: list[float], memory: int = 400_000) -> None:
        self.model, self.memory, self.known = model, memory, {}

    def words(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            got = self.known[token] = self._words(token)
        return got

    def _words(self, token: str) -> tuple[str, ...]:
        if _PLAIN.match(token):
            return (restore(token, self.model),) if _TRIPLE.search(token.lower()) else (token.lower(),)
        bare = token.strip(_TRIM)
        plain = tuple(w.lower() for w in _LETTERS.findall(bare))
        if _DISGUISED.search(bare) or _TRIPLE.search(bare.lower()):
            parts = [bare] + [p for p in _SPLIT.split(bare) if p != bare and _DISGUISED.search(p)]
            found = {w for p in parts if len(p) <= _LONGEST and (w := restore(p, self.model))}
            if len(bare) > _LONGEST or _DOTTED.search(bare):
                found |= self.run_on(bare)
            return plain + tuple(sorted(found))
        return plain

    def run_on(self, signs: str) -> set[str]:
        """The words of disguised writing without gaps between words."""
        found = set()
        for lo in range(0, max(1, len(signs) - _LONGEST), _WINDOW - _LONGEST):
            window = signs[lo : lo + _WINDOW]
            read = {restore(window, self.model, True, repeats).replace(" ", "") for repeats in (True, False)}
            found.update(*(likely_words(letters, self.model) for letters in read))
        return found

    def spaced(self, text: str, tokens: list[str]) -> Iterator[str]:
        """Words written as single letters with gaps; wider gaps may stand between words."""
        for run in _SPACED.findall(text):
            stretches = {run, *_WIDE.split(run)} if _WIDE.search(run) else {run}
            for letters in sorted({"".join(t[0] for t in x.split()) for x in stretches} - {""}):
                yield from self.unspaced(letters)

    def unspaced(self, letters: str) -> tuple[str, ...]:
        got = self.known.get(letters + " ")
        if got is None:
            whole = {restore(letters, self.model)} - {""} if len(letters) <= _LONGEST else set()
            got = tuple(sorted(self.run_on(letters) | whole))
            if len(letters) <= _WINDOW:
                if len(self.known) >= self.memory:
                    self.known.clear()
                self.known[letters + " "] = got
        return got

    def read(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        tokens = text.split()
        found = {w for token in set(tokens) for w in self.words(token)}
        found.update(self.spaced(text, tokens))
        return found


def _terms(word: str) -> tuple[str, ...]:
    """A word, and its beginnings."""
    return (word, *(f"^{word[:n]}" for n in (5, 6, 7) if len(word) > n))


@dataclass
class ToxicityModel:
    """Letter model, term strengths (log odds of a lower bound of the share of toxic rows among those
    with the term, over the odds of all rows) and the logistic weights of a document's evidence."""

    letters: list[float]
    strength: dict[str, float]
    weights: list[float]

    def scorer(self):
        reader, get = Reader(self.letters), self.strength.get

        def strong(words) -> tuple[tuple[str, float], ...]:
            return tuple((w, s) for w in words if (s := max(get(t, 0.0) for t in _terms(w))) > 0)

        class Known(dict):
            """The strong words behind a token, mostly none."""

            def __missing__(self, token: str):
                if len(self) >= reader.memory:
                    self.clear()
                self[token] = got = strong(reader._words(token))
                return got

        known, w = Known(), self.weights

        def evidence(text: str) -> tuple[float, float]:
            tokens = text.split()
            found: dict[str, float] = {}
            for got in filter(None, map(known.__getitem__, set(tokens))):
                found.update(got)
            found.update(strong(reader.spaced(text, tokens)))
            return math.log1p(sum(found.values())), max(found.values(), default=0.0)

        def score(text: str) -> float:
            both, most = evidence(text)
            z = w[0] + w[1] * both + w[2] * most
            return 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))

        return evidence, score


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.02] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def in_held_out(id_col):
    """Rows that are never learnt from: crc32 of the identifier as text is a multiple of five."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Count letters over all of ``docs`` and learn from at most ``max_rows`` labelled rows outside
    the held-out fifth. Null labels and null identifiers are left out; of several labels of one
    document the largest counts. Without rows of both kinds every score is the share of toxic rows
    (0 without any)."""
    letters = letter_model(letter_counts(docs, text_col))
    marked = labels.filter(labels[id_col].isNotNull() & labels[label_col].isNotNull() & ~in_held_out(labels[id_col]))
    marked = marked.groupBy(marked[id_col].cast("long").alias("id")).agg(F.max(marked[label_col].cast("int")).alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    train = staged(texts.join(F.broadcast(chosen), "id").select("text", "y"), "toxicity-training")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(letters)
        for frame in frames:
            for lo in range(0, len(frame), 500):
                part, by = frame.iloc[lo : lo + 500], (Counter(), Counter())
                for text, y in zip(part["text"], part["y"], strict=True):
                    by[int(y > 0)].update({t for w in reader.read(text) for t in _terms(w)})
                keys = [*(by[0] | by[1])]
                yield pd.DataFrame({"term": keys, "n0": [by[0][k] for k in keys], "n1": [by[1][k] for k in keys]})

    n0, n1 = train.agg(F.count_if(F.col("y") <= 0), F.count_if(F.col("y") > 0)).first()
    if not n0 or not n1:
        return ToxicityModel(letters, {}, [30.0 if n1 else -30.0, 0.0, 0.0])
    n = F.col("n0") + F.col("n1")
    p, z = F.col("n1") / n, 3.0
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    terms = train.mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log(F.col("s") / (1 - F.col("s"))) - math.log(n1 / n0)
    strong = terms.withColumn("s", bound).filter((F.col("s") > n1 / (n0 + n1)) & (n > 2)).withColumn("s", odds).filter(F.col("s") > LEAST_STRENGTH)
    model = ToxicityModel(letters, {r.term: float(r.s) for r in strong.select("term", "s").collect()}, [0.0] * 3)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence, _ = shared.value.scorer()
        for frame in frames:
            yield pd.DataFrame([(*evidence(t), float(y > 0)) for t, y in zip(frame["text"], frame["y"], strict=True)], columns=["a", "b", "y"])

    rows = np.array([tuple(r) for r in train.mapInPandas(measure, "a double, b double, y double").collect()])
    model.weights = _logistic(rows[:, :2], rows[:, 2])
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted``. A null text is empty and gets the
    score of a text without words; very long texts are read whole; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = None
        for batch in batches:
            rate = rate or shared.value.scorer()[1]
            for part, texts in slices(batch, "text"):
                scores = np.array([rate(t.decode()) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], schema=arrow)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = None
        for batch in batches:
            rate = rate or shared.value.scorer()[1]
            for part, texts in slices(batch, text_col):
                yield part.filter(pa.array([rate(t.decode()) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
