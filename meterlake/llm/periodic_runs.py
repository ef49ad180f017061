"""Periodic runs of words: stretches that repeat with some period at least twice, found exactly.

A suffix automaton of a stretch of words has the suffixes that end at a word on one path of its link
tree. Sweeping the words in order, each one accesses the path of its prefix as a link-cut tree does:
the path falls into segments of one colour, the colour being the place where the segment's suffixes
ended last, and is recoloured with the present place. A segment whose longest suffix has ``n`` words
and which ended ``d`` words ago is a square of period ``d`` if ``n >= d``; it begins where the run of
that period begins, and the last word that sees it ends the run. A square's root that was seen last
exactly ``d`` words ago is no power of a shorter word, so ``d`` is the least period.

Most texts repeat little. In a run of at least ``m`` words and two periods every word lies in one of
``(m + 1) // 2`` consecutive words that occur again inside the run, so only stretches of such words get an
automaton; what is left out can be part of no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterlake.llm.words import Hashes, frugal, mix, shingles, slices


def _automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: links and lengths of its states (0 is the root), and the state of each prefix."""
    follow: list[dict[int, int]] = [{}]
    link, length, prefix, last = [-1], [0], [], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = split
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = split
                    p = link[p]
        last = new
        prefix.append(new)
    return link, length, prefix


class LastEnds:
    """Link-cut access over the links of an automaton: each preferred path is a splay tree ordered by
    depth, whose root carries the place (from 1) where the path's suffixes ended last; 0 is none.
    Node 0 stands for no node, so the automaton's root, which has the empty suffix only, takes no part."""

    def __init__(self, link: list[int]) -> None:
        self.up = [max(x, 0) for x in link]
        self.left, self.right, self.ended = [0] * len(link), [0] * len(link), [0] * len(link)

    def _splay(self, u: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = u
        while True:
            p = up[u]
            if not p or (left[p] != u and right[p] != u):
                break
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == u):
                self._rotate(p)
            elif inner:
                self._rotate(u)
            top = g if inner else p
            self._rotate(u)
        if top != u:
            self.ended[u] = self.ended[top]

    def _rotate(self, u: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[u]
        g = up[p]
        if left[p] == u:
            child = left[p] = right[u]
            right[u] = p
        else:
            child = right[p] = left[u]
            left[u] = p
        if child:
            up[child] = p
        up[p], up[u] = u, g
        if g:
            if left[g] == p:
                left[g] = u
            elif right[g] == p:
                right[g] = u

    def access(self, u: int, now: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``u`` upwards with ``now``; gives the deepest node and the colour of each
        segment that had one."""
        up, right, ended, below = self.up, self.right, self.ended, 0
        while u:
            self._splay(u)
            if ended[u]:
                yield u, ended[u]
            if right[u]:
                ended[right[u]] = ended[u]
            right[u] = below
            below, u = u, up[u]
        ended[below] = now


def runs_of(symbols: list, least: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` symbols, by start and period."""
    names: dict = {}
    link, length, prefix = _automaton([names.setdefault(s, len(names)) for s in symbols])
    paths, ends = LastEnds(link), {}
    for now, state in enumerate(prefix, 1):
        for deepest, then in paths.access(state, now):
            period = now - then
            if length[deepest] >= period:
                ends[then - length[deepest], period] = now
    return sorted((start, end - start, period) for (start, period), end in ends.items() if end - start >= max(least, 2 * period))


def _repetitive(hashes: np.ndarray, owner: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches of consecutive words of one owner, each word in ``k`` words that occur again in the same
    stretch. Equal hashes of different words make a stretch too long at worst."""
    at, group = np.arange(len(hashes)), owner
    while len(at) >= k:
        n = len(at) - k + 1
        whole = np.flatnonzero(group[k - 1 :] == group[:n])
        keys = mix(shingles(hashes[at], k)[whole] ^ mix(group[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        equal = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        again = np.zeros(len(whole), bool)
        again[order[equal]] = again[order[equal + 1]] = True
        cover = np.zeros(len(at) + 1, np.int32)
        cover[whole[again]] += 1
        cover[whole[again] + k] -= 1
        kept = np.cumsum(cover[:-1]) > 0
        last, (at, group) = len(at), (at[kept], group[kept])
        cuts = np.append(0, np.cumsum((np.diff(at) != 1) | (np.diff(group) != 0))) if len(at) else at
        if len(at) == last:
            first = np.flatnonzero(np.append(True, np.diff(cuts) != 0))
            return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 1).tolist(), strict=True))
        group = cuts
    return []


def _texts_runs(texts: list[bytes], least: int, hashes: Hashes) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    split = [t.split() for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    flat = hashes.of([w for words in split for w in words])
    owner = np.repeat(np.arange(len(split)), np.diff(bounds))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for lo, hi in _repetitive(flat, owner, max(1, (least + 1) // 2)):
        i = int(owner[lo])
        first = int(lo - bounds[i])
        found.setdefault(i, []).extend((first + start, n, p) for start, n, p in runs_of(split[i][first : first + hi - lo], least))
    return ((words, found.get(i, [])) for i, words in enumerate(split))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those of a run behind its first period, joined by one space."""
    gone = bytearray(len(words))
    for start, n, period in runs:
        gone[start + period : start + n] = b"\1" * (n - period)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if runs else b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, its ``runs`` (start and length in words, least period) by start
    and period, and the text ``collapsed``: the words that no run contains behind its first period, joined
    by one space.

    Words are what ASCII white space separates, numbered from 0. A run is a stretch of at least ``least``
    words and two periods that no word beside it continues. A null or empty text has no words and no
    runs and collapses to the empty text; repeated rows and ids give a row each; other columns are
    ignored; an empty table gives no rows. Texts are worked on where they are read, so nothing is
    shuffled; a task holds the automaton of one stretch, some 600 bytes a word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                runs, collapsed = [], []
                for words, found in _texts_runs(texts, least, hashes):
                    runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
                    collapsed.append(_collapsed(words, found))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=_ARROW)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), _SCHEMA)
