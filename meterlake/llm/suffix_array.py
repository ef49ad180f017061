"""Suffix array of a shard by induced sorting, and its permuted longest common prefixes.

Suffixes are classified as smaller or larger than the next one; the leftmost smaller (LMS) substrings
are sorted by one induction and named; the suffixes of the string of names are ordered by the same
method, recursively; a second induction gives the whole array. Over a small alphabet a bucket's
suffixes are moved at once, in their order; over the many names of a deeper level, one by one.

A string ends in a 0 that stands nowhere else in it.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Suffixes placed one by one in the time of a step that moves a bucket.
STEP = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one counts as such."""
    step = np.sign(np.diff(s.astype(np.int32)))
    where = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(where[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def _deal(places: np.ndarray, s: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append places to the buckets of their letters, keeping their order."""
    if len(places):
        letters = s[places]
        order = np.argsort(letters, kind="stable")
        places, letters = places[order], letters[order]
        cuts = np.flatnonzero(np.diff(letters)) + 1
        for group in np.split(places, cuts):
            buckets[s[group[0]]].append(group)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the LMS suffixes in the order given."""
    starts = np.flatnonzero(np.append(True, np.diff(s) != 0))
    longest = np.zeros(int(s.max()) + 1, np.int64)
    np.maximum.at(longest, s[starts], np.diff(np.append(starts, len(s))))
    # By buckets it takes a step for each letter and each letter of its longest run.
    return (_induce_buckets if STEP * int(longest.sum()) < len(s) else _induce_each)(s, small, lms)


def _induce_each(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induction by one scan from the left and one from the right."""
    n, counts = len(s), np.bincount(s)
    ends = np.cumsum(counts)
    order = np.full(n, -1, np.int32)
    # Equal letters of the LMS suffixes fill the end of their bucket, in the order given.
    sorted_ = lms[np.argsort(s[lms], kind="stable")]
    seeds = np.bincount(s[lms], minlength=len(counts))
    order[np.repeat(ends - np.cumsum(seeds), seeds) + np.arange(len(lms))] = sorted_
    letter, before = np.full((2, n + 1), -1, np.int32), np.where(small[:-1], 1, 0)
    letter[before, np.arange(1, n)] = s[:-1]  # of the suffix one before, if it is of the kind that the scan places
    places = array("i", order.tobytes())
    kind, head = array("i", letter[0].tobytes()), array("i", (ends - counts).astype(np.int32).tobytes())
    for i in range(n):
        p = places[i]
        c = kind[p]
        if c >= 0:
            places[head[c]] = p - 1
            head[c] += 1
    kind, tail = array("i", letter[1].tobytes()), array("i", ends.astype(np.int32).tobytes())
    for i in range(n - 1, -1, -1):
        p = places[i]
        c = kind[p]
        if c >= 0:
            tail[c] -= 1
            places[tail[c]] = p - 1
    return np.frombuffer(places, np.int32).astype(np.int64)


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same, a bucket at a time."""
    letters = int(s.max()) + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(letters)]
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(lms, s, seeds)
    large: list[np.ndarray] = []
    none = np.zeros(0, np.int64)

    def before(places: np.ndarray, of: bool) -> np.ndarray:
        places = places[places > 0] - 1
        return places[small[places] == of]

    last = np.array([len(s) - 1])
    for c in range(letters):
        done: list[np.ndarray] = []
        if c == s[-1]:  # the end itself comes before all
            _deal(before(last, False), s, larger)
        while larger[c]:
            batch = np.concatenate(larger[c])
            larger[c] = []
            done.append(batch)
            _deal(before(batch, False), s, larger)
        large.append(np.concatenate(done) if done else none)
        if seeds[c]:
            batch = np.concatenate(seeds[c])
            _deal(before(batch[batch != len(s) - 1], False), s, larger)
    parts: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        done = []
        while smaller[c]:
            batch = np.concatenate(smaller[c])
            smaller[c] = []
            done.append(batch)
            _deal(before(batch, True), s, smaller)
        parts += done
        if len(large[c]):
            parts.append(large[c][::-1])
            _deal(before(large[c][::-1], True), s, smaller)
    parts.append(last)
    return np.concatenate(parts)[::-1]


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, in text order, from their sorted order."""
    end = np.full(len(s), len(s) - 1)
    end[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    new = end[a] - a != end[b] - b
    new[a == len(s) - 1] = True
    alive, j = np.flatnonzero(~new), 0
    while len(alive):
        differs = s[a[alive] + j] != s[b[alive] + j]
        new[alive[differs]] = True
        alive = alive[~differs]
        j += 1
        alive = alive[j <= end[a[alive]] - a[alive]]
    name = np.zeros(len(s), np.int64)
    name[order] = np.append(0, np.cumsum(new))
    return name[lms]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order."""
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(s, small, lms)
    first = _induce(s, small, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names = _names(s, order, lms)
    if names.max() + 1 < len(lms):
        order = lms[suffix_array(names)]
    return _induce(s, small, order)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in text order, the letters it shares with its predecessor in the array; zero for
    the first. Where the letters before both are equal too, that is one less than at the place before;
    only the other places are compared, letter by letter."""
    n = len(s)
    phi = np.zeros(n, np.int64)
    phi[order[1:]] = order[:-1]
    if n == 1:
        return phi
    own = s[np.arange(n) - 1] != s[phi - 1]
    here = np.flatnonzero(own)
    there, value = phi[here], np.zeros(len(here), np.int64)
    wide = np.zeros(n + 3, np.uint64)
    wide[:n] = s
    four = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3:] << np.uint64(48)
    alive, done = np.arange(len(here)), 0
    while len(alive) > 64 or (len(alive) and done < 512):
        other = four[here[alive] + done] ^ four[there[alive] + done]
        for bits in (16, 32, 48, 64):
            value[alive] += other & np.uint64(2**bits - 1) == 0
        alive, done = alive[other == 0], done + 4
    for i in alive.tolist():
        a, b = here[i] + done, there[i] + done
        while True:
            m = min(65_536, n - max(a, b))
            apart = np.flatnonzero(s[a : a + m] != s[b : b + m])
            if len(apart):
                value[i] = a + apart[0] - here[i]
                break
            a, b = a + m, b + m
    nearest = np.cumsum(own) - 1
    return value[nearest] - (np.arange(n) - here[nearest])


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, whether its ``length`` bytes from each place also start at another place, of
    the same text or of another. Nothing matches across texts."""
    size = sum(map(len, texts)) + len(texts) + 1
    s = np.ones(size, np.int32)  # 1 ends a text, 0 the shard
    s[-1] = 0
    at, starts = 0, []
    for text in texts:
        s[at : at + len(text)] = np.frombuffer(text, np.uint8).astype(np.int32) + 2
        starts.append(at)
        at += len(text) + 1
    order = suffix_array(s)
    shared = common_prefixes(s, order)
    phi = np.zeros(size, np.int64)
    phi[order[1:]] = order[:-1]
    gap = np.flatnonzero(s < 2)
    room = gap[np.searchsorted(gap, np.arange(size))] - np.arange(size)
    places = np.flatnonzero((shared >= length) & (room >= length))
    marked = np.zeros(size, bool)
    marked[places] = True
    marked[phi[places]] = True
    return [marked[a : a + max(0, len(t) - length + 1)] for a, t in zip(starts, texts, strict=True)]
