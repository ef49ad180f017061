"""Words of a text, as bytes: lower-cased A-Z, cut at every ASCII byte that is neither letter nor digit.

On UTF-8 bytes this is the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over code points, since every byte of
a code point beyond ASCII is itself beyond ASCII.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Text bytes that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows of bounded text size, each with its texts as bytes; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    lo, size = 0, 0
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
    for i, n in enumerate(lengths):
        if i > lo and size + n > SLICE_BYTES:
            yield batch.slice(lo, i - lo), [x or b"" for x in texts.slice(lo, i - lo).to_pylist()]
            lo, size = i, 0
        size += int(n)
    if lo < len(batch):
        yield batch.slice(lo), [x or b"" for x in texts.slice(lo).to_pylist()]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` giving its memory back to the system when a task ends: Spark keeps the worker for tasks
    of later stages, which need the room."""

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return ending


class Hashes(dict):
    """64-bit hashes of words, filled as they are met; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in place order; a text of fewer words, but not none, has one."""
    if len(hashes) == 0:
        return hashes
    n = max(1, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(hashes))):
        out = mix(out * np.uint64(31) + hashes[j : j + n])
    return out
