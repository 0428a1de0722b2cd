"""Vectorised word and shingle hashing over Arrow string columns.

All functions work on the UTF-8 bytes of a whole Arrow batch; no Python
string is made for a word.  A word is a longest run of characters other than
space and U+0009..U+000D; A-Z count as a-z.  Words hash to 64 bits by a
polynomial over a random byte table modulo 2**64, finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2**64
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _MULT + np.uint64(salt))


def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    table = seeds(256, 77)
    table[65:91] = table[97:123]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return table, space


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def chunks(offsets: np.ndarray, most: int = _CHUNK):
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


class WordHasher:
    """Hashes the words of byte ranges; keeps power tables between calls."""

    def __init__(self) -> None:
        self.table, self.space = _byte_table()
        self.pow = _powers(_CHUNK, _BASE)
        self.inv = _powers(_CHUNK, pow(_BASE, -1, 1 << 64))

    def _grow(self, n: int) -> None:
        if n > len(self.pow):
            self.pow = _powers(n, _BASE)
            self.inv = _powers(n, pow(_BASE, -1, 1 << 64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, starts, ends, and for each row the index of its first word (rows+1)."""
        n = len(data)
        self._grow(n)
        solid = ~self.space[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            after[-1] = False
            after[:-1] = solid[1:]
        starts = np.flatnonzero(solid & (~before | cut[:-1]))
        ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.pow[:n], out=total[1:])
        self.total = total
        return self.spans(starts, ends), starts, ends, np.searchsorted(starts, offsets)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of the data last given to ``words``."""
        h = (self.total[ends] - self.total[starts]) * self.inv[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * _MULT))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words and each row's first shingle (rows+1).

    A row of fewer words has its whole sequence as its one shingle; a row
    without words has none.  Repeats are still in.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(n)), counts)
    begin = first[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows])
    length = np.minimum(n, k)[rows]
    h = length.astype(np.uint64) * _MULT
    for j in range(k):
        with_j = j < length
        w = words[np.minimum(begin + j, max(len(words) - 1, 0))] if len(words) else np.zeros(0, dtype=np.uint64)
        h = np.where(with_j, mix(h * np.uint64(3) + w), h)
    return h, at


def distinct_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and offsets."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, np.searchsorted(rows, np.arange(len(at)))
