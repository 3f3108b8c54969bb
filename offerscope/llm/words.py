"""Vectorised word tables over Arrow text columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. These bytes never occur inside
a UTF-8 sequence, so words are found on the raw buffer of an Arrow string column, without a
Python object for each word. Each word gets a 64-bit polynomial hash from prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are worked on in slices of about this many bytes, so that temporaries stay small.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_LIBC = ctypes.CDLL(None)
_POWERS: dict[str, np.ndarray] = {}


def lean(run: Callable) -> Callable:
    """A task's function over batches that gives what it has freed back to the system when it ends, as workers live on."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        _POWERS[key] = np.cumprod(steps)
    return _POWERS[key][:n]


@dataclass
class Words:
    """The words of rows lo..hi of a text column; `doc` counts from lo."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    total: np.ndarray | None = None

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of each word's first `size` bytes."""
        stop = np.minimum(self.end, self.start + size)
        return mix((self.total[stop] - self.total[self.start]) * _powers(_INVERSE, len(self.total))[self.start])

    def first(self) -> np.ndarray:
        """Index of each document's first word, with the number of words as last entry."""
        return np.searchsorted(self.doc, np.arange(self.hi - self.lo + 1))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words from each word on; valid where they are of one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * _ROLL + self.hash[j : j + n]
        return mix(h), self.doc[:n] == self.doc[k - 1 :]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Word table of the texts between offsets; `space` marks the bytes between words."""
    at = int(offsets[0])
    b = data[at : int(offsets[-1])]
    off = offsets - at
    n = len(b)
    if lower:
        b = LOWER[b]
    inside = ~space[b]
    begin, stop = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        cut = np.unique(off[(off > 0) & (off < n)])
        begin[cut] = inside[cut]
        stop[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers(_BASE, n), out=total[1:])
    h = mix((total[end] - total[start]) * _powers(_INVERSE, n + 1)[start])
    w = Words(0, len(offsets) - 1, b, off, start, end, np.searchsorted(off, start, "right") - 1, h)
    w.total = total
    return w


def ranges(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, one row at least."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def word_tables(column: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = SPACE) -> Iterator[Words]:
    """Word tables of a column, slice by slice, in row order."""
    data, offsets = buffers(column)
    for lo, hi in ranges(offsets):
        w = split(data, offsets[lo : hi + 1], lower, space)
        w.lo, w.hi = lo, hi
        yield w


def crossing(values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of each key in sorted `values`, -1 where it isn't there."""
    if not len(values):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(values, key), len(values) - 1)
    return np.where(values[at] == key, at, -1)
