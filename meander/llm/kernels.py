"""Vectorised text kernels (numpy over Arrow buffers) used inside Spark tasks.

A batch's strings are handled as one byte buffer: every function costs a few
passes over the bytes and none loops over words in Python.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK_BYTES = 500_000
_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = _U(0x9E3779B97F4A7C15)


def tidied(run: Callable) -> Callable:
    """A task function that gives its memory back to the system at the end, as Spark keeps its Python workers."""

    @functools.wraps(run)
    def wrapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapper


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LANE = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def text_array(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty."""
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a large string array without nulls."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, off: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the offset of its first word (n+1 values). gap: the bytes between words."""
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = ~gap[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = off[1:-1][off[1:-1] < len(data)]
    first[edge] = ink[edge]
    last = np.zeros(len(data) + 1, bool)
    last[1:] = ink[:-1] & (~ink[1:])
    edge = edge[edge > 0]
    last[edge] |= ink[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    at = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(at, n)
    letters = data[within + np.repeat(starts, n)]
    h = np.add.reduceat(_BYTE[letters] * powers(int(n.max()))[within], at)
    return mix(h ^ (n.astype(np.uint64) * _U(0xFF51AFD7ED558CCD)))


def shingles(h: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in each row, and their row offsets.

    A row with fewer words (at least one) has one: its whole sequence. Repeats are kept.
    """
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_rows[-1]), np.uint64)
    if len(h) >= size:
        run = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            run += h[k : len(h) - size + 1 + k] * _LANE[k]
        run = mix(run)
        big = np.flatnonzero(n >= size)
        c = count[big]
        src = np.repeat(rows[:-1][big] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        dst = np.repeat(out_rows[:-1][big] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        out[dst] = run[src]
    for r in np.flatnonzero((n > 0) & (n < size)):
        w = h[rows[r] : rows[r + 1]]
        out[out_rows[r]] = mix((np.uint64(len(w)) + (w * _LANE[: len(w)]).sum(dtype=np.uint64)).reshape(1))[0]
    return out, out_rows


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes of its words, A-Z lower-cased."""
    for i, j in blocks(column):
        data, off = raw(pc.ascii_lower(column[i:j]))
        starts, ends, rows = word_bounds(data, off)
        s, at = shingles(word_hashes(data, starts, ends), rows, size)
        for a, b in zip(at[:-1], at[1:]):
            x = np.sort(s[a:b])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
