"""Numeric features of whole texts, from vectorised passes over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels

NAMES = (
    "log_words", "mean_word", "upper_share", "digit_share", "mark_share", "bang_share", "symbol_share", "other_share", "nonascii_share",
    "log_lines", "line_words", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "short_word_share", "long_word_share", "stop_share",
)

_KIND = np.zeros(256, np.int64)
for _kind, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?-'\"()", "!", "#*$%&|<>", "@/\\_=+{}[]~^`"), 1):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[128:] = 7
#: Common short words of the four languages.
STOP_WORDS = "the of and to in a is that for it as was with be by on not he this are der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als le de un et être il la les des en du une que est pour qui dans el que y los del se las por con no para una su al lo como".split()


def _hash_words(words: list[str]) -> np.ndarray:
    data, off = kernels.raw(kernels.text_array(pa.array([" ".join(words)])))
    starts, ends, _ = kernels.word_bounds(data, off)
    return np.unique(kernels.word_hashes(data, starts, ends))


_STOP = _hash_words(STOP_WORDS)


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct keys, members of keys found twice or more, and the commonest key's count."""
    distinct, repeated, top = (np.zeros(len(rows) - 1) for _ in range(3))
    for r in range(len(rows) - 1):
        x = np.sort(keys[rows[r] : rows[r + 1]])
        if len(x):
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            n = np.diff(at)
            distinct[r], repeated[r], top[r] = len(n), n[n > 1].sum(), n.max()
    return distinct, repeated, top


def features(column: pa.Array) -> np.ndarray:
    """(rows, len(NAMES)) of a large string array without nulls; all zero for a text without words."""
    out = [np.zeros((0, len(NAMES)))]
    for i, j in kernels.blocks(column):
        part = column[i:j]
        data, off = kernels.raw(part)
        kinds = np.stack([_per_row(_KIND[data] == k, off) for k in range(1, 8)])
        starts, ends, rows = kernels.word_bounds(data, off)
        n, size = np.diff(rows).astype(float), (ends - starts)
        low, low_off = kernels.raw(pc.utf8_lower(part))
        h = kernels.word_hashes(low, *(b := kernels.word_bounds(low, low_off))[:2])
        runs, run_rows = kernels.shingles(h, b[2], 3)
        words, many = np.maximum(n, 1), np.maximum(_per_row(size, rows), 1)
        distinct, _, top = _repeats(h, b[2])
        _, repeated, _ = _repeats(runs, run_rows)
        breaks = np.flatnonzero(data == 10)
        lines = np.diff(np.searchsorted(breaks, off)) + 1.0
        # a line's hash: the bytes between two breaks, as one word of the block
        bounds = np.unique(np.concatenate([[0], breaks + 1, off]))
        line_hash = kernels.word_hashes(data, bounds[:-1], bounds[1:])
        line_rows = np.searchsorted(bounds[:-1], off)
        full = np.diff(bounds) > 1
        _, same, _ = _repeats(line_hash[full], np.concatenate([[0], np.cumsum(full)])[line_rows])
        place = np.searchsorted(_STOP, h)
        stop = _STOP[np.minimum(place, len(_STOP) - 1)] == h
        x = np.column_stack([
            np.log1p(n), many / words, kinds[0] / many, kinds[1] / many, kinds[2] / words, kinds[3] / words, kinds[4] / many, kinds[5] / many, kinds[6] / many,
            np.log1p(lines), n / lines, same / lines, repeated / words, distinct / words, top / words, _per_row(size <= 3, rows) / words, _per_row(size >= 12, rows) / words, _per_row(stop, b[2]) / words,
        ])
        x[n == 0] = 0
        out.append(x)
    return np.concatenate(out)
