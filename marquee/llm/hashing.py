"""Vectorised hashing over the bytes of many texts at once (numpy, modulo 2^64)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser with a seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
        if size > 1 << 23:  # of a very long text: not kept
            del _POWERS[base]
    return have[:n]


class Prefix:
    """Polynomial hashes of any span of a byte array."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), out=self.sums[1:])
            self.back = _powers(_INVERSE, len(data) + 1)

    def span(self, start, stop) -> np.ndarray:
        """Hash of data[start:stop] for arrays of starts and stops (not mixed)."""
        with np.errstate(over="ignore"):
            return (self.sums[stop] - self.sums[start]) * self.back[start]


def text_slices(column: pa.Array, most_bytes: int = 1 << 22, most_rows: int = 4096):
    """``(first row, byte array, offsets)`` for runs of rows of a string column, each of
    at most ``most_bytes`` unless a single text is longer. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(ends, ends[row] + most_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), row + most_rows, len(column))
        yield row, raw[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row]
        row = stop
