"""Words, grams and hashes of whole texts as NumPy arrays, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Texts come as Arrow
batches; ``slices`` hands them out in pieces of bounded size, so a task holds a
few megabytes of text (or one document) whatever the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of ``batches`` with at most ``limit`` bytes in ``column`` (at least one row), and its values."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
            yield batch.slice(first, last - first), texts.slice(first, last - first).to_pylist()
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers, well mixed (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        powers = np.full((2, size), 1, dtype=np.uint64)
        powers[0, 1:], powers[1, 1:] = _MULTIPLIER, _INVERSE
        _powers[:] = list(np.multiply.accumulate(powers, axis=1))
    return _powers[0], _powers[1]


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit codes from its prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers, self._inverse = _tables(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * powers[:n], out=self._sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of ``codes[first:last]``, for arrays of bounds."""
        return mix((self._sums[last] - self._sums[first]) * self._inverse[first])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` codes."""
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:n]) * self._inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``; spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = RangeHash(BYTE_CODES[raw[base:base + b[-1]]]).of(a, b) + (b - a).astype(np.uint64)
        at = to
    return out


def joined(parts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """Texts joined by one space, and the offset of each (the last entry is the end)."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p or b"") + 1 for p in parts], out=offsets[1:])
    return b" ".join(p or b"" for p in parts) + b" ", offsets


def words_of(parts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, bounds of their words, and for each text the number of its first word."""
    data, offsets = joined(parts)
    starts, ends = word_bounds(data)
    return data, starts, ends, np.searchsorted(starts, offsets)


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i, empty ranges included."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def column_of(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)
