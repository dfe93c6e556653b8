"""Vectorised text kernels on Arrow buffers (numpy only, no per-character Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(9, 14)]] = True
#: Multipliers of the words of a window.
PLACES = mix(np.arange(101, 106, dtype=np.uint64)) | np.uint64(1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "fwd"
    if key not in _POWERS or len(_POWERS[key]) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n > 1 << 22:  # a single giant text: do not keep
            return table[:n]
        _POWERS[key] = table
    return _POWERS[key][:n]


def texts(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``first, last, bytes, offsets`` over runs of whole texts of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, first word of each text (n + 1 offsets), and non-space bytes' mask."""
    n = len(data)
    solid = ~SPACE[data]
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), solid
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    begins[cuts] = solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = cuts[cuts > 0] - 1
    ends[last] = solid[last]
    first, final = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[LOWER[data] if lower else data] * powers(n), out=sums[1:])
    hashes = mix((sums[final] - sums[first]) * powers(n, True)[first] + (final - first).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets), solid


def windows(hashes: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows inside texts, and the offsets of each text's windows."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total += hashes[k : len(hashes) - size + 1 + k] * PLACES[k]
    where = np.arange(at[-1]) + np.repeat(starts[:-1] - at[:-1], counts)
    return mix(total[where]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's lower-cased 5-word shingles; short texts give one for the whole sequence."""
    hashes, starts, _ = words(data, offsets, lower=True)
    grams, at = windows(hashes, starts)
    out = []
    for i in range(len(offsets) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
        else:
            own = hashes[starts[i] : starts[i + 1]]
            k = len(own)
            out.append(mix((own * PLACES[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k)) if k else np.zeros(0, np.uint64))
    return out


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of marked bytes; runs end with their text."""
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cuts = offsets[:-1][offsets[:-1] < len(solid)]
    begins[cuts] = solid[cuts]
    ends[cuts[cuts > 0] - 1] = solid[cuts[cuts > 0] - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
