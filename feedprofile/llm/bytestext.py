"""Whole texts of an Arrow batch as numpy arrays: bytes, words and hashes of words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked through in slices of about so many bytes and texts at most, which bounds memory; a longer text is a
#: slice of its own.
SLICE_BYTES, SLICE_TEXTS = 1 << 19, 2048

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Slice(NamedTuple):
    """Texts ``first`` to ``first + len(offsets) - 2`` of a batch; ``data`` holds their bytes."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES, most_texts: int = SLICE_TEXTS) -> Iterator[Slice]:
    """Cut a string column into slices of whole texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n, at + most_texts)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    out = np.full(max(n, 1), np.uint64(base & _MASK))
    out[0] = 1
    return np.cumprod(out)


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _kept or len(_kept[base]) < n:
        made = powers(base, n)
        if n > 4 * SLICE_BYTES:
            return made
        _kept[base] = made
    return _kept[base][:n]


def running_hashes(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values; ``range_hashes`` reads the hash of any range from them."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    return sums


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums over bytes."""
    return running_hashes(_TABLE[data])


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``; equal bytes give equal hashes wherever they stand."""
    back = _powers(pow(_BASE, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a slice in order, and how many each text has."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def words(piece: Slice) -> Words:
    """Runs of bytes other than space and tab to carriage return; none crosses from a text to the next."""
    data, offsets = piece.data, piece.offsets
    inside = ~SPACE[data]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[filled]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[filled + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.diff(np.searchsorted(starts, offsets)))


def word_hashes(piece: Slice, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, and the number of words of each text."""
    found = words(piece)
    sums = prefix_hashes(LOWER[piece.data] if lower else piece.data)
    return range_hashes(sums, found.starts, found.ends), found.counts


def total_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, of the given lengths (0 for an empty run)."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]
