"""Numpy over whole Arrow text columns: words, word hashes, shingles.

A column is handled in slices of about ``SLICE`` bytes (a longer text is a slice of its own), so what a task
holds follows its longest text, not its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 512 << 10
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null counts as empty. ``offsets`` has one entry more than rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1, row + 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; only the usual slice length is kept."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n, SLICE + 1) + 1
    made = []
    for base in (BASE, BASE_INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size <= SLICE + 2:
        _powers[:] = made
    return made[0], made[1]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper * np.uint8(32)).astype(np.uint8)


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = table(SPACES)


def words(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of maximal runs of word bytes, and the number of words before each row's end."""
    inside = ~_SPACE[raw] if in_word is None else in_word
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    fresh[cut] = inside[cut]
    starts = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values()[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, repeats included, and their bounds by row.

    A row of fewer words gives its whole sequence as one; a row without words gives none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    # the place of each shingle's first word
    at = np.arange(to[-1]) - np.repeat(to[:-1], made) + np.repeat(bounds[:-1], made)
    room = np.minimum(np.repeat(counts, made), width)
    total = room.astype(np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            factor = factor * BASE
            there = at + k if k == 0 else np.minimum(at + k, len(hashes) - 1)
            total = total + np.where(room > k, hashes[there], np.uint64(0)) * factor
    return mix(total), to
