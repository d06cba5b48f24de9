"""Permutations as column expressions: no row numbers are matched under two orders, no task holds a column."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4


def sides(n: int) -> tuple[int, int]:
    """A rectangle of at least ``n`` cells, with fewer than 2 sqrt(n) + 1 to spare."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def walks(n: int) -> int:
    """How often a place outside 0..n-1 has to be moved on: as often as there are spare cells, or until one in 1e30 is left."""
    a, b = sides(n)
    spare = a * b - n
    return 0 if not spare or n < 1 else min(spare, math.ceil(30 * math.log(10) / math.log(a * b / spare)))


def _draw(key: Column, turn: Column, value: Column, size: int) -> Column:
    """The head of an md5, so any engine can repeat it."""
    text = F.concat_ws(":", key, turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") % size


def permuted(index: Column, n: int, key: Column) -> Column:
    """Where the permutation named by ``key`` (a string) takes ``index`` of 0..n-1.

    Feistel rounds on the cells of a rectangle: each adds a hash of one coordinate to the other, which can be undone, so
    different places stay different. A place outside goes through the rounds again until it is inside.
    """
    a, b = sides(n)

    def once(place: Column) -> Column:
        def step(s: Column, turn: Column) -> Column:
            even = turn % 2 == 0
            left = F.when(even, (s["l"] + _draw(key, turn, s["r"], a)) % a).otherwise(s["l"])
            right = F.when(even, s["r"]).otherwise((s["r"] + _draw(key, turn, s["l"], b)) % b)
            return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

        start = F.struct(F.floor(place / b).cast("bigint").alias("l"), (place % b).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])

    first = once(index.cast("bigint"))
    more = walks(n)
    if not more:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(more)), first, lambda s, _: F.when(s < n, s).otherwise(once(s)))


def draws(n: int, key: str) -> list[np.ndarray]:
    """What the rounds of ``permuted`` add under ``key``: a number for each value of the coordinate that is hashed."""
    a, b = sides(n)

    def one(turn: int, value: int, size: int) -> int:
        return int(hashlib.md5(f"{key}:{turn}:{value}".encode()).hexdigest()[:12], 16) % size

    return [np.fromiter((one(turn, v, size) for v in range(values)), np.int64, values) for turn in range(ROUNDS) for size, values in [(a, b) if turn % 2 == 0 else (b, a)]]


def moved(index: np.ndarray, n: int, drawn: list[np.ndarray]) -> np.ndarray:
    """``permuted`` of a whole array, with the ``draws`` of its key: about 2 sqrt(n) hashes a round, however long the array."""
    a, b = sides(n)

    def once(place: np.ndarray) -> np.ndarray:
        left, right = np.divmod(place, b)
        for turn, add in enumerate(drawn):
            if turn % 2 == 0:
                left = (left + add[right]) % a
            else:
                right = (right + add[left]) % b
        return left * b + right

    place = once(np.asarray(index, np.int64))
    for _ in range(walks(n)):
        out = np.flatnonzero(place >= n)
        if not len(out):
            break
        place[out] = once(place[out])
    return place
