"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, 3 * q)`` words that neither
neighbouring word extends. Candidates come from dyadic blocks. A run with period q of at least 2**k words holds a whole
block of 2**k words that starts at a multiple of 2**k, and its copy q words on; so each block looks for its occurrences
in the window behind it:

* blocks are grouped by prefix doubling, from 8 words on; the same ranks order the suffixes, so the occurrences of a
  block are an interval of the suffix array;
* a wavelet matrix over the suffix array answers range successor queries: the first three occurrences in the window;
* one or two occurrences give their distances as candidates. Three or more stand in an arithmetic progression whose
  difference r is the block's own period; then the stretch of period r around the block and the one around the
  occurrences must begin or end at the run's distance, which leaves two candidates;
* blocks of 8 words also look at the next 8 places: there the nearest occurrence is the period of a short-period run.

A candidate is extended word by word in both directions; of equal stretches the smallest period is kept. Many documents
are handled as one array, in which words of different documents never agree.

The words of a text are compared by 64-bit hashes. A text is handled as a whole in one task, whose memory follows the
slice of texts or the longest text (about 100 bytes a word).

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; a null doc_id keeps its row;
repeated rows keep a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duepath.llm import text as tx

LEAST, LEVEL = 24, 3
#: (key of the document, number of words) -> (a, p): each word i >= a reads word a + (i - a) % p instead; or None.
Fold = Callable[[int, int], tuple[int, int] | None]


class WaveletMatrix:
    """Range counting and range successor over an array of integers in [0, len)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, len(values).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at [low, high) are smaller than x."""
        count = np.zeros(len(x), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[low], zeros[high]
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value at [low, high), from 0; n must be inside."""
        value = np.zeros(len(n), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value

    def successors(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, many: int) -> np.ndarray:
        """The ``many`` smallest values >= x at [low, high), one column each; -1 where there are fewer."""
        out = np.full((len(x), many), -1, np.int64)
        before = self.less(low, high, x)
        for k in range(many):
            there = np.flatnonzero(before + k < high - low)
            out[there, k] = self.nth(low[there], high[there], before[there] + k)
        return out


def _blocks(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Suffix array, rank of each of its entries, and by level k the repeated aligned blocks: place, rank and number of occurrences.

    ``first`` and ``last`` are the bounds of each word's document. Only suffixes whose first 8 words occur again in the
    document are in the array.
    """
    size = 1 << LEVEL
    whole = np.flatnonzero(np.arange(len(words)) + size <= last)
    name = first[whole].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            name = name * tx.BASE + words[whole + k]
    _, group, count = np.unique(tx.mix(name), return_inverse=True, return_counts=True)
    rank = np.full(len(words), -1, np.int64)
    active = whole[count[group] > 1]
    rank[whole] = (np.cumsum(count) - count)[group]
    single, longest, suffixes = len(words), int((last - first).max(initial=0)), active
    # suffixes that no other one equals need distinct ranks too, to tell apart what precedes them
    rank[rank < 0] = single + np.flatnonzero(rank < 0)
    found = []
    level, sizes = LEVEL, count[group][count[group] > 1]
    while len(active):
        step = 1 << level
        aligned = ((active - first[active]) % step == 0) & (last[active] - first[active] >= 3 * step)
        found.append((level, active[aligned], rank[active[aligned]], sizes[aligned]))
        if 3 * 2 * step > longest:
            break
        behind = active + step
        inside = behind < last[active]
        second = np.where(inside, rank[np.minimum(behind, len(words) - 1)], -1)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        one = rank[active]
        bucket = np.concatenate([[True], one[1:] != one[:-1]])
        fresh = bucket | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = one + begin - np.maximum.accumulate(np.where(bucket, at, 0))
        many = np.diff(np.concatenate([np.flatnonzero(fresh), [len(active)]]))[np.cumsum(fresh) - 1]
        active, sizes = active[many > 1], many[many > 1]
        level += 1
    order = np.argsort(rank[suffixes], kind="stable")
    return suffixes[order], rank[suffixes][order], found


class _Stretches:
    """Maximal stretches with a given period around a place, remembered by period."""

    def __init__(self, words: np.ndarray):
        self.words, self.known = words, {}

    def around(self, at: int, period: int, low: int, high: int) -> tuple[int, int]:
        """Bounds of the stretch inside [low, high) that holds the words ``at`` and ``at + period``, equal or not."""
        known = self.known.setdefault(period, [])
        k = bisect_right(known, (at, high + 1)) - 1
        if k >= 0 and known[k][0] <= at and at + period < known[k][1]:
            return known[k]
        w, end, start, step = self.words, at, at, 64
        while end + period < high:
            top = min(end + step, high - period)
            differ = w[end:top] != w[end + period : top + period]
            hit = int(differ.argmax())
            if differ[hit]:
                end += hit
                break
            end, step = top, step * 2
        step = 64
        while start > low:
            bottom = max(start - step, low)
            differ = (w[bottom:start] != w[bottom + period : start + period])[::-1]
            hit = int(differ.argmax())
            if differ[hit]:
                start -= hit
                break
            start, step = bottom, step * 2
        if end > at:
            insort(known, (start, end + period))
        return start, end + period


def runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Runs of documents whose words ``bounds`` delimits: columns document, start, length, period, ordered so."""
    none = np.zeros((0, 4), np.int64)
    sizes = np.diff(bounds)
    if not len(words) or sizes.max(initial=0) < LEAST:
        return none
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first, last = bounds[:-1][owner], bounds[1:][owner]
    array, ranks, levels = _blocks(words, first, last)
    if not len(array):
        return none
    places = np.sort(array)
    matrix = WaveletMatrix(np.searchsorted(places, array))
    stretches, best = _Stretches(words), {}

    def consider(at: int, period: int) -> None:
        low, high = int(first[at]), int(last[at])
        start, end = stretches.around(at, period, low, high)
        if end - start >= max(LEAST, 3 * period):
            key = (start, end)
            best[key] = min(best.get(key, period), period)

    def occurrences(at: np.ndarray, rank: np.ndarray, count: np.ndarray, ahead: int, width: int, many: int) -> np.ndarray:
        low = np.searchsorted(ranks, rank, "left")
        got = matrix.successors(low, low + count, np.searchsorted(places, at + ahead, "left"), many)
        place = np.where(got >= 0, places[got], -1)
        return np.where(place < (at + ahead + width)[:, None], place, -1)

    for level, at, rank, count in levels:
        step = 1 << level
        if level == LEVEL:
            near = occurrences(at, rank, count, 1, step, 1)[:, 0]
            for s, p in zip(at[near >= 0].tolist(), near[near >= 0].tolist()):
                consider(s, p - s)
        three = occurrences(at, rank, count, step, step, 3)
        some = np.flatnonzero(three[:, 0] >= 0)
        for s, (a, b, c) in zip(at[some].tolist(), three[some].tolist()):
            if c < 0:
                consider(s, a - s)
                if b >= 0:
                    consider(s, b - s)
                continue
            low, high, difference = int(first[s]), int(last[s]), b - a
            here, there = stretches.around(s, difference, low, high), stretches.around(a, difference, low, high)
            for period in {there[0] - here[0], there[1] - here[1]}:
                if step <= period < 2 * step:
                    consider(s, period)
    out = np.array([(owner[a], a - first[a], b - a, q) for (a, b), q in best.items()], np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _texts(column: pa.Array, keys: list, fold: Fold | None) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, collapsed text) of each row."""
    row = 0
    for _, raw, offsets in tx.slices(column):
        starts, ends, bounds = tx.words(raw, offsets)
        hashes = tx.word_hashes(raw, starts, ends)
        flat, folded = raw.tobytes(), {}
        if fold is not None:
            source = np.arange(len(hashes))
            for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                rule = fold(keys[row + k], high - low) if high > low and keys[row + k] is not None else None
                if rule is not None:
                    a, p = rule
                    source[low + a : high] = low + a + np.arange(high - low - a) % p
                    folded[k] = source[low:high] - low
            hashes = hashes[source]
        found = runs(hashes, bounds)
        cut = np.searchsorted(found[:, 0], np.arange(len(bounds)), "left")
        for k in range(len(offsets) - 1):
            words = flat[offsets[k] : offsets[k + 1]].split()
            own = found[cut[k] : cut[k + 1], 1:]
            if k in folded or len(own):
                places = folded.get(k, np.arange(len(words)))
                inside = np.zeros(len(words) + 1, np.int64)
                np.add.at(inside, own[:, 0] + own[:, 2], 1)
                np.add.at(inside, own[:, 0] + own[:, 1], -1)
                words = [words[i] for i in places[np.cumsum(inside[:-1]) == 0].tolist()]
            yield int(bounds[k + 1] - bounds[k]), [tuple(r) for r in own.tolist()], b" ".join(words).decode()
        row += len(offsets) - 1


def find(docs: DataFrame, fold: Fold | None = None, key: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed for every document.

    ``collapsed`` is the text's words joined by one blank without those that any run holds after its first period.
    ``fold`` rewrites the words of a document first, by the value of ``key``; a null key leaves it as it is.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, n, found, left, at, held = batch.column("doc_id"), [], [], [], 0, 0
            keys = batch.column("key").to_pylist()

            def part() -> pa.RecordBatch:
                lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], pa.list_(run))
                return pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), lists, pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

            for size, own, collapsed in _texts(batch.column("text"), keys, fold):
                n.append(size)
                found.append(own)
                left.append(collapsed)
                held += len(collapsed)
                if held > 4 << 20:
                    yield part()
                    at, held, n, found, left = at + len(n), 0, [], [], []
            if n:
                yield part()

    source = docs.select("doc_id", "text", (F.lit(None).cast("long") if key is None else key.cast("long")).alias("key"))
    return source.mapInArrow(batches, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def report(found: DataFrame) -> DataFrame:
    """Per row of ``find``: the number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text.

    Of equal exponents the smallest start, then the smallest period wins; without runs its four columns are null.
    """
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])  # noqa: E731  runs come by start, then period
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
