"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts are sequences of words (runs of ASCII letters and digits and of other letters' bytes, A-Z lower-cased). Windows
of item size start at every word. A CGK embedding walks over a window: at step j it writes the word at its place and
moves on by one random bit of that word's hash, so that after an insertion or deletion two walks soon meet again and
edit distance becomes Hamming distance. Each of ``repetitions()`` hash tables uses its own random bits, samples
``SAMPLED`` steps of the walk and looks for windows that agree with an item's window there; tables differ also in where
inside the item the window starts. Walks are cut short as soon as the sampled words fit no item. Every agreement is
verified by the exact edit distance in words between the item and the best stretch of text there; a document leaks an
item when that distance is at most ``MAX_EDITS`` of the item's words.

The benchmark is cut into blocks of at most about ``BLOCK_BYTES`` by a hash of the item, one pass over the documents per block.

Defined cases: null and empty texts and items leak nothing; items of fewer than five words must occur exactly; repeated
documents or items give a row each; empty tables give no rows; other columns are ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.llm import text as tx

MAX_EDITS, SAMPLED, BLOCK_BYTES = 0.2, 4, 4 << 20
#: Chance that one sampled step of the walk still agrees at a tenth of the words edited, and the recall aimed at there.
STEP_AGREES, TARGET_RECALL = 0.7, 0.999

_WORD = tx.table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def repetitions() -> int:
    return math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - STEP_AGREES**SAMPLED))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and their bounds by row."""
    raw = tx.lower_ascii(raw)
    starts, ends, bounds = tx.words(raw, offsets, _WORD[raw])
    return tx.word_hashes(raw, starts, ends) | np.uint64(1), bounds


@dataclass
class Table:
    """One hash table: random bits by step, sampled steps, and the items' keys after each sample (``bits_seen``: their first bits)."""

    size: int
    bits: np.ndarray
    steps: np.ndarray
    levels: list[np.ndarray]
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    bits_seen: list[np.ndarray] = field(default_factory=list)
    low: np.ndarray | None = None


def _walk(words: np.ndarray, start: np.ndarray, limit: np.ndarray, table: Table, levels: list[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of windows of ``words``; with ``levels``, only of those that agree with some item at every sample."""
    alive = np.arange(len(start))
    place, key, seen = start.copy(), np.zeros(len(start), np.uint64), []
    sampled = set(table.steps.tolist())
    for j in range(int(table.steps[-1]) + 1):
        inside = place < limit[alive]
        word = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
        if j in sampled:
            key = tx.mix(key * tx.BASE + word)
            if levels is None:
                seen.append(key)
            else:
                known = levels[len(seen)]
                if j:  # the first word has been looked up before; most other misses show in a few bits
                    fits = np.flatnonzero(table.bits_seen[len(seen)][(key >> np.uint64(48)).astype(np.int64)])
                    fits = fits[known[np.minimum(np.searchsorted(known, key[fits]), len(known) - 1)] == key[fits]]
                    alive, place, key, word = alive[fits], place[fits], key[fits], word[fits]
                seen.append(known)
                if not len(alive):
                    break
        place = place + ((word >> table.bits[j % 64]) & np.uint64(1)).astype(np.int64)
    return (key if levels is None else np.stack([alive.astype(np.uint64), key])), seen


def build(items: list[np.ndarray]) -> list[Table]:
    """Hash tables for word-hash sequences; items without words are left out."""
    out: list[Table] = []
    rng = np.random.Generator(np.random.PCG64(20))
    by_size: dict[tuple[int, bool], list[int]] = {}
    for k, words in enumerate(items):
        n = len(words)
        if n:
            exact = int(MAX_EDITS * n) == 0
            by_size.setdefault((n if exact else 1 << int(math.log2(max(1, 3 * n // 4))), exact), []).append(k)
    for (size, exact), members in sorted(by_size.items()):
        for r in range(1 if exact else repetitions()):
            bits = rng.permutation(64).astype(np.uint64)
            # one sample soon after the first ends most walks early; the rest are spread over the window
            soon = int(rng.integers(1, min(4, 2 * size - 1) + 1))
            free = np.setdiff1d(np.arange(1, max(size, 2)), [soon])
            steps = np.arange(1, 2 * size) if exact else np.sort(np.append(rng.choice(free, min(SAMPLED - 2, len(free)), replace=False), soon))
            steps = np.concatenate([[0], steps]).astype(np.int64)
            offsets = np.array([0 if exact else round(r * (len(items[k]) - size) / max(1, repetitions() - 1)) for k in members])
            table = Table(size, bits, steps, [], np.zeros(0, np.uint64), np.array(members), offsets)
            flat = np.concatenate([items[k] for k in members])
            base = np.concatenate([[0], np.cumsum([len(items[k]) for k in members])[:-1]])
            start = base + offsets
            key, seen = _walk(flat, start, start + size, table, None)
            order = np.argsort(key, kind="stable")
            table.keys, table.items, table.offsets = key[order], table.items[order], offsets[order]
            table.levels = [np.unique(s) for s in seen]
            table.bits_seen = [np.zeros(1 << 16, bool) for _ in seen]
            for known, flags in zip(table.levels, table.bits_seen):
                flags[(known >> np.uint64(48)).astype(np.int64)] = True
            # what is looked up first: the first sampled word itself
            table.low = np.zeros(1 << 18, bool)
            table.low[(flat[start] >> np.uint64(40)).astype(np.int64) & 0x3FFFF] = True
            out.append(table)
    return out


def edit_distance(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Smallest word edit distance between ``item`` and any stretch of each row of ``windows`` (0 pads)."""
    across = np.arange(windows.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(windows), windows.shape[1] + 1), np.int32)
    for k, word in enumerate(item):
        step = row + 1
        np.minimum(step[:, 1:], row[:, :-1] + (windows != word), out=step[:, 1:])
        row = np.minimum.accumulate(step - across, axis=1) + across
    return row.min(axis=1)


def find(words: np.ndarray, bounds: np.ndarray, items: list[np.ndarray], tables: list[Table]) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, word place) of verified leaks, the closest place of each row and item."""
    if not len(words):
        return []
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    short = (words >> np.uint64(40)).astype(np.int64) & 0x3FFFF
    hits: list[np.ndarray] = []
    some = np.flatnonzero(np.any([t.low for t in tables], axis=0)[short]) if tables else short[:0]
    short = short[some]
    for table in tables:
        at = some[table.low[short]]
        if not len(at):
            continue
        limit = np.minimum(at + table.size, bounds[row_of[at] + 1])
        found, _ = _walk(words, at, limit, table, table.levels)
        if not found.shape[1]:
            continue
        at, key = at[found[0].astype(np.int64)], found[1]
        lo, hi = np.searchsorted(table.keys, key, "left"), np.searchsorted(table.keys, key, "right")
        n = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        hits.append(np.stack([table.items[entry], np.repeat(row_of[at], n), np.repeat(at, n) - table.offsets[entry]]))
    if not hits:
        return []
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried = np.unique(np.concatenate(hits, axis=1), axis=1)
    for k in np.unique(tried[0]):
        item = items[k]
        allowed = int(MAX_EDITS * len(item))
        grain = allowed // 2 + 1
        near = np.unique(np.stack([tried[1, tried[0] == k], tried[2, tried[0] == k] // grain * grain]), axis=1)
        width = len(item) + 4 * allowed + grain
        for part in range(0, near.shape[1], 4096):
            row, start = near[0, part : part + 4096], near[1, part : part + 4096] - 2 * allowed
            place = start[:, None] + np.arange(width)
            inside = (place >= bounds[row][:, None]) & (place < bounds[row + 1][:, None])
            seen = np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
            # what the item has and the stretch lacks must be edited
            sorted_item = np.sort(item)
            there = (sorted_item[np.minimum(np.searchsorted(sorted_item, seen), len(item) - 1)] == seen).sum(1) >= len(item) - allowed
            if not there.any():
                continue
            row, start = row[there], start[there]
            edits = edit_distance(item, seen[there])
            for r, s, e in zip(row[edits <= allowed].tolist(), start[edits <= allowed].tolist(), edits[edits <= allowed].tolist()):
                at = max(0, s + 2 * allowed - int(bounds[r]))
                best[r, int(k)] = min(best.get((r, int(k)), (e, at)), (e, at))
    return sorted((r, k, e, at) for (r, k), (e, at) in best.items())


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark as lists of (item_id, text), each of a bounded expected size."""
    items = items.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["item_id"], r["text"]) for r in part), key=lambda x: (x[0] is None, x[0], x[1]))


def _hashed(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, raw, offsets in tx.slices(pa.array(texts, pa.string())):
        words, bounds = tokens(raw, offsets)
        out += [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def _matches(batch: pa.RecordBatch, items: list[np.ndarray], tables: list[Table]) -> Iterator[tuple[int, int, int, int]]:
    for first, raw, offsets in tx.slices(batch.column("text")):
        words, bounds = tokens(raw, offsets)
        for row, item, edits, at in find(words, bounds, items, tables):
            yield first + row, item, edits, at


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, item_words, word_at for every document and item it leaks (the closest place)."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, edits int, item_words int, word_at bigint"

    def over(block: list[tuple]) -> DataFrame:
        items = _hashed([t for _, t in block])
        tables = build(items)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                found = list(_matches(batch, items, tables))
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = [[block[f[1]][0] for f in found], [f[2] for f in found], [len(items[f[1]]) for f in found], [f[3] for f in found]]
                kinds = [pa.infer_type([b[0] for b in block]) if block else pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, k) for v, k in zip(rest, kinds)]], names=["doc_id", "item_id", "edits", "item_words", "word_at"])

        return docs.select("doc_id", "text").mapInArrow(batches, schema)

    return reduce(DataFrame.unionByName, [over(b) for b in blocks(benchmark, block_bytes)])


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that leak no item."""
    out = docs
    for block in blocks(benchmark, block_bytes):
        items = _hashed([t for _, t in block])
        tables = build(items)

        def batches(it: Iterator[pa.RecordBatch], items=items, tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in it:
                bad = {f[0] for f in _matches(batch, items, tables)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(batches, docs.schema)
    return out
