"""Near duplicates by min-max hashing over five-word shingles.

Every permutation (multiplication of a 64-bit shingle hash by an odd number) gives two signature values, the smallest
and the largest image of the set, so ``BANDS * ROWS / 2`` permutations fill ``BANDS`` bands of ``ROWS`` values. Both values
of one permutation go to different bands, since on small sets they are not independent (3 of 4 shingles: both agree
with chance 1/2, not 9/16). Two sets of similarity s agree in a band with probability s**4 and, as far as bands are
independent, share one with probability 1 - (1 - s**4)**40: 0.9999998 at 0.75. On small sets bands that hold the two
values of one permutation depend on each other, so there this is an approximation. Every link is then confirmed on the full sets.

Documents with equal sets form one class; one row per class is banded. The pairs of a bucket are not listed: members
are compared with the bucket's hub, and a bucket whose members are then in one component is finished. Texts of the
buckets left are compared across components where they share one of their rarest shingles, which no link lacks.

Defined cases: null text and text without words have an empty set, ``n_shingles`` 0, and are linked with nothing;
fewer than five words are one shingle; rows without doc_id take part and get the smallest id they reach, or null;
repeated rows are linked like any equal sets (each keeps its row); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.llm import text as tx
from duepath.llm.components import smallest_reachable
from duepath.llm.rows import content_key, only
from duepath.session import cut_lineage

BANDS, ROWS, WORDS = 40, 4, 5
#: How far the largest images are moved on against the smallest: no multiple of BANDS.
SHIFT = 17


def _multipliers(n: int) -> np.ndarray:
    return tx.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def document_sets(column: pa.Array, width: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes of some rows, sorted within a row; bounds by row), in row order."""
    for _, raw, offsets in tx.slices(column):
        raw = tx.lower_ascii(raw)
        starts, ends, bounds = tx.words(raw, offsets)
        made, to = tx.shingles(tx.word_hashes(raw, starts, ends), bounds, width)
        parts = [np.unique(made[a:b]) for a, b in zip(to[:-1], to[1:])]
        yield (np.concatenate(parts) if parts else made), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(sets: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per row and band; rows with an empty set get zeros."""
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    begin = bounds[full]
    half = bands * rows // 2
    values = np.empty((2 * half, len(full)), np.uint64)
    for k, odd in enumerate(_multipliers(half)):
        image = sets * odd
        values[k] = np.minimum.reduceat(image, begin)
        values[half + (k - SHIFT) % half] = np.maximum.reduceat(image, begin)
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64)
        for r in range(rows):  # the largest images come from other permutations than the smallest
            key = tx.mix(key * tx.BASE + values[band + r * bands])
        out[full, band] = key
    return out


def _signature_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for sets, bounds in document_sets(batch.column("text"), width):
            n = len(bounds) - 1
            full = np.flatnonzero(np.diff(bounds) > 0)
            digest = np.zeros((2, n), np.uint64)
            if len(full):
                digest[0, full] = tx.mix(np.add.reduceat(tx.mix(sets), bounds[full]))
                digest[1, full] = tx.mix(np.add.reduceat(tx.mix(sets * tx.BASE + np.uint64(1)), bounds[full]))
            keys = signatures(sets, bounds, bands, rows).view(np.int64)
            part = batch.slice(row, n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("body"), pa.array(np.diff(bounds)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))],
                names=["doc_id", "body", "n_shingles", "d0", "d1", "bands"],
            )
            row += n


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for sets, bounds in document_sets(batch.column("text"), width):
            n = len(bounds) - 1
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.slice(row, n).column("cid"), lists], names=["cid", "items"])
            row += n


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough. The partner of many is joined last, so its set stays in place."""
    one = pairs.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("of_b")), "b")
    both = one.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _hub_pairs(here: DataFrame) -> DataFrame:
    """Each member against its bucket's hub: the member that shares most buckets with most others.

    The text that copies were made from is such a member, so this round joins nearly all of a group.
    """
    hubs = cut_lineage(here.groupBy("key").agg(F.max(F.struct("weight", "cid", "n")).alias("h")), "hubs")
    pairs = here.join(hubs, "key").where("cid <> h.cid")
    return pairs.select(F.col("h.cid").alias("a"), F.col("h.n").alias("n_a"), F.col("cid").alias("b"), F.col("n").alias("n_b")).distinct()


def _remaining_pairs(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share one of their rarest shingles, as every pair similar enough must.

    With shingles in one order, rarest first, two sets of that similarity agree in one of the first
    n - ceil(percent * n / 100) + 1 places of each. Passages common to many texts come last, so a family that shares
    only such a passage gives no pairs. Counting and joining use 32 bits of a shingle, which can only add candidates.
    """
    open_docs = here.select("cid", "n", "root").distinct()
    items = sets.select("cid", F.explode("items").alias("whole")).select("cid", F.shiftright("whole", 32).cast("int").alias("item"))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = items.join(counts, "item").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("rare"))
    length = F.greatest(F.size("rare") - F.ceil(F.col("n") * percent / 100) + 1, F.lit(0)).cast("int")
    front = shared.join(open_docs, "cid").select("cid", "n", "root", F.size("rare").alias("in_others"), F.posexplode(F.slice("rare", F.lit(1), length)).alias("at", "x"))
    front = cut_lineage(front.select("cid", "n", "root", "x.item", (F.col("in_others") - F.col("at")).alias("left")), "front")
    parts = front.groupBy("item", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots"))
    front = cut_lineage(front.join(parts.where("roots > 1").select("item", F.col("m.root").alias("main")), "item").withColumn("few", F.col("root") != F.col("main")), "members")
    few = front.where("few").select("item", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("left").alias("left_a"))
    others = front.select("item", F.col("cid").alias("b"), F.col("n").alias("n_b"), "root", "few", "left")
    # what two sets have in common from their first common place on is at most what either still shares with any text
    enough = f"{100 + percent} * least(left, left_a) >= {percent} * (n_a + n_b)"
    return others.join(few, "item").where(f"(not few or a < b) and root <> root_a and {enough}").select("a", "n_a", "b", "n_b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, and ``row``, ``body`` and ``root``, which name the row, its text and its component."""
    source = docs.select("doc_id", "text").withColumn("body", content_key(F.col("doc_id"), F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(lambda it: _signature_batches(it, bands, rows, width), f"doc_id {kind}, body string, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>")
    signed = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()), "signed")
    full = signed.where("n_shingles > 0")
    # One class per distinct set; its first row stands for it.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "body")
    classes = full.groupBy("d0", "d1").agg(F.min(first).alias("x")).select("d0", "d1", F.struct("x.no_id", "x.doc_id").alias("name"), "x.row", "x.body")
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = signed.select("row", "n_shingles", "bands").join(classes.select("row", "cid"), "row").select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = cut_lineage(members.join(sizes, "key"), "crowded")
    weights = cut_lineage(crowded.groupBy("cid").agg(F.sum("size").alias("weight")), "weights")
    crowded = cut_lineage(crowded.drop("size").join(weights, "cid"), "buckets")
    wanted = classes.select("cid", "body").join(weights.select("cid"), "cid")
    texts = source.select("body", "text").join(wanted, "body").dropDuplicates(["cid"]).select("cid", "text")
    sets = cut_lineage(texts.mapInArrow(lambda it: _set_batches(it, width), "cid bigint, items array<bigint>"), "sets")

    near = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    links, labels = [], None
    for by_hub in (True, False):
        here = crowded.withColumn("root", F.col("cid"))
        if labels is not None:
            here = crowded.join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        open_keys = here.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        here = cut_lineage(here.join(open_keys, "key"), "open")
        if here.isEmpty():
            break
        pairs = _hub_pairs(here) if by_hub else _remaining_pairs(here, sets, percent)
        pairs = cut_lineage(pairs.where(near).select("a", "b"), "candidates")
        links.append(cut_lineage(_confirmed(pairs, sets, percent), "links"))
        labels = cut_lineage(smallest_reachable(reduce(DataFrame.union, links)), "components")

    named = classes.select("d0", "d1", "cid", "name")
    named = named.withColumn("root", F.col("cid")) if labels is None else named.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = cut_lineage(named, "named")
    least = cut_lineage(named.groupBy("root").agg(F.min("name").alias("least")).select("root", F.col("least.doc_id").alias("component_id")), "least")
    found = cut_lineage(named.join(least, "root").select("d0", "d1", "component_id", "root"), "found")
    out = full.join(found, ["d0", "d1"]).select("doc_id", "n_shingles", "component_id", "row", "body", "root")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", "body", F.lit(None).cast("long").alias("root"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, all columns, with one row of each component: the first of those with its smallest doc_id.

    Documents without words are linked with nothing and all stay.
    """
    found = near_duplicates(docs, percent)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    linked = found.where("n_shingles > 0").groupBy("root").agg(F.min_by("body", place).alias("key")).select("key")
    bodies = found.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
    stay = bodies.join(linked.withColumnRenamed("key", "body"), "body").select(F.col("body").alias("key"), (F.col("n") > 1).alias("repeated"))
    alone = bodies.where("n_shingles = 0").select(F.col("body").alias("key"), F.lit(False).alias("repeated"))
    return only(docs, cut_lineage(stay.unionByName(alone), "stay"))
