"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two bag models over ``BUCKETS`` hashed words and word pairs are counted, one on the documents labelled good, one on all
documents. A document's log weight is the mean log ratio of its n-grams times ``STRENGTH``; adding Gumbel noise (a hash
of seed, doc_id and text) and taking the k largest draws k documents without replacement in proportion to the weights.
The k-th key is found by counting in ever finer ranges of keys, without a global sort and without collecting keys.

Counts come from all rows and whole texts: each task adds up its own ``BUCKETS`` counters before the shuffle. The model
of all documents takes no join; only texts of good documents, and the few others that a filter lets pass, are shuffled to
meet their labels. The models that tasks receive are two arrays of ``BUCKETS`` numbers whatever the size of the corpus.

Defined cases: null text counts as empty; documents without words have log weight 0 and take part; without good
documents every ratio is 0; of contradicting labels of one doc_id the better one holds; rows equal in doc_id and text get
the same key, and of rows tied at the k-th key all are taken; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.llm import text as tx
from duepath.llm.rows import content_key
from duepath.session import cut_lineage

BUCKETS, STRENGTH, SMOOTH = 1 << 14, 20.0, 1.0
#: Of the filter in front of the shuffle of good documents: 2 MB of words.
FILTER_BITS = 1 << 24


def ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of words and word pairs, bounds by row)."""
    for first, raw, offsets in tx.slices(column):
        raw = tx.lower_ascii(raw)
        starts, ends, bounds = tx.words(raw, offsets)
        one = tx.word_hashes(raw, starts, ends)
        pair = tx.mix(one[:-1] * tx.BASE + one[1:]) if len(one) > 1 else one[:0]
        inside = np.ones(len(pair), bool)
        edge = bounds[1:-1]
        inside[edge[(edge > 0) & (edge <= len(pair))] - 1] = False
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        owner = np.concatenate([row, row[:-1][inside]]) if len(row) else row
        value = np.concatenate([one, pair[inside]]) % np.uint64(BUCKETS)
        order = np.argsort(owner, kind="stable")
        yield first, value[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(bounds)))


def counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) summed over all documents."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in it:
            for _, bucket, _ in ngrams(batch.column("text")):
                total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(batches, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose doc_id is in ``ids`` (doc_id, distinct).

    A filter of ``FILTER_BITS`` bits, which is at most so many 64-bit words whatever the number of ids, drops most of the
    other documents before their text is shuffled; what it lets through is joined by doc_id.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    place = bit(F.col("doc_id"))
    words = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int))")).alias("bits"))
    words = cut_lineage(words, "filter")
    hit = F.expr(f"shiftrightunsigned(bits, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int)) & 1 = 1")
    likely = docs.select("doc_id", "text").withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word").where(hit)
    # the same plan at every size: both sides shuffled by id
    return likely.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")


def models(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(bucket, target, raw): counts over the documents marked good and over all; ``marks`` has doc_id and good, one row an id."""
    good = counts(among(docs, cut_lineage(marks.where("good").select("doc_id"), "good")))
    return counts(docs).withColumnRenamed("n", "raw").join(good.withColumnRenamed("n", "target"), "bucket", "left").select("bucket", F.coalesce("target", F.lit(0)).alias("target"), "raw")


def log_ratios(table: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket's smoothed share: ``BUCKETS`` numbers."""
    total = np.full((2, BUCKETS), SMOOTH)
    seen = 0.0
    for row in table.collect():  # at most BUCKETS rows
        total[0, row["bucket"]] += row["target"]
        total[1, row["bucket"]] += row["raw"]
        seen += row["target"]
    if not seen:
        return np.zeros(BUCKETS)
    share = total / total.sum(1, keepdims=True)
    return np.log(share[0] / share[1])


def weighted(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, n_ngrams, log_weight and gumbel_key for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, bucket, to in ngrams(batch.column("text")):
                size = np.diff(to)
                full = np.flatnonzero(size > 0)
                n[first : first + len(size)] = size
                if len(full):
                    weight[first + full] = np.add.reduceat(ratios[bucket], to[full]) / size[full] * STRENGTH
            uniform = (np.array(batch.column("draw")).view(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
            gumbel = -np.log(-np.log(np.clip(uniform, 1e-300, 1 - 1e-16)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(weight + gumbel)], names=["doc_id", "n_ngrams", "log_weight", "gumbel_key"])

    source = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), content_key(F.col("doc_id"), F.col("text"))).alias("draw"))
    return source.mapInArrow(batches, f"doc_id {kind}, n_ngrams bigint, log_weight double, gumbel_key double")


def kth_largest(keys: DataFrame, column: str, k: int, parts: int = 1000) -> float:
    """The k-th largest value: counts in ``parts`` ranges, then in those of the one that holds it, and so on."""
    if k <= 0:
        return float("inf")
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("inf")
    while low < high:
        width = (high - low) / parts
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1)) if width > 0 else F.lit(0)
        rows = keys.where(F.col(column).between(low, high)).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(rows, key=lambda r: -r["p"]):
            if row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
        if len(rows) == 1 and width <= 0:
            break
    return low


def best_marks(labels: DataFrame) -> DataFrame:
    """doc_id, good: one row an id; of contradicting labels the better one holds."""
    return labels.select("doc_id", (F.col("quality") == 1).alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, n_ngrams, log_weight, gumbel_key, selected for every document.

    ``share`` of the rows are drawn; by default the share of good ones among the labelled.
    """
    marks = best_marks(labels)
    ratios = log_ratios(models(docs, marks))
    keys = cut_lineage(weighted(docs, ratios, seed), "keys")
    if share is None:
        share = marks.agg(F.avg(F.col("good").cast("int"))).first()[0] or 0.0
    cut = kth_largest(keys, "gumbel_key", round(share * keys.count()))
    return keys.withColumn("selected", F.col("gumbel_key") >= F.lit(cut))
