"""Carrying decisions about documents back to their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_key(doc_id: Column, text: Column) -> Column:
    """A digest of doc_id and text, which may both be null."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))))


def only(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose content key is in ``stay`` (key, repeated).

    Of a key marked ``repeated``, that is of rows alike in doc_id and text, one row stays, no matter which.
    """
    key, mark = "content_key", "is_repeated"
    while key in docs.columns or mark in docs.columns:
        key, mark = key + "_", mark + "_"
    kept = docs.withColumn(key, content_key(F.col("doc_id"), F.col("text"))).join(stay.select(F.col("key").alias(key), F.col("repeated").alias(mark)), key)
    return kept.where(~F.col(mark)).unionByName(kept.where(mark).dropDuplicates([key])).select(*docs.columns)


def few_of_each(rows: DataFrame, label: str, n: int) -> tuple[DataFrame, dict]:
    """The ``n`` rows of each label with the smallest hash of doc_id, numbered by ``place``, and all labels' counts.

    The labels are counted first; then only rows under a bar that four times ``n`` are expected to pass are compared, so
    what one task sorts doesn't grow with the table. There may be a few labels only, as they are collected.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    rank, near = F.xxhash64("doc_id"), F.lit(False)
    for value, count in counts.items():
        bar = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * n // count)
        near = near | (F.col(label).eqNullSafe(F.lit(value)) & (rank <= F.lit(bar)))
    place = F.row_number().over(Window.partitionBy(label).orderBy(rank, "doc_id", "text"))
    return rows.where(near).withColumn("place", place).where(F.col("place") <= n), counts
