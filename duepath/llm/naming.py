"""Exact duplicates by deterministic block naming, in DataFrame operations only.

The normalised text is cut into blocks of ``BLOCK`` bytes. Distinct blocks are sorted and numbered: equal blocks get
one integer name, different blocks different ones. Then adjacent names are paired, distinct pairs are sorted and
numbered, and so on until every document has one name. Two texts are equal exactly when length and name agree; no
step relies on a hash being free of collisions.

Block text is shuffled once, after each task has dropped its own repeats. Documents refer to their blocks by a
fingerprint; a fingerprint shared by different blocks is looked for, and then blocks are matched by their bytes.

Defined cases: null text counts as empty; rows without doc_id come last among equal texts and keep a null id; of
rows equal in every respect exactly one stays; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duepath.llm.rows import content_key, only
from duepath.session import cut_lineage

BLOCK = 4096
SPACE_CHARACTERS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def without_space(text: Column) -> Column:
    """The text without blanks, tabs and line ends; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARACTERS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """An integer name per row, in sorted order within each partition of a deterministic shuffle."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_rows(texts: DataFrame, size: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / size).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("body"), i * size + 1, F.lit(size)))
    return texts.withColumn("blocks", blocks).select("*", F.posexplode("blocks").alias("pos", "block")).drop("body", "blocks").withColumn("print", fingerprint(F.col("block")))


def identities(docs: DataFrame, block_bytes: int = BLOCK, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, n_chars, text_sha256, key, n_bytes and ``name``; (n_bytes, name) identifies the text."""
    source = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("raw")).withColumn("clean", without_space(F.col("raw")))
    texts = source.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.char_length("raw").cast("long").alias("n_chars"),
        F.sha2("clean", 256).alias("text_sha256"),
        content_key(F.col("doc_id"), F.col("raw")).alias("key"),
        F.octet_length("clean").alias("n_bytes"),
        F.col("clean").cast("binary").alias("body"),
    )
    rows = _block_rows(texts, block_bytes, fingerprint)
    distinct = _block_rows(source.select(F.octet_length("clean").alias("n_bytes"), F.col("clean").cast("binary").alias("body")), block_bytes, fingerprint).select("print", "block").distinct()
    named = _numbered(distinct, "block")
    by_print = cut_lineage(named.groupBy("print").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")), "names")
    if by_print.where("n > 1").isEmpty():
        joined = rows.drop("block").join(by_print.select("print", "name"), "print")
    else:
        joined = rows.join(named, ["print", "block"]).drop("block")
    first = F.col("pos") == 0
    facts = [F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_chars", "text_sha256", "key")]
    level = cut_lineage(joined.select("row", "pos", "n_bytes", "name", *facts), "level")
    heads = level.where(first).select("row", "doc_id", "n_chars", "text_sha256", "key", "n_bytes")
    single = F.col("n_bytes") <= block_bytes
    out = level.where(first & single).select("doc_id", "n_chars", "text_sha256", "key", "n_bytes", "name")
    longest = level.agg(F.max("pos")).first()[0] or 0
    left, span = level.where(~single).select("row", "pos", "n_bytes", "name"), block_bytes
    while longest > 0:
        span, longest = span * 2, longest // 2
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("row", "n_bytes", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = cut_lineage(pairs, "pairs")
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        left = cut_lineage(pairs.join(names, ["a", "b"]).select("row", F.col("half").alias("pos"), "n_bytes", "name"), "level")
        ready = F.col("n_bytes") <= span
        out = out.unionByName(left.where(ready).select("row", "name").join(heads, "row").select("doc_id", "n_chars", "text_sha256", "key", "n_bytes", "name"))
        left = left.where(~ready)
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the content key, for every document.

    Of equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id.
    """
    named = cut_lineage(identities(docs, block_bytes, fingerprint).withColumn("row", F.monotonically_increasing_id()), "named")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = cut_lineage(named.groupBy("n_bytes", "name").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(best, ["n_bytes", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "key"
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the one row of each group of equal texts that stays."""
    found = exact_duplicates(docs)
    stay = found.groupBy("key").agg(F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("repeated")).where("kept").drop("kept")
    return only(docs, cut_lineage(stay, "stay"))
