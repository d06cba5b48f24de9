"""Look-ups in a sorted table that is too large to send around.

Values and knots are put in one sequence, cut into ranges of at most about ``RANGE`` rows. Each range is sorted and filled
in one task: every value gets the last knot at or below it and the first one at or above it. Where a range has none on a
side, the last or first knot of the nearest range that has one is handed over by a table of one row per range.

Only distinct values are looked up, so rows that share a value, however many, cost one; they meet their knots in a join by
value afterwards, which Spark may broadcast or split as their sizes tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duepath.session import cut_lineage

RANGE = 1_000_000


def parts_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def _knot(prefix: str, columns: Sequence[str]) -> list[str]:
    return [f"{prefix}_{c}" for c in columns]


def neighbours(values: DataFrame, knots: DataFrame, columns: Sequence[str] = (), size: int = RANGE, ready: bool = False) -> DataFrame:
    """Each distinct value (x of ``values``) with the knots around it.

    Returns x, below_x, above_x and below_/above_ each of ``columns`` (numbers, as doubles). ``knots`` has one row per x;
    a value that is a knot is its own neighbour on both sides; beyond the ends a side is null. Null and NaN values are
    left out. ``ready`` says that ``values`` are distinct and, as the knots, read from a table.
    """
    columns = ["x", *columns]
    known = values.select(F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    known = known if ready else known.distinct()
    asked = known.withColumn("is_knot", F.lit(False)).select("x", "is_knot", *[F.lit(None).cast("double").alias(f"k_{c}") for c in columns])
    given = knots.select(F.col("x").cast("double").alias("x"), F.lit(True).alias("is_knot"), *[F.col(c).cast("double").alias(f"k_{c}") for c in columns])
    both = asked.unionByName(given)
    both = both if ready else cut_lineage(both, "values-and-knots")
    parts = parts_for(both.count(), size)
    sides = [*_knot("below", columns), *_knot("above", columns)]
    names = ["part", "is_value", "x", *sides]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]  # one range
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = table.column("part")[0].as_py()
        x = table.column("x").to_numpy()
        is_knot = np.asarray(table.column("is_knot").combine_chunks().to_numpy(zero_copy_only=False), bool)
        at = np.flatnonzero(is_knot)
        at = at[np.argsort(x[at], kind="stable")]
        kx = x[at]
        facts = {c: table.column(f"k_{c}").to_numpy()[at] for c in columns}
        v = x[~is_knot]
        low, high = np.searchsorted(kx, v, "right") - 1, np.searchsorted(kx, v, "left")

        def pick(c: str, place: np.ndarray) -> pa.Array:
            out = (place < 0) | (place >= len(kx))
            return pa.array(facts[c][np.where(out, 0, place)] if len(kx) else np.zeros(len(place)), mask=out)

        for start in range(0, len(v), 65_536):
            cut = slice(start, start + 65_536)
            n = len(v[cut])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, bool)), pa.array(v[cut]), *[pick(c, low[cut]) for c in columns], *[pick(c, high[cut]) for c in columns]], names=names)
        # the range's own last and first knot, for those that follow and precede it
        ends = [*[pick(c, np.array([len(kx) - 1])) for c in columns], *[pick(c, np.array([0])) for c in columns]]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([False]), pa.array([0.0]), *ends], names=names)

    schema = "part int, is_value boolean, x double, " + ", ".join(f"{s} double" for s in sides)
    ranged = both.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id())
    filled = cut_lineage(ranged.mapInArrow(batches, schema), "filled")
    # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    carried = filled.where(~F.col("is_value")).select(
        "part", *[F.last(c, ignorenulls=True).over(before).alias(f"c_{c}") for c in _knot("below", columns)], *[F.first(c, ignorenulls=True).over(after).alias(f"c_{c}") for c in _knot("above", columns)]
    )
    def side(prefix: str) -> list[Column]:
        return [F.when(F.col(f"{prefix}_x").isNull(), F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in _knot(prefix, columns)]

    return filled.where("is_value").join(carried, "part", "left").select("x", *side("below"), *side("above"))


def look_up(df: DataFrame, knots: DataFrame, score: Column, columns: Sequence[str] = (), size: int = RANGE) -> DataFrame:
    """Every row of ``df`` with the knots around ``score``: below_x, above_x and below_/above_ each of ``columns``.

    Rows whose score is null or NaN get nulls.
    """
    # written, so both readings see the same values to the last bit
    rows = cut_lineage(df.withColumn("_x", F.nanvl(score.cast("double"), F.lit(None).cast("double"))), "scored")
    found = neighbours(rows.select(F.col("_x").alias("x")), knots, columns, size).withColumnRenamed("x", "_at")
    return rows.join(found, F.col("_x") == F.col("_at"), "left").drop("_x", "_at")


def numbered(df: DataFrame, order: Sequence[str], name: str = "index", size: int = RANGE) -> DataFrame:
    """Rows with their 0-based place in the order of ``order``, a written table.

    Ranges are sorted and counted apart; what a range starts at comes from a table of one row per range. Ties are told
    apart by a hash of the whole row, so many equal rows are several ranges too.
    """
    source = cut_lineage(df, "rows")
    parts = parts_for(source.count(), size)
    keys = [*[F.col(c) for c in order], F.xxhash64(*df.columns)]
    ranged = source.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(cut_lineage(starts, "starts"), "_part").select(*df.columns, (F.col("_start") + F.col("_place")).cast("bigint").alias(name))
