"""Pool-adjacent-violators over any number of knots.

Neighbouring knots whose rate falls (or stays) are pooled until the rates rise. Which neighbours are pooled first does not
matter, so each round cuts the blocks that are left into ranges, pools inside every range in one task and writes the
result. A round with other cuts follows as long as the rate falls from the end of one range to the start of the next;
what is left over at a cut lies inside a range of the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.operators.asof import neighbours, parts_for
from duepath.session import cut_lineage

RANGE = 500_000
NAMES = ["x", "x_hi", "n", "k", "knots"]


def pool(n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, n and k of each block of a sequence after pooling."""
    first: list[int] = []
    ns: list[float] = []
    ks: list[float] = []
    for i, (a, b) in enumerate(zip(n.tolist(), k.tolist())):
        at = i
        # rates are compared by products, so equal ones are pooled whatever their sizes
        while first and ks[-1] * a >= b * ns[-1]:
            at = first.pop()
            a += ns.pop()
            b += ks.pop()
        first.append(at)
        ns.append(a)
        ks.append(b)
    return np.array(first, np.int64), np.array(ns), np.array(ks)


def _round(blocks: DataFrame, parts: int) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]  # one range
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = table.column("part")[0].as_py()
        columns = {c: table.column(c).to_numpy() for c in NAMES}
        order = np.argsort(columns["x"], kind="stable")
        columns = {c: v[order] for c, v in columns.items()}
        first, n, k = pool(columns["n"], columns["k"])
        last = np.append(first[1:], len(order)) - 1
        out = [columns["x"][first], columns["x_hi"][last], n, k, np.add.reduceat(columns["knots"], first)]
        for start in range(0, len(first), 65_536):
            cut = slice(start, start + 65_536)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[cut]) for c in out], pa.array(np.full(len(n[cut]), part, np.int32))], names=[*NAMES, "part"])

    ranged = blocks.select(*NAMES).repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id())
    return cut_lineage(ranged.mapInArrow(batches, "x double, x_hi double, n double, k double, knots bigint, part int"), "pooled")


def _rises(blocks: DataFrame) -> bool:
    """Whether the rate rises over the cuts between ranges; looks at two blocks of each range."""
    facts = F.struct("x", "n", "k")
    ends = blocks.groupBy("part").agg(F.min(facts).alias("a"), F.max(facts).alias("b"))
    rows = sorted(ends.collect(), key=lambda r: r["a"]["x"])  # one row per range
    return all(p["b"]["k"] * q["a"]["n"] < q["a"]["k"] * p["b"]["n"] for p, q in zip(rows, rows[1:]))


def pooled_blocks(points: DataFrame, size: int = RANGE) -> DataFrame:
    """Blocks of the isotonic fit of ``points`` (x, n, k; distinct x): x and x_hi (first and last knot), n, k, knots, y."""
    blocks = points.select(F.col("x").cast("double"), F.col("x").cast("double").alias("x_hi"), F.col("n").cast("double"), F.col("k").cast("double"), F.lit(1).cast("bigint").alias("knots"))
    left, turn = points.count(), 0
    while True:
        parts = parts_for(left, size)
        # one range more in every other round moves all cuts
        blocks = _round(blocks, parts + turn % 2 if parts > 1 else 1)
        if parts == 1 or _rises(blocks):
            return blocks.select(*NAMES, (F.col("k") / F.col("n")).alias("y"))
        left, turn = blocks.count(), turn + 1


def isotonic_fit(points: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The points, read from a table, with their fitted rate y, and the curve: the first and last knot (x, y) of every block."""
    blocks = pooled_blocks(points, size)
    y = F.least(F.greatest("y", F.lit(0.0)), F.lit(1.0))
    starts = blocks.select("x", y.alias("y"))
    found = neighbours(points.select("x"), starts, ["y"], ready=True).select("x", F.col("below_y").alias("y"))
    fitted = points.select("x", "n", "k").join(found, "x")
    curve = starts.unionByName(blocks.where("x_hi > x").select(F.col("x_hi").alias("x"), y.alias("y")))
    return cut_lineage(fitted, "fitted"), curve
