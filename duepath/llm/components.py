"""Connected components over an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.session import cut_lineage


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is the smallest node of its component.

    Alternating star rounds: each node hands its smallest neighbour to its larger ones, then to its smaller ones,
    until nothing changes; the number of rounds grows with the logarithm of the longest path. Each round's minima
    are written first, so the join of a node with very many edges has two shuffled sides and can be split.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    while True:
        both = now.select("u", "v").union(now.select("v", "u"))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        large = cut_lineage(large, "large")
        low = cut_lineage(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.*").where("u < v").distinct()
        following = cut_lineage(small, "edges")
        if following.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(following, ["u", "v"], "left_anti").isEmpty():
            break
        now = following
    pairs = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return pairs.union(pairs.select("root", "root")).distinct()
