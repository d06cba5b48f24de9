"""Ranks, prefix counts over scores, and splits by time."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.operators.ordered import (
    Index,
    OrderedGroups,
    RunningSum,
    hot_groups,
    hot_quantile,
    join_one_row,
)

from duepath.session import cut_lineage


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "raw", target: str = "target", weight: str | None = None) -> DataFrame:
    """Rows reduced to (keys, score, n0, n1). Everything about ranking is read off these."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(target).cast("double")
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & y.isNotNull())
    return known.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("n1"), F.sum(F.when(y == 1, 0.0).otherwise(w)).alias("n0"))


def prefix_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score counts with the counts of all lower scores (below0, below1). The counts are
    written once, so the look-up for hot groups costs no second pass over the rows."""
    counts = cut_lineage(counts, "score-counts")
    ordered = OrderedGroups(counts, keys, ["s"]).add(c0=RunningSum("n0"), c1=RunningSum("n1")).done()
    return ordered.withColumns({"below0": F.col("c0") - F.col("n0"), "below1": F.col("c1") - F.col("n1")}).drop("c0", "c1")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, alias: str = "rank") -> DataFrame:
    """Every row with the mean rank of its value inside its group; nulls get no rank."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    sizes = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = OrderedGroups(sizes, keys, [value]).add(_cum=RunningSum("_c")).done()
    ranks = ranked.select(*keys, value, (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(alias))
    return join_one_row(df, ranks, [*keys, value], hot_groups(known, [*keys, value]), "left")


def time_split(df: DataFrame, week: str, order: str, shares: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Chronological slices by row count. Only the weeks that a boundary falls into are
    ordered row by row; every other row is placed by its week alone."""
    rows = df.filter(F.col(week).isNotNull())
    weeks = cut_lineage(rows.groupBy(F.col(week).alias("_w")).agg(F.count(F.lit(1)).alias("_c")), "weeks")
    placed = OrderedGroups(weeks, [], ["_w"]).add(_cum=RunningSum("_c")).done()
    total = weeks.agg(F.sum("_c")).first()[0] or 0
    cuts, share = [], 0.0
    for part in shares:
        share += part
        cuts.append(int(total * share))
    # For each cut the one week that holds it: at most len(cuts) rows reach the driver.
    found = [placed.filter((F.col("_cum") - F.col("_c") <= c) & (F.col("_cum") > c)).select("_w", (F.col("_cum") - F.col("_c")).alias("_before")).first() for c in cuts]
    label = F.lit(labels[-1])
    edge_weeks = sorted({f["_w"] for f in found if f is not None})
    for cut_week, name in reversed(list(zip(found, labels))):
        if cut_week is not None:
            label = F.when(F.col(week) < F.lit(cut_week["_w"]), name).otherwise(label)
        else:
            label = F.lit(name)
    plain = rows.filter(~F.col(week).isin(edge_weeks)) if edge_weeks else rows
    out = plain.withColumn("slice", label)
    if edge_weeks:
        inner = OrderedGroups(rows.filter(F.col(week).isin(edge_weeks)), [week], [order]).add(_i=Index()).done()
        edge = F.lit(labels[-1])
        for cut, cut_week, name in reversed(list(zip(cuts, found, labels))):
            if cut_week is None:
                edge = F.lit(name)
                continue
            before = F.col(week) < F.lit(cut_week["_w"])
            inside = (F.col(week) == F.lit(cut_week["_w"])) & (F.col("_i") + F.lit(cut_week["_before"]) < F.lit(cut))
            edge = F.when(before | inside, name).otherwise(edge)
        out = out.unionByName(inner.withColumn("slice", edge).drop("_i"))
    return out


def three_way_split(df: DataFrame, week: str = "wk", order: str = "id") -> DataFrame:
    return time_split(df, week, order, [0.6, 0.2], ["train", "calib", "eval"])


def two_way_split(df: DataFrame, week: str = "wk", order: str = "id", share: float = 0.8) -> DataFrame:
    return time_split(df, week, order, [share], ["fit", "holdout"])


def quantile_split(df: DataFrame, week: str = "wk", share: float = 0.8, seed: int = 0, order: str = "id") -> DataFrame:
    """Slices at a quantile of the week itself; a seeded hash split where one side is empty."""
    weeks = df.select(F.col(week).cast("double").alias("_w"))
    limit = hot_quantile(weeks, [], "_w", share, "_cut").first()["_cut"]
    ends = weeks.agg(F.min("_w"), F.max("_w")).first()
    if ends[0] is None or limit is None or not (ends[0] <= limit < ends[1]):
        held = F.pmod(F.xxhash64(F.col(order).cast("string"), F.lit(seed)), F.lit(5)) == 0
        return df.withColumn("slice", F.when(held, "test").otherwise("train"))
    return df.withColumn("slice", F.when(F.col(week) <= limit, "train").otherwise("test"))


def random_cohort(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A reproducible random sample of n rows, by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def head_and_tail(df: DataFrame, n: int, score: str, key: str) -> DataFrame:
    top = df.orderBy(F.desc(score), F.asc(key)).limit(n).withColumn("part", F.lit("head"))
    low = df.orderBy(F.asc(score), F.desc(key)).limit(n).withColumn("part", F.lit("tail"))
    return top.unionByName(low)


def rank_blend(df: DataFrame, key: str, columns: Sequence[str], alias: str = "blend") -> DataFrame:
    """Mean of the average ranks of several predictions."""
    out = df
    for c in columns:
        out = average_rank(out, [], c, f"_r_{c}")
    mean = sum((F.col(f"_r_{c}") for c in columns), F.lit(0.0)) / len(columns)
    return out.select(key, mean.alias(alias))
