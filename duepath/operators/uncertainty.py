"""How sure a Gini, a rate or a score is: DeLong, block bootstrap, refits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duepath.functions import score as sc
from duepath.operators import calibrate
from duepath.operators.ordered import Index, OrderedGroups
from duepath.operators.ranking import prefix_counts, score_counts
from duepath.session import cut_lineage


def delong(df: DataFrame, score: str = "raw", target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    """AUC and its DeLong variance. The structural components depend on the score only, so
    they are read off the score counts and weighted, never computed per row."""
    keys = list(keys)
    pre = prefix_counts(score_counts(df, keys, score, target), keys)
    totals = pre.groupBy(*keys).agg(F.sum("n1").alias("m"), F.sum("n0").alias("n"))
    if keys:
        rows = pre.join(totals, keys)
    else:
        one = totals.first()
        rows = pre.withColumns({"m": F.lit(one["m"]), "n": F.lit(one["n"])})
    v1 = (F.col("below0") + F.col("n0") / 2) / F.col("n")
    v0 = 1.0 - (F.col("below1") + F.col("n1") / 2) / F.col("m")
    w1, w0 = F.col("n1"), F.col("n0")
    out = rows.groupBy(*keys).agg(
        F.max("m").alias("m"), F.max("n").alias("n"), F.sum(w1 * v1).alias("s1"), F.sum(w1 * v1 * v1).alias("q1"),
        F.sum(w0 * v0).alias("s0"), F.sum(w0 * v0 * v0).alias("q0"))

    def sample_var(q: str, s: str, size: str) -> Column:
        return F.when(F.col(size) > 1, (F.col(q) - F.col(s) * F.col(s) / F.col(size)) / (F.col(size) - 1)).otherwise(0.0)

    both = (F.col("m") > 0) & (F.col("n") > 0)
    return out.select(
        *keys, F.when(both, F.col("s1") / F.col("m")).alias("auc"),
        F.when(both, sample_var("q1", "s1", "m") / F.col("m") + sample_var("q0", "s0", "n") / F.col("n")).alias("variance"),
    ).withColumn("se_gini", 2 * F.sqrt("variance"))


def hash_draw(seed: Column, replicate: Column, draw: Column, size: Column) -> Column:
    """A reproducible draw from 0..size-1: the head of an md5, so any engine can repeat it."""
    text = F.concat_ws(":", seed.cast("string"), replicate.cast("string"), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") % size


def week_draws(spark: SparkSession, weeks: DataFrame, week: str, replicates: int, seed: int = 42, smaller: bool = False) -> DataFrame:
    """(replicate, week, times): whole weeks drawn with replacement. The table has one row per
    replicate and drawn week at most, whatever the number of scored rows."""
    numbered = cut_lineage(OrderedGroups(weeks.select(week).distinct(), [], [week]).add(_no=Index()).done(), "weeks")
    count = numbered.count()
    draws = max(2, int(round(count ** (2.0 / 3.0)))) if smaller else max(2, count)
    grid = spark.range(replicates * draws).select(
        F.floor(F.col("id") / draws).cast("bigint").alias("replicate"), (F.col("id") % draws).alias("_j"))
    picked = grid.withColumn("_no", hash_draw(F.lit(seed), F.col("replicate"), F.col("_j"), F.lit(count)))
    times = picked.groupBy("replicate", "_no").agg(F.count(F.lit(1)).alias("times"))
    return times.join(numbered, "_no").select("replicate", week, "times")


#: Rows of a range that one task holds, and of a piece of it with the counts of all replicates.
RANGE, PIECE = 200_000, 2048
#: Weeks whose draws a task is sent, a number per replicate each: nearly two centuries.
MOST_WEEKS = 10_000
Weigh = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]


def replicate_ginis(points: DataFrame, replicates: int, weigh: Weigh, size: int = RANGE) -> DataFrame:
    """Gini of every replicate from counts per score, read from a table of s, n0, n1 and what else ``weigh`` needs.

    ``weigh`` turns rows into their n0 and n1 under all replicates, a row of numbers each. The rows are cut into ranges of
    scores; a range adds up, for all replicates side by side, its pairs won and its counts, while walking along its
    scores. What lies below a range comes from the counts of the ranges before it. Nothing is binned, and no row is
    repeated per replicate.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]  # one range
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.argsort(columns["s"], kind="stable")
        columns = {c: v[order] for c, v in columns.items()}
        starts = np.flatnonzero(np.concatenate([[True], np.diff(columns["s"]) != 0]))
        won, low, high = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        at = 0
        while at < len(starts):
            # whole scores, about PIECE rows
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE, "right")) - 1)
            end = starts[to] if to < len(starts) else len(order)
            if end == len(order):
                to = len(starts)
            n0, n1 = weigh({c: v[starts[at] : end] for c, v in columns.items()})
            n0, n1 = (np.add.reduceat(n, starts[at:to] - starts[at], axis=0) for n in (n0, n1))
            below = low + np.cumsum(n0, axis=0) - n0
            won += (n1 * (below + n0 / 2)).sum(0)
            low += n0.sum(0)
            high += n1.sum(0)
            at = to
        each = pa.array(np.arange(replicates)), pa.array(won), pa.array(low), pa.array(high)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, columns["part"][0], np.int32)), *each], names=["part", "replicate", "won", "n0", "n1"])

    parts = calibrate.asof.parts_for(points.count(), size)
    ranged = points.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id())
    sums = cut_lineage(ranged.mapInArrow(batches, "part int, replicate bigint, won double, n0 double, n1 double"), "range-sums")
    # one row per replicate and range
    before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("below", F.coalesce(F.sum("n0").over(before), F.lit(0.0)))
    pos, neg = F.sum("n1"), F.sum("n0")
    value = F.sum(F.col("won") + F.col("n1") * F.col("below")) / (pos * neg)
    return placed.groupBy("replicate").agg((2 * F.when((pos > 0) & (neg > 0), value) - 1).alias("gini"))


def block_bootstrap(df: DataFrame, replicates: int = 500, week: str = "wk", score: str = "raw", target: str = "target",
                    seed: int = 42, smaller: bool = False, size: int = RANGE) -> DataFrame:
    """Gini per replicate when whole weeks are drawn with replacement: a draw only multiplies a week's counts."""
    counts = cut_lineage(score_counts(df, [week], score, target).where(F.col(week).isNotNull()), "week-score-counts")
    draws = week_draws(df.sparkSession, counts, week, replicates, seed, smaller)
    weeks = [r[0] for r in counts.select(week).distinct().limit(MOST_WEEKS + 1).collect()]
    if len(weeks) > MOST_WEEKS:
        raise ValueError(f"more than {MOST_WEEKS} weeks to draw from")
    place = {w: i for i, w in enumerate(weeks)}
    times = np.zeros((len(weeks), replicates), np.float32)
    for r in draws.collect():  # at most one row per week and replicate
        times[place[r[week]], r["replicate"]] = r["times"]
    names = cut_lineage(df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(weeks)], counts.select(week).schema.add("_no", "integer")), "week-places")

    def weigh(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        drawn = times[rows["_no"]].astype(float)
        return drawn * rows["n0"][:, None], drawn * rows["n1"][:, None]

    points = cut_lineage(counts.join(names, week).select("s", "n0", "n1", "_no"), "points")
    return replicate_ginis(points, replicates, weigh, size)


def row_bootstrap(df: DataFrame, replicates: int = 500, score: str = "raw", target: str = "target", seed: int = 42,
                  size: int = RANGE) -> DataFrame:
    """Gini per replicate of a row-wise bootstrap. A row's Poisson weights add up within equal
    (score, target) cells, so a cell draws once per replicate, all from one stream named by seed and score."""
    points = cut_lineage(score_counts(df, [], score, target).select("s", "n0", "n1"), "row-score-counts")

    def weigh(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n0, n1 = np.empty((len(rows["s"]), replicates)), np.empty((len(rows["s"]), replicates))
        # -0.0 and 0.0 are one score
        for i, bits in enumerate((rows["s"].astype(float) + 0.0).view(np.uint64).tolist()):
            stream = np.random.Generator(np.random.Philox(key=[seed, bits]))
            n1[i] = stream.poisson(rows["n1"][i], replicates)
            n0[i] = stream.poisson(rows["n0"][i], replicates)
        return n0, n1

    return replicate_ginis(points, replicates, weigh, size)


def summarise(values: DataFrame, column: str = "gini", keys: Sequence[str] = ()) -> DataFrame:
    """Sd, skew and the 2.5/97.5 percentiles of finite replicate values."""
    v = F.col(column)
    finite = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    n = F.count(v)
    return finite.groupBy(*keys).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.when(n > 1, F.stddev_samp(v)).alias("sd"),
        F.when((n >= 3) & (F.stddev_pop(v) > 0), F.skewness(v)).alias("skew"),
        F.percentile(v, F.lit(0.025)).alias("p025"), F.percentile(v, F.lit(0.975)).alias("p975"))


def design_effect(block: DataFrame, rows: DataFrame) -> DataFrame:
    """Standard error under block and row resampling, and their ratio."""
    both = block.select("gini", F.lit("block").alias("kind")).unionByName(rows.select("gini", F.lit("rows").alias("kind")))
    sd = {kind: F.stddev_samp(F.when(F.col("kind") == kind, F.col("gini"))) for kind in ("block", "rows")}
    return both.filter(F.col("gini").isNotNull()).agg(sd["block"].alias("se_block"), sd["rows"].alias("se_rows")).withColumn(
        "design_effect", F.col("se_block") / F.col("se_rows"))


def pool_adjacent(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit of a short sequence: each value is the largest, over the starts
    to its left, of the smallest running mean to its right (computed block by block)."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for r, w in zip(rate, weight):
        m, size = float(r), 1
        w = float(w)
        while means and means[-1] > m:
            pm, pw, ps = means.pop(), weights.pop(), sizes.pop()
            m, w, size = (pm * pw + m * w) / (pw + w), pw + w, ps + size
        means.append(m)
        weights.append(w)
        sizes.append(size)
    return np.repeat(means, sizes)


REFIT_FIELDS = ("replicate bigint, ref_score double, pd double, score double, tail_n double, tail_k double, "
                "base_rate double, floor double")


def refit_bootstrap(df: DataFrame, refs: Sequence[tuple[float, float]], replicates: int = 100, bins: int = 2000, week: str = "wk",
                    score: str = "raw", target: str = "target", seed: int = 42, floor: float = 0.0075, prior: float = 100.0,
                    smaller: bool = False) -> DataFrame:
    """Refit the binned calibrator in every replicate and read it at the reference raw scores.

    The calibrator is the one on quantile bins of the scores, which are cut once, so a replicate is a
    group of at most ``bins`` rows.
    """
    counts = cut_lineage(score_counts(df, [week], score, target), "week-score-counts")
    points = cut_lineage(counts.groupBy(F.col("s").alias("x")).agg(F.sum(F.col("n0") + F.col("n1")).alias("n")), "score-counts")
    edges = calibrate.quantile_edges(points, bins, points.agg(F.sum("n")).first()[0] or 0)
    place = calibrate.bin_index(edges, "right")
    cells = counts.withColumn("b", place(F.col("s"))).groupBy(week, "b").agg(
        F.sum(F.col("n0") + F.col("n1")).alias("n"), F.sum("n1").alias("k"), F.sum(F.col("s") * (F.col("n0") + F.col("n1"))).alias("xs"))
    draws = week_draws(df.sparkSession, counts, week, replicates, seed, smaller)
    drawn = cells.join(draws, week).groupBy("replicate", "b").agg(
        *[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "k", "xs")])
    ref_scores = np.array([r[0] for r in refs])
    ref_raw = np.array([r[1] for r in refs])
    offset, factor = sc.OFFSET, sc.FACTOR

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        n, k = pdf["n"].to_numpy(), pdf["k"].to_numpy()
        x = pdf["xs"].to_numpy() / n
        y = pool_adjacent(k / n, n)
        at = np.clip(np.interp(ref_raw, x, y), floor, 1.0 - floor)
        tail = y <= y.min() + 1e-12
        tn, tk, base = n[tail].sum(), k[tail].sum(), k.sum() / n.sum()
        fl = (prior * base + tk) / (prior + tn)
        return pd.DataFrame({
            "replicate": int(pdf["replicate"].iloc[0]), "ref_score": ref_scores, "pd": at,
            "score": offset + factor * np.log((1 - at) / at), "tail_n": tn, "tail_k": tk, "base_rate": base, "floor": fl})

    return drawn.groupBy("replicate").applyInPandas(refit, REFIT_FIELDS)


def reference_raw(fitted: DataFrame, scores: Sequence[float]) -> DataFrame:
    """For each reference score, the first knot whose fitted rate reaches the score's rate
    (the last knot where none does)."""
    targets = [(float(s), 1.0 / (1.0 + float(np.exp((s - sc.OFFSET) / sc.FACTOR)))) for s in scores]
    last = F.max("x")
    return fitted.agg(F.array(*[
        F.struct(F.lit(s).alias("ref_score"), F.coalesce(F.min(F.when(F.col("y") >= F.lit(p), F.col("x"))), last).alias("raw"))
        for s, p in targets]).alias("s")).select(F.inline("s"))


def tail_evidence(fitted: DataFrame, base_rate: float, strength: float = 100.0) -> DataFrame:
    """Observations and defaults of the lowest block, its rule-of-three bound and posterior mean."""
    low = fitted.agg(F.min("y")).first()[0]
    block = fitted.filter(F.col("y") <= F.lit(low + 1e-12)).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("knots"))
    return block.withColumns({
        "rule_of_three": sc.rule_of_three(F.col("n")),
        "posterior_mean": sc.posterior_mean(F.col("n"), F.col("k"), F.lit(base_rate), F.lit(strength))})
