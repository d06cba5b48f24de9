"""Discrimination, stability, drift and parity of scores and features."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duepath.config import DEFAULT, Settings
from duepath.operators.asof import parts_for
from duepath.operators.ordered import Index, OrderedGroups, Total
from duepath.operators.ranking import average_rank, prefix_counts, score_counts
from duepath.operators.reports import unpivot
from duepath.session import cut_lineage


def auc(df: DataFrame, keys: Sequence[str] = (), score: str = "raw", target: str = "target", weight: str | None = None,
        single_class: float | None = 0.5) -> DataFrame:
    """Tie-aware AUC per group: (keys, n, n_pos, auc, gini)."""
    keys = list(keys)
    pre = prefix_counts(score_counts(df, keys, score, target, weight), keys)
    wins = F.sum(F.col("n1") * (F.col("below0") + F.col("n0") / 2.0))
    pos, neg = F.sum("n1"), F.sum("n0")
    out = pre.groupBy(*keys).agg(wins.alias("_w"), pos.alias("n_pos"), neg.alias("_neg"))
    value = F.when((F.col("n_pos") > 0) & (F.col("_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("_neg")))
    if single_class is not None:
        value = F.coalesce(value, F.lit(single_class))
    return out.select(*keys, (F.col("n_pos") + F.col("_neg")).alias("n"), "n_pos", value.alias("auc")).withColumn("gini", 2 * F.col("auc") - 1)


def _stability(df: DataFrame, y: Column, x: Column, falling: float, noise: float) -> DataFrame:
    """mean + falling * min(0, slope) - noise * sd of residuals, from one aggregate."""
    slope = F.regr_slope(y, x)
    n = F.count(y)
    left = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)
    out = df.agg(
        n.alias("n_weeks"), F.avg(y).alias("mean_gini"), F.when(n >= 2, slope).alias("slope"),
        F.when(n >= 2, F.sqrt(F.greatest(left / n, F.lit(0.0)))).alias("res_std"))
    out = out.fillna(0.0, subset=["mean_gini", "slope", "res_std"])
    return out.withColumn(
        "stability", F.col("mean_gini") + falling * F.least(F.lit(0.0), F.col("slope")) - noise * F.col("res_std"))


def gini_stability(df: DataFrame, week: str = "wk", score: str = "raw", target: str = "target", falling: float = 88.0,
                   noise: float = 0.5, min_rows: int = 10) -> DataFrame:
    weekly = auc(df, [week], score, target, single_class=None)
    weekly = weekly.filter((F.col("n") >= min_rows) & F.col("auc").isNotNull())
    return _stability(weekly, F.col("gini"), F.col(week).cast("double"), falling, noise)


def vintages(df: DataFrame, week: str = "wk", score: str = "raw", target: str = "target", min_rows: int = 200, min_each: int = 5) -> DataFrame:
    """Default rate and Gini per week, where a week is large enough."""
    weekly = auc(df, [week], score, target, single_class=None)
    big = (F.col("n") >= min_rows) & (F.col("n_pos") >= min_each) & (F.col("n") - F.col("n_pos") >= min_each)
    return weekly.filter(big).select(
        F.col(week).cast("double").alias("vintage"), F.col("n").cast("bigint").alias("n"), F.col("n_pos").cast("bigint").alias("defaults"),
        (F.col("n_pos") / F.col("n")).alias("default_rate"), "gini")


def vintage_stability(table: DataFrame) -> DataFrame:
    """Stability with the trend taken over the row number of the vintage table."""
    rows = OrderedGroups(table.filter(F.col("gini").isNotNull()), [], ["vintage"]).add(t=Index()).done()
    return _stability(rows, F.col("gini"), F.col("t").cast("double"), 88.0, 0.5).filter(F.col("n_weeks") >= 3)


def censoring(table: DataFrame, ratio: float = 1.25) -> DataFrame:
    """Default rate of the first and the last third of the vintages, and the verdict."""
    tagged = OrderedGroups(table, [], ["vintage"]).add(t=Index(), n_vintages=Total()).done()
    third = F.greatest(F.lit(1), F.floor(F.col("n_vintages") / 3))
    out = tagged.agg(
        F.max("n_vintages").alias("n_vintages"),
        F.avg(F.when(F.col("t") < third, F.col("default_rate"))).alias("early_rate"),
        F.avg(F.when(F.col("t") >= F.col("n_vintages") - third, F.col("default_rate"))).alias("late_rate"))
    verdict = F.when((F.col("late_rate") > 0) & (F.col("early_rate") / F.col("late_rate") > ratio), "declining").otherwise("stable")
    return out.withColumn("verdict", verdict)


def verdict(gini: Column) -> Column:
    return F.when(gini < 0.02, "NO SIGNAL").when(gini < 0.10, "WEAK").when(gini < 0.40, "REAL SIGNAL").otherwise("STRONG")


def univariate_gini(df: DataFrame, columns: Sequence[str], target: str = "target", nulls_as_zero: bool = False, min_rows: int = 0) -> DataFrame:
    """Absolute Gini of each single column, all columns in one pass over long rows."""
    long = unpivot(df.filter(F.col(target).isNotNull()), [target], columns)
    if nulls_as_zero:
        long = long.fillna(0.0, subset=["value"])
    out = auc(long, ["feature"], "value", target)
    return out.filter(F.col("n") >= min_rows).select("feature", F.col("n").cast("bigint").alias("n"), F.abs("gini").alias("abs_gini"))


def coverage_gini(df: DataFrame, columns: Sequence[str], target: str = "target") -> DataFrame:
    """Share of known values next to the Gini with unknowns read as 0."""
    share = df.filter(F.col(target).isNotNull()).agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), (100.0 * F.count(c) / F.count(F.lit(1))).alias("coverage_pct")) for c in columns]).alias("s"))
    return univariate_gini(df, columns, target, nulls_as_zero=True).join(share.select(F.inline("s")), "feature")


def _pairs(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    left = a.select("case_id", *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    right = b.select("case_id", *[F.col(c).cast("double").alias(f"b_{c}") for c in columns])
    return left.join(right, "case_id")


def _per_feature(pairs: DataFrame, columns: Sequence[str], fields: list[Column]) -> DataFrame:
    """Aggregates of x and y of every feature, as one row each; grouped rows, since one row of all features' aggregates is
    more than Spark compiles."""
    long = pairs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("x"), F.col(f"b_{c}").alias("y")) for c in columns])))
    names = pairs.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(long.groupBy("feature").agg(*fields), "feature", "left")


def _corr(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    flat = (F.min(F.when(both, x)) == F.max(F.when(both, x))) | (F.min(F.when(both, y)) == F.max(F.when(both, y)))
    # F.corr divides by zero on flat columns, whatever the condition around it
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), spread))


def fidelity(a: DataFrame, b: DataFrame, columns: Sequence[str], cfg: Settings = DEFAULT) -> DataFrame:
    """How well matrix ``a`` reproduces ``b``, feature by feature, on shared cases."""
    x, y = F.col("x"), F.col("y")
    diff = F.abs(x - y)
    close = F.coalesce(diff <= cfg.parity_abs_tol + cfg.parity_rel_tol * F.greatest(F.abs(y), F.lit(1.0)), F.lit(False))
    match = close | (x.isNull() & y.isNull())
    return _per_feature(_pairs(a, b, columns), columns, [
        F.avg(match.cast("double")).alias("match_rate"), F.avg(diff).alias("mean_abs_diff"),
        F.when(F.count(x) > 2, _corr(x, y)).alias("corr")])


def drift(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean shift in units of the sd of ``a``, and the correlation, per feature."""
    x, y = F.col("x"), F.col("y")
    sd = F.stddev_pop(x)
    return _per_feature(_pairs(a, b, columns), columns, [
        F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"),
        F.when(sd > 0, F.abs(F.avg(x) - F.avg(y)) / sd).alias("std_shift"), _corr(x, y).alias("corr")])


def gates(report: DataFrame, drift_max: float = 3.0, min_corr: float = 0.30) -> DataFrame:
    """Which features survive the drift gate and the fidelity gate."""
    drifted = F.coalesce(F.col("std_shift") > drift_max, F.lit(False))
    scrambled = F.coalesce(F.col("corr") < min_corr, F.lit(True))
    return report.select("feature", F.when(drifted, "drift").when(scrambled, "fidelity").otherwise("keep").alias("gate"))


def parity_breaks(a: DataFrame, b: DataFrame, columns: Sequence[str], cfg: Settings = DEFAULT) -> DataFrame:
    """(case_id, feature, a, b) wherever two matrices differ beyond the parity tolerance."""
    pairs = _pairs(a, b, columns)

    def broken(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        limit = F.greatest(F.lit(cfg.parity_abs_tol), cfg.parity_rel_tol * F.greatest(F.abs(x), F.abs(y)))
        same = (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= limit, F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("feature"), x.alias("a"), y.alias("b")))

    # Compared side by side first, so that only one column, not all of both matrices, goes through the explode.
    breaks = pairs.select("case_id", F.array(*[broken(c) for c in columns]).alias("breaks"))
    return breaks.select("case_id", F.explode("breaks").alias("p")).filter(F.col("p").isNotNull()).select("case_id", "p.*")


def _moments(it: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of a task where both of two columns are known: one row per pair of columns."""
    p = len(columns)
    sums = np.zeros((6, p, p))
    for batch in it:
        ranks = np.stack([np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in columns], 1)
        known = (~np.isnan(ranks)).astype(float)
        x = np.where(known > 0, ranks, 0.0)
        sums += np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
    i, j = np.triu_indices(p, 1)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(s[i, j]) for s in sums]], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])


RANKS = 2_000_000


def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns, as (x, y, rho) rows; rows where both are known count.

    The ranks are written as one column per feature, and one pass over them sums the products of all pairs.
    """
    columns = list(columns)
    long = cut_lineage(unpivot(df, [key], columns), "long")
    ranked = average_rank(long, ["feature"], "value")
    # about their middle, ranks and their products stay small
    mid = F.broadcast(long.groupBy("feature").agg(((F.count("value") + 1) / 2).alias("mid")))
    centred = ranked.join(mid, "feature").withColumn("rank", F.col("rank") - F.col("mid"))
    # tasks of a fixed number of ranks, however many rows there are
    dealt = centred.repartition(parts_for(long.count(), RANKS), key)
    wide = cut_lineage(dealt.groupBy(key).pivot("feature", columns).agg(F.first("rank")).select(*[F.col(f"`{c}`") for c in columns]), "ranks")
    parts = wide.mapInArrow(lambda it: _moments(it, columns), "i bigint, j bigint, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.greatest(F.col("n"), F.lit(1.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = F.when((vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy")), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in columns])
    return s.select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), rho.alias("rho"))


def keep_uncorrelated(correlations: DataFrame, strength: DataFrame, limit: float = 0.90) -> list[str]:
    """Strongest feature of each correlated cluster. Works on the feature-by-feature table,
    whose size is the number of features squared, never the data."""
    rho = {frozenset((r["x"], r["y"])): r["rho"] for r in correlations.collect()}
    order = [r["feature"] for r in strength.orderBy(F.desc("abs_gini"), "feature").collect()]
    kept: list[str] = []
    for name in order:
        if all(abs(rho.get(frozenset((name, k))) or 0.0) < limit for k in kept):
            kept.append(name)
    return kept
