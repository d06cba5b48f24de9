"""From raw scores to calibrated default rates: isotonic fit, tails, anchoring, evidence."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duepath.functions import score as sc
from duepath.operators import asof, pooling
from duepath.operators.ordered import Index, Lag, OrderedGroups, RunningSum, Total
from duepath.operators.ranking import score_counts
from duepath.session import cut_lineage

TOL = 1e-12


def knots(df: DataFrame, score: str = "raw", target: str = "target") -> DataFrame:
    """One row per distinct score: x, n observations, k defaults."""
    counts = score_counts(df, [], score, target)
    return counts.select(F.col("s").alias("x"), (F.col("n0") + F.col("n1")).alias("n"), F.col("n1").alias("k"))


def binned_knots(df: DataFrame, bins: int = 2000, score: str = "raw", target: str = "target") -> DataFrame:
    """Distinct scores pooled into quantile bins. Edges are interpolated quantiles of the
    rows; a score equal to an edge goes to the bin above it; x is the mean score of a bin."""
    # One pass over the rows; everything after works on the written counts.
    return pooled_knots(cut_lineage(knots(df, score, target), "score-counts"), bins)


def pooled_knots(points: DataFrame, bins: int) -> DataFrame:
    """Counted scores pooled into quantile bins of the rows they stand for."""
    total = points.agg(F.sum("n")).first()[0] or 0
    if bins <= 1 or total <= bins:
        return points
    edges = quantile_edges(points, bins, total)
    # At most `bins` edges, so a literal array serves as the lookup.
    index = bin_index(edges, "right")
    grouped = points.withColumn("_b", index(F.col("x"))).groupBy("_b").agg(
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    return grouped.select("x", "n", "k")


def quantile_edges(points: DataFrame, bins: int, total: float) -> list[float]:
    """The inner quantiles of a weighted set of points, exact and interpolated."""
    cum = OrderedGroups(points, [], ["x"]).add(_cum=RunningSum("n")).done()
    # A point covers the positions a..b-1; every quantile needs the values at the floor and
    # at the ceiling of its place, so each point is matched to the quantiles around it.
    step = (total - 1.0) / bins
    covered = cum.select("x", (F.col("_cum") - F.col("n")).alias("a"), F.col("_cum").alias("b"))
    low = F.greatest(F.lit(1), F.floor((F.col("a") - 1) / F.lit(step))).cast("bigint")
    high = F.least(F.lit(bins - 1), F.ceil(F.col("b") / F.lit(step))).cast("bigint")
    near = covered.filter(low <= high).select("x", "a", "b", F.explode(F.sequence(low, high)).alias("i"))
    place = F.col("i") * F.lit(step)
    lo, hi = F.floor(place), F.ceil(place)
    vals = near.groupBy("i").agg(
        F.max(F.when((F.col("a") <= lo) & (lo < F.col("b")), F.col("x"))).alias("lo"),
        F.max(F.when((F.col("a") <= hi) & (hi < F.col("b")), F.col("x"))).alias("hi"))
    w = place - F.floor(place)
    edge = F.col("lo") + (F.coalesce("hi", "lo") - F.col("lo")) * w
    rows = vals.select(edge.alias("e")).distinct().orderBy("e").collect()
    return [r["e"] for r in rows if r["e"] is not None]


def bin_index(values: list[float], side: str):
    """Arrow function from a column of numbers to positions in a short sorted list."""
    arr = np.asarray(values, dtype=float)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(arr, x.to_numpy(dtype=float), side=side).astype("int32"))

    return place


@dataclass(frozen=True)
class Backbone:
    intercept: float
    slope: float


@dataclass(frozen=True)
class Calibrator:
    """A fitted calibration curve: ``knots`` has a row per distinct score with its counts and fitted rate,
    ``curve`` the first and last knot of every block; the rest are the handful of numbers that describe its ends."""

    knots: DataFrame = field(repr=False)
    curve: DataFrame = field(repr=False)
    n_knots: int = 0
    x_min: float = 0.0
    x_max: float = 0.0
    y_min: float = 0.0
    y_max: float = 0.0
    lead: int = 0
    trail: int = 0
    lead_x: float = 0.0
    trail_x: float = 0.0
    backbone: Backbone | None = None
    lower_z: float = 0.0
    upper_z: float = 0.0
    tail: str = "hybrid"
    pd_floor: float = 0.0003
    moc_logodds: float = 0.0
    ct_shift: float = 0.0
    break_plateau: bool = True
    min_plateau_knots: int = 2

    # -- prediction as column expressions --------------------------------------
    def _tails(self, s: Column, within: Column) -> tuple[Column, Column]:
        """(value, replaced?) with both ends priced off a trend instead of a flat line."""
        if self.tail == "clamp" or self.n_knots == 1:
            return within, F.lit(False)
        if self.tail == "hybrid" and self.backbone is not None:
            low_ok = self.break_plateau and self.lead + 1 >= self.min_plateau_knots and self.lead < self.n_knots - 1
            high_ok = self.break_plateau and self.n_knots - self.trail >= self.min_plateau_knots and self.trail > 0
            low_x = self.lead_x if low_ok else self.x_min
            high_x = self.trail_x if high_ok else self.x_max
            line = lambda x: F.lit(self.backbone.intercept) + F.lit(self.backbone.slope) * x

            def anchored(x0: float, y0: float) -> Column:
                shift = _logit_number(y0) - (self.backbone.intercept + self.backbone.slope * x0)
                return sc.sigmoid(line(s) + F.lit(shift))

            low, high = s < F.lit(low_x), s > F.lit(high_x)
            value = F.when(low, anchored(low_x, self.y_min)).when(high, anchored(high_x, self.y_max)).otherwise(within)
            return value, low | high
        if self.x_max <= self.x_min:
            return within, F.lit(False)
        l0, l1 = _logit_number(self.y_min), _logit_number(self.y_max)
        slope = max(0.0, (l1 - l0) / (self.x_max - self.x_min))
        low, high = s < F.lit(self.x_min), s > F.lit(self.x_max)
        value = (
            F.when(low, sc.sigmoid(F.lit(l0) + F.lit(slope) * (s - F.lit(self.x_min))))
            .when(high, sc.sigmoid(F.lit(l1) + F.lit(slope) * (s - F.lit(self.x_max))))
            .otherwise(within)
        )
        moved = F.abs(value - within) > 1e-8 + 1e-5 * F.abs(within)
        return value, moved

    def predict(self, df: DataFrame, score: str = "raw", alias: str = "pd", apply_shift: bool = True) -> DataFrame:
        """Adds the calibrated rate and ``<alias>_extrapolated``: a straight line between the two knots of the
        curve around the score, the end rate beyond it, then the tails."""
        s = F.col(score).cast("double")
        rows = asof.look_up(df, self.curve, s, ["y"])
        x0, y0, x1, y1 = (F.col(c) for c in ("below_x", "below_y", "above_x", "above_y"))
        within = F.when(x0.isNull(), y1).when(x1.isNull() | (x0 == x1), y0).otherwise(y0 + (y1 - y0) * (s - x0) / (x1 - x0))
        rows = rows.withColumn("_within", within).drop("below_x", "below_y", "above_x", "above_y")
        value, replaced = self._tails(s, F.col("_within"))
        rows = rows.withColumns({"_v": value, "_r": replaced})
        out = F.col("_v")
        if self.tail == "clamp":
            out = sc.clip(out, 0.0, 1.0)
        else:
            if self.moc_logodds:
                out = F.when(F.col("_r"), sc.sigmoid(sc.logit(out) + self.moc_logodds)).otherwise(out)
            if apply_shift and self.ct_shift:
                out = sc.sigmoid(sc.logit(out) + self.ct_shift)
            out = sc.clip(out, self.pd_floor, 1.0 - self.pd_floor)
        known = s.isNotNull() & ~F.isnan(s)
        return rows.withColumns({alias: F.when(known, out), f"{alias}_extrapolated": F.when(known, F.col("_r"))}).drop("_within", "_v", "_r")

    # -- storage ----------------------------------------------------------------
    def save(self, path: str) -> None:
        """The curve and the counted knots as tables, and one row of numbers beside them."""
        spark = self.knots.sparkSession
        line = self.backbone or Backbone(float("nan"), float("nan"))
        row = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("knots", "curve", "backbone")} | {"intercept": line.intercept, "slope": line.slope}
        self.knots.write.parquet(f"{path}/knots")
        self.curve.write.parquet(f"{path}/curve")
        spark.createDataFrame([row]).write.parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Calibrator":
        row = spark.read.parquet(f"{path}/params").first().asDict()
        line = Backbone(row.pop("intercept"), row.pop("slope"))
        return cls(knots=spark.read.parquet(f"{path}/knots"), curve=spark.read.parquet(f"{path}/curve"), backbone=None if math.isnan(line.slope) else line, **row)

    # -- anchoring --------------------------------------------------------------
    def anchored_at(self, df: DataFrame, target: float, score: str = "raw", tol: float = 1e-9) -> "Calibrator":
        """The same curve shifted in log-odds so that the mean rate is ``target``. Rates are
        counted per distinct value once; each pass then tries a whole grid of shifts."""
        if not 0.0 < target < 1.0:
            return replace(self, ct_shift=0.0)
        base = self.predict(df, score, "_pd", apply_shift=False)
        logits = base.filter(F.col("_pd").isNotNull()).groupBy(sc.logit(F.col("_pd")).alias("L")).agg(F.count(F.lit(1)).alias("w")).persist()
        low, high, width = -20.0, 20.0, 33
        shift = 0.0
        try:
            while high - low >= tol:
                grid = [low + (high - low) * i / (width - 1) for i in range(width)]
                row = logits.agg(*[(F.sum(F.col("w") * sc.sigmoid(F.col("L") + g)) / F.sum("w")).alias(f"m{i}") for i, g in enumerate(grid)]).first()
                means = [row[f"m{i}"] for i in range(width)]
                if means[0] is None or means[0] > target or means[-1] < target:
                    return replace(self, ct_shift=0.0)
                i = max(j for j in range(width - 1) if means[j] < target or j == 0)
                low, high = grid[i], grid[i + 1]
            shift = 0.5 * (low + high)
        finally:
            logits.unpersist()
        return replace(self, ct_shift=shift)

    def diagnose(self, df: DataFrame, score: str = "raw") -> DataFrame:
        s = F.col(score).cast("double")
        rows = self.predict(df, score, "pd")
        return rows.agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("pd_extrapolated").cast("double")).alias("frac_extrapolated"),
            F.avg((s < self.x_min).cast("double")).alias("frac_below"), F.avg((s > self.x_max).cast("double")).alias("frac_above"),
            F.lit(float(self.lead + 1)).alias("lower_plateau_knots"), F.lit(float(self.n_knots - self.trail)).alias("upper_plateau_knots"),
            F.min("pd").alias("pd_min"), F.max("pd").alias("pd_max"), F.avg("pd").alias("mean_pd"),
            F.lit(self.y_min).alias("isotonic_min"), F.lit(self.y_max).alias("isotonic_max"))


def _logit_number(p: float) -> float:
    q = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(q / (1 - q))


def backbone_row(fitted: DataFrame) -> DataFrame:
    """Weighted line through the smoothed log-odds of the knots; null where it does not rise."""
    n, x = F.col("n"), F.col("x")
    p = (F.col("k") + 0.5) / (n + 1.0)
    level = sc.logit(p)
    w = F.sum(n)
    xm, lm = F.sum(n * x) / w, F.sum(n * level) / w
    sums = fitted.agg(
        F.count(F.lit(1)).alias("knots"), xm.alias("xm"), lm.alias("lm"),
        (F.sum(n * x * x) - w * xm * xm).alias("sxx"), (F.sum(n * x * level) - w * xm * lm).alias("sxl"))
    slope = F.when((F.col("knots") >= 3) & (F.col("sxx") > 0) & (F.col("sxl") > 0), F.col("sxl") / F.col("sxx"))
    return sums.select((F.col("lm") - slope * F.col("xm")).alias("intercept"), slope.alias("slope"))


def backbone(fitted: DataFrame) -> Backbone | None:
    row = backbone_row(fitted).first()
    return None if row["slope"] is None else Backbone(row["intercept"], row["slope"])


def terminal_runs(fitted: DataFrame) -> DataFrame:
    """Sizes and ends of the flat first and last stretch. The fit never falls, so a stretch
    is simply every knot within the tolerance of the end value."""
    ends = fitted.agg(F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                      F.count(F.lit(1)).alias("n_knots"))
    e = ends.first()
    if not e["n_knots"]:
        raise ValueError("no labelled score to calibrate on")
    head = F.col("y") <= F.lit(e["y_min"] + TOL)
    last = F.col("y") >= F.lit(e["y_max"] - TOL)
    return fitted.agg(
        F.lit(e["n_knots"]).cast("bigint").alias("n_knots"),
        F.lit(e["x_min"]).alias("x_min"), F.lit(e["x_max"]).alias("x_max"), F.lit(e["y_min"]).alias("y_min"), F.lit(e["y_max"]).alias("y_max"),
        (F.count_if(head) - 1).alias("lead"), (F.lit(e["n_knots"]) - F.count_if(last)).cast("bigint").alias("trail"),
        F.max(F.when(head, F.col("x"))).alias("lead_x"), F.min(F.when(last, F.col("x"))).alias("trail_x"))


def plateau_z(fitted: DataFrame, low_x: float, high_x: float, n_knots: int) -> float:
    """How far a flat stretch sits above the trend of the other knots, in sd."""
    inside = F.col("x").between(F.lit(low_x), F.lit(high_x))
    if low_x >= high_x or n_knots < 6:
        return 0.0
    others = fitted.filter(~inside)
    line = backbone(others)
    if line is None:
        return 0.0
    p = sc.sigmoid(F.lit(line.intercept) + F.lit(line.slope) * F.col("x"))
    row = fitted.filter(inside).agg(
        F.sum(F.col("n") * p).alias("e"), F.sum("k").alias("o"), F.sum(F.col("n") * p * (1 - p)).alias("v")).first()
    return 0.0 if not row["v"] or row["v"] <= 0 else (row["o"] - row["e"]) / math.sqrt(row["v"])


def fit(df: DataFrame, score: str = "raw", target: str = "target", bins: int | None = None, **options) -> Calibrator:
    """The isotonic fit on all distinct scores, however many; with ``bins`` on quantile bins of the scores instead."""
    if bins is not None and bins < 2:
        raise ValueError("a binned fit needs at least 2 bins")
    points = cut_lineage(knots(df, score, target), "score-counts")
    if bins is not None:
        points = cut_lineage(pooled_knots(points, bins), "knots")
    if points.isEmpty():
        raise ValueError("no labelled score to calibrate on")
    fitted, curve = pooling.isotonic_fit(points)
    ends = terminal_runs(fitted).first()
    z = {
        "lower_z": plateau_z(fitted, ends["x_min"], ends["lead_x"], ends["n_knots"]),
        "upper_z": plateau_z(fitted, ends["trail_x"], ends["x_max"], ends["n_knots"]),
    }
    return Calibrator(
        knots=fitted, curve=curve, n_knots=ends["n_knots"], x_min=ends["x_min"], x_max=ends["x_max"], y_min=ends["y_min"],
        y_max=ends["y_max"], lead=ends["lead"], trail=ends["trail"], lead_x=ends["lead_x"], trail_x=ends["trail_x"],
        backbone=backbone(fitted), **z, **options)


# -- quality of calibrated rates -------------------------------------------------------------------


def _known(df: DataFrame, pd_col: str, target: str) -> DataFrame:
    return df.filter(F.col(pd_col).isNotNull() & F.col(target).isNotNull())


def brier(df: DataFrame, pd_col: str = "pd", target: str = "target") -> DataFrame:
    err = F.col(pd_col) - F.col(target)
    return _known(df, pd_col, target).agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("brier"))


def calibration_error(df: DataFrame, pd_col: str = "pd", target: str = "target", order: str = "id", bins: int = 20) -> DataFrame:
    """Equal-count calibration error; the first bins hold one row more where n does not divide."""
    rows = _known(df, pd_col, target).select(F.col(pd_col).alias("p"), F.col(target).cast("double").alias("y"), order)
    ranked = OrderedGroups(rows, [], ["p", order]).add(_i=Index(), _n=Total()).done()
    q = F.floor(F.col("_n") / bins)
    r = F.col("_n") % bins
    wide = r * (q + 1)
    b = F.when(F.col("_i") < wide, F.floor(F.col("_i") / (q + 1))).otherwise(r + F.floor((F.col("_i") - wide) / F.greatest(q, F.lit(1))))
    per_bin = ranked.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return per_bin.agg((F.sum(F.col("c") * F.abs(F.col("p") - F.col("y"))) / F.sum("c")).alias("ece"))


def reliability(df: DataFrame, pd_col: str = "pd", target: str = "target", bins: int = 10) -> DataFrame:
    """Count, mean rate and observed rate per equal-width bin, empty bins included."""
    p = F.col(pd_col)
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    at_least = sum(((p >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = _known(df, pd_col, target).filter((p >= 0) & (p <= 1))
    found = inside.groupBy(at_least.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pd"), F.avg(F.col(target).cast("double")).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna(0, subset=["n"])


def tail_modes(cal: Calibrator, df: DataFrame, score: str = "raw", target: str = "target", order: str = "id") -> DataFrame:
    """The three ways of pricing the tails, side by side."""
    from functools import reduce

    from duepath.operators.metrics import auc

    rows = []
    for mode in ("clamp", "loglinear", "hybrid"):
        scored = replace(cal, tail=mode).predict(df, score, "pd")
        main = scored.agg(
            F.avg(F.pow(F.col("pd") - F.col(target), F.lit(2.0))).alias("brier"), F.min("pd").alias("pd_min"), F.max("pd").alias("pd_max"),
            (100.0 * F.avg(F.col("pd_extrapolated").cast("double"))).alias("pct_extrapolated")).withColumn("mode", F.lit(mode))
        ece = calibration_error(scored, "pd", target, order).withColumn("mode", F.lit(mode))
        gini = auc(scored, [], "pd", target).select("gini", F.lit(mode).alias("mode"))
        rows.append(main.join(ece, "mode").join(gini, "mode"))
    return reduce(lambda a, b: a.unionByName(b), rows)


# -- blocks ------------------------------------------------------------------------------------------


def blocks(fitted: DataFrame, pd_floor: float | None = None, tol: float = 1e-15) -> DataFrame:
    """Runs of equal fitted rate: (block, knots, n, k, pd, x_lo, x_hi), floor applied first."""
    y = F.col("y") if pd_floor is None else F.greatest(F.col("y"), F.lit(pd_floor))
    ordered = OrderedGroups(fitted.select("x", "n", "k", y.alias("y")), [], ["x"])
    ordered.add(before=Lag("y"))
    ordered.df = ordered.df.withColumn("step", F.coalesce((F.col("y") - F.col("before") > tol).cast("int"), F.lit(0)))
    runs = ordered.add(block=RunningSum("step")).done()
    return runs.groupBy(F.col("block").cast("int").alias("block")).agg(
        F.count(F.lit(1)).alias("knots"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.min_by("y", "x").alias("pd"),
        F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))


def floor_policy(table: DataFrame, min_defaults: float = 1) -> DataFrame:
    """Rate of the lowest block with enough defaults, its ceiling score, and what it rests on."""
    floor = table.filter(F.col("k") >= min_defaults).agg(F.min("pd")).first()[0]
    at = table.filter(F.col("pd") <= F.lit(floor).cast("double") + TOL)
    return at.agg(F.lit(floor).cast("double").alias("pd_floor"), F.sum("n").alias("pinned_n"), F.sum("k").alias("pinned_k")).withColumn(
        "ceiling_score", sc.pd_to_score(F.col("pd_floor")))


def floor_sensitivity(fitted: DataFrame, strengths=(20, 50, 100, 200, 500), floor: float = 0.0075) -> DataFrame:
    """What the clean bottom of the curve supports under priors of several strengths."""
    row = fitted.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min(F.when(F.col("k") > 0, F.col("x"))).alias("x1")).first()
    base = row["k"] / row["n"]
    clean = F.sum("n") if row["x1"] is None else F.coalesce(F.sum(F.when(F.col("x") < F.lit(row["x1"]), F.col("n"))), F.lit(0.0))
    head = fitted.agg(clean.alias("n0"))
    grid = head.select("n0", F.explode(F.array(*[F.lit(float(m)) for m in strengths])).alias("m"))
    mean = sc.posterior_mean(F.col("n0"), F.lit(0.0), F.lit(base), F.col("m"))
    out = grid.select(
        "m", "n0", F.lit(base).alias("base_rate"), mean.alias("post_mean"), sc.pd_to_score(mean).alias("post_score"),
        sc.rule_of_three(F.col("n0")).alias("rule_of_three"), F.lit(3.0 / floor).alias("obs_needed"))
    return out.withColumn("upper95", beta_quantile(F.col("base_rate") * F.col("m"), F.col("n0") + (1 - F.col("base_rate")) * F.col("m"), F.lit(0.95)))


def block_intervals(table: DataFrame) -> DataFrame:
    """Binomial interval of each block on the score scale, capped at the policy ceiling."""
    ceiling = sc.pd_to_score(F.lit(table.agg(F.min("pd")).first()[0]))
    pd_lo, pd_hi = sc.wilson(F.col("k"), F.col("n"))
    rows = table.withColumns({"pd_lo": pd_lo, "pd_hi": pd_hi, "ceiling": ceiling})
    raw_hi = sc.pd_to_score(F.col("pd_lo"))
    none = F.col("pd_lo") <= 0
    hi = F.when(none, F.col("ceiling")).otherwise(F.least(raw_hi, F.col("ceiling")))
    lo = F.least(sc.pd_to_score(sc.clip(F.col("pd_hi"), 1e-9, 0.5)), F.col("ceiling"))
    point = F.least(sc.pd_to_score(F.col("pd")), F.col("ceiling"))
    rows = rows.withColumns({"_hi": hi, "_lo": lo, "_pt": point, "upper_is_policy": none | (raw_hi > F.col("ceiling") + 1e-9)})
    return rows.select(
        "block", "knots", "n", "k", "pd", "pd_lo", "pd_hi", F.bround("_pt", 1).alias("score"), F.bround("_lo", 1).alias("score_lo"),
        F.bround("_hi", 1).alias("score_hi"), F.bround(F.col("_hi") - F.col("_lo"), 1).alias("width"), sc.band(F.col("_pt")).alias("band"),
        sc.band_range(F.col("_lo"), F.col("_hi")).alias("band_range"), "upper_is_policy")


def row_intervals(df: DataFrame, table: DataFrame, pd_col: str = "pd") -> DataFrame:
    """Rows with the interval of the block their rate is nearest to: score, its bounds, width and the range of bands."""
    sides = block_intervals(table).select("block", F.col("score").alias("block_score"), "score_lo", "score_hi", "width", "band_range", "upper_is_policy")
    return block_for_pd(df, table, pd_col).join(sides, "block", "left")


def block_for_pd(df: DataFrame, table: DataFrame, pd_col: str = "pd") -> DataFrame:
    """Each row with the block whose rate is nearest (the lower one if two are equally near)."""
    rates = table.groupBy(F.col("pd").alias("x")).agg(F.min("block").alias("block"))
    p = F.col(pd_col).cast("double")
    rows = asof.look_up(df, rates, p, ["block"])
    lower = F.col("above_x").isNull() | (p - F.col("below_x") <= F.col("above_x") - p)
    return _with_block(rows, F.when(lower, F.col("below_block")).otherwise(F.col("above_block")), ["x", "block"])


def block_for_score(df: DataFrame, table: DataFrame, score: str = "raw") -> DataFrame:
    """Each row with the block that contains its raw score, else the one with the nearest edge."""
    edges = table.select(F.col("x_lo").alias("x"), "x_hi", "block")
    v = F.col(score).cast("double")
    rows = asof.look_up(df, edges, v + TOL, ["x_hi", "block"])

    def distance(side: str) -> Column:
        return F.least(F.abs(F.col(f"{side}_x") - v), F.abs(F.col(f"{side}_x_hi") - v))

    inside = v <= F.col("below_x_hi") + TOL
    lower = F.col("above_x").isNull() | inside | (distance("below") <= distance("above"))
    return _with_block(rows, F.when(F.col("below_x").isNotNull() & lower, F.col("below_block")).otherwise(F.col("above_block")), ["x", "x_hi", "block"])


def _with_block(rows: DataFrame, block: Column, looked_up: list[str]) -> DataFrame:
    return rows.withColumn("block", block.cast("int")).drop(*[f"{side}_{c}" for side in ("below", "above") for c in looked_up])


# -- local evidence ------------------------------------------------------------------------------------


def pooled_evidence(fitted: DataFrame, min_obs: float = 200.0, size: int = asof.RANGE) -> DataFrame:
    """For every knot: counts of the knot and of its neighbours, taken in turn from the left
    and the right until ``min_obs`` is reached. Every knot holds at least one observation, so
    ``min_obs`` neighbours on each side are always enough: a range of ``size`` knots also gets
    so many of the ones before and after it."""
    reach = int(math.ceil(min_obs))
    placed = asof.numbered(fitted.select("x", "n", "k"), ["x"], "knot", size)
    knot = F.col("knot")
    near = F.sequence(F.floor((knot - reach) / size).cast("bigint"), F.floor((knot + reach) / size).cast("bigint"))

    def widen(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("knot")
        n, k, own = (table[c].to_numpy() for c in ("n", "k", "knot"))
        cn, ck = np.concatenate([[0.0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(k)])
        i = np.flatnonzero(own // size == key[0])
        left, right, total = i.copy(), i.copy(), n[i]
        for _ in range(reach):
            open_left = (total < min_obs) & (left > 0)
            left = left - open_left
            total = cn[right + 1] - cn[left]
            open_right = (total < min_obs) & (right < len(n) - 1)
            right = right + open_right
            total = cn[right + 1] - cn[left]
            if not (open_left.any() or open_right.any()):
                break
        return pd.DataFrame({"knot": own[i], "x": table["x"].to_numpy()[i], "n_local": total, "k_local": ck[right + 1] - ck[left], "knots_used": (right - left + 1).astype("int32")})

    ranges = placed.withColumn("_range", F.explode(near)).where("_range >= 0")
    return ranges.groupBy("_range").applyInPandas(widen, "knot bigint, x double, n_local double, k_local double, knots_used int")


def knot_of(df: DataFrame, fitted: DataFrame, score: str = "raw") -> DataFrame:
    """Each row with the first knot at or above its raw score (the last one beyond the end)."""
    placed = asof.numbered(fitted.select("x"), ["x"], "knot")
    rows = asof.look_up(df, placed, F.col(score), ["knot"])
    knot = F.coalesce("above_knot", "below_knot").cast("bigint")
    return rows.withColumn("knot", knot).drop("below_x", "below_knot", "above_x", "above_knot")


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Log of the gamma function for positive numbers: Stirling's series, after a shift to at least 10."""
    z = np.asarray(z, float)
    steps = np.where(z < 10, np.ceil(10 - z), 0)
    shift = np.zeros_like(z)
    for j in range(10):
        shift += np.where(j < steps, np.log(np.where(j < steps, z + j, 1.0)), 0.0)
    big = z + steps
    inverse = 1.0 / (big * big)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / big
    return (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + series - shift


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of whole arrays, by its continued fraction on the side where it converges fast."""
    a, b, x = (np.array(v, float).ravel() for v in np.broadcast_arrays(a, b, x))
    inner = (x > 0) & (x < 1)
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, t = np.where(flip, b, a), np.where(flip, a, b), np.where(inner, np.where(flip, 1.0 - x, x), 0.5)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
    part = front / _fraction(p, q, t)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1.0 - part, part)))


def _fraction(p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """1 + t1/(1 + t2/(1 + ...)) of the incomplete beta function; converged elements leave the arrays now and then."""
    out, todo = np.ones_like(t), np.arange(len(t))
    # convergents A/B, scaled to B = 1; the ones before them scaled alike
    value, above, below = np.ones_like(t), np.ones_like(t), np.zeros_like(t)
    for j in range(1, 20_000):
        m = j // 2
        if j % 2:
            term = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1.0))
        else:
            term = m * (q - m) * t / ((p + 2 * m - 1.0) * (p + 2 * m))
        bottom = 1.0 + term * below
        before, value = value, (value + term * above) / bottom
        above, below = before / bottom, 1.0 / bottom
        if j % 8 == 0:
            left = np.abs(value - before) > 1e-15 * np.abs(value)
            out[todo] = value
            if not left.any():
                break
            p, q, t, value, above, below, todo = (v[left] for v in (p, q, t, value, above, below, todo))
    return out


def beta_ppf(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantiles of whole arrays: Newton steps on the distribution function, kept inside a shrinking bracket.

    Exact to about 1e-15 of the unit interval."""
    a, b, q = (np.array(v, float).ravel() for v in np.broadcast_arrays(a, b, q))
    out, todo = a / (a + b), np.arange(len(q))
    low, high, x = np.zeros_like(q), np.ones_like(q), out.copy()
    constant = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    while len(todo):
        off = beta_cdf(a, b, x) - q
        low, high = np.where(off < 0, x, low), np.where(off < 0, high, x)
        with np.errstate(all="ignore"):
            step = x - off / np.exp(constant + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        fresh = np.where(np.isfinite(step) & (step > low) & (step < high), step, 0.5 * (low + high))
        left = (np.abs(fresh - x) > 1e-14 * x) & (high - low > 1e-15)
        out[todo] = fresh
        a, b, q, low, high, constant, x, todo = (v[left] for v in (a, b, q, low, high, constant, fresh, todo))
    return out


@F.pandas_udf(T.DoubleType())
def beta_quantile(a: pd.Series, b: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series(beta_ppf(a.to_numpy(float), b.to_numpy(float), q.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def beta_share(a: pd.Series, b: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    a, b = a.to_numpy(float), b.to_numpy(float)
    return pd.Series(np.clip(beta_cdf(a, b, hi.to_numpy(float)) - beta_cdf(a, b, lo.to_numpy(float)), 0.0, 1.0))


def band_bounds(band: Column) -> tuple[Column, Column]:
    """(lowest, highest) default rate of a band."""
    cuts = [c for c, _ in sc.BANDS]
    names = [b for _, b in sc.BANDS] + [sc.LOWEST_BAND]
    high = F.when(band == names[-1], 1.0)
    low = F.when(band == names[0], 0.0)
    for i, name in enumerate(names[:-1]):
        high = high.when(band == name, sc.score_to_pd(F.lit(cuts[i])))
    for i, name in enumerate(names[1:]):
        low = low.when(band == name, sc.score_to_pd(F.lit(cuts[i])))
    return low, high


def posterior(df: DataFrame, base_rate: float, strength: float = 100.0) -> DataFrame:
    """Beta posterior of distinct (n_local, k_local) pairs: mean and 5/95 % quantiles."""
    base = min(max(base_rate, 1e-6), 1.0 - 1e-6)
    pairs = df.select("n_local", "k_local").distinct()
    a = F.greatest(F.col("k_local") + strength * base, F.lit(1e-9))
    b = F.greatest(F.col("n_local") - F.col("k_local") + strength * (1.0 - base), F.lit(1e-9))
    return pairs.withColumns({"alpha": a, "beta": b}).withColumns({
        "post_mean": F.col("alpha") / (F.col("alpha") + F.col("beta")),
        "lower05": beta_quantile("alpha", "beta", F.lit(0.05)),
        "upper95": beta_quantile("alpha", "beta", F.lit(0.95)),
    })


def evidence(df: DataFrame, cal: Calibrator, score: str = "raw", band: str = "band", strength: float = 100.0, min_obs: float = 200.0) -> DataFrame:
    """Rows with local evidence, its posterior, and how sure the band is. The posterior is
    worked out per knot and band, then joined to the rows on the knot number."""
    totals = cal.knots.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = totals["k"] / totals["n"]
    local = pooled_evidence(cal.knots, min_obs)
    per_knot = local.drop("x").join(posterior(local, base, strength), ["n_local", "k_local"])
    bands = F.array(*[F.lit(b) for b in [n for _, n in sc.BANDS] + [sc.LOWEST_BAND]])
    per_band = per_knot.withColumn("_band", F.explode(bands))
    lo, hi = band_bounds(F.col("_band"))
    table = per_band.withColumn("confidence", beta_share("alpha", "beta", lo, hi))
    rows = knot_of(df, cal.knots, score)
    joined = rows.join(table.withColumnRenamed("knot", "_knot"), (F.col("knot") == F.col("_knot")) & (F.col(band) == F.col("_band")), "left")
    return joined.drop("_knot", "_band", "knot").withColumns({
        "score_upper": sc.pd_to_score(F.col("lower05")), "score_lower": sc.pd_to_score(F.col("upper95"))})
