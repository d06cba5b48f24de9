"""Default models on Spark ML, their selection, and reason codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from duepath.functions import score as sc
from duepath.operators import flags
from duepath.operators import metrics
from duepath.operators.asof import numbered, parts_for
from duepath.operators.ordered import Lag, OrderedGroups, RunningSum
from duepath.operators.permute import draws, moved, permuted
from duepath.operators.ranking import two_way_split
from duepath.session import cut_lineage


# Numbers that a task of a permutation holds at once.
CELLS = 2_000_000


def top_reasons(contributions: Column, k: int = 3, increasing: bool = True) -> Column:
    """The k largest pushes in one direction from an array of (contribution, feature)."""
    if increasing:
        kept = F.sort_array(F.filter(contributions, lambda x: x.contribution > 0), asc=False)
    else:
        kept = F.sort_array(F.filter(contributions, lambda x: x.contribution < 0), asc=True)
    return F.slice(kept, 1, k)


def logit_blend(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Mean of log-odds, mapped back; needs no population to rank against."""
    w = list(weights) if weights is not None else [1.0] * len(columns)
    total = sum(w)
    z = sum((F.lit(wi / total) * sc.logit(F.col(c)) for c, wi in zip(columns, w)), F.lit(0.0))
    return sc.sigmoid(z)


class Prepared:
    """Median fill and scaling learned on the training rows."""

    def __init__(self, train: DataFrame, columns: Sequence[str], scale: bool = True):
        self.columns = list(columns)
        self.fill = flags.medians(train, self.columns)
        self.scale = scale
        found = flags.spreads(flags.impute(train, self.fill), self.columns) if scale else {}
        self.varied = [c for c, (_, sd) in found.items() if flags.varies(sd)]
        self.stats = {c: (m, sd if c in self.varied else 1.0) for c, (m, sd) in found.items()}

    def apply(self, df: DataFrame) -> DataFrame:
        out = flags.impute(df, self.fill)
        return flags.standardise(out, self.stats, self.columns) if self.scale else out


def _probability(df: DataFrame, alias: str) -> DataFrame:
    return df.withColumn(alias, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


class LinearModel:
    """L2 logistic regression on filled and scaled columns; the intercept is not penalised."""

    def __init__(self, train: DataFrame, columns: Sequence[str], target: str = "target", l2: float = 1e-2, max_iter: int = 100):
        self.prep = Prepared(train, columns)
        self.columns = list(columns)
        lr = LogisticRegression(labelCol=target, regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9)
        # Spark divides by the sd of every input, and what rounding leaves of a flat column's stops the search at once.
        used = self.prep.varied or self.columns
        stages = [VectorAssembler(inputCols=used, outputCol="features"), lr]
        self.model: PipelineModel = Pipeline(stages=stages).fit(self.prep.apply(train))
        fitted = self.model.stages[-1]
        self.weights = dict.fromkeys(self.columns, 0.0) | dict(zip(used, [float(v) for v in fitted.coefficients]))
        self.intercept = float(fitted.intercept)

    def predict(self, df: DataFrame, alias: str = "raw") -> DataFrame:
        scored = _probability(self.model.transform(self.prep.apply(df)), alias)
        return scored

    def log_odds(self) -> Column:
        """The log-odds of a row that ``prep`` has filled and scaled."""
        return sum((F.lit(w) * F.col(c) for c, w in self.weights.items() if w), F.lit(self.intercept))

    def contributions(self, df: DataFrame) -> DataFrame:
        """Pushes on the log-odds of each row against the average applicant."""
        filled = self.prep.apply(df)
        return filled.withColumn("contributions", F.array(*[
            F.struct((F.lit(w) * F.col(c)).alias("contribution"), F.lit(c).alias("feature")) for c, w in self.weights.items()]))


class BoostedModel:
    """Gradient-boosted trees with class weights and early stopping on marked rows. Spark ML
    has no monotone constraints; ``monotone_audit`` reports where the model goes against one."""

    def __init__(self, train: DataFrame, columns: Sequence[str], target: str = "target", validation: str | None = None,
                 seed: int = 42, prep: Prepared | None = None, **params):
        self.prep = prep or Prepared(train, columns, scale=False)
        self.columns = list(columns)
        counts = train.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")).first()
        weight = counts["n"] / max(1, counts["p"])
        rows = self.prep.apply(train).withColumn("_weight", F.when(F.col(target) == 1, weight).otherwise(1.0))
        settings = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, **params}
        gbt = GBTClassifier(labelCol=target, weightCol="_weight", seed=seed, **settings)
        if validation:
            gbt = gbt.setValidationIndicatorCol(validation)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.columns, outputCol="features"), gbt]).fit(rows)
        self.importance = dict(zip(self.columns, [float(v) for v in self.model.stages[-1].featureImportances.toArray()]))

    def predict(self, df: DataFrame, alias: str = "raw") -> DataFrame:
        return _probability(self.model.transform(self.prep.apply(df)), alias)


def gini_on(df: DataFrame, score: str = "raw", target: str = "target") -> float:
    return metrics.auc(df, [], score, target).first()["gini"]


def monotone_audit(scored: DataFrame, feature: str, direction: int, pred: str = "raw", bins: int = 10) -> DataFrame:
    """Mean prediction per quantile bin of a feature, and whether the steps keep the sign."""
    known = scored.filter(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias("x"), F.col(pred).alias("p"))
    values = known.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("sp"))
    cum = OrderedGroups(values, [], ["x"]).add(_cum=RunningSum("c")).done()
    total = known.count()
    b = F.least(F.floor((F.col("_cum") - F.col("c")) * bins / F.lit(max(1, total))), F.lit(bins - 1)).cast("int")
    table = cum.groupBy(b.alias("bin")).agg(F.sum("c").alias("n"), (F.sum("sp") / F.sum("c")).alias("mean_pred"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    steps = OrderedGroups(table, [], ["bin"]).add(_prev=Lag("mean_pred")).done()
    moved = F.col("mean_pred") - F.col("_prev")
    against = F.lit(False) if direction == 0 else F.coalesce(moved * direction < -1e-12, F.lit(False))
    return steps.select(F.lit(feature).alias("feature"), "bin", "n", "x_lo", "x_hi", "mean_pred", against.alias("against"))


def _sums(rows: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``part`` of the rows' (x with a leading 1, target), ``size`` numbers, summed over all rows; a task sends one sum."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in it:
            x, y = _matrix(batch)
            total += part(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(batches, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    return np.concatenate([np.ones((n, 1)), x], axis=1), batch.column("y").to_numpy(zero_copy_only=False)


class LeaveOneOut:
    """The L2 logistic regression on all columns and on all but one, for every column, fitted together.

    The full model takes Newton steps on its normal matrix, which is added up over the rows. A model without a column
    starts from that fit, corrected by the matrix's inverse; each further pass adds up the gradients of all models at once
    and solves each with the same inverse, less the row and column left out. A model whose gradient grows goes on with the
    matrix of the largest possible weights, with which it always falls. What reaches the driver is a square of the columns.
    """

    def __init__(self, train: DataFrame, columns: Sequence[str], target: str = "target", l2: float = 1e-2, tol: float = 1e-9, passes: int = 200):
        self.prep = Prepared(train, columns)
        self.used = self.prep.varied or list(columns)
        self.target = target
        rows = cut_lineage(self._rows(train), "scaled")
        p = len(self.used) + 1
        ridge = np.diag([0.0] + [l2] * (p - 1))
        n = rows.count()

        def newton(beta: np.ndarray):
            def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                if not len(y):
                    return np.zeros(2 * p * p + p)
                q = 1.0 / (1.0 + np.exp(-x @ beta))
                return np.concatenate([((x * (q * (1 - q))[:, None]).T @ x).ravel(), (x.T @ x).ravel() / 4, x.T @ (q - y)])

            return part

        beta = np.zeros(p)
        for _ in range(50):
            sums = _sums(rows, 2 * p * p + p, newton(beta)) / n
            curve, most = sums[: p * p].reshape(p, p) + ridge, sums[p * p : 2 * p * p].reshape(p, p) + ridge
            step = np.linalg.solve(curve, sums[2 * p * p :] + ridge @ beta)
            if np.abs(step).max() < tol:
                break
            beta = beta - step
        self.beta = beta
        inverse = [np.linalg.inv(curve), np.linalg.inv(most)]
        out = np.arange(1, p)
        both = beta[:, None] - inverse[0][:, 1:] * (beta[1:] / np.diag(inverse[0])[1:])
        bounded, before = np.zeros(p - 1, bool), np.full(p - 1, np.inf)
        for _ in range(passes):
            both[out, out - 1] = 0.0
            tried = both

            def gradients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return (x.T @ (1.0 / (1.0 + np.exp(-x @ tried)) - y[:, None])).ravel() if len(y) else np.zeros(p * (p - 1))

            slope = _sums(rows, p * (p - 1), gradients).reshape(p, p - 1) / n + ridge @ both
            slope[out, out - 1] = 0.0
            size = np.abs(slope).max(0)
            bounded |= size > before
            before = size
            step = np.zeros_like(both)
            for kind in (0, 1):
                m = np.flatnonzero(bounded == bool(kind))
                u = inverse[kind] @ slope[:, m]
                step[:, m] = u - inverse[kind][:, m + 1] * (u[m + 1, np.arange(len(m))] / np.diag(inverse[kind])[m + 1])
            if np.abs(step).max(initial=0.0) < tol * 10:
                break
            both = both - step
        self.without = both

    def _rows(self, df: DataFrame) -> DataFrame:
        scaled = self.prep.apply(df)
        return scaled.select(F.array(*[F.col(c).cast("double") for c in self.used]).alias("x"), F.col(self.target).cast("double").alias("y")).where(F.col("y").isNotNull())

    def ginis(self, test: DataFrame) -> dict[str | None, float]:
        """Gini on ``test`` of the full model (None) and of the one without each column."""
        weights = np.concatenate([self.beta[:, None], self.without], axis=1)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for at in range(0, batch.num_rows, 4096):
                    x, y = _matrix(batch.slice(at, 4096))
                    z = x @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(z.shape[1], dtype=np.int32), len(y))), pa.array(z.ravel()), pa.array(np.repeat(y, z.shape[1]))], names=["m", "raw", "target"])

        scored = self._rows(test).mapInArrow(batches, "m int, raw double, target double")
        names = [None, *self.used]
        return {names[r["m"]]: r["gini"] for r in metrics.auc(scored, ["m"]).collect()}


def leave_one_out(train: DataFrame, test: DataFrame, columns: Sequence[str], l2: float = 1e-2) -> list[tuple[str, float]]:
    """Gini lost when a column is left out of the linear model; a column that doesn't vary loses nothing."""
    ginis = LeaveOneOut(train, columns, l2=l2).ginis(test)
    base = ginis[None]
    return sorted(((c, base - ginis.get(c, base)) for c in columns), key=lambda t: -t[1])


def permutation_key(seed: int, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts])


def shuffled(df: DataFrame, column: str, seed: int, key: str = "case_id") -> DataFrame:
    """The frame with one column permuted: every value moves to the row that a keyed bijection of the rows' numbers names."""
    rows = numbered(df, [key], "_at")
    to = permuted(F.col("_at"), rows.count(), permutation_key(seed, F.lit(column)))
    return rows.drop(column).join(rows.select(to.alias("_at"), column), "_at").drop("_at")


def permuted_columns(rows: DataFrame, n: int, columns: Sequence[str], repeats: int, seed: int, cells: int = CELLS) -> DataFrame:
    """_at, repeat and ``got``: for each numbered row what each of ``columns`` has after its own permutation, as an array."""
    columns, repeats = list(columns), max(1, repeats)
    keys = ["/".join(map(str, (seed, r, j))) for r in range(repeats) for j in range(len(columns))]
    return _moved_cells(rows, n, columns, keys, len(columns), cells)


def _moved_cells(rows: DataFrame, n: int, columns: Sequence[str], keys: Sequence[str], length: int, cells: int = CELLS) -> DataFrame:
    """The columns, over and over, each moved by the permutation of the next of ``keys``; _at, repeat and ``got``, arrays of ``length``.

    All of them move in one shuffle: what a few rows send to a block of neighbouring rows is one record of arrays, and a
    block holds at most about ``cells`` numbers.
    """
    width, copies = len(keys), len(keys) // len(columns)
    lists = width // length
    block = max(1, cells // width)

    def scatter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: list[list[np.ndarray]] = []
        for batch in it:
            drawn = drawn or [draws(n, k) for k in keys]
            few = max(1, cells // 4 // width)
            for start in range(0, batch.num_rows, few):
                part = batch.slice(start, few)
                at = part.column("_at").to_numpy()
                flat = part.column("x").flatten()
                x, unknown = (np.asarray(v).reshape(len(at), -1) for v in (flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)))
                to = np.stack([moved(at, n, d) for d in drawn], 1)
                home = (to // block).ravel()
                order = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
                # the place inside the block, row by row; a null is marked by a negative one
                place = ((to % block) * width + np.arange(width)).ravel()
                place = np.where(np.tile(unknown, copies).ravel(), -1 - place, place)[order].astype(np.int64)
                value = np.tile(x, copies).ravel()[order].astype(np.float64)
                ends = [*cuts[1:], len(order)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(home[order][cuts], pa.int64()), pa.array([place[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
                    pa.array([value[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())], names=["block", "place", "value"])

    def gather(table: pa.Table) -> pa.Table:
        first = table.column("block")[0].as_py() * block
        here = min(block, n - first)
        place = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("place").to_pylist()])
        value = np.concatenate([np.frombuffer(b, np.float64) for b in table.column("value").to_pylist()])
        unknown = place < 0
        place = np.where(unknown, -1 - place, place)
        got, null = np.zeros(here * width), np.ones(here * width, bool)
        got[place], null[place] = value, unknown
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, here * width + 1, length), pa.int32()), pa.array(got, mask=null))
        return pa.table({"_at": pa.array(np.repeat(first + np.arange(here), lists)), "repeat": pa.array(np.tile(np.arange(lists, dtype=np.int32), here)), "got": arrays})

    values = rows.select("_at", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    # a range of numbered rows is too many cells for one task
    dealt = values.repartition(parts_for(n * width, 2 * cells), "_at")
    sent = dealt.mapInArrow(scatter, "block bigint, place binary, value binary")
    return sent.groupBy("block").applyInArrow(gather, "_at bigint, repeat int, got array<double>")


def permutation_importance(model, frame: DataFrame, columns: Sequence[str], repeats: int = 3, seed: int = 42, key: str = "case_id",
                           target: str = "target") -> list[tuple[str, float]]:
    """Mean Gini lost when a column is permuted, for every column, from one scoring of all of them.

    A linear model's log-odds move by its weight times the change of the column; other models score a copy of the rows
    for each column.
    """
    columns, repeats = list(columns), max(1, repeats)
    linear = isinstance(model, LinearModel)
    scored = model.prep.apply(frame).withColumn("_z", model.log_odds()) if linear else frame
    rows = numbered(scored, [key], "_at")
    base = gini_on(rows, "_z", target) if linear else gini_on(model.predict(rows), "raw", target)
    got = permuted_columns(rows, rows.count(), columns, repeats, seed)
    own = F.array(*[F.col(c).cast("double") for c in columns])
    both = rows.withColumn("_own", own).join(got, "_at")
    if linear:
        weights = np.array([model.weights.get(c, 0.0) for c in columns])

        def changes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    y, repeat, z = (part.column(c) for c in ("y", "repeat", "_z"))
                    got, own = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) for c in ("got", "_own"))
                    raw = z.to_numpy(zero_copy_only=False)[:, None] + weights * (got - own)
                    row = np.repeat(np.arange(len(y)), len(columns))
                    yield pa.RecordBatch.from_arrays([y.take(pa.array(row)), repeat.take(pa.array(row)), pa.array(np.tile(np.arange(len(columns), dtype=np.int32), len(y))), pa.array(raw.ravel())], names=["y", "repeat", "j", "raw"])

        each = both.select(F.col(target).cast("double").alias("y"), "repeat", "_z", "_own", "got").mapInArrow(changes, "y double, repeat int, j int, raw double")
        each = each.withColumnRenamed("y", target)
    else:
        kinds = dict(frame.dtypes)
        copies = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("j"))
        swapped = {c: F.when(F.col("j") == i, F.get("got", F.lit(i)).cast(kinds[c])).otherwise(F.col(c)) for i, c in enumerate(columns)}
        each = model.predict(copies.withColumns(swapped).drop("got", "_own"))
    drops = metrics.auc(each, ["j", "repeat"], "raw", target).groupBy("j").agg((F.lit(base) - F.avg("gini")).alias("drop")).collect()
    found = {columns[r["j"]]: r["drop"] for r in drops}
    return [(c, found.get(c, 0.0)) for c in columns]


def _at_once(df: DataFrame, fit: Callable, items: Sequence, most: int = 4) -> list:
    """``fit`` of each item, a few at a time: a boosted model is many short jobs, one after the other."""
    with ThreadPool(most) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(fit), items)


def null_importance(train: DataFrame, columns: Sequence[str], runs: int = 5, seed: int = 42, percentile: float = 0.75, **params) -> list[tuple[str, float, float, bool]]:
    """(feature, importance, its value at a percentile of shuffled-target runs, kept).

    The targets of all runs move in one shuffle and are written beside the filled columns, which all fits read.
    """
    columns = list(columns)
    prep = Prepared(train, columns, scale=False)
    rows = numbered(train.select("case_id", *columns, "target"), ["case_id"], "_at")
    n = rows.count()
    drawn = _moved_cells(rows, n, ["target"], ["/".join(map(str, (seed + r, "target"))) for r in range(runs)], runs).select("_at", "got") if runs else rows.select("_at", F.array().cast("array<double>").alias("got"))
    filled = prep.apply(rows).join(drawn, "_at").select(*columns, "target", "got").repartition(parts_for(n * len(columns), CELLS))
    filled = cut_lineage(filled, "null-targets")

    def fitted(run: int) -> dict[str, float]:
        given = filled if run < 0 else filled.withColumn("target", F.get("got", F.lit(run)).cast(filled.schema["target"].dataType))
        return BoostedModel(given, columns, seed=seed, prep=prep, **params).importance

    real, *nulls = _at_once(filled, fitted, range(-1, runs))
    out = []
    for c in columns:
        ranked = sorted(n[c] for n in nulls)
        place = percentile * (len(ranked) - 1)
        lo = int(place)
        hi = min(lo + 1, len(ranked) - 1)
        bar = ranked[lo] + (ranked[hi] - ranked[lo]) * (place - lo)
        out.append((c, real[c], bar, real[c] > bar))
    return out


def select_features(train: DataFrame, columns: Sequence[str], forced: Sequence[str] = (), min_gini: float = 0.0, corr_max: float = 0.90,
                    null_runs: int = 3, order: str = "case_id", **params) -> list[tuple[str, str]]:
    """(feature, step at which it left or 'kept') through the funnel: single-column Gini, null
    importance, correlated clusters, permutation on a later slice."""
    fate = {}
    gini = {r["feature"]: r["abs_gini"] for r in metrics.univariate_gini(train, columns).collect()}
    alive = [c for c in columns if c in forced or gini.get(c, 0.0) > min_gini]
    fate |= {c: "univariate" for c in columns if c not in alive}
    if alive:
        kept = {c for c, _, _, ok in null_importance(train, alive, null_runs, **params) if ok} | set(forced)
        fate |= {c: "null importance" for c in alive if c not in kept}
        alive = [c for c in alive if c in kept]
    if len(alive) > 1:
        strength = train.sparkSession.createDataFrame([(c, float(gini.get(c, 0.0))) for c in alive], "feature string, abs_gini double")
        single = set(metrics.keep_uncorrelated(metrics.spearman(train, order, alive), strength, corr_max)) | set(forced)
        fate |= {c: "correlated" for c in alive if c not in single}
        alive = [c for c in alive if c in single]
    if alive:
        parts = two_way_split(train, "wk", order)
        model = LinearModel(parts.filter(F.col("slice") == "fit"), alive)
        lost = dict(permutation_importance(model, parts.filter(F.col("slice") == "holdout"), alive, 1))
        fate |= {c: "permutation" for c in alive if lost[c] <= 0 and c not in forced}
    return [(c, fate.get(c, "kept")) for c in columns]


def random_search(train: DataFrame, columns: Sequence[str], grid: Sequence[dict], order: str = "case_id") -> list[tuple[int, float]]:
    """(position in the grid, stability on the later slice) of every setting, best first."""
    columns = list(columns)
    parts = two_way_split(train, "wk", order)
    prep = Prepared(parts.filter(F.col("slice") == "fit"), columns, scale=False)
    filled = cut_lineage(prep.apply(parts).select(*columns, "target", "wk", "slice"), "filled")
    fit, late = filled.filter(F.col("slice") == "fit"), filled.filter(F.col("slice") == "holdout")

    def stability(params: dict) -> float:
        scored = BoostedModel(fit, columns, prep=prep, **params).predict(late)
        return metrics.gini_stability(scored).first()["stability"]

    return sorted(enumerate(_at_once(filled, stability, grid)), key=lambda t: -t[1])


def cross_representation(matrices: dict[str, DataFrame], columns: Sequence[str], pairs: Sequence[tuple[str, str]], order: str = "case_id") -> list[tuple[str, str, float]]:
    """(trained on, served on, Gini) for models moved between representations of the same cases."""
    out = []
    for a, b in pairs:
        fit = two_way_split(matrices[a], "wk", order).filter(F.col("slice") == "fit")
        late = two_way_split(matrices[b], "wk", order).filter(F.col("slice") == "holdout")
        out.append((a, b, gini_on(LinearModel(fit, columns).predict(late))))
    return out


def batch_score(df: DataFrame, model, calibrator, raw: str = "raw") -> DataFrame:
    """Raw model output, calibrated rate, score and band for every row."""
    rows = calibrator.predict(model.predict(df, raw), raw, "pd")
    points = sc.pd_to_score(F.col("pd"))
    return rows.withColumns({"score": points, "band": sc.band(points)})
