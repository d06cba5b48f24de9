"""Calibration, scorecard, uncertainty and models."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duepath.functions import score as sc
from duepath.operators import asof, calibrate, metrics, modeling, permute, pooling, ranking, uncertainty
from duepath.session import cut_lineage


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    s = rng.uniform(0, 1, 4000)
    y = (rng.uniform(0, 1, 4000) < 0.02 + 0.5 * s**2).astype(int)
    rows = [(f"{i:05d}", i % 30, round(float(v), 3), int(t)) for i, (v, t) in enumerate(zip(s, y))]
    return spark.createDataFrame(rows, "id string, wk int, raw double, target int").repartition(4)


def numpy_fit(pdf):
    g = pdf.groupby("raw").target.agg(["size", "sum"]).reset_index()
    y = uncertainty.pool_adjacent((g["sum"] / g["size"]).to_numpy(), g["size"].to_numpy())
    return g.raw.to_numpy(), y, g["size"].to_numpy(), g["sum"].to_numpy()


def test_isotonic(spark, sample):
    cal = calibrate.fit(sample)
    k = cal.knots.orderBy("x").toPandas()
    x, y, n, d = numpy_fit(sample.toPandas())
    assert np.allclose(k.y, y) and np.allclose(k.n, n)
    assert (np.diff(k.y) >= -1e-12).all()
    assert (k.n * k.y).sum() == pytest.approx(d.sum())


def test_binned_isotonic(sample):
    pdf = sample.toPandas()
    k = calibrate.binned_knots(sample, 50).orderBy("x").toPandas()
    edges = np.unique(np.quantile(pdf.raw, np.linspace(0, 1, 51)[1:-1]))
    at = np.searchsorted(edges, pdf.raw, side="right")
    want = pdf.groupby(at).raw.mean()
    assert np.allclose(k.x, want.to_numpy()) and k.n.sum() == len(pdf)


def test_prediction_modes(spark, sample):
    cal = calibrate.fit(sample.filter("raw between 0.1 and 0.9"))
    grid = spark.createDataFrame([(i / 200,) for i in range(-20, 221)], "raw double")
    for mode in ("clamp", "loglinear", "hybrid"):
        from dataclasses import replace

        p = replace(cal, tail=mode).predict(grid).orderBy("raw").toPandas()
        assert (np.diff(p.pd) >= -1e-12).all(), mode
        inside = p[~p.pd_extrapolated]
        x, y, *_ = numpy_fit(sample.filter("raw between 0.1 and 0.9").toPandas())
        floor = cal.pd_floor if mode != "clamp" else 0.0
        assert np.allclose(inside.pd, np.clip(np.interp(inside.raw, x, y), floor, 1 - floor)), mode
    assert (replace(cal, moc_logodds=0.3).predict(grid).filter("not pd_extrapolated").subtract(cal.predict(grid).filter("not pd_extrapolated"))).count() == 0


def test_central_tendency(sample):
    cal = calibrate.fit(sample).anchored_at(sample, 0.12)
    assert cal.predict(sample).agg(F.avg("pd")).first()[0] == pytest.approx(0.12, abs=1e-5)


def test_calibration_keeps_ranking_and_brier(sample):
    cal = calibrate.fit(sample)
    scored = cal.predict(sample)
    assert metrics.auc(scored, [], "pd").first()["auc"] >= metrics.auc(sample).first()["auc"] - 0.02
    raw = calibrate.brier(sample.withColumn("pd", F.col("raw"))).first()["brier"]
    assert calibrate.brier(scored).first()["brier"] <= raw


def test_scorecard(spark):
    one = spark.range(1)
    assert one.select(sc.pd_to_score(F.lit(1 / 21))).first()[0] == pytest.approx(600.0)
    assert one.select(sc.score_to_pd(F.lit(600.0))).first()[0] == pytest.approx(1 / 21)
    pushes = F.array(*[F.struct(F.lit(v).alias("contribution"), F.lit(n).alias("feature")) for v, n in ((0.1, "f1"), (-0.3, "f2"), (0.5, "f3"), (0.2, "f4"))])
    got = one.select(modeling.top_reasons(pushes, 2).feature).first()[0]
    assert got == ["f3", "f4"]
    low, high = sc.wilson(F.lit(5.0), F.lit(534.0))
    # The two ends solve (p - k/n)^2 = z^2 p (1 - p) / n.
    for p in one.select(low, high).first():
        assert (p - 5 / 534) ** 2 == pytest.approx(sc.Z95**2 * p * (1 - p) / 534)


def test_beta_functions():
    # Beta(1, n) and Beta(n, 1) have closed forms; with whole parameters the function is a binomial sum.
    n, x = (v.ravel() for v in np.meshgrid([1.0, 5.0, 200.0], [0.001, 0.3, 0.9]))
    assert np.allclose(calibrate.beta_cdf(1.0, n, x), 1 - (1 - x) ** n, atol=1e-12)
    assert np.allclose(calibrate.beta_cdf(n, 1.0, x), x**n, atol=1e-12)
    for a in (1, 2, 20, 150):
        for b in (1, 3, 60, 400):
            for at in (0.0, 0.01, 0.2, 0.5, 0.9, 1.0):
                m = a + b - 1
                want = sum(math.comb(m, j) * at**j * (1 - at) ** (m - j) for j in range(a, m + 1))
                assert calibrate.beta_cdf(a, b, at)[0] == pytest.approx(want, abs=1e-10)
    assert calibrate.beta_ppf(1.0, 10.0, 0.95)[0] == pytest.approx(1 - 0.05**0.1, abs=1e-12)
    rng = np.random.default_rng(4)
    a, b, q = 10 ** rng.uniform(-1, 5, 3000), 10 ** rng.uniform(-1, 6, 3000), rng.uniform(0.01, 0.99, 3000)
    got = calibrate.beta_ppf(a, b, q)
    assert np.abs(calibrate.beta_cdf(a, b, got) - q)[(got > 1e-6) & (got < 1 - 1e-6)].max() < 1e-8


def test_a_million_scores_are_fitted_exactly(spark):
    """Continuous scores, none equal: the fit of all of them, in ranges, is that of one sequence."""
    rows = spark.range(1_000_000).select(
        (F.col("id") / 1e6).alias("raw"), (F.col("id") % 20).cast("int").alias("wk"),
        (F.rand(3) < 0.05 + 0.4 * F.col("id") / 1e6).cast("int").alias("target"))
    points = cut_lineage(calibrate.knots(rows))
    p = points.orderBy("x").toPandas()
    want = uncertainty.pool_adjacent((p.k / p.n).to_numpy(), p.n.to_numpy())
    for size in (pooling.RANGE, 60_000):
        fitted, curve = pooling.isotonic_fit(points, size)
        got = fitted.orderBy("x").toPandas()
        assert len(got) == 1_000_000 and (got.x == p.x).all() and np.allclose(got.y, want, atol=1e-12)
        assert curve.count() < 20_000
    cal = calibrate.fit(rows)
    at = cal.predict(rows.filter("raw in (0.25, 0.5)")).orderBy("raw").toPandas().pd
    assert np.allclose(at, want[[250_000, 500_000]])
    assert calibrate.binned_knots(rows).agg(F.max("n"), F.count("x")).first()[1] <= 2000
    full = metrics.auc(rows).first()["gini"]
    ginis = [r["gini"] for r in uncertainty.block_bootstrap(rows, 4).collect() + uncertainty.row_bootstrap(rows, 4).collect()]
    assert len(ginis) == 8 and all(abs(g - full) < 0.02 for g in ginis)
    with pytest.raises(ValueError):
        calibrate.fit(rows, bins=0)


@pytest.mark.parametrize("shape", ["falling", "rising", "steps", "noise", "one", "saw"])
def test_pooling_in_many_ranges(spark, shape):
    """Violators that reach over many ranges, and sequences in which every knot is a block of its own."""
    rng = np.random.default_rng(9)
    m = 1 if shape == "one" else 700
    n = rng.integers(1, 6, m).astype(float)
    rate = {"falling": np.linspace(1, 0, m), "rising": np.linspace(0, 1, m), "steps": np.floor(np.linspace(0, 9, m)) / 9, "noise": rng.uniform(0, 1, m), "one": np.array([0.5]),
            "saw": ((np.arange(m) % 50) / 50 + np.arange(m) / 5000) / 1.2}[shape]
    k = np.round(rate * n * 64) / 64
    points = spark.createDataFrame([(float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(n, k))], "x double, n double, k double").repartition(3)
    fitted, _ = pooling.isotonic_fit(points, 20)
    assert np.allclose(fitted.orderBy("x").toPandas().y, uncertainty.pool_adjacent(k / n, n), atol=1e-12)


def test_neighbours_of_a_million_blocks(spark):
    """Nearest and containing blocks in a table no task could be sent, against a search in one array."""
    blocks = spark.range(1_000_000).select(F.col("id").cast("int").alias("block"), (F.col("id") * 3.0).alias("x_lo"), (F.col("id") * 3.0 + 1).alias("x_hi"), (F.col("id") / 1e6).alias("pd"))
    rows = spark.range(3000).select("id", (F.rand(5) * 3.2e6 - 1e5).alias("raw"), (F.rand(6) * 1.2 - 0.1).alias("pd"))
    rows = rows.unionByName(spark.createDataFrame([(9001, None, None), (9002, float("nan"), float("nan")), (9003, 2.0, 0.0), (9004, 6.0, 0.5)], "id bigint, raw double, pd double"))
    by_score = {r.id: (r.raw, r.block) for r in calibrate.block_for_score(rows, blocks).collect()}
    by_pd = {r.id: (r.pd, r.block) for r in calibrate.block_for_pd(rows, blocks).collect()}
    assert len(by_score) == len(by_pd) == 3004 and by_score[9001][1] is by_score[9002][1] is by_pd[9001][1] is by_pd[9002][1] is None
    for raw, block in (v for k, v in by_score.items() if k not in (9001, 9002)):
        near = [b for b in range(max(0, int(raw // 3) - 1), min(999_999, max(0, int(raw // 3) + 2)) + 1)] or [999_999]
        away = {b: 0 if 3 * b - 1e-12 <= raw <= 3 * b + 1 + 1e-12 else min(abs(3 * b - raw), abs(3 * b + 1 - raw)) for b in near}
        assert block == min(away, key=lambda b: (away[b], b))
    for p, block in (v for k, v in by_pd.items() if k not in (9001, 9002)):
        near = range(max(0, min(999_999, int(p * 1e6) - 1)), max(0, min(999_999, int(p * 1e6) + 2)) + 1)
        assert abs(block / 1e6 - p) == min(abs(b / 1e6 - p) for b in near)


def test_knots_around_values_in_many_ranges(spark):
    rng = np.random.default_rng(2)
    knots, values = np.unique(rng.integers(0, 5000, 60)), rng.integers(-100, 5100, 400) + 0.5 * rng.integers(0, 2, 400)
    k = spark.createDataFrame([(float(x), float(-x)) for x in knots], "x double, y double")
    got = asof.neighbours(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double"), k, ["y"], 25).collect()
    assert len(got) == len(set(values))
    for r in got:
        below, above = [v for v in knots if v <= r.x], [v for v in knots if v >= r.x]
        assert (r.below_x, r.below_y) == ((max(below), -max(below)) if below else (None, None))
        assert (r.above_x, r.above_y) == ((min(above), -min(above)) if above else (None, None))


def test_numbering_in_many_ranges(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(500)] + [(3, 3)] * 100, "a int, b int").repartition(5)
    got = asof.numbered(rows, ["a"], size=40).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(600))
    assert [r.a for r in got] == sorted((r.a for r in got), key=lambda a: (a is not None, a or 0))


def test_pooled_evidence(sample):
    cal = calibrate.fit(sample, bins=100)
    k = cal.knots.orderBy("x").toPandas()
    got = calibrate.pooled_evidence(cal.knots, 200).orderBy("x").toPandas()
    again = calibrate.pooled_evidence(cal.knots, 200, size=7).orderBy("x").toPandas()
    assert again.equals(got) and got.knot.tolist() == list(range(len(k)))
    n, d = k.n.to_numpy(), k.k.to_numpy()
    for i in range(len(k)):
        lo = hi = i
        while n[lo:hi + 1].sum() < 200 and (lo > 0 or hi < len(k) - 1):
            if lo > 0:
                lo -= 1
            if hi < len(k) - 1 and n[lo:hi + 1].sum() < 200:
                hi += 1
        assert (got.n_local[i], got.k_local[i], got.knots_used[i]) == (n[lo:hi + 1].sum(), d[lo:hi + 1].sum(), hi - lo + 1)


def test_auc_and_delong(sample):
    pdf = sample.toPandas()
    pos, neg = pdf[pdf.target == 1].raw.to_numpy(), pdf[pdf.target == 0].raw.to_numpy()
    wins = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    assert metrics.auc(sample).first()["auc"] == pytest.approx(wins.mean())
    var = wins.mean(1).var(ddof=1) / len(pos) + wins.mean(0).var(ddof=1) / len(neg)
    row = uncertainty.delong(sample).first()
    assert row["auc"] == pytest.approx(wins.mean()) and row["variance"] == pytest.approx(var)


def test_bootstrap_is_reproducible(sample):
    a = {r["replicate"]: r["gini"] for r in uncertainty.block_bootstrap(sample, 6).collect()}
    b = {r["replicate"]: r["gini"] for r in uncertainty.block_bootstrap(sample.repartition(7), 6).collect()}
    assert a.keys() == b.keys() == set(range(6))
    assert all(a[k] == pytest.approx(b[k]) for k in a) and len(set(a.values())) > 3
    rows = uncertainty.row_bootstrap(sample, 12)
    s = uncertainty.summarise(rows).first()
    assert s["n"] == 12 and abs(s["mean"] - metrics.auc(sample).first()["gini"]) < 4 * s["sd"]


def gini_of(s, n1, n0):
    order = np.argsort(s, kind="stable")
    s, n1, n0 = s[order], n1[order], n0[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(s) != 0]))
    n1, n0 = np.add.reduceat(n1, starts), np.add.reduceat(n0, starts)
    return 2 * (n1 * (np.cumsum(n0) - n0 / 2)).sum() / (n1.sum() * n0.sum()) - 1


def test_replicates_of_continuous_scores(spark):
    """100,000 distinct scores: every replicate is the Gini of the drawn rows, in one range or many."""
    rows = spark.range(100_000).select("id", F.hash("id").cast("double").alias("raw"), (F.xxhash64("id") % 23).cast("int").alias("wk"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)) == 0).cast("int").alias("target"))
    pdf = rows.toPandas()
    assert pdf.raw.nunique() > 99_000
    draws = uncertainty.week_draws(spark, rows, "wk", 5).toPandas()
    for size in (uncertainty.RANGE, 9000):
        got = {r["replicate"]: r["gini"] for r in uncertainty.block_bootstrap(rows, 5, size=size).collect()}
        for rep in range(5):
            times = pdf.wk.map(draws[draws.replicate == rep].set_index("wk").times).fillna(0).to_numpy()
            assert got[rep] == pytest.approx(gini_of(pdf.raw.to_numpy(), times * pdf.target, times * (1 - pdf.target)), abs=1e-9)
    a = {r["replicate"]: r["gini"] for r in uncertainty.row_bootstrap(rows, 3).collect()}
    b = {r["replicate"]: r["gini"] for r in uncertainty.row_bootstrap(rows.repartition(5), 3, size=9000).collect()}
    assert a == pytest.approx(b, abs=1e-9)
    cells = pdf.groupby("raw").target.agg(["size", "sum"]).reset_index()
    n1, n0 = np.empty((len(cells), 3)), np.empty((len(cells), 3))
    for i, (s, n, k) in enumerate(zip(cells.raw, cells["size"], cells["sum"])):
        stream = np.random.Generator(np.random.Philox(key=[42, int(np.float64(s).view(np.uint64))]))
        n1[i], n0[i] = stream.poisson(k, 3), stream.poisson(n - k, 3)
    assert all(a[r] == pytest.approx(gini_of(cells.raw.to_numpy(), n1[:, r], n0[:, r]), abs=1e-9) for r in range(3))


def test_refit_bootstrap(sample):
    cal = calibrate.fit(sample, bins=100)
    refs = [(r["ref_score"], r["raw"]) for r in uncertainty.reference_raw(cal.knots, [500.0, 540.0]).collect()]
    out = uncertainty.refit_bootstrap(sample, refs, 5, 100).toPandas()
    assert len(out) == 10 and out.pd.between(0.0075, 0.9925).all() and (out.tail_n > 0).all()


def test_splits(spark, sample):
    parts = {r["slice"]: r["count"] for r in ranking.three_way_split(sample).groupBy("slice").count().collect()}
    assert parts == {"train": 2400, "calib": 800, "eval": 800}
    ends = ranking.three_way_split(sample).groupBy("slice").agg(F.min("wk").alias("a"), F.max("wk").alias("b")).collect()
    by = {r["slice"]: (r["a"], r["b"]) for r in ends}
    assert by["train"][1] <= by["calib"][0] and by["calib"][1] <= by["eval"][0]
    flat = sample.withColumn("wk", F.lit(1))
    assert {r[0] for r in ranking.quantile_split(flat).select("slice").distinct().collect()} == {"train", "test"}


def planted(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        p = 1 / (1 + math.exp(-(1.6 * a - 0.8 * b - 1.0)))
        rows.append((i, i % 25, float(rng.random() < p), a, b if i % 9 else None, c))
    return spark.createDataFrame(rows, "case_id bigint, wk int, target double, a double, b double, noise double").repartition(4).cache()


def test_planted_signal(spark):
    rows = planted(spark)
    parts = ranking.two_way_split(rows, "wk", "case_id")
    fit, late = parts.filter("slice = 'fit'").cache(), parts.filter("slice = 'holdout'").cache()
    model = modeling.LinearModel(fit, ["a", "b", "noise"])
    assert modeling.gini_on(model.predict(late)) > 0.40
    assert model.weights["a"] > 0 > model.weights["b"]
    drops = dict(modeling.permutation_importance(model, late, ["a", "noise"], 1))
    assert drops["a"] > 0.1 > abs(drops["noise"])
    boosted = modeling.BoostedModel(fit, ["a", "b", "noise"], maxIter=8)
    assert modeling.gini_on(boosted.predict(late)) > 0.40
    audit = modeling.monotone_audit(boosted.predict(late), "a", 1).collect()
    assert len(audit) == 10


def test_leave_one_out_is_that_of_separate_fits(spark):
    rows = planted(spark).withColumn("flat", F.lit(2.0)).withColumn("near", F.col("a") + 0.1 * F.col("noise"))
    parts = ranking.two_way_split(rows, "wk", "case_id")
    fit, late = parts.filter("slice = 'fit'").cache(), parts.filter("slice = 'holdout'").cache()
    columns = ["a", "b", "noise", "near", "flat"]
    together = modeling.LeaveOneOut(fit, columns)
    ginis = together.ginis(late)
    base = modeling.LinearModel(fit, columns)
    assert np.allclose(together.beta, [base.intercept, *[base.weights[c] for c in together.used]], atol=1e-5)
    assert ginis[None] == pytest.approx(modeling.gini_on(base.predict(late)), abs=1e-4)
    for i, c in enumerate(together.used):
        alone = modeling.LinearModel(fit, [x for x in columns if x != c])
        mine = dict(zip(["", *together.used], together.without[:, i]))
        assert all(mine[x] == pytest.approx(alone.weights[x], abs=1e-5) for x in together.used if x != c) and mine[c] == 0
        assert ginis[c] == pytest.approx(modeling.gini_on(alone.predict(late)), abs=1e-4)
    drops = dict(modeling.leave_one_out(fit, late, columns))
    assert drops["flat"] == 0.0 and drops["b"] == pytest.approx(ginis[None] - ginis["b"]) and set(drops) == set(columns)


def moved(place, n, key):
    """The permutation again, number by number."""
    a, b = permute.sides(n)
    while True:
        side = [place // b, place % b]
        for turn in range(permute.ROUNDS):
            i = turn % 2
            text = f"{key}:{turn}:{side[1 - i]}"
            side[i] = (side[i] + int(hashlib.md5(text.encode()).hexdigest()[:12], 16) % (a, b)[i]) % (a, b)[i]
        place = side[0] * b + side[1]
        if place < n:
            return place


def test_stored_calibrator(sample, tmp_path):
    for k, rows in enumerate((sample, sample.filter("raw < 0.003"))):  # the second has no rising line
        cal = calibrate.fit(rows, moc_logodds=0.1)
        cal.save(str(tmp_path / str(k)))
        back = calibrate.Calibrator.load(sample.sparkSession, str(tmp_path / str(k)))
        assert back.backbone == cal.backbone and (back.n_knots, back.lead, back.trail, back.tail, back.moc_logodds) == (cal.n_knots, cal.lead, cal.trail, cal.tail, cal.moc_logodds)
        a, b = (c.predict(sample.limit(50)).orderBy("id").toPandas() for c in (cal, back))
        assert np.array_equal(a.pd, b.pd)


def test_permutation_of_nothing(spark):
    empty = planted(spark).limit(0)
    assert modeling.shuffled(empty, "a", 1).count() == 0 and permute.walks(0) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000, 4097])
def test_permutations(spark, n):
    got = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, F.lit("k/3"))).collect()]
    assert sorted(got) == list(range(n)) and got[:40] == [moved(i, n, "k/3") for i in range(min(n, 40))]
    if n >= 1000:
        other = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, F.lit("k/4"))).collect()]
        assert sum(x == y for x, y in zip(got, other)) < 20 and sum(x == i for i, x in enumerate(got)) < 20
        assert abs(np.corrcoef(got, range(n))[0, 1]) < 0.15


def test_permutation_importance_against_brute_force(spark):
    """Both ways of scoring permuted columns against one frame after the other."""
    rows = planted(spark).filter("case_id % 4 <> 1").select("case_id", "wk", "target", "a", "b", "noise")
    model = modeling.LinearModel(rows, ["a", "b", "noise"])
    got = dict(modeling.permutation_importance(model, rows, ["a", "b"], 2, seed=6))
    pdf = rows.orderBy("case_id").toPandas()
    n = len(pdf)
    base = modeling.gini_on(model.predict(rows))
    for j, c in enumerate(["a", "b"]):
        drops = []
        for repeat in range(2):
            mixed = pdf.copy()
            mixed[c] = mixed[c].astype(object)
            for i in range(n):
                mixed.at[moved(i, n, f"6/{repeat}/{j}"), c] = None if pdf[c][i] != pdf[c][i] else float(pdf[c][i])
            frame = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in mixed.itertuples(index=False)], rows.schema)
            drops.append(base - modeling.gini_on(model.predict(frame)))
        assert got[c] == pytest.approx(np.mean(drops), abs=1e-9)

    class Plain:
        """The same model without the short way."""

        predict = staticmethod(model.predict)

    assert dict(modeling.permutation_importance(Plain, rows, ["a", "b"], 2, seed=6)) == pytest.approx(got, abs=1e-9)


def test_shuffle_keeps_the_values(spark):
    rows = planted(spark)
    mixed = modeling.shuffled(rows, "a", 5)
    assert sorted(r[0] for r in rows.select("a").collect()) == sorted(r[0] for r in mixed.select("a").collect())
    same = rows.select("case_id", "a").join(mixed.select("case_id", F.col("a").alias("z")), "case_id").filter("a = z").count()
    assert same < 30


def test_moved_arrays_are_the_permutation(spark):
    from duepath.operators import permute

    for n in (1, 2, 7, 150):
        rows = spark.range(n).select("id", permute.permuted(F.col("id"), n, F.lit("5/x")).alias("to")).orderBy("id").collect()
        assert permute.moved(np.arange(n), n, permute.draws(n, "5/x")).tolist() == [r["to"] for r in rows]


def test_permuted_columns_in_small_blocks(spark):
    rows = spark.createDataFrame([(i, float(i), None if i % 3 else 2.0 * i) for i in range(50)], "_at bigint, a double, b double").coalesce(1)
    got = {(r["_at"], r["repeat"]): r["got"] for r in modeling.permuted_columns(rows, 50, ["a", "b"], 2, 6, cells=40).collect()}
    assert len(got) == 100
    for j, own in enumerate(([float(i) for i in range(50)], [None if i % 3 else 2.0 * i for i in range(50)])):
        for r in range(2):
            to = [x["to"] for x in spark.range(50).select("id", modeling.permuted(F.col("id"), 50, F.lit(f"6/{r}/{j}")).alias("to")).orderBy("id").collect()]
            assert [got[to[i], r][j] for i in range(50)] == own


def test_null_targets_move_in_one_pass(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 2)) for i in range(40)], "case_id bigint, a double, target double")
    seen, passes = [], []

    class Seen:
        def __init__(self, train, columns, **_):
            seen.append(sorted((r["a"], r["target"]) for r in train.collect()))
            self.importance = dict.fromkeys(columns, 0.0)

    numbered = modeling.numbered
    monkeypatch.setattr(modeling, "BoostedModel", Seen)
    monkeypatch.setattr(modeling, "numbered", lambda *a: passes.append(1) or numbered(*a))
    modeling.null_importance(rows, ["a"], 3, seed=8)
    assert len(passes) == 1
    expected = [rows, *[modeling.shuffled(rows, "target", 8 + r) for r in range(3)]]
    assert sorted(seen) == sorted(sorted((r["a"], r["target"]) for r in e.collect()) for e in expected)
