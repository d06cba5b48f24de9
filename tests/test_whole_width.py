"""The modelling and metric queries run over every column with the operators' own settings."""

import inspect

import numpy as np
import pandas as pd
import pytest

from duepath.operators import features as ft
from duepath.operators import metrics, modeling
from duepath.plans import metric_queries, score_queries


def test_model_columns_are_whole(spark, sf):
    from duepath.plans.source_queries import assembled

    numbers = [c for c, kind in assembled(spark, sf).dtypes if c not in ("case_id", "target", "wk") and kind in ("double", "bigint", "int")]
    assert score_queries.ASSEMBLED == numbers
    assert set(score_queries.PARITY) == set(ft.PARITY_NAMES) and len(set(score_queries.MODEL_COLS)) == len(numbers) + 71
    text = inspect.getsource(score_queries)
    assert "SMALL" not in text and "FAST" not in text


@pytest.mark.parametrize("n", [400])
def test_rank_correlation_of_many_columns(spark, n):
    rng = np.random.default_rng(3)
    base = rng.normal(size=n)
    pdf = pd.DataFrame({f"f{k}": np.round(base * (k % 5) + rng.normal(size=n), 1) for k in range(71)})
    pdf = pdf.mask(rng.uniform(size=pdf.shape) < 0.1)
    pdf["f7"], pdf["f8"] = 3.0, np.nan
    want = pdf.rank().corr()
    rows = spark.createDataFrame([(i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(pdf.to_numpy())], "case_id bigint, " + ", ".join(f"{c} double" for c in pdf.columns))
    got = metrics.spearman(rows, "case_id", list(pdf.columns)).collect()
    assert len(got) == 71 * 70 // 2
    for r in got:
        w = want.loc[r["x"], r["y"]]
        assert r["rho"] is None if w != w else r["rho"] == pytest.approx(w, abs=1e-9)


def test_flat_columns(spark):
    rows = spark.createDataFrame([(f"{i}", 0.090909090909091 if i % 3 else None, float(i % 7), float(i % 7 > 3)) for i in range(60)], "case_id string, flat double, x double, target double")
    found = {r["feature"]: r for r in metrics.fidelity(rows, rows, ["flat", "x"]).collect()}
    assert found["flat"]["corr"] is None and found["x"]["corr"] == pytest.approx(1.0)
    # rounding leaves a flat column a tiny sd, which stopped the search before its first step
    model = modeling.LinearModel(rows, ["flat", "x"])
    assert model.weights["flat"] == 0.0 and model.weights["x"] > 0.5


def test_parity_queries_cover_every_feature(spark, sf):
    got = metric_queries.parity_matrix(spark, sf)
    assert set(ft.PARITY_NAMES) <= set(got.columns)
    fidelity = metrics.fidelity(*metric_queries.rendered(spark, sf), ft.PARITY_NAMES)
    assert {r["feature"] for r in fidelity.collect()} == set(ft.PARITY_NAMES)
