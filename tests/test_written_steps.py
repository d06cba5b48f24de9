"""Steps that are written, dealt or pruned before they are read again."""

import pytest
from pyspark.sql import functions as F

from duepath.operators import governance as gov
from duepath.operators import metrics, modeling
from duepath.plans import history_queries
from duepath.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["c21_cycles_as_transactions", "c21_cycle_mandates"])
def test_cycles_are_written_before_their_lines_are_numbered(spark, sf, monkeypatch, name):
    seen, real = [], history_queries.streams.cycles_as_transactions
    monkeypatch.setattr(history_queries.streams, "cycles_as_transactions", lambda c, a: seen.append(c) or real(c, a))
    QUERIES[name](spark, sf)
    assert seen[0].inputFiles() and all("/cycles-" in f for f in seen[0].inputFiles())


def test_drift_and_fidelity_group_by_feature(spark):
    a = spark.createDataFrame([("1", 1.0, None), ("2", 3.0, None), ("3", 8.0, None)], "case_id string, u double, v double")
    b = spark.createDataFrame([("1", 2.0, 1.0), ("2", 4.0, 2.0), ("3", 9.0, 3.0)], "case_id string, u double, v double")
    for report in (metrics.drift(a, b, ["u", "v"]), metrics.fidelity(a, b, ["u", "v"])):
        assert "Aggregate [feature" in report._jdf.queryExecution().optimizedPlan().toString()
    got = {r["feature"]: r for r in metrics.drift(a, b, ["u", "v"]).collect()}
    assert (got["u"]["mean_a"], got["u"]["mean_b"], got["v"]["mean_a"], got["v"]["corr"]) == (4.0, 5.0, None, None) and got["u"]["corr"] == pytest.approx(1.0)
    empty = metrics.fidelity(a.limit(0), b, ["u", "v"]).collect()
    assert sorted((r["feature"], r["match_rate"], r["corr"]) for r in empty) == [("u", None, None), ("v", None, None)]


def test_ranks_are_dealt_in_tasks_of_bounded_size(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i * 7 % 11), float(i * 5 % 13)) for i in range(100)], "id int, a double, b double")
    whole = metrics.spearman(rows, "id", ["a", "b"]).first()["rho"]
    files, real = {}, metrics.cut_lineage

    def cut(df, name="stage"):
        out = real(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(metrics, "RANKS", 50)
    monkeypatch.setattr(metrics, "cut_lineage", cut)
    assert metrics.spearman(rows, "id", ["a", "b"]).first()["rho"] == pytest.approx(whole) and files["ranks"] == 4


def test_claims_leave_their_spellings_before_the_registry(spark):
    claims = spark.createDataFrame([(1, "t", ["u"], 5.0)], "claim_id int, tx_hash string, claimed_user_hashes array<string>, claimed_score double")
    stored = spark.createDataFrame([("t", "u", "b", 5.0)], "tx_hash string, user_hash string, body string, event_score double").withColumn("anchored_hash", F.sha2("body", 256))
    rows = gov.verify_claims(claims, stored, stored.select("user_hash", F.col("anchored_hash").alias("latest_hash")), F.col("body")).select("claim_id", "verdict")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_contains") > plan.index("Join LeftOuter")
    assert rows.first()["verdict"] == "VERIFIED"


def test_settings_share_one_preparation(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i // 4, float(i * 7 % 5), float(i % 2)) for i in range(120)], "case_id bigint, wk int, a double, target double")
    made, real = [], modeling.Prepared
    monkeypatch.setattr(modeling, "Prepared", lambda *a, **k: made.append(1) or real(*a, **k))
    got = modeling.random_search(rows, ["a"], [{"maxIter": 1}, {"maxIter": 2}])
    assert len(made) == 1 and sorted(i for i, _ in got) == [0, 1]
