"""The bank-feed path over few passes: equal to the separate steps, and nothing looked up or shuffled twice."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duepath.operators import metrics, streams

PAY = "case_id string, line_id string, pdate date, tie bigint, amount double, overdue double, dpd double"
CYC = "case_id string, line_id string, as_of date, i int, n int, due date, instalment double, dpd double, overdue double"
TXN = "case_id string, payee string, tdate date, txn_id bigint, amount double, hint string"
DAY = dt.date(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def payments(spark):
    """Lines with holes, several payments a day, equal rows, null keys, dates and amounts."""
    rng, out = random.Random(5), []
    for case in ("a", "b", None):
        for line in ("l1", "l2", "l3", None):
            day = 0
            for k in range(rng.choice((1, 2, 3, 9, 14))):
                day += rng.choice((0, 1, 29, 30, 30, 31, 62, 95))
                when = None if k == 4 and line == "l2" else DAY + dt.timedelta(days=day)
                out.append((case, line, when, k, rng.choice((100.0, 80.0, 0.0, -5.0, None)), rng.choice((None, 7.0)), rng.choice((None, None, 12.0))))
            out.append(out[-1])
    return spark.createDataFrame(out, PAY)


def test_history_at_once_equals_both_schedules(spark):
    rows = payments(spark)
    seen = streams.Schedule(rows, distinct=True).with_dpd().select(*streams.PAYMENT_COLUMNS)
    missed = streams.missed_cycles(rows)
    got = streams.complete_history(rows)
    assert missed.count() > 5 and got.columns == list(streams.PAYMENT_COLUMNS)
    assert rows_of(got) == rows_of(seen.unionByName(missed))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_line_numbers_without_a_join(spark):
    cyc = [(c, n, DAY, i, 3, DAY + dt.timedelta(days=30 * i), 100.0 + i, d, 0.0)
           for c in ("1", "2", None) for n in ("x", None, "b", "a") for i, d in ((0, 0.0), (1, 20.0), (1, 3.0), (2, None))]
    cyc = spark.createDataFrame(cyc, CYC)
    who = spark.createDataFrame([("1", DAY, 2500.0), ("2", DAY, None)], "case_id string, as_of date, monthly_income double")
    txns, mandates = streams.cycles_as_transactions(cyc, who)
    assert "Join" not in txns._jdf.queryExecution().optimizedPlan().toString()
    cold = rows_of(txns), rows_of(mandates)
    assert {(r["case_id"], r["payee"]) for r in mandates.collect()} == {(c, f"loan {x}") for c in "12" for x in "bcd"}
    spark.conf.set("duepath.hotGroupRows", "3")
    try:
        assert tuple(map(rows_of, streams.cycles_as_transactions(cyc, who))) == cold
    finally:
        spark.conf.unset("duepath.hotGroupRows")


def test_feed_looks_up_transactions_once(spark, monkeypatch):
    plain = streams.hot_groups
    asked = []
    monkeypatch.setattr(streams, "hot_groups", lambda df, keys, *a: asked.append(list(keys)) or plain(df, keys, *a))
    steady = [("1", "club", DAY + dt.timedelta(days=30 * i), i, 12.0, "DIRECT_DEBIT") for i in range(8) if i != 4]
    once = [("1", "gym", DAY, 50, 30.0, "DIRECT_DEBIT")]
    txns = spark.createDataFrame(steady + once, TXN)
    mandates = spark.createDataFrame([("1", "gym", 30.0), ("1", "club", 12.0)], "case_id string, payee string, amount double")
    got = streams.history_from_transactions(txns, mandates)
    assert asked == [["case_id"]]
    assert got.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.max("dpd")).orderBy("line_id").collect() == [
        ("mandate::gym#0", 1, None), ("stream::club#12.0", 8, 90.0)]
    spark.conf.set("duepath.hotGroupRows", "3")
    try:
        assert rows_of(streams.history_from_transactions(txns, mandates)) == rows_of(got)
    finally:
        spark.conf.unset("duepath.hotGroupRows")


def test_parity_breaks_explode_one_column(spark):
    a = spark.createDataFrame([("1", 1.0, None), ("2", 2.0, None), ("3", 1.0, 5.0)], "case_id string, x double, y double")
    b = spark.createDataFrame([("1", 1.00001, None), ("2", 2.1, 1.0), ("3", None, 5.0), ("4", 0.0, 0.0)], "case_id string, x double, y double")
    out = metrics.parity_breaks(a, b, ["x", "y"])
    assert [(r["case_id"], r["feature"]) for r in out.orderBy("case_id", "feature").collect()] == [("2", "x"), ("2", "y"), ("3", "x")]
    assert out.filter("case_id = '2' and feature = 'x'").first() == ("2", "x", 2.0, pytest.approx(2.1))
    node = out._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(")[1].split("\n")[0]
    assert "a_x" not in node
