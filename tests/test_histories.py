"""Literal applicants, income, schedules and aggregates with known answers."""

import datetime as dt
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from duepath.functions import clean
from duepath.operators import features as ft
from duepath.operators import metrics, streams
from duepath.sources import bureau

AS_OF = dt.date(2026, 1, 10)
PAY = "case_id string, line_id string, pdate date, tie bigint, amount double, overdue double, dpd double"
CYC = "case_id string, line_id string, as_of date, i int, n int, due date, instalment double, dpd double, overdue double"
WHO = ("case_id string, as_of date, monthly_income double, stated_income double, income_type string, education string, "
       "housing string, employment string")
TXN = "case_id string, payee string, tdate date, txn_id bigint, amount double, hint string"

LINES = [("1001", "ACME LOAN", 250.0, ()), ("1001", "PHONE FINANCE", 45.0, (5,)), ("1002", "KLARNA", 80.0, (3, 8)), ("1002", "CAR LOAN", 320.0, (7,))]
PEOPLE = [("1001", AS_OF, 3200.0, 3200.0, "SALARIED", None, "OWNED", None), ("1002", AS_OF, 2100.0, 2500.0, "OTHER", None, "RENTED", None)]


def cycles_of(spark, lines, start, as_of, n=12):
    out = []
    for case, name, amount, missed in lines:
        for i in range(n):
            gone = i in missed
            out.append((case, name, as_of, i, n, start + dt.timedelta(days=30 * i), amount, 90.0 if gone else 0.0, amount if gone else 0.0))
    return spark.createDataFrame(out, CYC)


def both_ways(spark, cyc, who, names=ft.PARITY_NAMES):
    none = spark.createDataFrame([], "case_id string, account_id string, acct_type string, bdate date, balance double")
    terms = cyc.groupBy("case_id", "line_id").agg(F.max("instalment").alias("amount")).select("case_id", "amount")
    direct = ft.build(streams.cycles_as_payments(cyc), who, terms, none, names)
    txns, mandates = streams.cycles_as_transactions(cyc, who)
    feed_income = streams.monthly_income(txns.withColumn("amount", -F.col("amount")))
    feed_who = who.drop("monthly_income").join(feed_income, "case_id", "left")
    feed = ft.build(streams.history_from_transactions(txns, mandates), feed_who, mandates.select("case_id", "amount"), none, names)
    return direct, feed


EXPECTED = {
    "max_dpd_24m": (90, 90), "mean_dpd_24m": (3.75, 11.25), "num_dpd_events_24m": (1, 3), "longest_clean_streak_24m": (12, 7),
    "max_consecutive_dpd_24m": (1, 1), "total_overdue_amount": (45, 480), "max_overdue_amount_24m": (45, 320), "num_active_obligations": (2, 2),
    "total_annuity": (295, 400), "debt_to_income": (0.0921875, 0.19047619), "declared_is_homeowner": (1, 0),
    "declared_income_is_employment": (1, 0), "declared_income_gap": (0, 0.16),
}


def test_two_applicants_both_sources(spark):
    cyc = cycles_of(spark, LINES, dt.date(2025, 1, 6), AS_OF)
    direct, feed = both_ways(spark, cyc, spark.createDataFrame(PEOPLE, WHO))
    got = {r["case_id"]: r.asDict() for r in direct.collect()}
    for name, (a, b) in EXPECTED.items():
        assert got["1001"][name] == pytest.approx(a, abs=1e-6), name
        assert got["1002"][name] == pytest.approx(b, abs=1e-6), name
    assert metrics.parity_breaks(feed, direct, ft.PARITY_NAMES).collect() == []


def test_three_lines_stay_three(spark):
    as_of = dt.date(2024, 6, 1)
    rows = []
    for line, late in (("l0", {}), ("l1", {3: 6.0, 7: 9.0}), ("l2", {})):
        rows += [("8001", line, as_of, i, 10, dt.date(2023, 7, 1) + dt.timedelta(days=30 * i), 300.0, late.get(i, 0.0), 0.0) for i in range(10)]
    who = spark.createDataFrame([("8001", as_of, 2500.0, None, None, None, None, None)], WHO)
    names = ["num_active_obligations", "total_annuity", "max_dpd_24m", "num_dpd_events_24m", "mean_dpd_24m"]
    for side in both_ways(spark, spark.createDataFrame(rows, CYC), who, names):
        r = side.first()
        assert (r["num_active_obligations"], r["total_annuity"], r["max_dpd_24m"]) == (3, 900, 9)
        assert r["num_dpd_events_24m"] == 2


def test_real_cycle_path(spark):
    as_of, start = dt.date(2024, 6, 1), dt.date(2023, 6, 7)
    late = (0, 0, 0, 6, 0, 0, 90, 0, 9, 0, 0)
    rows = [("1", "l", as_of, i, 11, start + dt.timedelta(days=30 * i), 300.0, float(d), 300.0 if i == 6 else 0.0) for i, d in enumerate(late)]
    who = spark.createDataFrame([("1", as_of, 2500.0, None, None, None, None, None)], WHO)
    direct, feed = both_ways(spark, spark.createDataFrame(rows, CYC), who)
    assert direct.first()["num_serious_arrears_24m"] >= 1
    assert metrics.parity_breaks(feed, direct, ft.PARITY_NAMES).collect() == []


def test_no_history_gives_defaults(spark):
    who = spark.createDataFrame([("9", AS_OF, None, None, None, None, " ", None)], WHO)
    empty = spark.createDataFrame([], PAY)
    r = ft.build(empty, who, spark.createDataFrame([], "case_id string, amount double"),
                 spark.createDataFrame([], "case_id string, account_id string, acct_type string, bdate date, balance double")).first()
    for s in ft.SPECS:
        assert r[s.name] == s.default, s.name
    assert len(ft.SPECS) == 83 and len(ft.PARITY_NAMES) == 71


def credits(spark, parts):
    out, n = [], 0
    for payee, amount, count, step in parts:
        for i in range(count):
            n += 1
            out.append(("c", payee, dt.date(2025, 1, 1) + dt.timedelta(days=step * i), n, float(amount), ""))
    return spark.createDataFrame(out, TXN)


@pytest.mark.parametrize("parts, want", [
    ([("acme salary", 2500, 12, 30)], 2500.0),
    ([("weekly pay", 500, 12, 7)], 500 * 30.44 / 7),
    ([("cashback", 25, 12, 30)], None),
    ([("gift", 900, 1, 30), ("refund", 700, 1, 30), ("sale", 400, 1, 30)], None),
    ([("monthly transfer", 1800, 12, 30)], 1800.0),
    ([("acme salary", 2600, 12, 30), ("sweep", 4000, 12, 30)], 2600.0),
])
def test_income(spark, parts, want):
    rows = streams.monthly_income(credits(spark, parts)).collect()
    assert (rows[0][0 + 1] if rows else None) == (pytest.approx(want) if want else None)


def payments_on(spark, dates):
    return spark.createDataFrame([("c", "l", d, i, 100.0, None, None) for i, d in enumerate(dates)], PAY)


def test_schedule(spark):
    start = dt.date(2024, 1, 1)
    dates = [start + dt.timedelta(days=30 * i + (14 if i == 6 else 0)) for i in range(12)]
    points = streams.Schedule(payments_on(spark, dates)).points().collect()
    assert {p["period"] for p in points} == {30.0}
    late = [p for p in points if p["late"]]
    assert len(late) == 1 and late[0]["off"] >= 10
    gap = [d for i, d in enumerate(start + dt.timedelta(days=30 * i) for i in range(12)) if i != 5]
    assert streams.Schedule(payments_on(spark, gap)).skipped().first()["n_skipped"] == 1
    missed = streams.missed_cycles(payments_on(spark, gap)).collect()
    assert [(m["pdate"], m["dpd"], m["overdue"]) for m in missed] == [(start + dt.timedelta(days=150), 90.0, 100.0)]


def test_same_day_payment_moves_only_the_cycle_count(spark):
    start = dt.date(2024, 1, 1)
    dates = [start + dt.timedelta(days=30 * i) for i in range(6)] + [start + dt.timedelta(days=60)]
    assert streams.Schedule(payments_on(spark, dates)).points().count() == 6
    moved = streams.Schedule(payments_on(spark, dates), distinct=False).rows.agg(F.max("cycle")).first()[0]
    assert moved == 6


def test_bureau_aggregates(spark):
    cols = "case_id bigint, pmts_dpd_1073P string, pmts_overdue_1140A double"
    part = bureau.payment_partials(spark.createDataFrame([(1, "0", 0.0), (1, "10", 5.0), (1, "40", 20.0)], cols)).first()
    assert (part["dpd_max"], part["dpd_sum"], part["n_pmts"], part["n_dpd_gt0"], part["n_dpd_ge30"], part["ovd_max"], part["ovd_sum"]) == (40, 50, 3, 2, 1, 20, 25)
    wild = bureau.payment_partials(spark.createDataFrame([(1, "185124192", 0.0), (1, "120", 0.0), (1, "n/a", None)], cols)).first()
    assert (wild["dpd_max"], wild["dpd_sum"], wild["n_pmts"]) == (90, 180, 3)
    two = [bureau.payment_partials(spark.createDataFrame([(1, v, 0.0) for v in vs], cols)) for vs in (("0", "0"), ("30",))]
    assert bureau.combine_payments(two).first()["mean_dpd"] == 10


def test_text_code_and_names(spark):
    code = spark.range(1).select(clean.text_code(F.lit("SALARIED"))).first()[0]
    assert code == 14739965 == int(hashlib.md5(b"SALARIED").hexdigest()[:6], 16)
    name = spark.range(1).select(clean.plain_name(F.lit("Dr. Zoë  Anne O'Néil-Smith"))).first()[0]
    assert name == "ZOE ANNE O NEIL SMITH"
    assert spark.range(1).select(clean.plain_name(F.lit("Dvořák Łukasz Nguyễn ＡＢ"))).first()[0] == "DVORAK UKASZ NGUYEN AB"
    every = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFKD", chr(c)).translate(dict.fromkeys(range(0x300, 0x370)))) == 1]
    got = spark.createDataFrame([(c,) for c in every], "c string").select("c", clean.plain_name(F.col("c")).alias("p")).collect()
    assert len(got) > 500
    for r in got:
        plain = unicodedata.normalize("NFKD", r["c"])[0]
        assert r["p"] == (plain.upper() if plain.isascii() and plain.isalpha() else ""), r["c"]


def test_case_universe_without_dated_rows(spark):
    pay = spark.createDataFrame([("7",), ("7",), ("8",)], "case_id string")
    for rows in ([], [(1, None)], [(1, "soon")]):
        base = spark.createDataFrame(rows, "case_id int, date_decision string")
        assert {tuple(r) for r in bureau.case_universe(base, pay).collect()} == {("7", None), ("8", None)}
        assert bureau.case_universe(base, None).isEmpty()
    base = spark.createDataFrame([(1, "2026-01-10"), (2, None)], "case_id int, date_decision string")
    assert [tuple(r) for r in bureau.case_universe(base, pay).collect()] == [("1", AS_OF)]
    tries = spark.range(1).select(clean.name_spellings(F.lit("mr Jon A Doe"))).first()[0]
    assert tries == ["JON A DOE", "JON DOE", "J DOE"]


def test_line_letters(spark):
    got = [r[0] for r in spark.createDataFrame([(i,) for i in (0, 25, 26, 27, 701, 702)], "i int").select(streams.letters(F.col("i"))).collect()]
    assert got == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


def test_month_start(spark):
    df = spark.createDataFrame([(2023, 5), (2023, 13), (1899, 1), (None, 2), (2100, 12)], "y int, m int")
    got = [r[0] for r in df.select(clean.month_start(F.col("y"), F.col("m"))).collect()]
    assert got == [dt.date(2023, 5, 1), None, None, None, dt.date(2100, 12, 1)]


def test_chunked_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, 0, 2023, 5, "3")], "case_id bigint, num_group1 int, pmts_year_1139T int, pmts_month_158T int, pmts_dpd_1073P string")
    b = spark.createDataFrame([(2, 0, 2023, 6, 7.0, "x")], "case_id bigint, num_group1 int, pmts_year_1139T int, pmts_month_158T int, pmts_overdue_1140A double, extra string")
    import shutil

    for name, df in (("train_credit_bureau_a_2_0", a), ("train_credit_bureau_a_2_1", b), ("credit_bureau_a_1", a)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        shutil.copy(part, tmp_path / f"{name}.parquet")
    got = bureau.read_logical(spark, str(tmp_path), "credit_bureau_a_2")
    assert "extra" not in got.columns and got.count() == 2
    pay = bureau.union_payments({"a": got}).orderBy("case_id").collect()
    assert [(p["pdate"], p["dpd"], p["overdue"]) for p in pay] == [(dt.date(2023, 5, 1), 3.0, 0.0), (dt.date(2023, 6, 1), 0.0, 7.0)]
    assert bureau.read_logical(spark, str(tmp_path), "static_0") is None
