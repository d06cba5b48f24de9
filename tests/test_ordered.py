"""The split path for hot groups must give what plain windows give."""

import pytest
from pyspark.sql import functions as F

from frame_rows import rows_of
from duepath.operators import ordered as od


def frame(spark, n=400):
    rng = range(n)
    data = [
        (("a" if i % 3 else "b") if i % 17 else None, (i * 7919) % 50, i, float((i * 31) % 23), None if i % 5 == 0 else float(i % 11)) for i in rng
    ]
    return spark.createDataFrame(data, "g string, o int, t bigint, v double, w double")


SPECS = dict(
    idx=od.Index(), n=od.Total(), l1=od.Lag("w"), l3=od.Lag("v", 3), s=od.RunningSum("w"), m=od.RunningMax("w"), nx=od.NextMin("w"))


def both(spark, make):
    plain = make()
    spark.conf.set("duepath.hotGroupRows", "3")
    try:
        split = make()
    finally:
        spark.conf.unset("duepath.hotGroupRows")
    return plain, split


@pytest.mark.parametrize("keys", [["g"], []])
@pytest.mark.parametrize("order", [["o", "t"], ["t"]])
def test_ordered_columns(spark, keys, order):
    df = frame(spark)
    plain, split = both(spark, lambda: rows_of(od.OrderedGroups(df, keys, order).add(**SPECS).done()))
    assert plain == split


def test_one_value_fills_many_segments(spark):
    df = spark.range(500).select(F.lit("k").alias("g"), F.lit(1).alias("o"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    spark.conf.set("duepath.hotGroupRows", "20")
    try:
        groups = od.OrderedGroups(df, ["g"], ["o", "t"])
        sizes = [r["count"] for r in groups.df.groupBy(od.SEG).count().collect()]
        out = groups.add(idx=od.Index()).done().filter(F.col("idx") != F.col("t")).count()
    finally:
        spark.conf.unset("duepath.hotGroupRows")
    assert out == 0
    assert len(sizes) > 10 and max(sizes) < 100


def test_text_order(spark):
    df = spark.createDataFrame([("g", f"stream::line{i:03d}") for i in range(60)], "g string, name string")
    plain, split = both(spark, lambda: rows_of(od.OrderedGroups(df, ["g"], ["name"]).add(i=od.Index()).done()))
    assert plain == split


@pytest.mark.parametrize("p", [0.5, 0.1, 0.975])
def test_quantiles(spark, p):
    df = frame(spark)
    plain, split = both(spark, lambda: rows_of(od.exact_quantile(df, ["g"], "v", p)))
    assert plain == split
    want = df.toPandas().v.quantile(p)
    spark.conf.set("duepath.hotGroupRows", "3")
    try:
        got = od.exact_quantile(df, [], "v", p).first()[0]
    finally:
        spark.conf.unset("duepath.hotGroupRows")
    assert got == pytest.approx(want)


def test_group_stats_and_spread_back(spark):
    df = frame(spark).filter(F.col("g").isNotNull())
    make = lambda: rows_of(od.group_stats(df, ["g"], {"n": F.count(F.lit(1))}, {"mv": "v", "mw": "w"}))
    plain, split = both(spark, make)
    assert plain == split

    def back():
        hot = od.hot_groups(df, ["g"])
        return rows_of(od.spread_back(df, ["g"], F.sum("v"), "total", hot))

    plain, split = both(spark, back)
    assert plain == split


def test_join_one_row(spark):
    df = frame(spark).filter(F.col("g").isNotNull())
    side = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "g string, x int")
    plain, split = both(spark, lambda: rows_of(od.join_one_row(df, side, ["g"], od.hot_groups(df, ["g"]))))
    assert plain == split and len(plain) == df.count()


def test_join_salted(spark):
    df = frame(spark).filter(F.col("g").isNotNull())
    side = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "g string, x int")
    plain, split = both(spark, lambda: rows_of(od.join_salted(df, side, ["g"], od.hot_groups(df, ["g"]))))
    assert plain == split and len(plain) > df.count()


def test_many_lines_in_one_case(spark):
    """A case that is hot because of its many lines, not because of one long line."""
    import datetime as dt

    from duepath.operators import features as ft

    day = dt.date(2024, 1, 1)
    rows = [("1", f"l{i}", day + dt.timedelta(days=i % 300), i, float(50 + i % 7), None, float(i % 40)) for i in range(60)]
    pay = spark.createDataFrame(rows, "case_id string, line_id string, pdate date, tie bigint, amount double, overdue double, dpd double")
    who = spark.createDataFrame([("1", dt.date(2024, 12, 1), 1000.0)], "case_id string, as_of date, monthly_income double")
    inst = spark.createDataFrame([], "case_id string, amount double")
    bal = spark.createDataFrame([], "case_id string, acct_type string, bdate date, balance double")
    names = ["agg_instal_median", "total_annuity", "agg_dpd_median", "num_active_obligations", "max_dpd_24m"]
    spark.conf.set("duepath.hotGroupRows", "20")
    try:
        split = rows_of(ft.build(pay, who, inst, bal, names))
    finally:
        spark.conf.unset("duepath.hotGroupRows")
    assert split == rows_of(ft.build(pay, who, inst, bal, names)) and len(split) == 1


def test_average_rank_matches_pandas(spark, tiny_limit):
    from duepath.operators.ranking import average_rank

    df = frame(spark)
    got = average_rank(df.select("t", "v"), [], "v").toPandas().sort_values("t")
    want = df.toPandas().sort_values("t").v.rank()
    assert got["rank"].tolist() == want.tolist()


def test_features_split_path(spark, sf):
    """A case and a line far above the limit go through segments; all features stay the same."""
    from duepath.operators import features as ft
    from duepath.sources import tables as fx

    names = ["agg_dpd_median", "agg_interval_median", "dpd_late_autocorr_lag3_24m", "max_consecutive_dpd_24m", "avg_overdue_amount_6m",
             "dpd_acceleration_24m", "mk_p_late_to_worse_24m", "agg_dpd_last", "agg_instal_median", "recency_weighted_dpd_24m"]
    pay = fx.payments(spark, sf).filter("cast(case_id as int) < 12")
    who = fx.applicants(spark, sf).filter("cast(case_id as int) < 12")
    make = lambda: rows_of(ft.build(pay, who, fx.instalments(spark, sf), fx.balances(spark, sf), names))
    plain, split = both(spark, make)
    assert plain == split and len(plain) == 12


def test_schedule_split_path(spark, sf):
    from duepath.operators import streams
    from duepath.sources import tables as fx

    pay = fx.payments(spark, sf).filter("cast(case_id as int) < 10")
    plain, split = both(spark, lambda: rows_of(streams.complete_history(pay).drop("tie")))
    assert plain == split
    plain, split = both(spark, lambda: rows_of(streams.profile(pay)))
    assert plain == split


def test_metrics_split_path(spark, sf):
    from duepath.operators import calibrate, flags, governance, metrics, ranking, reports, streams, uncertainty
    from duepath.plans.history_queries import CFG, inflows, transactions
    from duepath.sources import tables as fx

    s = fx.scored(spark, sf)
    subs = fx.submissions(spark, sf).filter("seq < 400")
    changes = subs.filter(F.col("seq") % 50 < 2).select("issuer", "ts", (F.col("seq") % 2 == 0).alias("approved"))
    for make in (
        lambda: flags.medians(s, ["raw", "wk"]),
        lambda: rows_of(reports.score_distribution(s.withColumn("score", F.col("raw")))),
        lambda: rows_of(calibrate.binned_knots(s, 40)),
        lambda: rows_of(metrics.spearman(s, "id", ["raw", "wk"])),
        lambda: rows_of(streams.monthly_income(inflows(spark, sf), CFG)),
        lambda: rows_of(streams.detect(transactions(spark, sf), CFG)[1]),
        lambda: rows_of(streams.robust_stats(fx.instalments(spark, sf), ["case_id"], "amount"), 4),
        lambda: rows_of(governance.merkle_roots(subs.withColumnRenamed("event_hash", "leaf"), ["issuer"], "seq")),
        lambda: rows_of(governance.issuers_at(subs, changes).select("seq", "approved")),
        lambda: rows_of(governance.rate_flags(fx.requests(spark, sf), 2).select("seq", "over_limit")),
        lambda: rows_of(metrics.auc(s, ["wk"])),
        lambda: rows_of(metrics.auc(s)),
        lambda: rows_of(uncertainty.delong(s), 10),
        lambda: rows_of(ranking.three_way_split(s).select("id", "slice")),
        lambda: rows_of(calibrate.calibration_error(s.withColumn("p", F.col("raw") / 500), "p")),
        lambda: rows_of(governance.quota_flags(fx.submissions(spark, sf), 2).select("seq", "over_quota")),
        lambda: rows_of(governance.reused_hashes(fx.submissions(spark, sf)).select("seq", "reused")),
        lambda: rows_of(governance.cooldown_flags(fx.submissions(spark, sf)).select("seq", "too_soon", "period_not_newer")),
    ):
        plain, split = both(spark, make)
        assert plain == split


def segment_sizes(df, keys, order, limit):
    """Rows per window partition, and the ordered rows."""
    spark = df.sparkSession
    spark.conf.set("duepath.hotGroupRows", str(limit))
    try:
        groups = od.OrderedGroups(df, keys, order)
        sizes = [r["count"] for r in groups.df.groupBy(*keys, od.SEG).count().collect()]
        return sizes, groups.add(i=od.Index()).done().collect()
    finally:
        spark.conf.unset("duepath.hotGroupRows")


def test_one_odd_text_does_not_stop_the_split(spark):
    df = spark.range(20_000).select(F.format_string("application-%08d", "id").alias("name")).union(spark.createDataFrame([("zzz",)], "name string"))
    sizes, rows = segment_sizes(df, [], ["name"], 500)
    assert sum(sizes) == 20_001 and max(sizes) <= 1_000
    assert [r.name for r in sorted(rows, key=lambda r: r.i)] == sorted(r.name for r in rows)


def test_ties_on_the_whole_order_are_split(spark):
    df = spark.range(2_000).select(F.lit("k").alias("g"), F.lit(1).alias("o"), F.lit(2).alias("t"), "id")
    sizes, rows = segment_sizes(df, ["g"], ["o", "t"], 100)
    assert sum(sizes) == 2_000 and max(sizes) <= 200
    assert sorted(r.i for r in rows) == list(range(2_000))


def test_every_hot_group_is_found(spark):
    df = spark.range(80_000).select((F.col("id") % 20_000).alias("g"), "id")
    hot = od.hot_groups(df, ["g"], 3)
    assert hot.count() == 20_000 and hot.filter("_rows <> 4").count() == 0
    assert od.hot_groups(df, ["g"], 4) is None
    assert od.drop_hot(df, hot, ["g"]).isEmpty()
