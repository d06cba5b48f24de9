"""Queries for ranks, splits, discrimination, stability, drift and cohort reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from duepath.functions import score as sc
from duepath.operators import metrics, ranking, reports, streams
from duepath.operators import features as ft
from duepath.plans.feature_queries import SQL as FEATURE_SQL
from duepath.plans.feature_queries import column_sql, matrix, shown
from duepath.plans.history_queries import cycles
from duepath.plans.raw_oracle import RAW
from duepath.plans.registry import register, rounded
from duepath.plans.source_queries import assembled
from duepath.session import cut_lineage
from duepath.sources import tables as fx

SPLIT: dict[str, str] = {
    "dx_split": """
select *, case when i < floor(n_all * 0.6) then 'train' when i < floor(n_all * 0.8) then 'calib' else 'eval' end as slice from (
  select *, row_number() over (order by wk, id) - 1 as i, count(*) over () as n_all from fx_scored)""",
}


def auc_sql(source: str, keys: str = "", score: str = "raw", target: str = "target") -> str:
    by = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    return f"""select {by}n1 + n0 as n, n1 as n_pos, case when n1 > 0 and n0 > 0 then w / (cast(n1 as double) * n0) end as auc from (
  select {by}sum(c1) as n1, sum(c0) as n0, sum(cast(c1 as double) * (below + c0 / 2.0)) as w from (
    select *, sum(c0) over ({part}order by s) - c0 as below from (
      select {by}{score} as s, sum(case when {target} = 1 then 1 else 0 end) as c1, sum(case when {target} = 1 then 0 else 1 end) as c0
      from {source} where {score} is not null and {target} is not null group by {by}{score}))
  {'group by ' + keys if keys else ''})"""


SPLIT["dx_weekly"] = auc_sql("fx_scored", "wk")
SPLIT["dx_vintages"] = """
select cast(wk as double) as vintage, cast(n as bigint) as n, cast(n_pos as bigint) as defaults, n_pos / n as default_rate, 2 * auc - 1 as gini
from dx_weekly where n >= 150 and n_pos >= 5 and n - n_pos >= 5"""

COHORT = ["num_active_obligations", "max_dpd_24m", "num_serious_arrears_24m", "num_dpd_events_24m", "monthly_income", "debt_to_income",
          "payment_to_income", "min_balance_3m", "longest_clean_streak_24m", "cv_payment_amount"]
SPLIT["dx_cohort"] = f"""
select *, concat_ws(' / ', thickness, conduct, afford, case when cv_payment_amount > 0.5 then 'volatile income' end) as label from (
select *, case when num_serious_arrears_24m > 0 then 'serious arrears' when max_dpd_24m >= 30 then '30d+ late' when num_dpd_events_24m > 0 then 'minor late'
    when longest_clean_streak_24m >= 18 then 'long clean' when thickness in ('no-file', 'ultra-thin') then 'no history' else 'clean' end as conduct,
  case when monthly_income is null or monthly_income <= 0 then 'income undetected' when payment_to_income > 0.45 then 'stretched'
    when debt_to_income > 6.0 then 'high debt' when min_balance_3m < 0 then 'overdrawn' else 'comfortable' end as afford
from (select *, case when coverage < 0.5 and th in ('no-file', 'thin') then 'ultra-thin' else th end as thickness from (
  select *, ({' + '.join(f'({c} is not null)::int' for c in COHORT)}) / {float(len(COHORT))} as coverage,
    case when num_active_obligations is null or num_active_obligations <= 0 then 'no-file' when num_active_obligations <= 2 then 'thin'
      when num_active_obligations <= 5 then 'medium' else 'thick' end as th from dx_matrix)))"""
SPLIT["dx_scored_cohort"] = """
select c.*, 600 - 40 / ln(2.0) * ln(20.0) + 40 / ln(2.0) * ln((1 - p) / p) as score, target
from (select *, least(greatest(0.01 + mean_dpd_24m / 100, 1e-9), 1 - 1e-9) as p from dx_cohort) c
left join (select cast(case_id as varchar) as case_id, target from dx_base) b on b.case_id = c.case_id"""


def q(name, sql=None, dates=()):
    return register(name, sql, {**RAW, **FEATURE_SQL, **SPLIT}, dates)


# -- W: ranks, splits, limits ---------------------------------------------------------------------


@q("w01_line_index", "select case_id, line_id, tie, row_number() over (partition by case_id, line_id order by pdate, tie) - 1 as idx from fx_payments")
def _(spark, folder):
    from duepath.operators.ordered import Index, OrderedGroups

    return OrderedGroups(fx.payments(spark, folder), ["case_id", "line_id"], ["pdate", "tie"]).add(idx=Index()).done().select(
        "case_id", "line_id", "tie", "idx")


@q("w02_average_rank", "select id, rank() over (order by raw) + (count(*) over (partition by raw) - 1) / 2.0 as rank from fx_scored")
def _(spark, folder):
    return ranking.average_rank(fx.scored(spark, folder), [], "raw").select("id", "rank")


@q("w03_three_way_split", "select id, wk, slice from dx_split")
def _(spark, folder):
    return ranking.three_way_split(fx.scored(spark, folder)).select("id", "wk", "slice")


@q("w04_two_way_split", "select id, case when i < floor(n_all * 0.8) then 'fit' else 'holdout' end as slice from dx_split")
def _(spark, folder):
    return ranking.two_way_split(fx.scored(spark, folder)).select("id", "slice")


@q("w05_quantile_split", "select id, case when wk <= (select quantile_cont(wk, 0.8) from fx_scored) then 'train' else 'test' end as slice from fx_scored")
def _(spark, folder):
    return ranking.quantile_split(fx.scored(spark, folder)).select("id", "slice")


@q("w06_random_cohort")
def _(spark, folder):
    evals = ranking.three_way_split(fx.scored(spark, folder)).filter(F.col("slice") == "eval")
    return ranking.random_cohort(evals, 100, "id").select("id", "wk", "raw")


@q("w07_head_and_tail", """
(select id, raw, 'head' as part from fx_scored order by raw desc, id limit 20) union all (select id, raw, 'tail' from fx_scored order by raw, id desc limit 20)""")
def _(spark, folder):
    return ranking.head_and_tail(fx.scored(spark, folder), 20, "raw", "id").select("id", "raw", "part")


@q("w08_score_history", """
select key, seq, score, round(score - lead(score) over (partition by key order by ts desc, seq desc), 6) as delta from (
  select cast(user_id as varchar) as key, event_id as seq, ts, value as score, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
where rn <= 10""")
def _(spark, folder):
    from duepath.operators import governance

    e = fx.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return governance.recent_scores(e, 10, digits=6).select("key", "seq", "score", "delta")


@q("w09_latest_record", "select user_hash, arg_max(event_hash, seq) as event_hash, arg_max(period, seq) as period from fx_submissions group by user_hash")
def _(spark, folder):
    from duepath.sources import sinks

    return sinks.latest_per_user(fx.submissions(spark, folder), "seq").select("user_hash", "event_hash", "period")


@q("w10_top_contributions", """
select case_id, array_to_string(list_transform(list_sort(list_filter(v, lambda x: x.c > 0), 'desc')[:2], lambda x: x.f), ',') as increasing,
  array_to_string(list_transform(list_sort(list_filter(v, lambda x: x.c < 0))[:2], lambda x: x.f), ',') as decreasing from (
select case_id, [struct_pack(c := max_dpd_24m / 10 - 4.31, f := 'max_dpd_24m'), struct_pack(c := mean_dpd_24m / 10 - 1.07, f := 'mean_dpd_24m'),
  struct_pack(c := agg_dpd_count / 10 - 0.63, f := 'agg_dpd_count'), struct_pack(c := pct_dpd_payments_24m - 0.4013, f := 'pct_dpd_payments_24m')] as v from dx_matrix)""")
def _(spark, folder):
    from duepath.operators import modeling

    m = matrix(spark, folder, ["max_dpd_24m", "mean_dpd_24m", "agg_dpd_count", "pct_dpd_payments_24m"])
    c = F.array(*[F.struct(e.alias("contribution"), F.lit(n).alias("feature")) for e, n in (
        (F.col("max_dpd_24m") / 10 - 4.31, "max_dpd_24m"), (F.col("mean_dpd_24m") / 10 - 1.07, "mean_dpd_24m"),
        (F.col("agg_dpd_count") / 10 - 0.63, "agg_dpd_count"), (F.col("pct_dpd_payments_24m") - 0.4013, "pct_dpd_payments_24m"))])
    m = m.withColumn("c", c)
    return m.select("case_id", F.array_join(modeling.top_reasons(F.col("c"), 2).feature, ",").alias("increasing"),
                    F.array_join(modeling.top_reasons(F.col("c"), 2, False).feature, ",").alias("decreasing"))


@q("w11_rank_blend", """
select id, (rank() over (order by raw) + (count(*) over (partition by raw) - 1) / 2.0 + rank() over (order by wk) + (count(*) over (partition by wk) - 1) / 2.0) / 2 as blend from fx_scored""")
def _(spark, folder):
    return ranking.rank_blend(fx.scored(spark, folder), "id", ["raw", "wk"])


@q("w12_bureau_union", "select line_id, count(*) as n, round(sum(dpd), 4) as total_dpd from dx_bureau_pay group by line_id")
def _(spark, folder):
    from duepath.sources import bureau

    rows = bureau.union_payments({"a": fx.bureau_a(spark, folder), "b": fx.bureau_b(spark, folder)})
    return rows.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dpd"), 4).alias("total_dpd"))


@q("w13_last_payments", "select case_id, line_id, i, n from dx_cycles")
def _(spark, folder):
    return cycles(spark, folder).select("case_id", "line_id", "i", "n")


# -- M: discrimination, stability, drift ----------------------------------------------------------


@q("m01_auc", f"select cast(n as double) as n, cast(n_pos as double) as n_pos, round(auc, 9) as auc from ({auc_sql('fx_scored')})")
def _(spark, folder):
    return rounded(metrics.auc(fx.scored(spark, folder)).select("n", "n_pos", "auc"), 9)


@q("m02_weekly_gini", "select wk, cast(n as double) as n, round(2 * coalesce(auc, 0.5) - 1, 9) as gini from dx_weekly")
def _(spark, folder):
    return rounded(metrics.auc(fx.scored(spark, folder), ["wk"]).select("wk", "n", "gini"), 9)


STAB = """select count(*) as n_weeks, round(avg(g), 8) as mean_gini, round(regr_slope(g, x), 10) as slope,
  round(sqrt((regr_syy(g, x) - regr_sxy(g, x) * regr_sxy(g, x) / regr_sxx(g, x)) / count(*)), 8) as res_std,
  round(avg(g) + 88 * least(0, regr_slope(g, x)) - 0.5 * sqrt((regr_syy(g, x) - regr_sxy(g, x) * regr_sxy(g, x) / regr_sxx(g, x)) / count(*)), 7) as stability
from ({0})"""


def _stability_columns(df):
    return df.select("n_weeks", F.round("mean_gini", 8).alias("mean_gini"), F.round("slope", 10).alias("slope"),
                     F.round("res_std", 8).alias("res_std"), F.round("stability", 7).alias("stability"))


@q("m03_gini_stability", STAB.format("select cast(wk as double) as x, 2 * auc - 1 as g from dx_weekly where n >= 10 and auc is not null"))
def _(spark, folder):
    return _stability_columns(metrics.gini_stability(fx.scored(spark, folder)))


def vintage_table(spark, folder):
    return metrics.vintages(fx.scored(spark, folder), min_rows=150)


@q("m04_vintage_stability", STAB.format("select cast(row_number() over (order by vintage) - 1 as double) as x, gini as g from dx_vintages"))
def _(spark, folder):
    return _stability_columns(metrics.vintage_stability(vintage_table(spark, folder)))


@q("m05_signal_verdict", "select wk, case when g < 0.02 then 'NO SIGNAL' when g < 0.10 then 'WEAK' when g < 0.40 then 'REAL SIGNAL' else 'STRONG' end as verdict from (select wk, abs(2 * coalesce(auc, 0.5) - 1) as g from dx_weekly)")
def _(spark, folder):
    weekly = metrics.auc(fx.scored(spark, folder), ["wk"])
    return weekly.select("wk", metrics.verdict(F.abs("gini")).alias("verdict"))


UNI = ["max_dpd", "mean_dpd", "num_dpd_gt0", "total_overdue", "total_annuity", "monthly_income", "debt_to_income"]
UNI_LONG = " union all ".join(f"select '{c}' as feature, cast({c} as double) as value, target from dx_assembled where target is not null" for c in UNI)


@q("m06_univariate_gini", f"select feature, cast(n as bigint) as n, round(abs(2 * coalesce(auc, 0.5) - 1), 8) as abs_gini from ({auc_sql(f'({UNI_LONG})', 'feature', 'value')}) where n >= 10")
def _(spark, folder):
    return rounded(metrics.univariate_gini(assembled(spark, folder), UNI, min_rows=10), 8)


@q("a06_coverage_gini", f"""
select a.feature, cast(n as bigint) as n, round(abs(2 * coalesce(auc, 0.5) - 1), 8) as abs_gini, round(coverage_pct, 6) as coverage_pct
from ({auc_sql(f'(select feature, coalesce(value, 0) as value, target from ({UNI_LONG}))', 'feature', 'value')}) a
join (select feature, 100.0 * count(value) / count(*) as coverage_pct from ({UNI_LONG}) group by feature) c on c.feature = a.feature""")
def _(spark, folder):
    out = metrics.coverage_gini(assembled(spark, folder), UNI)
    return out.select("feature", "n", F.round("abs_gini", 8).alias("abs_gini"), F.round("coverage_pct", 6).alias("coverage_pct"))


BOTH = {"max_dpd": "max_dpd_24m", "mean_dpd": "mean_dpd_24m", "num_dpd_gt0": "num_dpd_events_24m", "monthly_income": "monthly_income"}


def two_matrices(spark, folder):
    a = matrix(spark, folder, list(BOTH.values())).select("case_id", *[F.col(v).alias(k) for k, v in BOTH.items()])
    b = assembled(spark, folder).select(F.col("case_id").cast("string").alias("case_id"), *BOTH)
    return a, b


PAIR = " union all ".join(
    f"select '{k}' as feature, cast(m.{v} as double) as a, cast(s.{k} as double) as b from dx_matrix m join dx_assembled s on cast(s.case_id as varchar) = m.case_id"
    for k, v in BOTH.items())


@q("m07_fidelity", f"""
select feature, round(avg(case when (a is null and b is null) or coalesce(abs(a - b) <= 1e-6 + 1e-4 * greatest(abs(b), 1), false) then 1.0 else 0.0 end), 8) as match_rate,
  round(avg(abs(a - b)), 6) as mean_abs_diff, round(corr(a, b), 8) as corr from ({PAIR}) group by feature""")
def _(spark, folder):
    out = metrics.fidelity(*two_matrices(spark, folder), list(BOTH))
    return out.select("feature", F.round("match_rate", 8).alias("match_rate"), F.round("mean_abs_diff", 6).alias("mean_abs_diff"), F.round("corr", 8).alias("corr"))


SPLIT["dx_drift"] = f"""
select feature, avg(a) as mean_a, avg(b) as mean_b, abs(avg(a) - avg(b)) / stddev_pop(a) as std_shift, corr(a, b) as corr from ({PAIR}) group by feature"""


@q("m08_drift", "select feature, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(std_shift, 8) as std_shift, round(corr, 8) as corr from dx_drift")
def _(spark, folder):
    out = metrics.drift(*two_matrices(spark, folder), list(BOTH))
    return out.select("feature", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("std_shift", 8).alias("std_shift"), F.round("corr", 8).alias("corr"))


@q("m09_parity_breaks", f"""
select case_id, feature, round(a, 6) as a, round(b, 6) as b from ({PAIR.replace("' as feature,", "' as feature, m.case_id,")})
where not ((a is null and b is null) or coalesce(abs(a - b) <= greatest(1e-6, 1e-4 * greatest(abs(a), abs(b))), false))""")
def _(spark, folder):
    return rounded(metrics.parity_breaks(*two_matrices(spark, folder), list(BOTH)))


SP = ["max_dpd", "mean_dpd", "total_overdue", "total_annuity"]
SPLIT["dx_ranks"] = "select case_id, " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in SP) + " from dx_assembled"


@q("m10_rank_correlation", " union all ".join(
    f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 8) as rho from dx_ranks" for i, x in enumerate(SP) for y in SP[i + 1:]))
def _(spark, folder):
    return rounded(metrics.spearman(assembled(spark, folder), "case_id", SP), 8)


def parity_matrix(spark, folder):
    """All parity features of the cases, to the six digits they are shown with, and the target where it is known."""
    labels = fx.base(spark, folder).select(F.col("case_id").cast("string").alias("case_id"), "target")
    return cut_lineage(shown(matrix(spark, folder, list(ft.PARITY_NAMES))).join(labels, "case_id", "left"), "parity")


NAMED = ", ".join(f"'{n}'" for n in ft.PARITY_NAMES)
SPLIT["dx_parity"] = f"""
select f.*, target from (select case_id, {", ".join(column_sql(n) for n in ft.PARITY_NAMES)} from dx_features) f
left join (select cast(case_id as varchar) as case_id, target from dx_base) b on b.case_id = f.case_id"""
SPLIT["dx_parity_long"] = f"select case_id, target, feature, value from (unpivot dx_parity on {', '.join(ft.PARITY_NAMES)} into name feature value value)"
SPLIT["dx_parity_ranks"] = """
select case_id, feature, list_position(names, feature) as no, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as r
from dx_parity_long, (select [""" + NAMED + """] as names)"""


# The queries above keep the columns of their SQL; those named _all take every parity feature.
@q("m06_univariate_gini_all", f"""
select feature, cast(n as bigint) as n, round(abs(2 * coalesce(auc, 0.5) - 1), 8) as abs_gini
from ({auc_sql('(select * from dx_parity_long where target is not null)', 'feature', 'value')}) where n >= 10""")
def _(spark, folder):
    return rounded(metrics.univariate_gini(parity_matrix(spark, folder), ft.PARITY_NAMES, min_rows=10), 8)


@q("m10_rank_correlation_all", f"""
with dx_pairs as (select a.name as x, b.name as y, a.no as i, b.no as j from (select unnest([{NAMED}]) as name, unnest(range(1, {len(ft.PARITY_NAMES) + 1})) as no) a
  join (select unnest([{NAMED}]) as name, unnest(range(1, {len(ft.PARITY_NAMES) + 1})) as no) b on a.no < b.no),
dx_rho as (select a.no as i, b.no as j, case when stddev_pop(a.r) > 0 and stddev_pop(b.r) > 0 then corr(a.r, b.r) end as rho
  from dx_parity_ranks a join dx_parity_ranks b on a.case_id = b.case_id and a.no < b.no group by a.no, b.no)
select x, y, round(rho, 8) as rho from dx_pairs left join dx_rho using (i, j)""")
def _(spark, folder):
    return rounded(metrics.spearman(parity_matrix(spark, folder), "case_id", ft.PARITY_NAMES), 8)


@q("m11_uncorrelated_features")
def _(spark, folder):
    rows = parity_matrix(spark, folder)
    kept = metrics.keep_uncorrelated(metrics.spearman(rows, "case_id", ft.PARITY_NAMES), metrics.univariate_gini(rows, ft.PARITY_NAMES))
    return spark.createDataFrame([(k, i) for i, k in enumerate(kept)], "feature string, place int")


@q("m12_gates", "select feature, case when std_shift > 0.5 then 'drift' when corr is null or corr < 0.30 then 'fidelity' else 'keep' end as gate from dx_drift")
def _(spark, folder):
    return metrics.gates(metrics.drift(*two_matrices(spark, folder), list(BOTH)), drift_max=0.5)


def rendered(spark, folder, names=ft.PARITY_NAMES):
    """The same history seen through the bureau and through the bank feed."""
    cyc, who = cut_lineage(cycles(spark, folder), "cycles"), fx.applicants(spark, folder)
    money = cyc.groupBy("case_id", "line_id").agg(F.max("instalment").alias("amount"))
    direct = ft.build(streams.cycles_as_payments(cyc), who, money.select("case_id", "amount"), fx.balances(spark, folder), names)
    txns, mandates = streams.cycles_as_transactions(cyc, who)
    # Both are read several times, and numbering the lines sorts all cycles.
    txns, mandates = cut_lineage(txns, "feed"), cut_lineage(mandates, "feed-mandates")
    feed = ft.build(streams.history_from_transactions(txns, mandates), who, mandates.select("case_id", "amount"), fx.balances(spark, folder), names)
    return feed, direct


@q("m07_round_trip_fidelity")
def _(spark, folder):
    feed, direct = rendered(spark, folder)
    return rounded(metrics.fidelity(feed, direct, ft.PARITY_NAMES), 6)


@q("m08_drift_all")
def _(spark, folder):
    return rounded(metrics.drift(*rendered(spark, folder), ft.PARITY_NAMES), 6)


@q("m09_parity_breaks_all")
def _(spark, folder):
    return rounded(metrics.parity_breaks(*rendered(spark, folder), ft.PARITY_NAMES))


@q("m12_gates_all")
def _(spark, folder):
    return metrics.gates(metrics.drift(*rendered(spark, folder), ft.PARITY_NAMES))


# -- A: reports -----------------------------------------------------------------------------------


@q("a05_column_profile", """
select 'dpd' as column_name, count(*) as n, count(try_cast(dpd_text as double)) as n_known, round(100.0 * (count(*) - count(try_cast(dpd_text as double))) / count(*), 6) as null_pct,
  count(*) filter (try_cast(dpd_text as double) <> 0) as n_nonzero, min(try_cast(dpd_text as double)) as min_value, max(try_cast(dpd_text as double)) as max_value,
  round(avg(try_cast(dpd_text as double)), 4) as mean_value from dx_bureau_a
union all select 'overdue', count(*), count(ovd), round(100.0 * (count(*) - count(ovd)) / count(*), 6), count(*) filter (ovd <> 0), round(min(ovd), 6), round(max(ovd), 6), round(avg(ovd), 4) from dx_bureau_a""")
def _(spark, folder):
    a = fx.bureau_a(spark, folder).withColumnsRenamed({"pmts_dpd_1073P": "dpd", "pmts_overdue_1140A": "overdue"})
    return rounded(reports.column_profile(a, ["dpd", "overdue"]).withColumn("mean_value", F.round("mean_value", 4)))


@q("a07_population_narrowing", """
with dx_l as (select distinct cast(case_id as varchar) as case_id from dx_base where target is not null), dx_s as (select distinct case_id from dx_bureau_pay),
dx_b as (select distinct case_id from dx_pay)
select (select count(*) from dx_l) as n_labelled, (select count(*) from dx_s) as n_streamable, (select count(*) from dx_b) as n_built,
  (select count(*) from dx_l semi join dx_s using (case_id)) as n_labelled_streamable, (select count(*) from dx_l semi join dx_b using (case_id)) as n_labelled_built,
  (select count(*) from dx_l semi join dx_s using (case_id) semi join dx_b using (case_id)) as n_all""")
def _(spark, folder):
    from duepath.sources import bureau

    labelled = fx.base(spark, folder).filter(F.col("target").isNotNull())
    pay = bureau.union_payments({"a": fx.bureau_a(spark, folder), "b": fx.bureau_b(spark, folder)})
    built = matrix(spark, folder, ["agg_dpd_count"]).filter(F.col("agg_dpd_count") > 0)
    return reports.narrowing(labelled, pay, built)


def cohort(spark, folder):
    return reports.cohort_labels(matrix(spark, folder, COHORT), COHORT)


@q("a08_cohort_labels", "select case_id, coverage, thickness, conduct, afford, label from dx_cohort")
def _(spark, folder):
    return cohort(spark, folder).select("case_id", "coverage", "thickness", "conduct", "afford", "label")


@q("a09_cohort_sentence", """
select case_id, concat_ws(', ', case when o <= 0 then 'no-file' when o <= 1 then 'ultra-thin' when o <= 2 then 'thin' when o <= 5 then 'medium' else 'thick' end,
  case when s >= 1 then 'serious arrears' when d >= 8 then 'late payments' when d > 0 then 'minor lateness' else 'clean conduct' end,
  case when debt_to_income > 0.6 then 'stretched' when debt_to_income > 0.3 then 'moderate leverage' when debt_to_income is not null then 'comfortable' end,
  case when cv_payment_amount > 0.5 then 'volatile income' end) as label
from (select *, coalesce(num_active_obligations, 0) as o, coalesce(num_serious_arrears_24m, 0) as s, coalesce(max_dpd_24m, 0) as d from dx_matrix)""")
def _(spark, folder):
    m = matrix(spark, folder, COHORT)
    return m.select("case_id", reports.cohort_sentence(m).alias("label"))


def scored_cohort(spark, folder):
    m = reports.cohort_labels(matrix(spark, folder, COHORT + ["mean_dpd_24m"]), COHORT)
    labels = fx.base(spark, folder).select(F.col("case_id").cast("string").alias("case_id"), "target")
    return m.withColumn("score", sc.pd_to_score(0.01 + F.col("mean_dpd_24m") / 100)).join(labels, "case_id", "left")


@q("a10_archetypes", """
select case when grouping(thickness) = 0 then 'thickness' when grouping(conduct) = 0 then 'conduct' else 'afford' end as grouping_key,
  coalesce(thickness, conduct, afford) as group_name, count(*) as n, round(avg(score), 6) as mean_score, round(min(score), 6) as min_score,
  round(max(score), 6) as max_score, round(avg(target), 6) as default_rate from dx_scored_cohort group by grouping sets ((thickness), (conduct), (afford))""")
def _(spark, folder):
    return rounded(reports.archetypes(scored_cohort(spark, folder)))


@q("a11_score_distribution", """
select count(score) as n, round(min(score), 6) as min_score, round(max(score), 6) as max_score, round(max(score) - min(score), 6) as spread,
  count(*) filter (score >= 720) as n_a, count(*) filter (score >= 660 and score < 720) as n_b, count(*) filter (score >= 600 and score < 660) as n_c,
  count(*) filter (score >= 540 and score < 600) as n_d, count(*) filter (score < 540) as n_e,
  round(quantile_cont(score, 0.05), 6) as p5, round(quantile_cont(score, 0.25), 6) as p25, round(quantile_cont(score, 0.5), 6) as p50,
  round(quantile_cont(score, 0.75), 6) as p75, round(quantile_cont(score, 0.95), 6) as p95 from dx_scored_cohort""")
def _(spark, folder):
    return rounded(reports.score_distribution(scored_cohort(spark, folder)))


@q("a12_cohort_summary", """
with dx_r as (select round(score, 1) as score from dx_scored_cohort)
select count(*) as n, count(distinct score) as n_distinct, max(score) as top_score, round(avg(case when score = (select max(score) from dx_r) then 1.0 else 0.0 end), 6) as share_at_top,
  round(avg(case when score >= 690.0 - 0.05 then 1.0 else 0.0 end), 6) as share_at_ceiling from dx_r""")
def _(spark, folder):
    rows = scored_cohort(spark, folder).select(F.round("score", 1).alias("score"))
    return rounded(reports.cohort_summary(rows, 690.0))


@q("a17_vintages", "select vintage, n, defaults, round(default_rate, 8) as default_rate, round(gini, 8) as gini from dx_vintages")
def _(spark, folder):
    return rounded(vintage_table(spark, folder), 8)


@q("a18_censoring", """
with dx_v as (select *, row_number() over (order by vintage) - 1 as t, count(*) over () as c, greatest(1, count(*) over () // 3) as third from dx_vintages),
dx_e as (select max(c) as n_vintages, avg(default_rate) filter (t < third) as early_rate, avg(default_rate) filter (t >= c - third) as late_rate from dx_v)
select n_vintages, round(early_rate, 8) as early_rate, round(late_rate, 8) as late_rate, case when late_rate > 0 and early_rate / late_rate > 1.25 then 'declining' else 'stable' end as verdict from dx_e""")
def _(spark, folder):
    return rounded(metrics.censoring(vintage_table(spark, folder)), 8)
