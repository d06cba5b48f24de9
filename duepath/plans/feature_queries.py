"""Queries for the 83 features: one per feature and one for the whole matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from duepath.operators import features as ft
from duepath.plans.registry import register
from duepath.sources import tables as fx

SQL: dict[str, str] = {
    "dx_pay": """
select p.case_id, line_id, pdate, tie, amount, overdue, greatest(coalesce(dpd, 0), 0) as v,
  pdate >= as_of - 182 as in6
from fx_payments p join fx_applicants a on a.case_id = p.case_id
where pdate between as_of - 730 and as_of""",
    "dx_inst": """
select case_id, line_id, quantile_cont(case when amount > 0 then amount end, 0.5) as inst24,
  quantile_cont(case when amount > 0 and in6 then amount end, 0.5) as inst6
from dx_pay group by all""",
    "dx_seq": """
select p.*, inst24, case when v > 0 then 1 else 0 end as late,
  case when v < 1 then 0 when v < 30 then 1 when v < 90 then 2 else 3 end as st,
  case when overdue is not null then greatest(overdue, 0) when inst24 is not null then greatest(inst24 - amount, 0) else 0 end as o24,
  case when in6 then case when overdue is not null then greatest(overdue, 0) when inst6 is not null then greatest(inst6 - amount, 0) else 0 end end as o6,
  row_number() over w - 1 as idx, count(*) over (partition by case_id, line_id) as n,
  lag(v) over w as v1, date_diff('day', lag(pdate) over w, pdate) as gap
from dx_pay p join dx_inst using (case_id, line_id)
window w as (partition by case_id, line_id order by pdate, tie)""",
    "dx_seq2": """
select *, lag(st) over w as st1, lag(late, 1) over w as late1, lag(late, 2) over w as late2, lag(late, 3) over w as late3,
  sum(1 - late) over (w rows unbounded preceding) as clean_no, sum(late) over (w rows unbounded preceding) as late_no,
  avg(late) over (partition by case_id, line_id) as late_share
from dx_seq window w as (partition by case_id, line_id order by idx)""",
    "dx_runs": """
select case_id, line_id, max(late_len) as late_len, max(clean_len) as clean_len from (
  select case_id, line_id, clean_no, late_no, sum(late) over (partition by case_id, line_id, clean_no) as late_len,
    sum(1 - late) over (partition by case_id, line_id, late_no) as clean_len from dx_seq2) group by all""",
    "dx_line": """
select case_id, line_id, max(n) as n, max(inst24) as inst, count(*) filter (in6) as n6,
  max(late_len) as late_len, max(clean_len) as clean_len,
  case when max(n) >= 3 then regr_slope(v, idx) end as dpd_trend_slope_24m,
  case when count(distinct pdate) >= 3 then stddev_pop(gap) filter (gap > 0) end as std_payment_interval_days,
  case when count(*) filter (amount > 0) >= 2 then stddev_pop(amount) filter (amount > 0) / abs(avg(amount) filter (amount > 0)) end as cv_payment_amount,
  case when max(n) >= 6 then regr_slope(v, idx) filter (idx >= n // 2) - regr_slope(v, idx) filter (idx < n // 2) end as dpd_acceleration_24m,
  case when max(n) >= 4 then avg(v) filter (idx >= n // 2) - avg(v) filter (idx < n // 2) end as dpd_recent_minus_old_24m,
  sum(pow(0.85, n - 1 - idx) * v) / sum(pow(0.85, n - 1 - idx)) as recency_weighted_dpd_24m,
  case when max(n) >= 3 then avg(late) filter (idx >= n - greatest(1, n // 3)) end as frac_late_recent_third_24m,
  max(n) - 1 - coalesce(max(idx) filter (late = 1), -1) as current_clean_streak_24m,
  case when max(n) >= 3 then case when max(late) = min(late) then 0 else sum((late - late_share) * (late1 - late_share)) / sum((late - late_share) * (late - late_share)) end end as dpd_late_autocorr_lag1_24m,
  case when max(n) >= 4 then case when max(late) = min(late) then 0 else sum((late - late_share) * (late2 - late_share)) / sum((late - late_share) * (late - late_share)) end end as dpd_late_autocorr_lag2_24m,
  case when max(n) >= 5 then case when max(late) = min(late) then 0 else coalesce(sum((late - late_share) * (late3 - late_share)), 0) / sum((late - late_share) * (late - late_share)) end end as dpd_late_autocorr_lag3_24m,
  case when max(n) >= 2 then avg(abs(v - v1)) end as dpd_mean_abs_change_24m,
  case when max(n) >= 2 then case when max(late) = min(late) then 0 else -(avg(late) * log2(avg(late)) + (1 - avg(late)) * log2(1 - avg(late))) end end as late_payment_entropy_24m,
  sum(late) filter (in6) as num_dpd_events_6m, avg(late) filter (in6) as pct_dpd_payments_6m,
  max(v) filter (in6) as max_dpd_6m, avg(v) filter (in6) as mean_dpd_6m,
  case when count(*) filter (in6) >= 3 then regr_slope(v, idx) filter (in6) end as dpd_trend_slope_6m,
  avg(o6) as avg_overdue_amount_6m, max(o6) as max_overdue_amount_6m,
  avg(case when o6 > 1.0 then 1.0 when o6 is not null then 0.0 end) as pct_overdue_payments_6m,
  avg(late) filter (in6) - avg(late) as pct_dpd_6m_minus_24m, avg(v) filter (in6) - avg(v) as mean_dpd_6m_minus_24m,
  avg(o6) - avg(o24) as avg_overdue_6m_minus_24m,
  avg(case when st = 0 then 1.0 else 0.0 end) filter (st1 = 0) as mk_p_stay_current_24m,
  avg(case when st > 0 then 1.0 else 0.0 end) filter (st1 = 0) as mk_p_current_to_late_24m,
  avg(case when st = 0 then 1.0 else 0.0 end) filter (st1 > 0) as mk_p_late_to_cure_24m,
  avg(case when st > st1 then 1.0 else 0.0 end) filter (st1 > 0) as mk_p_late_to_worse_24m,
  avg(case when st >= 2 then 1.0 else 0.0 end) filter (st1 >= 2) as mk_p_severe_persist_24m,
  count(*) filter (st > 0) / nullif(count(*) filter (st > 0 and coalesce(st1, 0) = 0), 0) as mk_mean_arrears_run_24m
from dx_seq2 join dx_runs using (case_id, line_id) group by case_id, line_id""",
    "dx_flat": """
select case_id, max(v) as max_dpd_24m, avg(v) as mean_dpd_24m, sum(late) as num_dpd_events_24m,
  count(*) filter (v >= 30) as num_serious_arrears_24m, avg(late) as pct_dpd_payments_24m,
  max(o24) as max_overdue_amount_24m, avg(o24) as avg_overdue_amount_24m, sum(o24) as total_overdue_amount,
  count(*) filter (o24 > 1.0) as num_overdue_payments_24m, avg(case when o24 > 1.0 then 1.0 else 0.0 end) as pct_overdue_payments_24m,
  count(distinct line_id) as num_active_obligations,
  count(*) as agg_dpd_count, avg(v) as agg_dpd_mean, max(v) as agg_dpd_max, min(v) as agg_dpd_min,
  stddev_pop(v) as agg_dpd_std, sum(v) as agg_dpd_sum, quantile_cont(v, 0.5) as agg_dpd_median,
  count(*) filter (v > 0) as agg_dpd_nonzero,
  first(v order by pdate, line_id, tie) as agg_dpd_first, last(v order by pdate, line_id, tie) as agg_dpd_last,
  count(gap) as agg_interval_count, avg(gap) as agg_interval_mean, max(gap) as agg_interval_max, min(gap) as agg_interval_min,
  stddev_pop(gap) as agg_interval_std, sum(gap) as agg_interval_sum, quantile_cont(gap, 0.5) as agg_interval_median,
  count(*) filter (gap > 0) as agg_interval_nonzero
from dx_seq group by case_id""",
    "dx_case": """
select case_id, max(late_len) as max_consecutive_dpd_24m, max(clean_len) as longest_clean_streak_24m,
  avg(columns(* exclude (case_id, line_id, n, n6, inst, late_len, clean_len)))
from dx_line group by case_id""",
    "dx_list": """
select case_id, amount from fx_instalments where amount <> 0
union all
select case_id, inst from dx_line where inst > 0 and case_id not in (select case_id from fx_instalments)""",
    "dx_instal": """
select case_id, count(*) as agg_instal_count, avg(amount) as agg_instal_mean, max(amount) as agg_instal_max,
  min(amount) as agg_instal_min, stddev_pop(amount) as agg_instal_std, sum(amount) as agg_instal_sum,
  quantile_cont(amount, 0.5) as agg_instal_median, count(*) filter (amount > 0) as agg_instal_nonzero
from dx_list group by case_id""",
    "dx_bal": """
select b.case_id, avg(balance) as mean_balance_3m, min(balance) as min_balance_3m
from fx_balances b join fx_applicants a on a.case_id = b.case_id
where acct_type in ('current', 'savings') and bdate between as_of - 91 and as_of group by b.case_id""",
    "dx_features": """
select a.* exclude (as_of, monthly_income, stated_income, income_type, education, housing, employment),
  f.* exclude (case_id), c.* exclude (case_id), i.* exclude (case_id), b.* exclude (case_id),
  agg_instal_sum as total_annuity, agg_instal_mean as avg_instalment_amount,
  coalesce(agg_instal_sum, 0) / monthly_income as debt_to_income,
  case when monthly_income is not null then coalesce(agg_instal_max, 0) / monthly_income end as payment_to_income,
  monthly_income,
  case when income_type is not null then case when regexp_matches(lower(income_type), 'salar|employ|wage|work|private_sector') then 1.0 else 0.0 end end as declared_income_is_employment,
  case when housing is not null then case when contains(lower(housing), 'own') then 1.0 else 0.0 end end as declared_is_homeowner,
  cast(cast(('0x' || md5(income_type)[1:6]) as bigint) as double) as declared_income_type_code,
  cast(cast(('0x' || md5(education)[1:6]) as bigint) as double) as declared_education_code,
  cast(cast(('0x' || md5(housing)[1:6]) as bigint) as double) as declared_housing_code,
  cast(cast(('0x' || md5(employment)[1:6]) as bigint) as double) as declared_employment_code,
  case when stated_income > 0 and monthly_income <> 0 then abs(stated_income - monthly_income) / greatest(abs(stated_income), abs(monthly_income)) end as declared_income_gap
from fx_applicants a left join dx_flat f using (case_id) left join dx_case c using (case_id)
left join dx_instal i using (case_id) left join dx_bal b using (case_id)""",
}


# Money averages often end in a 5 just after the last place shown, where two engines may round
# apart; both sides nudge them off the tie first.
MONEY_MEANS = ("avg_overdue_amount_24m", "avg_instalment_amount", "agg_instal_mean", "avg_overdue_amount_6m",
               "max_overdue_amount_6m", "avg_overdue_6m_minus_24m")
NUDGE = 1e-9


def column_sql(name: str) -> str:
    default = next(s.default for s in ft.SPECS if s.name == name)
    value = name if default is None else f"coalesce({name}, 0)"
    nudge = f" + {NUDGE!r}" if name in MONEY_MEANS else ""
    return f"round(cast({value} as double){nudge}, 6) as {name}"


def shown(df):
    def one(c):
        return F.round(F.col(c) + NUDGE if c in MONEY_MEANS else F.col(c), 6).alias(c)

    return df.select("case_id", *[one(c) for c in df.columns if c != "case_id"])


# The matrix with defaults filled, for other queries to build on.
SQL["dx_matrix"] = (
    "select case_id, "
    + ", ".join(
        n if next(s.default for s in ft.SPECS if s.name == n) is None else f"coalesce({n}, 0) as {n}" for n in ft.NAMES
    )
    + " from dx_features"
)


def matrix(spark, folder, names=ft.NAMES):
    return ft.build(
        fx.payments(spark, folder), fx.applicants(spark, folder), fx.instalments(spark, folder),
        fx.balances(spark, folder), names,
    )


def _one(name: str):
    return lambda spark, folder: shown(matrix(spark, folder, [name]))


for _i, _spec in enumerate(ft.SPECS, start=1):
    register(
        f"f{_i:02d}_{_spec.name}", f"select case_id, {column_sql(_spec.name)} from dx_features", SQL
    )(_one(_spec.name))

register(
    "feature_matrix", "select case_id, " + ", ".join(column_sql(n) for n in ft.NAMES) + " from dx_features", SQL
)(lambda spark, folder: shown(matrix(spark, folder)))
