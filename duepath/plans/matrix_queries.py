"""The 83 features straight from the sources: bureau tables or a bank feed to the matrix as one job."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from duepath.operators import features as ft
from duepath.operators import streams
from duepath.plans.feature_queries import SQL as FEATURE_SQL
from duepath.plans.feature_queries import column_sql, shown
from duepath.plans.history_queries import transactions
from duepath.plans.raw_oracle import RAW
from duepath.plans.registry import register
from duepath.sources import bureau
from duepath.sources import tables as fx

ALL = "select case_id, " + ", ".join(column_sql(n) for n in ft.NAMES) + " from dx_features"
AS_OF = "2023-09-01"

# The canonical tables of each source take the place of the shared ones; the feature SQL stays the same.
BUREAU = {
    "fx_payments": "select * from dx_bureau_pay",
    "fx_applicants": """
select b.case_id, as_of, monthly_income, stated_income, income_type, education, housing, employment
from (select cast(case_id as varchar) as case_id, as_of from dx_base) b left join dx_income i using (case_id) left join dx_declared d using (case_id)""",
    "fx_instalments": "select cast(case_id as varchar) as case_id, annuity_853a as amount from dx_applprev where annuity_853a is not null",
    "fx_balances": """
select cast(o_custkey as varchar) as case_id, 'current' as acct_type, date '2001-08-01' as bdate, arg_min(o_totalprice / 100, o_orderkey) as balance
from orders where o_orderkey % 3 = 0 and o_orderkey % 2 = 0 and o_custkey in (select case_id from dx_base) group by o_custkey""",
}

# The schedule of the feed's own lines: the shared views once more, over its payments.
SCHEDULE = [n for n in RAW if re.match(r"dx_(dates|fit\d?|all\d|missed)$", n)]


def _of_feed(text: str) -> str:
    text = re.sub(r"\bdx_(dates|fit\d?|all\d|missed)\b", r"dx_feed_\1", text)
    return re.sub(r"\bfx_payments\b", "dx_feed_paid", text)


FEED = {_of_feed(n): _of_feed(RAW[n]) for n in SCHEDULE} | {
    "dx_feed_paid": "select case_id, line_id, pdate, tie, amount, cast(null as double) as overdue, cast(null as double) as dpd from dx_lines_pay",
    "fx_payments": """
select p.case_id, p.line_id, p.pdate, p.tie, p.amount, p.overdue, case when count(*) over (partition by p.case_id, p.line_id) = 1 then null
  else cast(least(greatest(coalesce(f.off, 0), 0), 90) as double) end as dpd
from dx_feed_paid p left join dx_feed_fit f on f.case_id = p.case_id and f.line_id = p.line_id and f.pdate = p.pdate
union all select case_id, line_id, pdate, -1, 0.0, overdue, 90.0 from dx_feed_missed""",
    "fx_applicants": f"""
select c.case_id, date '{AS_OF}' as as_of, monthly_income, cast(null as double) as stated_income, cast(null as varchar) as income_type,
  cast(null as varchar) as education, cast(null as varchar) as housing, cast(null as varchar) as employment
from (select distinct case_id from fx_feed) c left join (
  select case_id, coalesce(max(monthly) filter (salary_named), max(monthly)) as monthly_income from dx_income_streams group by case_id) i using (case_id)""",
    "fx_instalments": """
select case_id, amount from fx_feed_mandates
union all select case_id, quantile_cont(amount, 0.5) from dx_lines_pay where case_id not in (select case_id from fx_feed_mandates) group by case_id, line_id""",
    "fx_balances": """
select cast(user_id as varchar) as case_id, case event_id % 3 when 0 then 'savings' when 1 then 'current' else 'card' end as acct_type,
  date '2023-01-01' + cast(floor((epoch(ts) - 1704067200) / 10800) as int) as bdate, value * 20 - 300 as balance from events where event_type = 'purchase'""",
}


def bureau_tables(spark, folder) -> bureau.Canonical:
    return bureau.canonical(
        {"a": fx.bureau_a(spark, folder), "b": fx.bureau_b(spark, folder)}, fx.base(spark, folder), fx.static_0(spark, folder), fx.static_cb_0(spark, folder),
        fx.applprev(spark, folder), fx.person(spark, folder), fx.debitcard(spark, folder))


def feed_tables(spark, folder) -> bureau.Canonical:
    rows = transactions(spark, folder)
    payments, instalments, income = streams.feed_history(rows, fx.feed_mandates(spark, folder))
    cases = rows.select("case_id").distinct().withColumn("as_of", F.lit(AS_OF).cast("date"))
    unknown = {c: F.lit(None).cast("string") for c in ("income_type", "education", "housing", "employment")}
    applicants = cases.join(income, "case_id", "left").withColumns({"stated_income": F.lit(None).cast("double"), **unknown})
    return bureau.Canonical(payments, applicants, instalments, fx.feed_balances(spark, folder))


def features_of(c: bureau.Canonical):
    return ft.build(c.payments, c.applicants, c.instalments, c.balances)


@register("bureau_matrix", ALL, {**RAW, **FEATURE_SQL, **BUREAU})
def _(spark, folder):
    return shown(features_of(bureau_tables(spark, folder)))


@register("payload_matrix", ALL, {**RAW, **FEATURE_SQL, **FEED})
def _(spark, folder):
    return shown(features_of(feed_tables(spark, folder)))
