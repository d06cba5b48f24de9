"""Queries for streams, schedules, missed cycles, income and the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from duepath.config import DEFAULT
from duepath.functions import clean
from duepath.operators import streams
from duepath.plans.feature_queries import SQL as FEATURE_SQL
from duepath.plans.raw_oracle import RAW
from duepath.plans.registry import register, rounded
from duepath.plans.source_queries import KIND
from duepath.session import cut_lineage
from duepath.sources import openbanking
from duepath.sources import tables as fx

CFG = DEFAULT


def q(name, sql=None, dates=()):
    return register(name, sql, {**RAW, **FEATURE_SQL}, dates)


def transactions(spark, folder):
    t = fx.feed(spark, folder)
    return t.select(
        "case_id", "txn_id", F.col("ts").cast("date").alias("tdate"), (-F.col("amount")).alias("amount"),
        F.coalesce(F.nullif(clean.payee(F.col("merchant"), F.col("description"), F.col("category")), F.lit("")), F.lit("unknown")).alias("payee"),
        F.lit("").alias("hint"),
    )


def inflows(spark, folder):
    return transactions(spark, folder).withColumn("amount", -F.col("amount"))


def detected(spark, folder):
    return streams.detect(transactions(spark, folder), CFG)


def bank_lines(spark, folder):
    found, paid = detected(spark, folder)
    lines, seeded = streams.seed_mandates(fx.feed_mandates(spark, folder), found, transactions(spark, folder))
    return found, lines, paid.unionByName(seeded)


@q("c06_recurring_streams", "select case_id, payee, cast(bucket as double) as bucket, n, period, round(cv, 6) as cv, opened, " + KIND.format("payee") + " as kind from dx_streams", ("opened",))
def _(spark, folder):
    found, _ = detected(spark, folder)
    return rounded(found.select("case_id", "payee", F.col("bucket").cast("double").alias("bucket"), "n", "period", "cv", "opened", "kind"))


@q("c07_seeded_mandates", """
select u.case_id, concat('mandate::', u.payee, '#', u.no) as line_id, count(t.txn_id) as n_payments, round(max(u.amount), 6) as scheduled
from dx_unseen u left join dx_txn t on t.case_id = u.case_id and t.payee = u.payee and t.amount > 0 group by all""")
def _(spark, folder):
    _, lines, paid = bank_lines(spark, folder)
    counts = paid.groupBy("case_id", "line_id").agg(F.count(F.lit(1)).alias("n_payments"))
    out = lines.join(counts, ["case_id", "line_id"], "left").select(
        "case_id", "line_id", F.coalesce("n_payments", F.lit(0)).alias("n_payments"), F.col("scheduled"))
    return rounded(out)


@q("c08_feed_instalments", """
select case_id, round(amount, 6) as amount from fx_feed_mandates
union all select case_id, round(quantile_cont(amount, 0.5), 6) from dx_lines_pay where case_id not in (select case_id from fx_feed_mandates) group by case_id, line_id""")
def _(spark, folder):
    _, _, paid = bank_lines(spark, folder)
    return rounded(streams.instalments(fx.feed_mandates(spark, folder), paid))


@q("c09_scheduled_instalment", "select case_id, line_id, round(quantile_cont(amount, 0.5), 6) as instalment from fx_payments where amount > 0 group by case_id, line_id")
def _(spark, folder):
    return rounded(streams.scheduled_instalment(fx.payments(spark, folder)))


@q("c10_overdue_amounts", "select case_id, line_id, tie, round(o24, 6) as o24, round(o6, 6) as o6 from dx_seq")
def _(spark, folder):
    from duepath.operators.features import PaymentWindow

    w = PaymentWindow(fx.payments(spark, folder), fx.applicants(spark, folder))
    return rounded(w.rows.select("case_id", "line_id", "tie", "o24", "o6"))


@q("c11_schedule_fit", """
select case_id, line_id, pdate, anchor, period, cast(cycle as bigint) as cycle, anchor + expected_off as expected, off from dx_fit""", ("pdate", "anchor", "expected"))
def _(spark, folder):
    p = streams.Schedule(fx.payments(spark, folder)).points()
    return p.select("case_id", "line_id", "pdate", "anchor", "period", F.col("cycle").cast("bigint").alias("cycle"), "expected", "off")


@q("c12_skipped_cycles", "select case_id, line_id, cast(sum(case when gap is not null then step - 1 else 0 end) as bigint) as n_skipped from dx_fit group by case_id, line_id")
def _(spark, folder):
    return streams.Schedule(fx.payments(spark, folder)).skipped()


@q("c13_late_flags", "select case_id, line_id, count(*) as n_points, count(*) filter (late) as n_late from dx_fit group by case_id, line_id")
def _(spark, folder):
    p = streams.Schedule(fx.payments(spark, folder)).points()
    return p.groupBy("case_id", "line_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("late").alias("n_late"))


@q("c14_inferred_dpd", """
select p.case_id, p.line_id, p.tie, case when p.dpd is not null then p.dpd
  when count(*) over (partition by p.case_id, p.line_id) = 1 then null else cast(least(greatest(coalesce(f.off, 0), 0), 90) as double) end as dpd
from fx_payments p left join dx_fit f on f.case_id = p.case_id and f.line_id = p.line_id and f.pdate = p.pdate""")
def _(spark, folder):
    return streams.Schedule(fx.payments(spark, folder)).with_dpd().select("case_id", "line_id", "tie", "dpd")


@q("c15_missed_cycles", "select case_id, line_id, pdate, 90.0 as dpd, round(overdue, 6) as overdue from dx_missed", ("pdate",))
def _(spark, folder):
    return rounded(streams.missed_cycles(fx.payments(spark, folder)).select("case_id", "line_id", "pdate", "dpd", "overdue"))


@q("c16_income_detection", """
select case_id, round(coalesce(max(monthly) filter (salary_named), max(monthly)), 6) as monthly_income from dx_income_streams group by case_id""")
def _(spark, folder):
    return rounded(streams.monthly_income(inflows(spark, folder), CFG))


@q("c17_monthly_value", "select case_id, payee, round(typical, 6) as typical, period, round(monthly, 6) as monthly, salary_named from dx_income_streams")
def _(spark, folder):
    return rounded(streams.income_streams(inflows(spark, folder), CFG).select("case_id", "payee", "typical", "period", "monthly", "salary_named"))


@q("c18_delinquency_profile", """
with dx_prof0 as (select *, row_number() over w - 1 as idx, greatest(off, 0) as days, sum(late::int) over (w rows unbounded preceding) as late_no,
    min(case when not late then pdate end) over (partition by case_id, line_id order by pdate rows between current row and unbounded following) as next_ok
  from dx_fit window w as (partition by case_id, line_id order by pdate)),
dx_prof1 as (select *, sum(1 - late::int) over (partition by case_id, line_id, late_no) as run from dx_prof0)
select case_id, line_id, count(*) as n_payments, count(*) filter (late) as n_late, cast(sum(case when gap is not null then step - 1 else 0 end) as bigint) as n_missed,
  cast(max(run) as bigint) as longest_ontime, round_even(avg(case when late then date_diff('day', pdate, next_ok) end), 0) as days_to_recover,
  round(case when count(*) >= 3 then stddev_pop(gap) end, 6) as interval_sd, round(case when count(*) >= 3 then regr_slope(days, idx) end, 6) as dpd_slope,
  cast(sum(days) + sum(case when gap is not null then step - 1 else 0 end) * 90 as double) as capped_dpd_sum
from dx_prof1 group by case_id, line_id""")
def _(spark, folder):
    return rounded(streams.profile(fx.payments(spark, folder)))


CYCLE_COLS = "case_id, line_id, i, n, due, round(instalment, 6) as instalment, round(dpd, 6) as dpd, round(overdue, 6) as overdue"


def cycles(spark, folder):
    return streams.to_cycles(fx.payments(spark, folder), fx.applicants(spark, folder), fx.instalments(spark, folder))


def written_cycles(spark, folder):
    """The cycles as a table: their lines are numbered and counted before they are read again."""
    return cut_lineage(cycles(spark, folder), "cycles")


@q("c19_history_to_cycles", f"select {CYCLE_COLS} from dx_cycles", ("due",))
def _(spark, folder):
    return rounded(cycles(spark, folder).drop("as_of"))


@q("c20_cycles_as_bureau", "select case_id, line_id, due as pdate, cast(i as bigint) as tie, round(overdue, 6) as overdue, round(dpd, 6) as dpd from dx_cycles", ("pdate",))
def _(spark, folder):
    return rounded(streams.cycles_as_payments(cycles(spark, folder)).drop("amount"))


@q("c21_cycles_as_transactions", """
with dx_no as (select case_id, line_id, dense_rank() over (partition by case_id order by line_id) - 1 as line_no from dx_cycles)
select c.case_id, concat('loan ', chr(cast(97 + line_no as int))) as payee, due + cast(floor(dpd) as int) as tdate, round(instalment, 6) as amount
from dx_cycles c join (select distinct * from dx_no) n on n.case_id = c.case_id and n.line_id = c.line_id where dpd < 15
union all
select case_id, 'acme corp salary', as_of - cast(30 * (13 - m) as int), -round(monthly_income, 6) from fx_applicants, range(0, 14) r(m) where monthly_income > 0""", ("tdate",))
def _(spark, folder):
    txns, _ = streams.cycles_as_transactions(written_cycles(spark, folder), fx.applicants(spark, folder))
    return rounded(txns.select("case_id", "payee", "tdate", "amount"))


@q("c21_cycle_mandates", """
select case_id, concat('loan ', chr(cast(97 + dense_rank() over (partition by case_id order by line_id) - 1 as int))) as payee, round(max(instalment), 6) as amount
from dx_cycles group by case_id, line_id""")
def _(spark, folder):
    _, mandates = streams.cycles_as_transactions(written_cycles(spark, folder), fx.applicants(spark, folder))
    return rounded(mandates)


@q("c22_resolved_cycles", """
select case_id, line_id, i, least(greatest(dpd, 0), 90) as dpd, round(case when o is not null then greatest(o, 0) when dpd >= 90 then instalment else 0 end, 6) as overdue
from (select *, case when i % 2 = 0 then overdue end as o from dx_cycles)""")
def _(spark, folder):
    half_known = cycles(spark, folder).withColumn("overdue", F.when(F.col("i") % 2 == 0, F.col("overdue")))
    return rounded(streams.resolve_cycles(half_known).select("case_id", "line_id", "i", "dpd", "overdue"))


@q("a13_connection_thickness", """
select cast(o_custkey as varchar) as case_id, count(distinct o_orderkey // 50 % 2) as accounts,
  count(distinct case when (o_orderkey // 50) % 3 = 2 then o_orderkey // 50 % 2 end) as credit_accounts,
  count(*) filter (o_orderkey % 4 in (1, 2)) as mandates, count(*) as transactions from orders group by o_custkey""")
def _(spark, folder):
    t = openbanking.thickness(openbanking.parse_payloads(fx.account_payloads(spark, folder)))
    return t.select("case_id", "accounts", "credit_accounts", F.col("mandates").cast("bigint").alias("mandates"), F.col("transactions").cast("bigint").alias("transactions"))


@q("a14_realised_history", """
select case_id, min(cast(ts as date)) as history_start, max(cast(ts as date)) as history_end, date_diff('day', min(cast(ts as date)), max(cast(ts as date))) as history_days,
  round(date_diff('day', min(cast(ts as date)), max(cast(ts as date))) / 30.44, 1) as months_of_history, count(*) as history_transactions,
  round(date_diff('day', min(cast(ts as date)), max(cast(ts as date))) / 30.44, 1) > 61.0 as too_long
from fx_transactions group by case_id""", ("history_start", "history_end"))
def _(spark, folder):
    from duepath.operators import reports

    rows = fx.transactions(spark, folder).select("case_id", F.col("ts").cast("date").alias("tdate"))
    return reports.realised_history(rows, months_requested=60)


@q("a15_credit_accounts", """
select o_custkey as case_id, count(distinct case when regexp_matches(lower(o_orderpriority), 'credit|card|loan|mortgage|overdraft') or o_orderkey % 5 = 0 then o_orderkey % 100 end) as credit_accounts
from orders group by o_custkey""")
def _(spark, folder):
    from duepath.operators import reports

    o = fx.table(spark, folder, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "MY CREDIT LINE").otherwise(F.col("o_orderpriority"))
    rows = o.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 100).alias("account_id"), kind.alias("kind"))
    return reports.credit_account_count(rows)


@q("a16_robust_stats", """
with dx_dev as (select case_id, line_id, amount, quantile_cont(amount, 0.5) over (partition by case_id, line_id) as med from fx_payments where amount > 0)
select case_id, line_id, count(*) as n, round(max(med), 6) as median,
  round(case when count(*) >= 2 then quantile_cont(abs(amount - med), 0.5) * 1.4826 else 0 end, 6) as mad,
  round(case when count(*) < 2 then 0 else stddev_pop(amount) / abs(avg(amount)) end, 6) as cv from dx_dev group by case_id, line_id""")
def _(spark, folder):
    rows = fx.payments(spark, folder).filter(F.col("amount") > 0)
    return rounded(streams.robust_stats(rows, ["case_id", "line_id"], "amount"))
