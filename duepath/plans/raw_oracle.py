"""DuckDB twins of the raw bureau tables and of what is made of them."""

RAW: dict[str, str] = {
    "dx_bureau_a": """
select o_custkey as case_id, l_linenumber % 3 as num_group1, l_orderkey * 10 + l_linenumber as num_group2,
  case when l_partkey % 51 <> 0 then year(l_shipdate) end as y,
  case when l_partkey % 50 = 0 then 13 else month(l_shipdate) end as m,
  case when l_suppkey % 10 = 0 then 'n/a' else cast(cast(trunc(l_quantity * 4 - 20) as int) as varchar) end as dpd_text,
  l_extendedprice * l_discount - 100 as ovd
from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'O'""",
    "dx_bureau_b": """
select o_custkey as case_id, l_linenumber % 3 as num_group1, l_orderkey * 10 + l_linenumber as num_group2,
  case when l_partkey % 40 <> 0 then cast(l_shipdate as date) end as d,
  case when l_partkey % 30 = 0 then 185124192.0 when l_returnflag = 'R' then l_quantity end as dpd_raw,
  case when l_returnflag <> 'N' then l_extendedprice * l_tax end as ovd
from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'F'""",
    "dx_bureau_pay": """
select cast(case_id as varchar) as case_id, concat('a:', num_group1) as line_id, make_date(y, m, 1) as pdate, num_group2 as tie,
  0.0 as amount, greatest(ovd, 0) as overdue, least(greatest(coalesce(try_cast(dpd_text as double), 0), 0), 90) as dpd
from dx_bureau_a where y is not null and m between 1 and 12
union all
select cast(case_id as varchar), concat('b:', num_group1), d, num_group2, 0.0, greatest(coalesce(ovd, 0), 0),
  least(greatest(coalesce(dpd_raw, 0), 0), 90) from dx_bureau_b where d is not null""",
    "dx_applprev": """
select o_custkey as case_id, o_orderkey as num_group1, case when o_orderkey % 7 <> 0 then o_totalprice / 120 end as annuity_853a,
  case when o_orderkey % 5 = 0 then 'x' else cast(o_orderkey % 1000 - 100 as varchar) end as annuity_780a
from orders""",
    "dx_income": """
select case_id, coalesce(max(v) filter (r = 0), max(v) filter (r = 1)) as monthly_income from (
  select cast(c_custkey as varchar) as case_id, 0 as r, case when c_acctbal > 0 then c_acctbal end as v from customer where c_custkey % 3 = 0
  union all select cast(c_custkey as varchar), 1, abs(c_acctbal) + 7 from customer where c_custkey % 2 = 0)
where v is not null group by case_id""",
    "dx_declared": """
select cast(c_custkey as varchar) as case_id, case when c_acctbal > 0 then c_acctbal end as stated_income,
  c_mktsegment as income_type, case when c_custkey % 5 <> 0 then concat('edu', c_nationkey) end as education,
  case when c_nationkey % 2 = 0 then 'OWNED' else 'RENTED' end as housing, cast(null as varchar) as employment from customer""",
    "dx_base": """
select c_custkey as case_id, date '2001-08-01' as as_of,
  case when c_custkey % 11 <> 0 then case when c_acctbal < 2000 then 1 else 0 end end as target, c_custkey % 40 as wk
from customer where c_custkey % 10 <> 9""",
    "dx_part": """
select case_id, least(greatest(try_cast(dpd_text as double), 0), 90) as d, greatest(ovd, 0) as o from dx_bureau_a
union all
select case_id, case when dpd_raw is not null then least(greatest(dpd_raw, 0), 90) end,
  case when ovd is not null then greatest(ovd, 0) end from dx_bureau_b""",
    "dx_bureau_case": """
select case_id, max(d) as max_dpd, coalesce(sum(d), 0) / count(*) as mean_dpd, count(*) filter (d > 0) as num_dpd_gt0,
  count(*) filter (d >= 30) as num_dpd_ge30, max(o) as max_overdue, coalesce(sum(o), 0) as total_overdue, count(*) as num_bureau_payments
from dx_part group by case_id""",
    "dx_appl_case": """
select case_id, coalesce(sum(a), 0) as total_annuity, max(a) as max_annuity, count(*) as num_prev_apps from (
  select case_id, case when coalesce(annuity_853a, try_cast(annuity_780a as double)) is not null
    then greatest(coalesce(annuity_853a, -1e300), coalesce(try_cast(annuity_780a as double), -1e300), 0) end as a from dx_applprev)
group by case_id""",
    "dx_income_max": """
select case_id, max(v) as monthly_income from (
  select c_custkey as case_id, case when c_acctbal > 0 then c_acctbal end as v from customer where c_custkey % 3 = 0
  union all select c_custkey, abs(c_acctbal) + 7 from customer where c_custkey % 2 = 0) group by case_id""",
    "dx_assembled": """
select b.case_id, b.target, b.wk, coalesce(max_dpd, 0) as max_dpd, coalesce(mean_dpd, 0) as mean_dpd, coalesce(num_dpd_gt0, 0) as num_dpd_gt0,
  coalesce(num_dpd_ge30, 0) as num_dpd_ge30, coalesce(max_overdue, 0) as max_overdue, coalesce(total_overdue, 0) as total_overdue,
  coalesce(num_bureau_payments, 0) as num_bureau_payments, coalesce(total_annuity, 0) as total_annuity,
  coalesce(max_annuity, 0) as max_annuity, coalesce(num_prev_apps, 0) as num_prev_apps, monthly_income,
  case when monthly_income > 0 then coalesce(total_annuity, 0) / monthly_income end as debt_to_income
from dx_base b left join dx_bureau_case using (case_id) left join dx_appl_case using (case_id) left join dx_income_max using (case_id)""",
    # transactions with a normalised payee, money out positive
    "dx_txn": "select case_id, txn_id, tdate, -amount as amount, payee from fx_feed",
    "dx_gap": """
select *, round_even(amount, 0) as bucket,
  date_diff('day', lag(tdate) over (partition by case_id, payee, round_even(amount, 0) order by tdate, txn_id), tdate) as gap
from dx_txn where amount > 0""",
    "dx_streams": """
select case_id, payee, bucket, count(*) as n, quantile_cont(gap, 0.5) as period, stddev_pop(amount) / abs(avg(amount)) as cv, min(tdate) as opened
from dx_gap group by case_id, payee, bucket
having count(*) >= 3 and quantile_cont(gap, 0.5) between 20 and 400 and stddev_pop(amount) / abs(avg(amount)) <= 0.35""",
    "dx_unseen": """
select m.*, row_number() over (partition by case_id, payee order by amount) - 1 as no
from fx_feed_mandates m where (case_id, payee) not in (select (case_id, payee) from dx_streams)""",
    "dx_lines_pay": """
select g.case_id, concat('stream::', g.payee, '#', cast(cast(g.bucket as bigint) as varchar)) as line_id, g.tdate as pdate, g.txn_id as tie, g.amount
from dx_gap g join dx_streams s on g.case_id = s.case_id and g.payee = s.payee and g.bucket = s.bucket
union all
select t.case_id, concat('mandate::', t.payee, '#', u.no), t.tdate, t.txn_id, t.amount
from dx_unseen u join dx_txn t on t.case_id = u.case_id and t.payee = u.payee where t.amount > 0""",
    # schedule over the distinct dates of the payments that came from the card-like lines
    "dx_dates": "select distinct case_id, line_id, pdate from fx_payments",
    "dx_fit0": """
select *, date_diff('day', lag(pdate) over w, pdate) as gap, min(pdate) over (partition by case_id, line_id) as anchor
from dx_dates window w as (partition by case_id, line_id order by pdate)""",
    "dx_fit1": """
select *, quantile_cont(gap, 0.5) over (partition by case_id, line_id) as period from dx_fit0""",
    "dx_fit2": """
select *, case when gap is null then 0 else greatest(1, cast(round_even(gap / period, 0) as int)) end as step from dx_fit1 where period is not null""",
    "dx_fit3": """
select *, sum(step) over (partition by case_id, line_id order by pdate rows unbounded preceding) as cycle from dx_fit2""",
    "dx_fit": """
select *, cast(round_even(cycle * period, 0) as int) as expected_off,
  date_diff('day', anchor, pdate) - cast(round_even(cycle * period, 0) as int) as off,
  date_diff('day', anchor, pdate) - cast(round_even(cycle * period, 0) as int) > greatest(3.0, 0.1 * period) as late
from dx_fit3""",
    "dx_all0": """
select *, date_diff('day', lag(pdate) over w, pdate) as gap, min(pdate) over (partition by case_id, line_id) as anchor,
  count(*) over (partition by case_id, line_id) as n_line,
  quantile_cont(case when amount > 0 then amount end, 0.5) over (partition by case_id, line_id) as instalment
from fx_payments window w as (partition by case_id, line_id order by pdate, tie)""",
    "dx_all1": "select *, quantile_cont(gap, 0.5) over (partition by case_id, line_id) as period from dx_all0",
    "dx_all2": """
select *, case when gap is null then 0 else greatest(1, cast(round_even(gap / period, 0) as int)) end as step from dx_all1
where n_line >= 3 and period > 0 and instalment > 0""",
    "dx_all3": """
select *, sum(step) over (partition by case_id, line_id order by pdate, tie rows unbounded preceding) as cycle from dx_all2""",
    "dx_missed": """
select case_id, line_id, anchor + cast(round_even(c * period, 0) as int) as pdate, instalment as overdue from (
  select distinct case_id, line_id, anchor, period, instalment, unnest(range(0, cast(max(cycle) over (partition by case_id, line_id) as bigint) + 1)) as c from dx_all3) g
where not exists (select 1 from dx_all3 p where p.case_id = g.case_id and p.line_id = g.line_id and p.cycle = g.c)""",
    "dx_credit": """
select *, case when date_diff('day', lag(tdate) over w, tdate) > 0 then date_diff('day', lag(tdate) over w, tdate) end as gap
from (select case_id, payee, txn_id, tdate, -amount as amount from dx_txn where amount < 0)
window w as (partition by case_id, payee order by tdate, txn_id)""",
    "dx_income_streams": """
select *, case when period between 26 and 35 then typical else typical * (30.44 / period) end as monthly,
  regexp_matches(payee, '\\b(salary|salaries|payroll|wages?|hmrc|net\\s*pay|paye)\\b') as salary_named from (
  select case_id, payee, count(*) as n, count(gap) as n_gaps, quantile_cont(gap, 0.5) as period, quantile_cont(amount, 0.5) as typical,
    stddev_pop(amount) / abs(avg(amount)) as cv from dx_credit group by case_id, payee)
where n >= 3 and n_gaps >= 2 and period between 5 and 40 and cv <= 0.35
  and case when period between 26 and 35 then typical else typical * (30.44 / period) end >= 100""",
    "dx_cycles0": """
select p.*, row_number() over (partition by case_id, line_id order by pdate desc, tie desc) as back,
  count(*) over (partition by case_id, line_id) as n_all from fx_payments p""",
    "dx_typical": "select case_id, quantile_cont(amount, 0.5) as typical from fx_instalments where amount > 0 group by case_id",
    # two digits, halves to the even one, of the number as it is written
    "dx_pence": """
select case_id, cast((floor(d * 100) + case when d * 100 - floor(d * 100) > 0.5 then 1 when d * 100 - floor(d * 100) = 0.5 then floor(d * 100) % 2 else 0 end) as double) / 100 as pence
from (select case_id, cast(cast(typical as varchar) as decimal(30, 15)) as d from dx_typical)""",
    "dx_cycles": """
select c.case_id, line_id, as_of, cast(least(n_all, 22) - back as int) as i, cast(least(n_all, 22) as int) as n,
  as_of + cast(30 * (least(n_all, 22) - back) - 30 * least(n_all, 22) as int) as due,
  coalesce(pence, 100.0) as instalment, least(greatest(coalesce(dpd, 0), 0), 90) as dpd, greatest(coalesce(overdue, 0), 0) as overdue
from dx_cycles0 c join fx_applicants a on a.case_id = c.case_id left join dx_pence t on t.case_id = c.case_id where back <= 22""",
}
