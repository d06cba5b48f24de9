"""The same views in DuckDB's SQL, for the side-by-side check."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "fx_applicants": """
select cast(c_custkey as varchar) as case_id, date '2001-08-01' as as_of,
  case when c_acctbal > 1000 then c_acctbal end as monthly_income,
  case when c_custkey % 4 <> 0 then abs(c_acctbal) * 1.1 end as stated_income,
  case when c_custkey % 5 <> 0 then c_mktsegment end as income_type,
  case when c_custkey % 3 <> 0 then concat('edu ', cast(c_nationkey as varchar)) end as education,
  case when c_custkey % 7 <> 0 then case when c_nationkey % 2 = 0 then 'Owned' else 'Rented' end end as housing,
  case when c_custkey % 6 <> 0 then concat('band ', cast(c_custkey % 9 as varchar)) end as employment
from customer""",
    "fx_payments": """
select cast(o_custkey as varchar) as case_id, l_linestatus as line_id, cast(l_shipdate as date) as pdate,
  (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as tie,
  case when l_returnflag = 'N' then l_extendedprice / 100 else 0.0 end as amount,
  case when l_returnflag = 'R' then l_extendedprice * l_discount when l_returnflag = 'A' then 0.0 end as overdue,
  case when l_returnflag = 'R' then least(l_quantity * 2, 90.0)
       when l_returnflag = 'A' and l_quantity <= 10 then l_quantity when l_returnflag = 'A' then 0.0 end as dpd
from lineitem join orders on l_orderkey = o_orderkey""",
    "fx_instalments": """
select cast(o_custkey as varchar) as case_id, o_totalprice / 120 as amount from orders where o_orderstatus = 'O'""",
    "fx_balances": """
select cast(o_custkey as varchar) as case_id, concat('acc', cast(o_orderkey % 2 as varchar)) as account_id,
  case o_orderkey % 3 when 0 then 'savings' when 1 then 'current' else 'card' end as acct_type,
  cast(o_orderdate as date) as bdate, o_totalprice / 10 - 5000 as balance from orders""",
    "fx_transactions": """
select cast(o_custkey as varchar) as case_id, concat('acc', cast(o_orderkey % 2 as varchar)) as account_id,
  o_orderkey as txn_id, o_orderdate as ts,
  case when o_orderstatus = 'P' then o_totalprice else -o_totalprice end as amount,
  case when o_orderstatus = 'P' and o_custkey % 2 = 0 then 'ACME SALARY 42'
       when o_orderstatus = 'P' then 'Transfer-7'
       else concat('Loan ', substr(o_orderpriority, 3)) end as merchant,
  cast(null as varchar) as description, cast(null as varchar) as category
from orders""",
    "fx_mandates": """
select cast(o_custkey as varchar) as case_id, concat('loan ', lower(substr(o_orderpriority, 3))) as payee,
  o_totalprice / 120 as amount from orders where o_orderkey % 4 = 1""",
    "fx_feed": """
select cast(user_id as varchar) as case_id, event_id as txn_id, date '2023-01-01' + cast(floor((epoch(ts) - 1704067200) / 10800) as int) as tdate,
  case when event_type in ('signup', 'purchase') then 1500 + value when event_type = 'error' then -value * 10
    else -([cast(12.99 as double), 49.5, 250.0][event_id % 3 + 1] + value / 1000) end as amount,
  case when event_type = 'signup' and user_id % 2 = 0 then 'acme salary' when event_type in ('signup', 'purchase') then 'transfer' when event_type = 'error' then 'rent llc'
    when event_type = 'view' then 'loan one' else 'card club' end as payee
from events""",
    "fx_feed_mandates": """
select cast(user_id as varchar) as case_id, case when event_id % 2 = 0 then 'rent llc' when event_type = 'view' then 'gym plan' else 'card club' end as payee, value + 5 as amount
from events where event_id % 25 = 1 and user_id % 3 <> 0""",
    "fx_scored": """
select cast(o_orderkey as varchar) as id, year(o_orderdate) * 100 + month(o_orderdate) as wk,
  case when o_orderstatus = 'F' then 1 else 0 end as target, floor(o_totalprice / 1000) as raw from orders""",
    "fx_submissions": """
select o_orderkey as seq, o_orderdate as ts, o_orderpriority as issuer, cast(o_custkey as varchar) as user_hash,
  sha256(concat('e', cast(cast(floor(o_totalprice / 10) as bigint) as varchar))) as event_hash,
  year(o_orderdate) * 100 + month(o_orderdate) as period from orders""",
    "fx_requests": """
select event_id as seq, ts, cast(user_id as varchar) as req_key from events""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it names, dependencies first."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:fx|dx)_\w+", text):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} as ({known[name].strip()})" for name in order)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {parts},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}"
