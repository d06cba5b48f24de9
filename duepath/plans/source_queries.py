"""Queries for sources, sinks, cleaning, canonical tables, joins and direct aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.config import Settings
from duepath.functions import clean
from duepath.operators import features as ft
from duepath.operators import flags
from duepath.operators.ordered import hot_groups, join_one_row
from duepath.plans.feature_queries import SQL as FEATURE_SQL
from duepath.plans.feature_queries import matrix
from duepath.plans.raw_oracle import RAW
from duepath.plans.registry import register, rounded
from duepath.session import fresh_path
from duepath.sources import bureau, openbanking, sinks
from duepath.sources import tables as fx


def q(name, sql=None, dates=()):
    return register(name, sql, {**RAW, **FEATURE_SQL}, dates)


PAY_COLS = "case_id, line_id, pdate, tie, round(overdue, 7) as overdue, round(dpd, 6) as dpd"


def _bureau(spark, folder) -> dict[str, DataFrame]:
    return {"a": fx.bureau_a(spark, folder), "b": fx.bureau_b(spark, folder)}


# -- S: sources ----------------------------------------------------------------------------------


@q("s01_logical_scan", "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 4) as total from orders group by o_orderstatus")
def _(spark, folder):
    df = bureau.read_logical(spark, folder, "orders")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@q("s02_column_allow_list", "select case_id, num_group1, round(annuity_853a, 6) as annuity from dx_applprev")
def _(spark, folder):
    kept = bureau.prune(fx.applprev(spark, folder), "applprev_1")
    return kept.select("case_id", "num_group1", F.round("annuity_853A", 6).alias("annuity"))


@q("s03_first_cases", """
select case_id, count(*) as n_rows, round(sum(annuity_853a), 6) as total from dx_applprev
where case_id in (select case_id from dx_base order by case_id limit 200) group by case_id""")
def _(spark, folder):
    cases = bureau.first_cases(fx.base(spark, folder), 200)
    rows = bureau.restrict(fx.applprev(spark, folder), cases)
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("annuity_853A"), 6).alias("total"))


@q("s04_timed_tables_only", "select case when line_id[1:1] = 'a' then 'a' else 'b' end as source, count(*) as n, min(pdate) as first_date, max(pdate) as last_date from dx_bureau_pay group by 1", dates=('first_date', 'last_date'))
def _(spark, folder):
    tables = _bureau(spark, folder)
    tables["untimed"] = fx.bureau_b(spark, folder).drop("pmts_date_1107D")
    rows = bureau.union_payments(tables).withColumn("source", F.substring_index("line_id", ":", 1))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("pdate").alias("first_date"), F.max("pdate").alias("last_date"))


@q("s05_partitioned_scan", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as qty from lineitem group by all")
def _(spark, folder):
    return fx.table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@q("s06_labels", "select cast(case_id as varchar) as case_id, cast(target as double) as target, cast(wk as int) as wk from dx_base")
def _(spark, folder):
    return fx.base(spark, folder).select(
        F.col("case_id").cast("string").alias("case_id"), F.col("target").cast("double").alias("target"), F.col("wk").cast("int").alias("wk"))


@q("s07_feature_table_read", "select case_id, round(max_dpd_24m, 6) as max_dpd_24m, round(mean_dpd_24m, 6) as mean_dpd_24m from dx_matrix")
def _(spark, folder):
    path = fresh_path(spark, "features-csv")
    sinks.write_matrix(matrix(spark, folder, ["max_dpd_24m", "mean_dpd_24m"]), path, fmt="csv")
    return rounded(sinks.read_any(spark, path, "case_id string, max_dpd_24m double, mean_dpd_24m double"))


@q("s08_payload_transactions", """
select cast(o_custkey as varchar) as case_id, concat('acc', o_custkey, '-', (o_orderkey // 50) % 2) as account_id, cast(o_orderkey as varchar) as txn_id,
  cast(o_orderdate as date) as tdate, case when o_orderstatus = 'P' then -o_totalprice else o_totalprice end as amount,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(concat(case when o_orderkey % 2 = 0 then concat('Shop-', o_custkey, ' ') else '' end, o_orderpriority, ' DIRECT_DEBIT')), '[0-9]+', '', 'g'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) as payee
from orders""", dates=('tdate',))
def _(spark, folder):
    rows = openbanking.transactions(openbanking.parse_payloads(fx.account_payloads(spark, folder)))
    return rows.select("case_id", "account_id", "txn_id", "tdate", "amount", "payee")


@q("s09_payload_balances", """
select cast(o_custkey as varchar) as case_id, concat('acc', o_custkey, '-', (o_orderkey // 50) % 2) as account_id,
  case when (o_orderkey // 50) % 3 = 0 then 'savings' else 'current' end as acct_type,
  case o_orderkey % 3 when 0 then cast(o_orderdate as date) when 1 then date '2001-01-05' else date '2001-08-01' end as bdate,
  round(case when o_orderkey % 4 <> 0 then o_totalprice / 10 else o_totalprice / 20 end, 6) as balance from orders""", dates=('bdate',))
def _(spark, folder):
    return rounded(openbanking.balances(openbanking.parse_payloads(fx.account_payloads(spark, folder))))


@q("s10_transaction_dedup", """
select case_id, transaction_id, timestamp, amount, fetch_seq from (
  select o_custkey as case_id, case when o_orderkey % 3 <> 0 then cast(o_orderkey as varchar) end as transaction_id,
    cast(cast(o_orderdate as date) as varchar) as timestamp, floor(o_totalprice / 10000) as amount, f as fetch_seq,
    row_number() over (partition by o_custkey, coalesce(case when o_orderkey % 3 <> 0 then cast(o_orderkey as varchar) end,
      concat(cast(o_orderdate as date), '|', floor(o_totalprice / 10000))) order by o_orderkey * 10 + f desc) as rn,
  from orders, (values (0), (1)) v(f)) where rn = 1""")
def _(spark, folder):
    # Every order arrives in two overlapping fetch windows; a third of them without an id.
    o = fx.table(spark, folder, "orders")
    rows = o.select(
        F.col("o_custkey").alias("case_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("timestamp"),
        F.floor(F.col("o_totalprice") / 10000).cast("double").alias("amount"),
        F.col("o_orderkey").alias("ok"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("fetch_seq"),
    ).withColumn("_order", F.col("ok") * 10 + F.col("fetch_seq"))
    return openbanking.deduplicate(rows, ["case_id"], "_order").select("case_id", "transaction_id", "timestamp", "amount", "fetch_seq")


@q("s11_matrix_sink", "select case_id, round(max_dpd_24m, 6) as max_dpd_24m, cast(agg_dpd_count as double) as agg_dpd_count from dx_matrix")
def _(spark, folder):
    path = fresh_path(spark, "features")
    sinks.write_matrix(matrix(spark, folder, ["max_dpd_24m", "agg_dpd_count"]), path)
    return rounded(sinks.read_any(spark, path))


@q("s12_merge_shards", """
select m.case_id, cast(cast(mean_dpd_24m as float) as double) as mean_dpd_24m, cast(target as double) as target, cast(wk as double) as wk
from dx_matrix m left join dx_base b on cast(b.case_id as varchar) = m.case_id""")
def _(spark, folder):
    first = matrix(spark, folder, ["mean_dpd_24m"])
    path = fresh_path(spark, "shards")
    sinks.append_shard(first, path, shard=1)
    sinks.append_shard(first.withColumn("mean_dpd_24m", F.col("mean_dpd_24m") + 1), path, shard=2)
    labels = fx.base(spark, folder).select(
        F.col("case_id").cast("string").alias("case_id"), F.col("target").cast("double").alias("target"), F.col("wk").cast("int").alias("wk"))
    merged = sinks.merge_shards(spark, path, labels)
    return merged.select("case_id", F.col("mean_dpd_24m").cast("double").alias("mean_dpd_24m"), "target", F.col("wk").cast("double").alias("wk"))


@q("s13_score_history", "select cast(o_custkey as varchar) as key, o_orderkey as seq, round(o_totalprice / 1000, 6) as score from orders")
def _(spark, folder):
    path = fresh_path(spark, "history")
    rows = fx.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000).alias("score"))
    sinks.append_history(rows, path)
    # A half-written line must not stop the reader.
    rows.filter(F.col("seq") % 1000 == 0).select(F.concat(F.lit('{"key": "'), "key").alias("value")).write.mode("append").text(path)
    return rounded(sinks.read_history(spark, path, "key string, seq bigint, score double"))


@q("s14_anchor_store", """
select user_hash, arg_max(event_hash, seq) as event_hash, max(seq) as seq, count(*) as n_anchors from fx_submissions group by user_hash""")
def _(spark, folder):
    path = fresh_path(spark, "anchors")
    sinks.append_anchors(fx.submissions(spark, folder).withColumn("tx_hash", F.sha2(F.col("seq").cast("string"), 256)), path)
    anchors = spark.read.parquet(path)
    latest = sinks.latest_per_user(anchors, "seq").select("user_hash", "event_hash", "seq")
    return latest.join(anchors.groupBy("user_hash").agg(F.count(F.lit(1)).alias("n_anchors")), "user_hash")


@q("s15_incremental_build", """
select case_id, round(max_dpd_24m, 6) as max_dpd_24m, case when cast(case_id as bigint) % 2 = 0 then 'first' else 'second' end as run from dx_matrix""")
def _(spark, folder):
    path = fresh_path(spark, "incremental")
    every = matrix(spark, folder, ["max_dpd_24m"])
    sinks.append_new_cases(every.filter(F.col("case_id").cast("bigint") % 2 == 0).withColumn("run", F.lit("first")), path, "v1")
    sinks.append_new_cases(every.withColumn("run", F.lit("second")), path, "v1")
    return rounded(spark.read.parquet(path).drop("feature_version"))


# -- P: cleaning -----------------------------------------------------------------------------------


@q("p01_month_start", """
select num_group2, case when y is not null and m between 1 and 12 then make_date(y, m, 1) end as pdate from dx_bureau_a""", dates=('pdate',))
def _(spark, folder):
    return fx.bureau_a(spark, folder).select(
        "num_group2", clean.month_start(F.col("pmts_year_1139T"), F.col("pmts_month_158T")).alias("pdate"))


@q("p02_non_negative", "select num_group2, round(greatest(coalesce(ovd, 0), 0), 7) as overdue, greatest(coalesce(try_cast(dpd_text as double), 0), 0) as dpd from dx_bureau_a")
def _(spark, folder):
    return fx.bureau_a(spark, folder).select(
        "num_group2", F.round(clean.non_negative("pmts_overdue_1140A"), 7).alias("overdue"), clean.non_negative("pmts_dpd_1073P").alias("dpd"))


@q("p03_clipped_dpd", """
select num_group2, least(greatest(coalesce(dpd_raw, 0), 0), 90) as dpd from dx_bureau_b
union all select num_group2, least(greatest(coalesce(try_cast(dpd_text as double), 0), 0), 90) from dx_bureau_a""")
def _(spark, folder):
    b = fx.bureau_b(spark, folder).select("num_group2", clean.clipped_dpd("pmts_dpdvalue_108P").alias("dpd"))
    return b.unionByName(fx.bureau_a(spark, folder).select("num_group2", clean.clipped_dpd("pmts_dpd_1073P").alias("dpd")))


@q("p04_first_present", "select num_group2, round(ovd, 7) as overdue from dx_bureau_b union all select num_group2, round(ovd, 7) from dx_bureau_a")
def _(spark, folder):
    parts = [
        t.select("num_group2", F.round(F.col(clean.first_present(t.columns, bureau.OVERDUE_COLS)), 7).alias("overdue"))
        for t in _bureau(spark, folder).values()
    ]
    return parts[1].unionByName(parts[0])


@q("p05_row_max", """
select case_id, num_group1, round(case when a is null then b when b is null then a else greatest(a, b) end, 6) as annuity
from (select case_id, num_group1, annuity_853a as a, try_cast(annuity_780a as double) as b from dx_applprev)""")
def _(spark, folder):
    df = fx.applprev(spark, folder)
    return df.select("case_id", "num_group1", F.round(clean.row_max(bureau.matching(df.columns, "^annuity_")), 6).alias("annuity"))


@q("p06_clean_text", "select case_id, num_group1, education, housing, income_type from dx_declared, (values (0), (1)) g(num_group1)")
def _(spark, folder):
    p = fx.person(spark, folder)
    return p.select(
        F.col("case_id").cast("string").alias("case_id"), "num_group1", clean.clean_text("education_927M").alias("education"),
        clean.clean_text("housetype_905L").alias("housing"), clean.clean_text("incometype_1044T").alias("income_type"))


@q("p07_declared", "select * from dx_declared")
def _(spark, folder):
    return bureau.declared(fx.person(spark, folder))


@q("p08_applicant_row", "select case_id, stated_income, income_type from dx_declared")
def _(spark, folder):
    return bureau.declared(fx.person(spark, folder)).select("case_id", "stated_income", "income_type")


PAYEE = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[0-9]+', '', 'g'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"


@q("p09_payee_text", f"select doc_id, {PAYEE.format("coalesce(text, '')")} as payee from documents")
def _(spark, folder):
    d = fx.table(spark, folder, "documents")
    return d.select("doc_id", clean.payee(F.col("text"), F.lit(""), F.lit(None).cast("string")).alias("payee"))


@q("p10_sign_and_unknown", f"""
select event_id, -value as amount, coalesce(nullif({PAYEE.format("case when event_id % 3 = 0 then '12' else event_type end")}, ''), 'unknown') as payee from events""")
def _(spark, folder):
    e = fx.table(spark, folder, "events")
    name = F.when(F.col("event_id") % 3 == 0, "12").otherwise(F.col("event_type"))
    return e.select("event_id", (-F.col("value")).alias("amount"), F.coalesce(F.nullif(clean.payee(name), F.lit("")), F.lit("unknown")).alias("payee"))


KIND = """case when regexp_matches({0}, 'klarna|clearpay|laybuy|paypal4|zilch|bnpl') then 'bnpl'
  when regexp_matches({0}, 'card|visa|mastercard|amex') then 'card'
  when regexp_matches({0}, 'loan|finance|lending|credit|repay|instal') then 'loan' else 'unknown' end"""


@q("p11_line_kind", "select case_id, txn_id, " + KIND.format("lower(concat(merchant, ' ', case when txn_id % 5 = 0 then 'BNPL' when txn_id % 7 = 0 then 'VISA' else '' end))") + " as kind from fx_transactions")
def _(spark, folder):
    hint = F.when(F.col("txn_id") % 5 == 0, "BNPL").when(F.col("txn_id") % 7 == 0, "VISA").otherwise("")
    return fx.transactions(spark, folder).select("case_id", "txn_id", clean.line_kind(F.col("merchant"), hint).alias("kind"))


@q("p12_account_kind", "select p_partkey, case when starts_with(upper(concat(case when p_partkey % 2 = 0 then 'Sav' else '' end, p_type)), 'SAV') then 'savings' else 'current' end as acct_type from part")
def _(spark, folder):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Sav").otherwise(""), F.col("p_type"))
    return fx.table(spark, folder, "part").select("p_partkey", clean.account_kind(raw).alias("acct_type"))


@q("p13_mandates", f"""
select cast(o_custkey as varchar) as case_id, {PAYEE.format("concat(o_orderpriority, ' dd')")} as payee, round(o_totalprice / 120, 6) as amount
from orders where o_orderkey % 4 = 1 and o_totalprice > 0
union all select cast(o_custkey as varchar), lower(o_orderstatus), round(o_totalprice / 120 - 1000, 6) from orders where o_orderkey % 4 = 2 and o_totalprice / 120 - 1000 > 0""")
def _(spark, folder):
    return rounded(openbanking.mandates(openbanking.parse_payloads(fx.account_payloads(spark, folder))))


@q("p14_window", "select p.case_id, count(*) as n24, count(*) filter (pdate >= as_of - 182) as n6, count(*) filter (pdate >= as_of - 91) as n3 from fx_payments p join fx_applicants a on a.case_id = p.case_id where pdate between as_of - 730 and as_of group by p.case_id")
def _(spark, folder):
    cfg = Settings()
    pay = fx.payments(spark, folder)
    dated = join_one_row(pay, fx.applicants(spark, folder).select("case_id", "as_of"), ["case_id"], hot_groups(pay, ["case_id"]))
    rows = ft.in_window(dated, 24, cfg)
    age = F.datediff("as_of", "pdate")
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n24"), F.count_if(age <= cfg.window_days(6)).alias("n6"), F.count_if(age <= cfg.window_days(3)).alias("n3"))


FLAG_COLS = ["monthly_income", "num_active_obligations", "declared_income_gap", "declared_is_homeowner", "debt_to_income", "mean_balance_3m"]
FLAG_SQL = """select case_id, case when monthly_income > 0 then 1.0 else 0.0 end as income_detected,
  case when num_active_obligations is null or num_active_obligations <= 0 then 1.0 else 0.0 end as thin_file,
  case when declared_income_gap is not null or declared_is_homeowner is not null then 1.0 else 0.0 end as declared_provided,
  cast((monthly_income is null)::int + (num_active_obligations is null)::int + (declared_income_gap is null)::int + (declared_is_homeowner is null)::int
    + (debt_to_income is null)::int + (mean_balance_3m is null)::int as double) as n_features_missing from dx_matrix"""


@q("p15_missing_flags", FLAG_SQL)
def _(spark, folder):
    return flags.add_flags(matrix(spark, folder, FLAG_COLS), FLAG_COLS).select("case_id", *flags.FLAGS)


@q("p16_flag_coverage", f"""
select flag, round(coverage, 6) as coverage, constant from (
  select 'income_detected' as flag, avg(income_detected) as coverage, min(income_detected) = max(income_detected) as constant from ({FLAG_SQL})
  union all select 'thin_file', avg(thin_file), min(thin_file) = max(thin_file) from ({FLAG_SQL})
  union all select 'declared_provided', avg(declared_provided), min(declared_provided) = max(declared_provided) from ({FLAG_SQL})
  union all select 'n_features_missing', avg(n_features_missing), min(n_features_missing) = max(n_features_missing) from ({FLAG_SQL}))""")
def _(spark, folder):
    return rounded(flags.coverage(flags.add_flags(matrix(spark, folder, FLAG_COLS), FLAG_COLS)))


IMPUTE = ["monthly_income", "debt_to_income", "mean_balance_3m"]


@q("p17_median_impute", """
select case_id, """ + ", ".join(f"round(coalesce({c}, (select quantile_cont({c}, 0.5) from dx_matrix where cast(case_id as bigint) % 5 < 3), 0), 6) as {c}" for c in IMPUTE) + " from dx_matrix")
def _(spark, folder):
    m = matrix(spark, folder, IMPUTE)
    train = m.filter(F.col("case_id").cast("bigint") % 5 < 3)
    return rounded(flags.impute(m, flags.medians(train, IMPUTE)))


@q("p18_z_score", """
select case_id, """ + ", ".join(
    f"round(({c} - (select avg({c}) from dx_matrix where cast(case_id as bigint) % 5 < 3)) / (select case when stddev_pop({c}) < 1e-9 then 1 else stddev_pop({c}) end from dx_matrix where cast(case_id as bigint) % 5 < 3), 6) as {c}"
    for c in ("max_dpd_24m", "mean_dpd_24m", "agg_dpd_count")) + " from dx_matrix")
def _(spark, folder):
    cols = ["max_dpd_24m", "mean_dpd_24m", "agg_dpd_count"]
    m = matrix(spark, folder, cols)
    return rounded(flags.standardise(m, flags.moments(m.filter(F.col("case_id").cast("bigint") % 5 < 3), cols), cols))


@q("p19_policy_columns", "select case_id, round(max_dpd_24m, 6) as max_dpd_24m, round(total_annuity, 6) as total_annuity from dx_matrix")
def _(spark, folder):
    names = ["max_dpd_24m", "std_payment_interval_days", "agg_interval_mean", "monthly_income", "total_annuity"]
    kept = flags.allowed(names, drop=("monthly_income",))
    return rounded(matrix(spark, folder, kept))


NAME = "case when c_custkey % 3 = 0 then concat('Dr. ', c_name) when c_custkey % 3 = 1 then concat('Zoë ', c_mktsegment, ' O''Néil') else concat('mr ', lower(c_mktsegment), '  Smith-Jones') end"
NAME_SQL = f"""select c_custkey, array_to_string(list_filter(string_split(upper(regexp_replace(translate({NAME}, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'), '[^A-Za-z ]', ' ', 'g')), ' '), lambda w: w <> '' and w not in ('MR','MRS','MISS','MS','DR','PROF','SIR','MX','REV')), ' ') as name from customer"""


def _names(spark, folder):
    k = F.col("c_custkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit("Dr. "), "c_name"))
        .when(k == 1, F.concat(F.lit("Zoë "), "c_mktsegment", F.lit(" O'Néil")))
        .otherwise(F.concat(F.lit("mr "), F.lower("c_mktsegment"), F.lit("  Smith-Jones")))
    )
    return fx.table(spark, folder, "customer").select("c_custkey", raw.alias("raw"))


@q("p20_plain_name", NAME_SQL)
def _(spark, folder):
    return _names(spark, folder).select("c_custkey", clean.plain_name(F.col("raw")).alias("name"))


@q("p21_name_spellings", f"""
select * from (select distinct c_custkey, unnest([name, case when len(w) > 2 then concat(w[1], ' ', w[-1]) end, case when len(w) >= 2 then concat(w[1][1:1], ' ', w[-1]) end]) as spelling
from (select c_custkey, name, string_split(name, ' ') as w from ({NAME_SQL}))) where spelling is not null""")
def _(spark, folder):
    return _names(spark, folder).select("c_custkey", F.explode(clean.name_spellings(F.col("raw"))).alias("spelling"))


# -- C: canonical tables ----------------------------------------------------------------------------


@q("c01_bureau_payments", f"select {PAY_COLS} from dx_bureau_pay", dates=('pdate',))
def _(spark, folder):
    rows = bureau.union_payments(_bureau(spark, folder))
    return rows.select("case_id", "line_id", "pdate", "tie", F.round("overdue", 7).alias("overdue"), F.round("dpd", 6).alias("dpd"))


@q("c02_income", "select case_id, round(monthly_income, 6) as monthly_income from dx_income")
def _(spark, folder):
    return rounded(bureau.income(fx.static_0(spark, folder), fx.static_cb_0(spark, folder)))


@q("c03_instalments", "select cast(case_id as varchar) as case_id, round(annuity_853a, 6) as amount from dx_applprev where annuity_853a is not null")
def _(spark, folder):
    return rounded(bureau.instalments(fx.applprev(spark, folder)))


@q("c04_balance_proxy", """
select cast(o_custkey as varchar) as case_id, concat('card:', o_custkey) as account_id, 'current' as acct_type, date '2001-08-01' as bdate,
  round(arg_min(o_totalprice / 100, o_orderkey), 6) as balance from orders where o_orderkey % 3 = 0 and o_orderkey % 2 = 0
  and o_custkey in (select case_id from dx_base) group by o_custkey""", dates=('bdate',))
def _(spark, folder):
    return rounded(bureau.balance_proxy(fx.debitcard(spark, folder), bureau.case_universe(fx.base(spark, folder), None)))


@q("c05_case_universe", """
select cast(case_id as varchar) as case_id, as_of, 'base' as origin from dx_base
union all select distinct case_id, cast(null as date), 'payments' from dx_bureau_pay""", dates=('as_of',))
def _(spark, folder):
    pay = bureau.union_payments(_bureau(spark, folder))
    named = bureau.case_universe(fx.base(spark, folder), pay).withColumn("origin", F.lit("base"))
    return named.unionByName(bureau.case_universe(None, pay).withColumn("origin", F.lit("payments")))


# -- A, J: direct aggregates and joins ---------------------------------------------------------------


@q("a01_bureau_partials", """
select case_id, count(*) as n_pmts, coalesce(sum(d), 0) as dpd_sum, max(d) as dpd_max, count(*) filter (d > 0) as n_dpd_gt0,
  count(*) filter (d >= 30) as n_dpd_ge30, round(max(ovd0), 6) as ovd_max, round(coalesce(sum(ovd0), 0), 6) as ovd_sum
from (select case_id, least(greatest(try_cast(dpd_text as double), 0), 90) as d, greatest(ovd, 0) as ovd0 from dx_bureau_a) group by case_id""")
def _(spark, folder):
    return rounded(bureau.payment_partials(fx.bureau_a(spark, folder)))


BUREAU_COLS = "round(max_dpd, 6) as max_dpd, round(mean_dpd, 6) as mean_dpd, cast(num_dpd_gt0 as double) as num_dpd_gt0, cast(num_dpd_ge30 as double) as num_dpd_ge30, round(max_overdue, 6) as max_overdue, round(total_overdue, 6) as total_overdue, cast(num_bureau_payments as double) as num_bureau_payments"


def _combined(spark, folder):
    return bureau.combine_payments([bureau.payment_partials(t) for t in _bureau(spark, folder).values()])


@q("a02_bureau_final", f"select case_id, {BUREAU_COLS} from dx_bureau_case")
def _(spark, folder):
    return rounded(_combined(spark, folder))


@q("a03_application_totals", "select case_id, round(total_annuity, 6) as total_annuity, round(max_annuity, 6) as max_annuity, cast(num_prev_apps as double) as num_prev_apps from dx_appl_case")
def _(spark, folder):
    return rounded(bureau.application_totals(fx.applprev(spark, folder)))


@q("a04_income_max", "select case_id, round(monthly_income, 6) as monthly_income from dx_income_max")
def _(spark, folder):
    return rounded(bureau.income_max(fx.static_0(spark, folder), fx.static_cb_0(spark, folder)))


def assembled(spark, folder):
    return bureau.assemble(
        fx.base(spark, folder).select("case_id", "target", "wk"), _combined(spark, folder),
        bureau.application_totals(fx.applprev(spark, folder)),
        bureau.income_max(fx.static_0(spark, folder), fx.static_cb_0(spark, folder)))


@q("j01_assembled_features", f"""
select case_id, cast(target as double) as target, wk, {BUREAU_COLS}, round(total_annuity, 6) as total_annuity, round(max_annuity, 6) as max_annuity,
  cast(num_prev_apps as double) as num_prev_apps, round(monthly_income, 6) as monthly_income, round(debt_to_income, 6) as debt_to_income from dx_assembled""")
def _(spark, folder):
    return rounded(assembled(spark, folder).withColumn("target", F.col("target").cast("double")))


@q("j02_labelled_matrix", """
select m.case_id, round(max_dpd_24m, 6) as max_dpd_24m, round(monthly_income, 6) as monthly_income, cast(b.target as double) as target, cast(wk as int) as wk
from dx_matrix m join dx_base b on cast(b.case_id as varchar) = m.case_id where b.target is not null""")
def _(spark, folder):
    labels = fx.base(spark, folder).select(
        F.col("case_id").cast("string").alias("case_id"), F.col("target").cast("double").alias("target"), F.col("wk").cast("int").alias("wk"))
    return rounded(flags.labelled(matrix(spark, folder, ["max_dpd_24m", "monthly_income"]), labels))


@q("j03_shared_cases", """
select m.case_id, round(m.max_dpd_24m, 6) as max_dpd_24m, round(b.max_dpd, 6) as max_dpd from dx_matrix m join dx_bureau_case b on cast(b.case_id as varchar) = m.case_id""")
def _(spark, folder):
    right = _combined(spark, folder).select(F.col("case_id").cast("string").alias("case_id"), "max_dpd")
    return rounded(matrix(spark, folder, ["max_dpd_24m"]).join(right, "case_id"))


@q("j04_case_lookup", """
select p.case_id, line_id, pdate, tie, round(dpd, 6) as dpd, as_of from dx_bureau_pay p join (select cast(case_id as varchar) as case_id, as_of from dx_base) b on b.case_id = p.case_id""", dates=('pdate', 'as_of'))
def _(spark, folder):
    rows = bureau.bureau_payments_with_cases(_bureau(spark, folder), bureau.case_universe(fx.base(spark, folder), None))
    return rows.select("case_id", "line_id", "pdate", "tie", F.round("dpd", 6).alias("dpd"), "as_of")


@q("j05_unseen_cases", "select case_id, count(*) as n from dx_bureau_pay where case_id not in (select cast(case_id as varchar) from dx_base) group by case_id")
def _(spark, folder):
    pay = bureau.union_payments(_bureau(spark, folder))
    return pay.join(bureau.case_universe(fx.base(spark, folder), None), "case_id", "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
