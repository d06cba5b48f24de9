"""Reading bureau tables that arrive as numbered Parquet chunks, and making payments of them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duepath.config import DEFAULT, Settings
from duepath.functions import clean
from duepath.operators.ordered import hot_groups, join_one_row

# Column names of the bureau files and which of them are read.
DPD_COLS = ("pmts_dpd_1073P", "pmts_dpdvalue_108P")
OVERDUE_COLS = ("pmts_overdue_1140A", "pmts_pmtsoverdue_635A")
DATE_COLS = ("pmts_date_1107D",)
YEAR_COLS = ("pmts_year_1139T", "pmts_year_507T")
MONTH_COLS = ("pmts_month_158T", "pmts_month_706T")
PAYMENT_COLS = ("case_id", "num_group1", "num_group2") + DPD_COLS + OVERDUE_COLS + DATE_COLS + YEAR_COLS + MONTH_COLS
USED_COLUMNS: Mapping[str, Sequence[str]] = {
    "base": ("case_id", "date_decision"),
    "credit_bureau_a_2": PAYMENT_COLS,
    "credit_bureau_b_2": PAYMENT_COLS,
    "applprev_1": ("case_id", "num_group1", "annuity_853A", "creationdate_885D"),
    "static_0": ("case_id", "maininc_215A"),
    "static_cb_0": ("case_id", "maininc_215A"),
    "debitcard_1": ("case_id", "num_group1", "last180dayaveragebalance_704A"),
    "person_1": ("case_id", "num_group1", "mainoccupationinc_384A", "incometype_1044T", "education_927M",
                 "housetype_905L", "empl_employedtotal_800L"),
}


def chunk_paths(spark: SparkSession, folder: str, stem: str) -> list[str]:
    """Files of one logical table: an optional train_/test_ prefix, an optional chunk number."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*{stem}*.parquet")
    found = pattern.getFileSystem(conf).globStatus(pattern) or []
    name_ok = re.compile(rf"(train_|test_)?{re.escape(stem)}(_+\d+|_*)?\.parquet")
    paths = [f.getPath() for f in found]
    return sorted(p.toString() for p in paths if name_ok.fullmatch(p.getName()))


def read_logical(spark: SparkSession, folder: str, stem: str) -> DataFrame | None:
    """All chunks of a logical table in one scan; columns missing in a chunk read as null."""
    paths = chunk_paths(spark, folder, stem)
    if not paths:
        return None
    return prune(spark.read.option("mergeSchema", "true").parquet(*paths), stem)


def prune(df: DataFrame, stem: str) -> DataFrame:
    wanted = USED_COLUMNS.get(stem)
    return df if wanted is None else df.select(*[c for c in wanted if c in df.columns])


def has_timing(columns: Sequence[str]) -> bool:
    dated = clean.first_present(columns, DATE_COLS)
    year, month = clean.first_present(columns, YEAR_COLS), clean.first_present(columns, MONTH_COLS)
    return dated is not None or (year is not None and month is not None)


def first_cases(base: DataFrame, n: int) -> DataFrame:
    """The first n cases in id order, as a filter for every other table."""
    return base.select("case_id").orderBy("case_id").limit(n)


def restrict(df: DataFrame, cases: DataFrame) -> DataFrame:
    return df.join(cases, "case_id", "left_semi")


def payments_of(df: DataFrame, source: str, cfg: Settings = DEFAULT) -> DataFrame:
    """One bureau table as payments. ``source`` goes into the line id, because two tables
    number their lines independently."""
    dpd = clean.first_present(df.columns, DPD_COLS)
    overdue = clean.first_present(df.columns, OVERDUE_COLS)
    dated = clean.first_present(df.columns, DATE_COLS)
    if dated:
        pdate = F.col(dated).try_cast("date")
    else:
        year, month = clean.first_present(df.columns, YEAR_COLS), clean.first_present(df.columns, MONTH_COLS)
        if year is None or month is None:
            pdate = F.lit(None).cast("date")
        else:
            pdate = clean.month_start(F.col(year), F.col(month))
    return df.select(
        F.col("case_id").cast("string").alias("case_id"),
        F.concat(F.lit(source + ":"), F.col("num_group1").cast("string")).alias("line_id"),
        pdate.alias("pdate"),
        (F.col("num_group2") if "num_group2" in df.columns else F.lit(0)).cast("bigint").alias("tie"),
        F.lit(0.0).alias("amount"),
        (clean.non_negative(overdue) if overdue else F.lit(0.0)).alias("overdue"),
        (clean.clipped_dpd(dpd, cfg) if dpd else F.lit(0.0)).alias("dpd"),
    ).filter(F.col("pdate").isNotNull())


def union_payments(tables: Mapping[str, DataFrame], cfg: Settings = DEFAULT) -> DataFrame:
    parts = [payments_of(df, name, cfg) for name, df in tables.items() if has_timing(df.columns)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_value(df: DataFrame, value: str, order: str | None = None, alias: str = "value") -> DataFrame:
    """First non-null value of a case in ``order``; an aggregate, so no group is sorted."""
    kept = df.filter(F.col(value).isNotNull())
    key = order or value
    return kept.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.min_by(value, key).alias(alias))


def income(static_0: DataFrame | None, static_cb_0: DataFrame | None) -> DataFrame:
    """Monthly income: the first table that knows it wins."""
    sides = []
    for rank, df in enumerate((static_0, static_cb_0)):
        if df is not None:
            sides.append(df.select(F.col("case_id").cast("string").alias("case_id"), F.col("maininc_215A").alias("income"), F.lit(rank).alias("rank")))
    both = reduce(lambda a, b: a.unionByName(b), sides).filter(F.col("income").isNotNull())
    return both.groupBy("case_id").agg(F.min_by("income", F.struct("rank", "income")).alias("monthly_income"))


def instalments(applprev: DataFrame) -> DataFrame:
    return applprev.filter(F.col("annuity_853A").isNotNull()).select(
        F.col("case_id").cast("string").alias("case_id"), F.col("annuity_853A").alias("amount")
    )


def declared(person: DataFrame) -> DataFrame:
    """Declared attributes of the applicant row of each case."""
    first = person.filter(F.col("num_group1") == 0).groupBy(F.col("case_id").cast("string").alias("case_id")).agg(
        F.min(F.struct("mainoccupationinc_384A", "incometype_1044T", "education_927M", "housetype_905L",
                         "empl_employedtotal_800L")).alias("p")
    )
    stated = clean.number(F.col("p.mainoccupationinc_384A"))
    return first.select(
        "case_id",
        F.when(stated > 0, stated).alias("stated_income"),
        clean.clean_text(F.col("p.incometype_1044T")).alias("income_type"),
        clean.clean_text(F.col("p.education_927M")).alias("education"),
        clean.clean_text(F.col("p.housetype_905L")).alias("housing"),
        clean.clean_text(F.col("p.empl_employedtotal_800L")).alias("employment"),
    )


def case_universe(base: DataFrame | None, payments: DataFrame | None) -> DataFrame:
    """Cases with a decision date; where no row has one, every case that has payments."""
    if base is not None:
        dated = base.select(
            F.col("case_id").cast("string").alias("case_id"), F.col("date_decision").try_cast("date").alias("as_of")
        ).filter(F.col("as_of").isNotNull())
        if payments is None or not dated.isEmpty():
            return dated
    return payments.select("case_id").distinct().withColumn("as_of", F.lit(None).cast("date"))


def applicants(base: DataFrame, income_side: DataFrame, declared_side: DataFrame) -> DataFrame:
    cases = case_universe(base, None)
    return cases.join(income_side, "case_id", "left").join(declared_side, "case_id", "left")


def balance_proxy(debitcard: DataFrame, cases: DataFrame) -> DataFrame:
    """One balance row per case, dated at the decision."""
    value = first_value(debitcard, "last180dayaveragebalance_704A", "num_group1", "balance")
    return value.join(cases.select("case_id", "as_of"), "case_id").select(
        "case_id", F.concat(F.lit("card:"), F.col("case_id")).alias("account_id"), F.lit("current").alias("acct_type"),
        F.col("as_of").alias("bdate"), "balance",
    )


@dataclass(frozen=True)
class Canonical:
    """What the feature job reads, whatever it was made from."""

    payments: DataFrame
    applicants: DataFrame
    instalments: DataFrame
    balances: DataFrame


def canonical(payment_tables: Mapping[str, DataFrame], base: DataFrame, static_0: DataFrame | None, static_cb_0: DataFrame | None,
              applprev: DataFrame, person: DataFrame, debitcard: DataFrame, cfg: Settings = DEFAULT) -> Canonical:
    """All bureau tables as one canonical history: one pass over each, one left join per side of a case."""
    payments = union_payments(payment_tables, cfg)
    cases = case_universe(base, payments)
    sides = cases.join(income(static_0, static_cb_0), "case_id", "left").join(declared(person), "case_id", "left")
    return Canonical(payments, sides, instalments(applprev), balance_proxy(debitcard, cases))


# -- direct aggregates: the relational short cut to a linear model --------------------------------


def matching(columns: Sequence[str], pattern: str) -> list[str]:
    return [c for c in columns if re.search(pattern, c, re.I)]


def payment_partials(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    dpd_cols, overdue_cols = matching(df.columns, "dpd"), matching(df.columns, "overdue")
    dpd = clean.row_max(dpd_cols) if dpd_cols else F.lit(None).cast("double")
    dpd = F.when(dpd.isNotNull(), F.least(F.greatest(dpd, F.lit(0.0)), F.lit(cfg.dpd_cap_days)))
    over = clean.row_max(overdue_cols) if overdue_cols else F.lit(None).cast("double")
    over = F.when(over.isNotNull(), F.greatest(over, F.lit(0.0)))
    return df.select(F.col("case_id").cast("bigint").alias("case_id"), dpd.alias("d"), over.alias("o")).groupBy("case_id").agg(
        F.max("d").alias("dpd_max"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("dpd_sum"), F.count(F.lit(1)).alias("n_pmts"),
        F.count_if(F.col("d") > 0).alias("n_dpd_gt0"),
        F.count_if(F.col("d") >= cfg.dpd_serious_days).alias("n_dpd_ge30"),
        F.max("o").alias("ovd_max"), F.coalesce(F.sum("o"), F.lit(0.0)).alias("ovd_sum"),
    )


def combine_payments(partials: Sequence[DataFrame]) -> DataFrame:
    """Final bureau row per case; the mean divides by all rows, known lateness or not."""
    both = reduce(lambda a, b: a.unionByName(b), partials)
    return both.groupBy("case_id").agg(
        F.max("dpd_max").alias("max_dpd"),
        (F.sum("dpd_sum") / F.sum("n_pmts")).alias("mean_dpd"),
        F.sum("n_dpd_gt0").cast("double").alias("num_dpd_gt0"),
        F.sum("n_dpd_ge30").cast("double").alias("num_dpd_ge30"),
        F.max("ovd_max").alias("max_overdue"),
        F.sum("ovd_sum").alias("total_overdue"),
        F.sum("n_pmts").cast("double").alias("num_bureau_payments"),
    )


def application_totals(df: DataFrame) -> DataFrame:
    annuity = clean.row_max([c for c in df.columns if c.startswith("annuity_")])
    rows = df.select(
        F.col("case_id").cast("bigint").alias("case_id"),
        F.when(annuity.isNotNull(), F.greatest(annuity, F.lit(0.0))).alias("a"),
    )
    return rows.groupBy("case_id").agg(
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("total_annuity"), F.max("a").alias("max_annuity"),
        F.count(F.lit(1)).cast("double").alias("num_prev_apps"),
    )


def income_max(*tables: DataFrame) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b), [
        t.select(F.col("case_id").cast("bigint").alias("case_id"), clean.number("maininc_215A").alias("v")) for t in tables])
    return rows.groupBy("case_id").agg(F.max("v").alias("monthly_income"))


ZERO_FILLED = ("max_dpd", "mean_dpd", "num_dpd_gt0", "num_dpd_ge30", "max_overdue", "total_overdue",
               "num_bureau_payments", "total_annuity", "max_annuity", "num_prev_apps")


def assemble(base: DataFrame, bureau: DataFrame, applications: DataFrame, incomes: DataFrame) -> DataFrame:
    """One row per base case; unknown counts and amounts are 0, unknown income stays null."""
    out = base
    for side in (bureau, applications, incomes):
        out = out.join(side, "case_id", "left")
    out = out.fillna(0.0, subset=list(ZERO_FILLED))
    return out.withColumn("debt_to_income", F.when(F.col("monthly_income") > 0, F.col("total_annuity") / F.col("monthly_income")))


def bureau_payments_with_cases(tables: Mapping[str, DataFrame], cases: DataFrame) -> DataFrame:
    rows = union_payments(tables)
    return join_one_row(rows, cases, ["case_id"], hot_groups(rows, ["case_id"]))
