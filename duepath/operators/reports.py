"""Column profiles, population counts, cohort labels and cohort reports."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duepath.config import DEFAULT
from duepath.functions import clean, score
from duepath.operators.ordered import value_quantiles


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Columns as (feature, value) rows of doubles."""
    typed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keep), list(columns), name, value)


def realised_history(rows: DataFrame, months_requested: int | None = None) -> DataFrame:
    """Length of the transaction history a case really has."""
    out = rows.groupBy("case_id").agg(
        F.min("tdate").alias("history_start"), F.max("tdate").alias("history_end"), F.count("tdate").alias("history_transactions"))
    days = F.datediff("history_end", "history_start")
    months = F.bround(days / F.lit(DEFAULT.days_per_month), 1)
    late = F.lit(False) if months_requested is None else months > float(months_requested) + 1.0
    return out.withColumns({"history_days": days.cast("bigint"), "months_of_history": months, "too_long": late})


def credit_account_count(rows: DataFrame) -> DataFrame:
    """Distinct credit-type accounts per case. Accounts are made distinct before counting,
    so a busy case is spread over its accounts."""
    ids = rows.select("case_id", F.when(clean.is_credit_account(F.col("kind")), F.col("account_id")).alias("acc")).distinct()
    return ids.groupBy("case_id").agg(F.count("acc").alias("credit_accounts"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, nulls and range of each column read as a number, in one pass."""
    n = F.count(F.lit(1))
    stats = []
    for c in columns:
        v = clean.number(c)
        known = F.count(v)
        stats.append(F.struct(
            F.lit(c).alias("column_name"), n.alias("n"), known.alias("n_known"), (100.0 * (n - known) / n).alias("null_pct"),
            F.count_if(v != 0).alias("n_nonzero"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"),
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def narrowing(labelled: DataFrame, streamable: DataFrame, built: DataFrame) -> DataFrame:
    """How many cases survive each step, and how far the steps overlap. One grouped pass over
    tagged ids instead of a join per pair."""
    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("case_id").cast("string").alias("case_id"), F.lit(name).alias("step"))

    tagged = tag(labelled, "labelled").unionByName(tag(streamable, "streamable")).unionByName(tag(built, "built"))
    one = tagged.groupBy("case_id").agg(*[
        F.max((F.col("step") == s).cast("int")).alias(s) for s in ("labelled", "streamable", "built")])
    return one.agg(
        F.sum("labelled").alias("n_labelled"), F.sum("streamable").alias("n_streamable"), F.sum("built").alias("n_built"),
        F.count_if((F.col("labelled") == 1) & (F.col("streamable") == 1)).alias("n_labelled_streamable"),
        F.count_if((F.col("labelled") == 1) & (F.col("built") == 1)).alias("n_labelled_built"),
        F.count_if((F.col("labelled") + F.col("streamable") + F.col("built")) == 3).alias("n_all"),
    )


def cohort_labels(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Plain-word thickness, conduct and affordability of each applicant (report form)."""
    c = F.col
    present = sum((c(x).isNotNull().cast("int") for x in feature_cols), F.lit(0))
    share = present / F.lit(float(max(1, len(feature_cols))))
    lines = c("num_active_obligations")
    thickness = F.when(lines.isNull() | (lines <= 0), "no-file").when(lines <= 2, "thin").when(lines <= 5, "medium").otherwise("thick")
    thin = thickness.isin("no-file", "thin") & (share < 0.5)
    out = df.withColumn("coverage", share).withColumn("thickness", F.when(thin, "ultra-thin").otherwise(thickness))
    conduct = (
        F.when(c("num_serious_arrears_24m") > 0, "serious arrears")
        .when(c("max_dpd_24m") >= 30, "30d+ late")
        .when(c("num_dpd_events_24m") > 0, "minor late")
        .when(c("longest_clean_streak_24m") >= 18, "long clean")
        .when(c("thickness").isin("no-file", "ultra-thin"), "no history")
        .otherwise("clean")
    )
    income = c("monthly_income")
    afford = (
        F.when(income.isNull() | (income <= 0), "income undetected")
        .when(c("payment_to_income") > 0.45, "stretched")
        .when(c("debt_to_income") > 6.0, "high debt")
        .when(c("min_balance_3m") < 0, "overdrawn")
        .otherwise("comfortable")
    )
    out = out.withColumns({"conduct": conduct, "afford": afford})
    return out.withColumn(
        "label", F.concat_ws(" / ", "thickness", "conduct", "afford", F.when(c("cv_payment_amount") > 0.5, "volatile income")))


def cohort_sentence(df: DataFrame) -> Column:
    """The shorter label shown next to a live score; its cut-offs differ from the report's."""
    c = F.col
    lines, worst, serious = (F.coalesce(c(x), F.lit(0.0)) for x in ("num_active_obligations", "max_dpd_24m", "num_serious_arrears_24m"))
    return F.concat_ws(
        ", ",
        F.when(lines <= 0, "no-file").when(lines <= 1, "ultra-thin").when(lines <= 2, "thin").when(lines <= 5, "medium").otherwise("thick"),
        F.when(serious >= 1, "serious arrears").when(worst >= 8, "late payments").when(worst > 0, "minor lateness").otherwise("clean conduct"),
        F.when(c("debt_to_income") > 0.6, "stretched").when(c("debt_to_income") > 0.3, "moderate leverage").when(c("debt_to_income").isNotNull(), "comfortable"),
        F.when(c("cv_payment_amount") > 0.5, "volatile income"),
    )


def archetypes(df: DataFrame) -> DataFrame:
    """Score and observed default per thickness, conduct and affordability group, in one pass."""
    tagged = df.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("grouping_key"), F.col(k).alias("group_name")) for k in ("thickness", "conduct", "afford")])).alias("g"),
        "score", "target",
    ).select("g.*", "score", "target")
    return tagged.groupBy("grouping_key", "group_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"), F.avg("target").alias("default_rate"))


def score_distribution(df: DataFrame) -> DataFrame:
    """Range, quantiles and band counts of a scored population, one row."""
    s, c = F.col("score"), F.col("_c")
    bands = {f"n_{b.lower()}": F.sum(F.when(score.band(s) == b, c).otherwise(0)) for b in ("A", "B", "C", "D", "E")}
    return value_quantiles(df, "score", {f"p{pct}": pct / 100 for pct in (5, 25, 50, 75, 95)}, {
        "n": F.sum(c), "min_score": F.min(s), "max_score": F.max(s), "spread": F.max(s) - F.min(s), **bands})


def cohort_summary(df: DataFrame, ceiling: float) -> DataFrame:
    """Distinct scores and the shares at the top score and at the policy ceiling. Scores are
    counted per value first, so no task ever holds all distinct scores."""
    values = df.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    return values.agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.max("score").alias("top_score"),
        (F.max_by("c", "score") / F.sum("c")).alias("share_at_top"),
        (F.sum(F.when(F.col("score") >= ceiling - 0.05, F.col("c")).otherwise(0)) / F.sum("c")).alias("share_at_ceiling"))
