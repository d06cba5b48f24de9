"""The 83 applicant features, from payments to one row per case.

Shape of the job: one join of payments to the decision date (filter on the window), one
exchange on the case, window columns over the date-ordered line, one row per line, one row
per case, and left joins of the small per-case sides. Catalyst drops what a caller does not
select, so asking for three features builds only those.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duepath.config import DEFAULT, Settings
from duepath.functions import clean
from duepath.operators.ordered import (
    SEG,
    Index,
    Lag,
    OrderedGroups,
    RunningMax,
    Total,
    group_stats,
    hot_groups,
    hot_quantile,
    join_one_row,
    keep_hot,
    _attach,
)
from duepath.session import cut_lineage

STREAM_OPS = ("count", "mean", "max", "min", "std", "sum", "median", "nonzero")


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature is, apart from its expression. ``direction`` is the sign of risk."""

    name: str
    family: str
    direction: int
    parity: bool = True
    default: float | None = 0.0


def _spec_rows() -> list[FeatureSpec]:
    S = FeatureSpec
    rows = [
        S("max_dpd_24m", "delinquency", 1), S("mean_dpd_24m", "delinquency", 1),
        S("num_dpd_events_24m", "delinquency", 1), S("num_serious_arrears_24m", "delinquency", 1),
        S("pct_dpd_payments_24m", "delinquency", 1), S("max_consecutive_dpd_24m", "delinquency", 1),
        S("dpd_trend_slope_24m", "delinquency", 1), S("longest_clean_streak_24m", "delinquency", -1),
        S("max_overdue_amount_24m", "delinquency", 1), S("avg_overdue_amount_24m", "delinquency", 1),
        S("total_overdue_amount", "delinquency", 1), S("num_overdue_payments_24m", "delinquency", 1),
        S("pct_overdue_payments_24m", "delinquency", 1), S("num_active_obligations", "exposure", 0),
        S("total_annuity", "exposure", 1), S("avg_instalment_amount", "exposure", 1),
        S("debt_to_income", "affordability", 1, default=None), S("payment_to_income", "affordability", 1, default=None),
        S("mean_balance_3m", "liquidity", -1, parity=False, default=None),
        S("min_balance_3m", "liquidity", -1, parity=False, default=None),
        S("monthly_income", "affordability", -1, default=None),
        S("std_payment_interval_days", "alpha", 1, parity=False), S("cv_payment_amount", "alpha", 1, parity=False),
        S("declared_income_is_employment", "stability", -1, default=None),
        S("declared_is_homeowner", "stability", -1, default=None),
        S("declared_income_type_code", "stability", 0, default=None),
        S("declared_education_code", "stability", 0, default=None),
        S("declared_housing_code", "stability", 0, default=None),
        S("declared_employment_code", "stability", 0, default=None),
        S("declared_income_gap", "affordability", 1, default=None),
    ]
    for stream, family, risk in (("dpd", "delinquency", 1), ("instal", "exposure", 0), ("interval", "alpha", 0)):
        for op in STREAM_OPS:
            sign = 0 if op == "count" else risk
            rows.append(S(f"agg_{stream}_{op}", family, sign, parity=stream != "interval"))
        if stream == "dpd":
            rows += [S("agg_dpd_first", family, 1), S("agg_dpd_last", family, 1)]
    signed = {
        "dpd_acceleration_24m": 1, "dpd_recent_minus_old_24m": 1, "recency_weighted_dpd_24m": 1,
        "frac_late_recent_third_24m": 1, "current_clean_streak_24m": -1, "dpd_late_autocorr_lag1_24m": 1,
        "dpd_late_autocorr_lag2_24m": 1, "dpd_late_autocorr_lag3_24m": 1, "dpd_mean_abs_change_24m": 1,
        "late_payment_entropy_24m": 0, "num_dpd_events_6m": 1, "pct_dpd_payments_6m": 1, "max_dpd_6m": 1,
        "mean_dpd_6m": 1, "dpd_trend_slope_6m": 1, "avg_overdue_amount_6m": 1, "max_overdue_amount_6m": 1,
        "pct_overdue_payments_6m": 1, "pct_dpd_6m_minus_24m": 1, "mean_dpd_6m_minus_24m": 1,
        "avg_overdue_6m_minus_24m": 1, "mk_p_stay_current_24m": -1, "mk_p_current_to_late_24m": 1,
        "mk_p_late_to_cure_24m": -1, "mk_p_late_to_worse_24m": 1, "mk_p_severe_persist_24m": 1,
        "mk_mean_arrears_run_24m": 1,
    }
    rows += [S(name, "delinquency", sign) for name, sign in signed.items()]
    return rows


SPECS: tuple[FeatureSpec, ...] = tuple(_spec_rows())
NAMES: tuple[str, ...] = tuple(s.name for s in SPECS)
PARITY_NAMES: tuple[str, ...] = tuple(s.name for s in SPECS if s.parity)
PARITY_ONLY_DROPPED = tuple(s.name for s in SPECS if not s.parity)


def in_window(df: DataFrame, months: int, cfg: Settings = DEFAULT, date: str = "pdate") -> DataFrame:
    """Rows dated inside the look-back window and not after the decision."""
    low = F.date_sub("as_of", cfg.window_days(months))
    return df.filter(F.col(date).between(low, F.col("as_of")))


def overdue_amount(overdue: Column, instalment: Column, amount: Column) -> Column:
    """The reported overdue, else the shortfall against the instalment, else 0."""
    shortfall = F.when(instalment.isNotNull(), F.greatest(F.lit(0.0), instalment - amount)).otherwise(0.0)
    return F.when(overdue.isNotNull(), F.greatest(F.lit(0.0), overdue)).otherwise(shortfall)


def arrears_state(dpd: Column) -> Column:
    return F.when(dpd < 1, 0).when(dpd < 30, 1).when(dpd < 90, 2).otherwise(3)


class PaymentWindow:
    """Payments of the look-back window with every ordered column the features need."""

    CASE = "case_id"
    LINE = ["case_id", "line_id"]

    def __init__(self, payments: DataFrame, applicants: DataFrame, cfg: Settings = DEFAULT):
        self.cfg = cfg
        hot = hot_groups(payments, [self.CASE])
        # The one exchange of the job: payments by case. Every window and both aggregates below
        # are keyed by the case or by parts of it, so they reuse it.
        dates = applicants.select(self.CASE, "as_of").hint("shuffle_hash")
        joined = join_one_row(payments, dates, [self.CASE], hot)
        recent_low = F.date_sub("as_of", cfg.window_days(cfg.recent_months))
        rows = in_window(joined, cfg.full_months, cfg).select(
            "case_id", "line_id", "pdate", "tie", "amount", "overdue",
            F.greatest(F.lit(0.0), F.coalesce("dpd", F.lit(0.0))).alias("v"),
            (F.col("pdate") >= recent_low).alias("in6"),
            F.when(F.col("amount") > 0, F.col("amount")).alias("paid"),
        ).withColumn("paid6", F.when(F.col("in6"), F.col("paid")))
        # A line is only as hot as its case, so the second look-up is rarely needed.
        self.hot_cases = hot_groups(rows, [self.CASE]) if hot is not None else None
        if self.hot_cases is not None:
            rows = cut_lineage(rows, "payment-window")
        self.hot_lines = hot_groups(rows, self.LINE) if self.hot_cases is not None else None
        self._raw = rows
        self.rows = self._ordered(rows)

    def _ordered(self, rows: DataFrame) -> DataFrame:
        lines = OrderedGroups(rows, self.LINE, ["pdate", "tie"], hot=self.hot_lines, probe=False, written=True)
        if self.hot_cases is None:
            split: list[str] = []
        else:
            # Spread a hot case over its lines and their segments; other cases keep one place.
            flagged = _attach(lines.df, self.hot_cases.select("case_id", F.lit(True).alias("_hot")), ["case_id"])
            seg = F.col(SEG) if self.hot_lines is not None else F.lit(0)
            lines.df = flagged.withColumn(
                "_split", F.when(F.col("_hot"), F.xxhash64("line_id", seg)).otherwise(F.lit(0).cast("bigint"))
            ).drop("_hot").repartition("case_id", "_split")
            split = ["_split"]
        line_part = self.LINE + split + ([SEG] if self.hot_lines is not None else [])
        per_line = Window.partitionBy(*line_part)
        per_case = Window.partitionBy("case_id", *split)
        # Ordered columns come first: the sort they need also serves the unordered windows.
        lines.df = lines.df.withColumns({"late": (F.col("v") > 0).cast("int"), "st": arrears_state(F.col("v"))})
        lines.add(idx=Index(), n=Total(), v1=Lag("v"), st1=Lag("st"), pdate1=Lag("pdate"), late1=Lag("late", 1),
                  late2=Lag("late", 2), late3=Lag("late", 3))
        lines.df = lines.df.withColumns({
            "clean_at": F.when(F.col("late") == 0, F.col("idx")),
            "late_at": F.when(F.col("late") == 1, F.col("idx")),
            "gap": F.datediff("pdate", "pdate1").cast("double"),
        })
        lines.add(last_clean=RunningMax("clean_at"), last_late=RunningMax("late_at"))
        lines.df = lines.df.select(
            "*",
            F.percentile("paid", F.lit(0.5)).over(per_line).alias("inst24"),
            F.percentile("paid6", F.lit(0.5)).over(per_line).alias("inst6"),
        )
        if self.hot_lines is not None:
            for name, source in (("inst24", "paid"), ("inst6", "paid6")):
                exact = hot_quantile(keep_hot(self._raw, self.hot_lines, self.LINE), self.LINE, source, 0.5, "_exact")
                lines.df = _attach(lines.df, exact, self.LINE).withColumn(
                    name, F.coalesce("_exact", name)).drop("_exact")
        lines.df = lines.df.withColumns({
            "o24": overdue_amount(F.col("overdue"), F.col("inst24"), F.col("amount")),
            "o6": F.when(F.col("in6"), overdue_amount(F.col("overdue"), F.col("inst6"), F.col("amount"))),
        })
        out = lines.df.select(
            "*",
            F.percentile("v", F.lit(0.5)).over(per_case).alias("med_v"),
            F.percentile("gap", F.lit(0.5)).over(per_case).alias("med_gap"),
        )
        if self.hot_cases is not None:
            out = cut_lineage(out, "payment-order")
            base = out
            for name, source in (("med_v", "v"), ("med_gap", "gap")):
                exact = hot_quantile(keep_hot(base, self.hot_cases, ["case_id"]), ["case_id"], source, 0.5, "_exact")
                out = _attach(out, exact, ["case_id"]).withColumn(name, F.coalesce("_exact", name)).drop("_exact")
        return out

    # -- one row per line ------------------------------------------------------
    def lines(self) -> DataFrame:
        c = F.col
        n, idx, v = c("n"), c("idx"), c("v")
        mid = F.floor(n / 2)
        newer = idx >= mid
        weight = F.pow(F.lit(0.85), (n - 1 - idx).cast("double"))
        third = idx >= n - F.greatest(F.lit(1), F.floor(n / 3))
        s, s1 = c("st"), c("st1")
        in6 = c("in6")

        def share(num: Column, den: Column) -> Column:
            bottom = F.count_if(den)
            return F.when(bottom > 0, F.count_if(den & num) / bottom)

        aggs: dict[str, Column] = {
            "l_n": F.count(F.lit(1)),
            "l_max": F.max("v"), "l_min": F.min("v"), "l_sum": F.sum("v"), "l_sumsq": F.sum(v * v),
            "l_late": F.count_if(v > 0), "l_serious": F.count_if(v >= self.cfg.dpd_serious_days),
            "l_late_run": F.max(F.when(v > 0, idx - F.coalesce("last_clean", F.lit(-1)))),
            "l_clean_run": F.max(F.when(v <= 0, idx - F.coalesce("last_late", F.lit(-1)))),
            "l_slope_raw": F.regr_slope(v, idx),
            "l_omax": F.max("o24"), "l_osum": F.sum("o24"), "l_oavg": F.avg("o24"),
            "l_over": F.count_if(c("o24") > self.cfg.overdue_tol),
            "l_inst": F.max("inst24"),
            "l_gap_n": F.count("gap"), "l_gap_sum": F.sum("gap"), "l_gap_sumsq": F.sum(c("gap") * c("gap")),
            "l_gap_max": F.max("gap"), "l_gap_min": F.min("gap"), "l_gap_pos": F.count_if(c("gap") > 0),
            "l_gap_sd": F.stddev_pop(F.when(c("gap") > 0, c("gap"))),
            "l_paid_n": F.count("paid"), "l_paid_sd": F.stddev_pop("paid"), "l_paid_avg": F.avg("paid"),
            # Plain numbers and dates keep this a hash aggregate.
            "l_first": F.max(F.when(idx == 0, v)), "l_first_date": F.min("pdate"), "l_first_tie": F.max(F.when(idx == 0, c("tie"))),
            "l_last": F.max(F.when(idx == n - 1, v)), "l_last_date": F.max("pdate"), "l_last_tie": F.max(F.when(idx == n - 1, c("tie"))),
            "l_med_v": F.max("med_v"), "l_med_gap": F.max("med_gap"),
            "l_slope_new": F.regr_slope(F.when(newer, v), F.when(newer, idx)),
            "l_slope_old": F.regr_slope(F.when(~newer, v), F.when(~newer, idx)),
            "l_avg_new": F.avg(F.when(newer, v)), "l_avg_old": F.avg(F.when(~newer, v)),
            "l_recency": F.sum(weight * v) / F.sum(weight),
            "l_third": F.avg(F.when(third, c("late").cast("double"))),
            "l_last_late": F.max("late_at"),
            "l_change": F.avg(F.abs(v - c("v1"))),
            "l_n6": F.count_if(in6), "l_late6": F.count_if(in6 & (v > 0)), "l_max6": F.max(F.when(in6, v)),
            "l_avg6": F.avg(F.when(in6, v)),
            "l_slope6": F.regr_slope(F.when(in6, v), F.when(in6, idx)),
            "l_oavg6": F.avg("o6"), "l_omax6": F.max("o6"),
            "l_over6": F.count_if(c("o6") > self.cfg.overdue_tol),
            "l_stay": share(s == 0, s1 == 0), "l_slip": share(s > 0, s1 == 0),
            "l_cure": share(s == 0, s1 > 0), "l_worse": share(s > s1, s1 > 0),
            "l_severe": share(s >= 2, s1 >= 2),
            "l_arrears": F.count_if(s > 0), "l_runs": F.count_if((s > 0) & (F.coalesce(s1, F.lit(0)) == 0)),
        }
        for k in (1, 2, 3):
            b, bk = c("late").cast("double"), c(f"late{k}").cast("double")
            aggs[f"l_cross{k}"] = F.sum(b * bk)
            aggs[f"l_ends{k}"] = F.sum(F.when(bk.isNotNull(), b + bk))
        return self.rows.groupBy("case_id", "line_id").agg(*[e.alias(k) for k, e in aggs.items()])

    def line_features(self) -> DataFrame:
        """Per-line values that are averaged over the lines of a case."""
        c = F.col
        n, n6 = c("l_n"), c("l_n6")
        p = c("l_late") / n
        lp = {
            "dpd_trend_slope_24m": F.when(n >= 3, c("l_slope_raw")),
            "std_payment_interval_days": F.when(c("l_gap_pos") >= 2, c("l_gap_sd")),
            "cv_payment_amount": F.when(c("l_paid_n") >= 2, c("l_paid_sd") / F.abs(c("l_paid_avg"))),
            "dpd_acceleration_24m": F.when(n >= 6, c("l_slope_new") - c("l_slope_old")),
            "dpd_recent_minus_old_24m": F.when(n >= 4, c("l_avg_new") - c("l_avg_old")),
            "recency_weighted_dpd_24m": c("l_recency"),
            "frac_late_recent_third_24m": F.when(n >= 3, c("l_third")),
            "current_clean_streak_24m": (n - 1 - F.coalesce("l_last_late", F.lit(-1))).cast("double"),
            "dpd_mean_abs_change_24m": F.when(n >= 2, c("l_change")),
            "late_payment_entropy_24m": F.when(
                n >= 2,
                F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p))),
            ),
            "num_dpd_events_6m": F.when(n6 > 0, c("l_late6").cast("double")),
            "pct_dpd_payments_6m": F.when(n6 > 0, c("l_late6") / n6),
            "max_dpd_6m": c("l_max6"),
            "mean_dpd_6m": c("l_avg6"),
            "dpd_trend_slope_6m": F.when(n6 >= 3, c("l_slope6")),
            "avg_overdue_amount_6m": c("l_oavg6"),
            "max_overdue_amount_6m": c("l_omax6"),
            "pct_overdue_payments_6m": F.when(n6 > 0, c("l_over6") / n6),
            "pct_dpd_6m_minus_24m": F.when(n6 > 0, c("l_late6") / n6 - p),
            "mean_dpd_6m_minus_24m": c("l_avg6") - c("l_sum") / n,
            "avg_overdue_6m_minus_24m": c("l_oavg6") - c("l_oavg"),
            "mk_p_stay_current_24m": c("l_stay"),
            "mk_p_current_to_late_24m": c("l_slip"),
            "mk_p_late_to_cure_24m": c("l_cure"),
            "mk_p_late_to_worse_24m": c("l_worse"),
            "mk_p_severe_persist_24m": c("l_severe"),
            "mk_mean_arrears_run_24m": F.when(c("l_runs") > 0, c("l_arrears") / c("l_runs")),
        }
        for k in (1, 2, 3):
            m = p
            var = n * m * (1 - m)
            cov = c(f"l_cross{k}") - m * c(f"l_ends{k}") + (n - k) * m * m
            lp[f"dpd_late_autocorr_lag{k}_24m"] = F.when(
                n >= k + 2, F.when((c("l_late") == 0) | (c("l_late") == n), 0.0).otherwise(cov / var)
            )
        self._line_names = tuple(lp)
        return self.lines().withColumns({f"p_{k}": e for k, e in lp.items()})

    # -- one row per case ------------------------------------------------------
    def cases(self) -> DataFrame:
        lines = self.line_features()
        c = F.col
        total, gaps = F.sum("l_n"), F.sum("l_gap_n")

        def spread(square: str, plain: str, size: Column) -> Column:
            mean = F.sum(plain) / size
            return F.when(size >= 2, F.sqrt(F.greatest(F.sum(square) / size - mean * mean, F.lit(0.0)))).otherwise(0.0)

        agg: dict[str, Column] = {
            "max_dpd_24m": F.max("l_max"),
            "mean_dpd_24m": F.sum("l_sum") / total,
            "num_dpd_events_24m": F.sum("l_late").cast("double"),
            "num_serious_arrears_24m": F.sum("l_serious").cast("double"),
            "pct_dpd_payments_24m": F.sum("l_late") / total,
            "max_consecutive_dpd_24m": F.max("l_late_run").cast("double"),
            "longest_clean_streak_24m": F.max("l_clean_run").cast("double"),
            "max_overdue_amount_24m": F.max("l_omax"),
            "avg_overdue_amount_24m": F.sum("l_osum") / total,
            "total_overdue_amount": F.sum("l_osum"),
            "num_overdue_payments_24m": F.sum("l_over").cast("double"),
            "pct_overdue_payments_24m": F.sum("l_over") / total,
            "num_active_obligations": F.count(F.lit(1)).cast("double"),
            "agg_dpd_count": total.cast("double"),
            "agg_dpd_mean": F.sum("l_sum") / total,
            "agg_dpd_max": F.max("l_max"), "agg_dpd_min": F.min("l_min"),
            "agg_dpd_std": spread("l_sumsq", "l_sum", total),
            "agg_dpd_sum": F.sum("l_sum"),
            "agg_dpd_median": F.max("l_med_v"),
            "agg_dpd_nonzero": F.sum("l_late").cast("double"),
            "agg_dpd_first": F.min_by("l_first", F.struct("l_first_date", "line_id", "l_first_tie")),
            "agg_dpd_last": F.max_by("l_last", F.struct("l_last_date", "line_id", "l_last_tie")),
            "agg_interval_count": gaps.cast("double"),
            "agg_interval_mean": F.when(gaps > 0, F.sum("l_gap_sum") / gaps),
            "agg_interval_max": F.max("l_gap_max"), "agg_interval_min": F.min("l_gap_min"),
            "agg_interval_std": spread("l_gap_sumsq", "l_gap_sum", gaps),
            "agg_interval_sum": F.sum("l_gap_sum"),
            "agg_interval_median": F.max("l_med_gap"),
            "agg_interval_nonzero": F.sum("l_gap_pos").cast("double"),
            # Instalment list of last resort: the median paid on each line.
            "fb_n": F.count_if(c("l_inst") > 0), "fb_sum": F.sum("l_inst"), "fb_max": F.max("l_inst"),
            "fb_min": F.min("l_inst"), "fb_std": F.stddev_pop("l_inst"),
        }
        for name in self._line_names:
            agg[name] = F.avg(f"p_{name}")
        if self.hot_cases is not None:
            lines = cut_lineage(lines, "lines")
        return group_stats(lines, ["case_id"], agg, {"fb_median": "l_inst"}, self.hot_cases, probe=False)


def instalment_stats(instalments: DataFrame) -> DataFrame:
    """Per-case statistics of the contractual instalments; zero amounts do not count."""
    amt = F.when(F.col("amount") != 0, F.col("amount"))
    rows = instalments.select("case_id", amt.alias("amt"))
    aggs = {
        "in_rows": F.count(F.lit(1)), "in_n": F.count("amt"), "in_sum": F.sum("amt"), "in_max": F.max("amt"), "in_min": F.min("amt"),
        "in_std": F.stddev_pop("amt"), "in_pos": F.count_if(F.col("amt") > 0),
    }
    return group_stats(rows, ["case_id"], aggs, {"in_median": "amt"})


def balance_stats(balances: DataFrame, applicants: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Mean and lowest current and savings balance of the last three months."""
    kept = balances.filter(F.col("acct_type").isin("current", "savings")).select("case_id", "bdate", "balance")
    hot = hot_groups(kept, ["case_id"])
    dated = join_one_row(kept, applicants.select("case_id", "as_of"), ["case_id"], hot)
    return (
        in_window(dated, cfg.short_months, cfg, "bdate")
        .groupBy("case_id")
        .agg(F.avg("balance").alias("mean_balance_3m"), F.min("balance").alias("min_balance_3m"))
    )


def build(
    payments: DataFrame,
    applicants: DataFrame,
    instalments: DataFrame,
    balances: DataFrame,
    names: Sequence[str] = NAMES,
    cfg: Settings = DEFAULT,
) -> DataFrame:
    """One row per applicant with the wanted features, as doubles."""
    names = list(names)
    wanted = set(names)
    declared = {n for n in NAMES if n.startswith("declared_")} | {"monthly_income"}
    balance_side = {"mean_balance_3m", "min_balance_3m"}
    listed = {"total_annuity", "avg_instalment_amount", "debt_to_income", "payment_to_income"} | {
        n for n in NAMES if n.startswith("agg_instal_")
    }
    out = applicants
    from_payments = wanted - declared - balance_side
    if from_payments:
        out = out.join(PaymentWindow(payments, applicants, cfg).cases(), "case_id", "left")
    if wanted & listed:
        out = out.join(instalment_stats(instalments), "case_id", "left")
    if wanted & balance_side:
        out = out.join(balance_stats(balances, applicants, cfg), "case_id", "left")

    c = F.col
    exprs: dict[str, Column] = {}
    income = F.when(c("monthly_income") != 0, c("monthly_income"))
    if wanted & listed:
        own = c("in_rows") > 0

        def pick(a: str, b: str) -> Column:
            return F.when(own, c(a)).otherwise(c(b))

        count = F.coalesce(pick("in_n", "fb_n"), F.lit(0))
        total = F.coalesce(pick("in_sum", "fb_sum"), F.lit(0.0))
        top = F.coalesce(pick("in_max", "fb_max"), F.lit(0.0))
        mean = F.when(count > 0, total / count)
        exprs |= {
            "total_annuity": total,
            "avg_instalment_amount": mean,
            "debt_to_income": total / income,
            "payment_to_income": F.when(income.isNotNull(), top / income),
            "agg_instal_count": count.cast("double"), "agg_instal_mean": mean,
            "agg_instal_max": top, "agg_instal_min": pick("in_min", "fb_min"),
            "agg_instal_std": F.when(count >= 2, pick("in_std", "fb_std")),
            "agg_instal_sum": total, "agg_instal_median": pick("in_median", "fb_median"),
            "agg_instal_nonzero": F.coalesce(pick("in_pos", "fb_n"), F.lit(0)).cast("double"),
        }
    text = {k: clean.clean_text(c(k)) for k in ("income_type", "education", "housing", "employment") if k in out.columns}
    stated = F.when(c("stated_income") > 0, c("stated_income")) if "stated_income" in out.columns else F.lit(None).cast("double")
    exprs |= {
        "monthly_income": income,
        "declared_income_gap": F.abs(stated - income) / F.greatest(F.abs(stated), F.abs(income)),
    }
    # `greatest` skips nulls, but the numerator is null whenever either side is.
    if text:
        exprs |= {
            "declared_income_is_employment": clean.is_employment(text["income_type"]),
            "declared_is_homeowner": F.lower(text["housing"]).contains("own").cast("double"),
            "declared_income_type_code": clean.text_code(text["income_type"]),
            "declared_education_code": clean.text_code(text["education"]),
            "declared_housing_code": clean.text_code(text["housing"]),
            "declared_employment_code": clean.text_code(text["employment"]),
        }
    defaults = {s.name: s.default for s in SPECS}
    cols = []
    for name in names:
        e = exprs.get(name, F.col(name) if name in out.columns else F.lit(None).cast("double"))
        if defaults[name] is not None:
            e = F.coalesce(e.cast("double"), F.lit(defaults[name]))
        cols.append(e.cast("double").alias(name))
    return out.select("case_id", *cols)
