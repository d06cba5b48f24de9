"""Recurring streams, payment schedules and income from plain bank transactions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duepath.config import DEFAULT, Settings
from duepath.functions import clean
from duepath.operators.ordered import (
    Index,
    Lag,
    NextMin,
    OrderedGroups,
    RunningMax,
    RunningSum,
    group_stats,
    hot_groups,
    join_one_row,
    join_salted,
    spread_back,
)
from duepath.session import cut_lineage

LINE = ("case_id", "line_id")


def variation(value: str) -> Column:
    """Population sd over the size of the mean; 0 for one value or a zero mean."""
    mean = F.avg(value)
    return F.when((F.count(value) < 2) | (mean == 0), 0.0).otherwise(F.stddev_pop(value) / F.abs(mean))


def robust_stats(df: DataFrame, keys: Sequence[str], value: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Count, median, scaled median absolute deviation and variation of a column per group."""
    hot = hot_groups(df, keys)
    middle = group_stats(df, keys, {"n": F.count(value), "cv": variation(value)}, {"median": value}, hot, probe=False)
    away = join_one_row(df.filter(F.col(value).isNotNull()), middle.select(*keys, "median"), list(keys), hot).select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("_dev")
    )
    devs = group_stats(away, keys, {}, {"_mad": "_dev"}, hot, probe=False)
    out = middle.join(devs, list(keys), "left")
    return out.select(
        *keys, "n", "median", F.when(F.col("n") >= 2, F.col("_mad") * cfg.mad_scale).otherwise(0.0).alias("mad"), "cv"
    )


def debits(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("amount") > 0)


def detect(transactions: DataFrame, cfg: Settings = DEFAULT, probe: bool = True, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(streams, payments). A stream is a payee and a rounded amount that recurs at a steady
    pace; input columns: case_id, payee, tdate, amount (money out > 0), txn_id, hint. ``write`` writes the streams before
    the payments read them, for callers that read both."""
    keys = ["case_id", "payee", "bucket"]
    scale = 10.0 ** cfg.amount_round_dp
    bucket = F.bround(F.col("amount"), cfg.amount_round_dp) if cfg.amount_round_dp >= 0 else F.bround(F.col("amount") * scale) / scale
    rows = debits(transactions).select("case_id", "payee", bucket.alias("bucket"), "tdate", "txn_id", "amount", "hint")
    grouped = OrderedGroups(rows, keys, ["tdate", "txn_id"], probe=probe)
    grouped.add(before=Lag("tdate"))
    timed = grouped.done().withColumn("gap", F.datediff("tdate", "before"))
    # Gaps are whole days, so the exact percentile keeps a small count table however many rows.
    streams = (
        timed.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"), F.percentile("gap", F.lit(0.5)).alias("period"), variation("amount").alias("cv"),
            F.min("tdate").alias("opened"), F.min_by("hint", F.struct("tdate", "txn_id")).alias("hint"),
        )
        .filter(
            (F.col("n") >= cfg.min_payments)
            & F.col("period").between(cfg.period_min_days, cfg.period_max_days)
            & (F.col("cv") <= cfg.amount_cv_max)
        )
        .withColumn("kind", clean.line_kind(F.col("payee"), F.col("hint")))
    )
    if write:
        streams = cut_lineage(streams, "streams")
    line_id = F.concat(F.lit("stream::"), F.col("payee"), F.lit("#"), F.col("bucket").cast("string"))
    payments = join_one_row(rows, streams.select(*keys), keys, grouped.hot).select(
        "case_id", line_id.alias("line_id"), F.col("tdate").alias("pdate"), F.col("txn_id").alias("tie"), "amount",
        F.lit(None).cast("double").alias("overdue"), F.lit(None).cast("double").alias("dpd"),
    )
    return streams.withColumn("line_id", line_id), payments


def seed_mandates(mandates: DataFrame, streams: DataFrame, transactions: DataFrame, probe: bool = True) -> tuple[DataFrame, DataFrame]:
    """(lines, payments) for mandates whose payee formed no stream, with the debits that cleared."""
    unseen = mandates.join(streams.select("case_id", "payee").distinct(), ["case_id", "payee"], "left_anti")
    numbered = OrderedGroups(unseen, ["case_id", "payee"], ["amount"]).add(no=Index()).done()
    lines = numbered.select(
        "case_id", "payee", F.concat(F.lit("mandate::"), F.col("payee"), F.lit("#"), F.col("no").cast("string")).alias("line_id"),
        clean.line_kind(F.col("payee"), F.lit("")).alias("kind"), F.col("amount").alias("scheduled"),
    )
    paid = debits(transactions)
    keys = ["case_id", "payee"]
    payments = join_salted(paid, lines.select(*keys, "line_id"), keys, hot_groups(paid, keys) if probe else None).select(
        "case_id", "line_id", F.col("tdate").alias("pdate"), F.col("txn_id").alias("tie"), "amount",
        F.lit(None).cast("double").alias("overdue"), F.lit(None).cast("double").alias("dpd"),
    )
    return lines, payments


def scheduled_instalment(payments: DataFrame) -> DataFrame:
    """Median positive amount paid on each line."""
    rows = payments.filter(F.col("amount") > 0).select(*LINE, "amount")
    return group_stats(rows, LINE, {}, {"instalment": "amount"})


def instalments(mandates: DataFrame, payments: DataFrame) -> DataFrame:
    """The mandate amounts of a case if it has any mandate, else one instalment per line."""
    listed = mandates.select("case_id").distinct()
    derived = scheduled_instalment(payments).join(listed, "case_id", "left_anti").select("case_id", F.col("instalment").alias("amount"))
    return mandates.select("case_id", "amount").unionByName(derived)


def whole_days(value: Column) -> Column:
    return F.bround(value).cast("int")


class Schedule:
    """Cadence of each line and the distance of each payment from it.

    ``distinct`` reads several payments of one day as one date. Columns added: gap, period,
    anchor, step, cycle, expected (date), off (signed days late) and late.
    """

    def __init__(self, payments: DataFrame, distinct: bool = True, cfg: Settings = DEFAULT, keys: Sequence[str] = LINE,
                 hot: DataFrame | None = None, probe: bool = True):
        self.cfg = cfg
        self.keys = list(keys)
        lines = OrderedGroups(payments, self.keys, ["pdate", "tie"], hot, probe)
        self.hot = lines.hot
        lines.add(before=Lag("pdate"))
        gap = F.datediff("pdate", "before")
        lines.df = lines.df.withColumn("gap", F.when(gap > 0, gap) if distinct else gap)
        for name, value in (("period", F.percentile("gap", F.lit(0.5))), ("anchor", F.min("pdate"))):
            lines.df = spread_back(lines.df, self.keys, value, name, self.hot)
        usable = F.col("period") > 0
        step = F.greatest(F.lit(1), whole_days(F.col("gap") / F.col("period")))
        lines.df = lines.df.withColumn("step", F.when(F.col("gap").isNull(), 0).when(usable, step))
        lines.add(cycle=RunningSum("step"))
        expected = whole_days(F.col("cycle") * F.col("period"))
        lines.df = lines.df.withColumns({
            "expected": F.date_add("anchor", expected),
            "off": F.datediff("pdate", "anchor") - expected,
        }).withColumn("late", F.col("off") > F.greatest(F.lit(float(cfg.ontime_abs_tol_days)), cfg.ontime_rel_tol * F.col("period")))
        self.rows = lines.done()
        self.distinct = distinct

    def points(self) -> DataFrame:
        """One row per payment date of a line with a cadence."""
        first_of_day = F.col("before").isNull() | F.col("gap").isNotNull()
        return self.rows.filter(first_of_day & F.col("period").isNotNull())

    def skipped(self) -> DataFrame:
        return self.points().groupBy(*self.keys).agg(
            F.sum(F.when(F.col("gap").isNotNull(), F.col("step") - 1).otherwise(0)).alias("n_skipped"))

    def with_dpd(self) -> DataFrame:
        """Payments with lateness filled in where the source gave none."""
        cap = F.lit(self.cfg.dpd_cap_days)
        inferred = F.least(F.greatest(F.coalesce(F.col("off"), F.lit(0)), F.lit(0)).cast("double"), cap)
        rows = spread_back(self.rows, self.keys, F.count(F.lit(1)), "n_line", self.hot)
        fill = F.col("dpd").isNull() & (F.col("n_line") >= 2)
        return rows.withColumn("dpd", F.when(fill, inferred).otherwise(F.col("dpd"))).drop("n_line")


PAYMENT_COLUMNS = ("case_id", "line_id", "pdate", "tie", "amount", "overdue", "dpd")


def missed_cycles(payments: DataFrame, cfg: Settings = DEFAULT, hot: DataFrame | None = None, probe: bool = True) -> DataFrame:
    """One zero payment per empty cycle of a line with at least three payments. Works on all
    dates, so a second payment on one day moves the cycle count on."""
    sched = Schedule(payments, distinct=False, cfg=cfg, hot=hot, probe=probe)
    facts = group_stats(payments.withColumn("paid", F.when(F.col("amount") > 0, F.col("amount"))), LINE,
                        {"n": F.count(F.lit(1))}, {"instalment": "paid"}, sched.hot, probe=False)
    holes = sched.rows.filter((F.col("step") > 1) & (F.col("period") > 0))
    joined = join_one_row(holes, facts.filter((F.col("n") >= 3) & (F.col("instalment") > 0)), list(LINE), sched.hot)
    cycles = joined.select(
        *LINE, "tie", "anchor", "period", "instalment",
        F.explode(F.sequence(F.col("cycle") - F.col("step") + 1, F.col("cycle") - 1)).alias("cyc"),
    )
    return cycles.select(
        *LINE, F.date_add("anchor", whole_days(F.col("cyc") * F.col("period"))).alias("pdate"),
        (-F.col("cyc") - 1).cast("bigint").alias("tie"), F.lit(0.0).alias("amount"), F.col("instalment").alias("overdue"),
        F.lit(float(cfg.missed_dpd_days)).alias("dpd"),
    )


def complete_history(payments: DataFrame, cfg: Settings = DEFAULT, probe: bool = True) -> DataFrame:
    """Observed payments with inferred lateness, and the missed ones."""
    hot = hot_groups(payments, LINE) if probe else None
    if hot is None:
        return _history_at_once(payments, cfg)
    seen = Schedule(payments, distinct=True, cfg=cfg, hot=hot, probe=False).with_dpd().select(*PAYMENT_COLUMNS)
    return seen.unionByName(missed_cycles(payments, cfg, hot, probe=False))


def _history_at_once(payments: DataFrame, cfg: Settings) -> DataFrame:
    """Both schedules of ``complete_history`` over one ordering of the lines: ``d_`` columns read the payments of one day as
    one date, ``m_`` columns count every payment. A row brings the empty cycles before it along."""
    c, line = F.col, Window.partitionBy(*LINE)
    ordered = line.orderBy("pdate", "tie")
    past = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = payments.select(*PAYMENT_COLUMNS, F.datediff("pdate", F.lag("pdate").over(ordered)).alias("m_gap"))
    rows = rows.withColumn("d_gap", F.when(c("m_gap") > 0, c("m_gap")))
    rows = rows.select(
        "*", F.min("pdate").over(line).alias("anchor"), F.count(F.lit(1)).over(line).alias("n_line"),
        F.percentile("d_gap", F.lit(0.5)).over(line).alias("d_period"), F.percentile("m_gap", F.lit(0.5)).over(line).alias("m_period"),
        F.percentile(F.when(c("amount") > 0, c("amount")), F.lit(0.5)).over(line).alias("instalment"),
    )

    def step(kind: str) -> Column:
        gap, period = c(f"{kind}_gap"), c(f"{kind}_period")
        return F.when(gap.isNull(), 0).when(period > 0, F.greatest(F.lit(1), whole_days(gap / period)))

    rows = rows.withColumns({"d_step": step("d"), "m_step": step("m")})
    rows = rows.select("*", F.sum("d_step").over(past).alias("d_cycle"), F.sum("m_step").over(past).alias("m_cycle"))
    off = F.datediff("pdate", "anchor") - whole_days(c("d_cycle") * c("d_period"))
    inferred = F.least(F.greatest(F.coalesce(off, F.lit(0)), F.lit(0)).cast("double"), F.lit(cfg.dpd_cap_days))
    empty = ((c("m_step") > 1) & (c("m_period") > 0) & (c("n_line") >= 3) & (c("instalment") > 0)
             & c("case_id").isNotNull() & c("line_id").isNotNull())
    rows = rows.select(
        *LINE, "pdate", "tie", "amount", "overdue", "anchor", "m_period", "instalment",
        F.when(c("dpd").isNull() & (c("n_line") >= 2), inferred).otherwise(c("dpd")).alias("dpd"),
        (c("m_cycle") - c("m_step")).alias("done"), F.when(empty, c("m_step") - 1).otherwise(0).alias("n_empty"),
    )
    # 0 is the payment itself, the others are the cycles between it and the one before.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), c("n_empty"))).alias("k"))
    seen, cyc = c("k") == 0, c("done") + c("k")
    return rows.select(
        *LINE,
        F.when(seen, c("pdate")).otherwise(F.date_add("anchor", whole_days(cyc * c("m_period")))).alias("pdate"),
        F.when(seen, c("tie")).otherwise((-cyc - 1).cast("bigint")).alias("tie"),
        F.when(seen, c("amount")).otherwise(0.0).alias("amount"),
        F.when(seen, c("overdue")).otherwise(c("instalment")).alias("overdue"),
        F.when(seen, c("dpd")).otherwise(F.lit(float(cfg.missed_dpd_days))).alias("dpd"),
    )


def profile(payments: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Delinquency profile per line from its schedule."""
    sched = Schedule(payments, distinct=True, cfg=cfg)
    points = sched.points().select(*LINE, "pdate", "gap", "step", "late", F.greatest("off", F.lit(0)).alias("days"))
    # Points are a part of the payments, so without a hot line there is nothing to look up.
    lines = OrderedGroups(points, LINE, ["pdate"], probe=sched.hot is not None)
    lines.df = lines.df.withColumn("ontime_date", F.when(~F.col("late"), F.col("pdate")))
    lines.add(idx=Index(), next_ontime=NextMin("ontime_date"))
    lines.df = lines.df.withColumn("late_at", F.when(F.col("late"), F.col("idx")))
    lines.add(last_late=RunningMax("late_at"))
    idx = F.col("idx")
    run = F.when(~F.col("late"), idx - F.coalesce("last_late", F.lit(-1)))
    recover = F.when(F.col("late"), F.datediff("next_ontime", "pdate"))
    out = lines.done().groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("n_payments"), F.count_if("late").alias("n_late"),
        F.sum(F.when(F.col("gap").isNotNull(), F.col("step") - 1).otherwise(0)).alias("n_missed"),
        F.coalesce(F.max(run), F.lit(0)).alias("longest_ontime"),
        F.bround(F.avg(recover)).alias("days_to_recover"),
        F.stddev_pop("gap").alias("interval_sd"), F.regr_slope(F.col("days"), idx).alias("slope"),
        F.sum("days").alias("dpd_sum"),
    )
    big = F.col("n_payments") >= 3
    return out.select(
        *LINE, "n_payments", "n_late", "n_missed", "longest_ontime", "days_to_recover",
        F.when(big, F.col("interval_sd")).alias("interval_sd"), F.when(big, F.col("slope")).alias("dpd_slope"),
        (F.col("dpd_sum") + F.col("n_missed") * cfg.missed_dpd_days).cast("double").alias("capped_dpd_sum"),
    )


def income_streams(transactions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Recurring credits per payee with their monthly value; input: case_id, payee, tdate,
    txn_id, amount (money in > 0)."""
    keys = ["case_id", "payee"]
    rows = transactions.filter((F.col("amount") > 0) & F.col("tdate").isNotNull()).select(*keys, "tdate", "txn_id", "amount")
    grouped = OrderedGroups(rows, keys, ["tdate", "txn_id"])
    grouped.add(before=Lag("tdate"))
    gap = F.datediff("tdate", "before")
    timed = grouped.done().withColumn("gap", F.when(gap > 0, gap))
    stats = group_stats(
        timed, keys,
        {"n": F.count(F.lit(1)), "n_gaps": F.count("gap"), "cv": variation("amount"), "period": F.percentile("gap", F.lit(0.5))},
        {"typical": "amount"}, grouped.hot, probe=False,
    )
    return (
        stats.filter(
            (F.col("n") >= cfg.income_min_events) & (F.col("n_gaps") >= cfg.income_min_events - 1)
            & F.col("period").between(cfg.income_period_min_days, cfg.income_period_max_days)
            & (F.col("cv") <= cfg.income_amount_cv_max)
        )
        .withColumn("monthly", clean.to_monthly(F.col("typical"), F.col("period"), cfg))
        .filter(F.col("monthly") >= cfg.income_min_monthly)
        .withColumn("salary_named", clean.is_salary(F.col("payee")))
    )


def monthly_income(transactions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The largest salary-named stream of a case, else its largest stream."""
    return income_streams(transactions, cfg).groupBy("case_id").agg(
        F.coalesce(F.max(F.when(F.col("salary_named"), F.col("monthly"))), F.max("monthly")).alias("monthly_income")
    )


# -- a whole feed --------------------------------------------------------------------------------------


def feed_history(transactions: DataFrame, mandates: DataFrame, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(payments, instalments, income) of a bank feed: recurring debits and the mandates they don't show become lines,
    lateness and missed cycles are inferred from their schedules, and steady credits are the income.

    transactions: case_id, txn_id, tdate, payee, hint, amount (money out > 0); mandates: case_id, payee, amount. The lines'
    payments are written once, since schedules, missed cycles and instalments all read them.
    """
    found, paid = detect(transactions, cfg, write=True)
    _, seeded = seed_mandates(mandates, found, transactions)
    lines = cut_lineage(paid.unionByName(seeded), "feed-lines")
    credits = transactions.withColumn("amount", -F.col("amount"))
    return complete_history(lines, cfg), instalments(mandates, lines), monthly_income(credits, cfg)


# -- between the two sources ------------------------------------------------------------------------


def to_cycles(payments: DataFrame, applicants: DataFrame, instalments: DataFrame, cfg: Settings = DEFAULT,
              keep: int = 22, fallback: float = 100.0, digits: int = 2) -> DataFrame:
    """The last payments of each line on a 30-day grid that ends at the decision."""
    hot_cases = hot_groups(payments, ["case_id"])
    # A line is only as hot as its case, so the second look-up is rarely needed.
    # Dealt by case, the lines meet their case below without moving again.
    dealt = payments.repartition("case_id") if hot_cases is None else payments
    lines = OrderedGroups(dealt, LINE, ["pdate", "tie"], hot_groups(payments, LINE) if hot_cases is not None else None, probe=False)
    # Newest first is read off the group size, so one ordering serves.
    lines.add(idx=Index())
    sized = spread_back(lines.done(), LINE, F.count(F.lit(1)), "n_all", lines.hot)
    last = sized.filter(F.col("idx") >= F.col("n_all") - keep)
    typical = group_stats(instalments.filter(F.col("amount") > 0), ["case_id"], {}, {"typical": "amount"})
    side = applicants.select("case_id", "as_of").join(typical, "case_id", "left")
    n = F.least(F.col("n_all"), F.lit(keep))
    i = F.col("idx") - (F.col("n_all") - n)
    return join_one_row(last, side, ["case_id"], hot_cases).select(
        "case_id", "line_id", "as_of", i.cast("int").alias("i"), n.cast("int").alias("n"),
        F.date_add("as_of", (i * 30 - n * 30).cast("int")).alias("due"),
        F.bround(F.coalesce("typical", F.lit(fallback)), digits).alias("instalment"),
        F.least(F.greatest(F.coalesce("dpd", F.lit(0.0)), F.lit(0.0)), F.lit(cfg.dpd_cap_days)).alias("dpd"),
        F.greatest(F.coalesce("overdue", F.lit(0.0)), F.lit(0.0)).alias("overdue"),
    )


def resolve_cycles(cycles: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Lateness clipped; an unknown overdue is the instalment of a missed cycle, else 0."""
    dpd = F.least(F.greatest(F.col("dpd"), F.lit(0.0)), F.lit(cfg.dpd_cap_days))
    over = F.when(F.col("overdue").isNotNull(), F.greatest(F.col("overdue"), F.lit(0.0))).otherwise(
        F.when(dpd >= cfg.dpd_cap_days, F.col("instalment")).otherwise(0.0))
    return cycles.withColumns({"dpd": dpd, "overdue": over})


def cycles_as_payments(cycles: DataFrame) -> DataFrame:
    """The bureau rendering: every cycle is reported, paid or not."""
    return cycles.select(
        "case_id", "line_id", F.col("due").alias("pdate"), F.col("i").cast("bigint").alias("tie"), F.lit(0.0).alias("amount"),
        "overdue", "dpd",
    )


def letters(position: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA ...: a payee suffix without digits."""
    n = position + 1

    def place(k: int) -> Column:
        # Letters are digits 1-26, so every shorter suffix comes before the longer ones.
        shorter = sum(26**j for j in range(1, k + 1))
        code = 65 + F.pmod(F.floor((n - 1 - shorter) / F.lit(26**k)).cast("bigint"), F.lit(26))
        return F.when(n > shorter, F.char(code))

    return F.concat_ws("", *[place(k) for k in reversed(range(8))])


def line_numbers(cycles: DataFrame) -> DataFrame:
    """Lines of a case numbered from 0 in id order."""
    lines = cycles.select("case_id", "line_id").distinct()
    return OrderedGroups(lines, ["case_id"], ["line_id"]).add(line_no=Index()).done()


def cycles_as_transactions(cycles: DataFrame, applicants: DataFrame, missed_from: int = 15, salaries: int = 14) -> tuple[DataFrame, DataFrame]:
    """(transactions, mandates) as a bank would show the same history: a late cycle is paid
    late, a cycle from ``missed_from`` days on is not there, salary arrives every 30 days."""
    if hot_groups(cycles, ["case_id"]) is None:
        by_line = Window.partitionBy("case_id").orderBy("line_id")
        numbered = cycles.withColumn("line_no", (F.dense_rank().over(by_line) - 1).cast("bigint"))
        numbered = numbered.filter(F.col("case_id").isNotNull() & F.col("line_id").isNotNull())
    else:
        numbered = join_one_row(cycles, line_numbers(cycles), list(LINE), hot_groups(cycles, list(LINE)))
    name = F.concat(F.lit("loan "), F.lower(letters(F.col("line_no"))))
    paid = numbered.filter(F.col("dpd") < missed_from).select(
        "case_id", name.alias("payee"), F.date_add("due", F.floor("dpd").cast("int")).alias("tdate"),
        (F.col("line_no") * 1000 + F.col("i")).cast("bigint").alias("txn_id"), F.col("instalment").alias("amount"),
        F.lit("DIRECT_DEBIT").alias("hint"),
    )
    inflow = applicants.filter(F.col("monthly_income") > 0).select(
        "case_id", "as_of", "monthly_income", F.explode(F.sequence(F.lit(0), F.lit(salaries - 1))).alias("m"))
    salary = inflow.select(
        "case_id", F.lit("acme corp salary").alias("payee"), F.date_sub("as_of", (salaries - 1 - F.col("m")) * 30).alias("tdate"),
        (-F.col("m") - 1).cast("bigint").alias("txn_id"), (-F.col("monthly_income")).alias("amount"), F.lit("CREDIT").alias("hint"),
    )
    terms = numbered.groupBy("case_id", "line_no").agg(F.max("instalment").alias("amount"))
    mandates = terms.select("case_id", name.alias("payee"), "amount")
    return paid.unionByName(salary), mandates


def history_from_transactions(transactions: DataFrame, mandates: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The whole bank-feed path to payments: streams, seeded mandates, lateness, missed cycles."""
    # Streams and lines are parts of a case, so without a hot case there is nothing else to look up.
    probe = hot_groups(transactions, ["case_id"]) is not None
    streams, found = detect(transactions, cfg, probe, write=True)
    _, seeded = seed_mandates(mandates, streams, transactions, probe)
    # Read by the look-up for hot lines and by the passes over the schedule.
    paid = cut_lineage(found.unionByName(seeded), "feed-payments")
    return cut_lineage(complete_history(paid, cfg, probe), "feed-history")
