"""Ordered work inside groups that may be too big for one task.

Lags, running sums, running maxima and exact quantiles are window functions as long as
every group is small. The rows of groups above ``duepath.hotGroupRows`` are range-partitioned
by group and order; each range is a segment and one window partition, and one summary row per
group and segment carries the state of the earlier segments over. Which groups are hot is
looked up when the plan is made, so ordinary data gets the plain window plan and nothing else.

The hot list, the segments and the summaries are written tables: their number follows the
data (never more than one per ``hotGroupRows`` rows, twice over), nothing of them is cut, and
whether a join broadcasts them is decided by Spark from their size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duepath.session import cut_lineage

SEG = "_seg"


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("duepath.hotGroupRows", "2000000"))


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """The groups with more than ``limit`` rows and their sizes as a written table, or None."""
    limit = hot_limit(df) if limit is None else limit
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    return None if counts.isEmpty() else cut_lineage(counts, "hot")


def keep_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _match(df, hot.select(*keys), keys, "left_semi")


def drop_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _match(df, hot.select(*keys), keys, "left_anti")


def _same_keys(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys; groups may have null keys."""
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[f"_k_{k}"]) for k in keys])


def _match(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    if not keys:
        return df if how == "left_semi" else df.limit(0)
    side = few.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    return df.join(side, _same_keys(df, side, keys), how)


def _attach(df: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a table with unique keys; no key means a one-row table, the only one broadcast by hand."""
    if not keys:
        one = F.broadcast(few.withColumn("_one", F.lit(1)))
        return df.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")
    side = few.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    return df.join(side, _same_keys(df, side, keys), "left").drop(*[f"_k_{k}" for k in keys])


def join_one_row(
    big: DataFrame, small: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join to a table with one row per key. The rows that hot keys meet are written first: few of
    them are broadcast, and many have a known size, so their shuffled join can be split."""
    keys = list(keys)
    if hot is None:
        return big.join(small, keys, how)
    few = cut_lineage(keep_hot(small, hot, keys), "few")
    cold = drop_hot(big, hot, keys).join(small, keys, how)
    return cold.unionByName(keep_hot(big, hot, keys).join(few, keys, how))


def join_salted(
    big: DataFrame, small: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "inner", salts: int = 64
) -> DataFrame:
    """Join to a table with several rows per key. Rows of a hot key are dealt over ``salts``
    places and the other side's rows of that key are repeated in each of them."""
    keys = list(keys)
    if hot is None:
        return big.join(small, keys, how)
    dealt = keep_hot(big, hot, keys).withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = keep_hot(small, hot, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cold = drop_hot(big, hot, keys).join(small, keys, how)
    return cold.unionByName(dealt.join(copies, [*keys, "_salt"], how).drop("_salt"))


def _segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` with a segment number that never falls along the order of a hot group; 0 in other groups.

    Ranges are cut at sampled values of the whole (keys, order) tuple; rows that tie on it are
    told apart by a hash of all columns, so a group of ties is split as well. The number is
    written with the row, so a task that runs again sees the same segments.
    """
    rows = hot.agg(F.sum("_rows")).first()[0]
    parts = max(2, math.ceil(rows / hot_limit(df)))
    ranged = keep_hot(df, hot, keys).withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(parts, *keys, *order, "_tie")
    split = cut_lineage(ranged.drop("_tie").withColumn(SEG, F.spark_partition_id() + 1), "ranges")
    return drop_hot(df, hot, keys).withColumn(SEG, F.lit(0)).unionByName(split) if keys else split


@dataclass(frozen=True)
class Index:
    """0-based position inside the group."""


@dataclass(frozen=True)
class Total:
    """Number of rows of the group."""


@dataclass(frozen=True)
class Lag:
    column: str
    offset: int = 1


@dataclass(frozen=True)
class RunningSum:
    """Sum of a column up to and including the row."""

    column: str


@dataclass(frozen=True)
class RunningMax:
    """Largest non-null value up to and including the row."""

    column: str


@dataclass(frozen=True)
class NextMin:
    """Smallest non-null value at or after the row."""

    column: str


class OrderedGroups:
    """Rows of ``df`` in groups ``keys``, ordered by ``order`` inside each group.

    ``hot`` passes groups already known to be hot; ``probe=False`` says they were looked
    up before. ``written`` says that ``df`` is a table and need not be written again.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame | None = None,
                 probe: bool = True, written: bool = False):
        self.keys = list(keys)
        self.order = list(order)
        if hot is None and probe:
            hot = hot_groups(df, self.keys)
        self.hot = hot
        if hot is not None:
            # Rows of hot and of other groups are read apart; a written table keeps that cheap and stable.
            df = _segmented(df if written else cut_lineage(df, "ordered"), self.keys, self.order, hot)
        self.df = df

    def _partition(self) -> list[str]:
        return self.keys + ([SEG] if self.hot is not None else [])

    def _window(self, descending: bool = False) -> Window:
        parts = [F.col(c) for c in self._partition()] or [F.lit(0)]
        order = [F.desc(c) if descending else F.asc(c) for c in self.order]
        return Window.partitionBy(*parts).orderBy(*order)

    def add(self, **columns: Index | Total | Lag | RunningSum | RunningMax | NextMin) -> "OrderedGroups":
        """Add the named ordered columns; returns self for chaining."""
        ordered = self._window()
        past = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        future = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        whole = Window.partitionBy(*([F.col(c) for c in self._partition()] or [F.lit(0)]))
        local = {}
        for name, what in columns.items():
            if isinstance(what, Index):
                local[name] = F.row_number().over(ordered) - 1
            elif isinstance(what, Total):
                local[name] = F.count(F.lit(1)).over(whole)
            elif isinstance(what, Lag):
                local[name] = F.lag(what.column, what.offset).over(ordered)
            elif isinstance(what, RunningSum):
                local[name] = F.sum(what.column).over(past)
            elif isinstance(what, RunningMax):
                local[name] = F.max(what.column).over(past)
            else:
                local[name] = F.min(what.column).over(future)
        if self.hot is None:
            self.df = self.df.select("*", *[c.cast("bigint").alias(n) if isinstance(columns[n], (Index, Total)) else c.alias(n)
                                            for n, c in local.items()])
            return self
        return self._add_with_carry(columns, local, ordered, whole)

    def _add_with_carry(self, columns, local, ordered, whole) -> "OrderedGroups":
        reach = max([w.offset for w in columns.values() if isinstance(w, Lag)], default=0)
        lagged = sorted({w.column for w in columns.values() if isinstance(w, Lag)})
        base = self.df.select(
            "*",
            F.row_number().over(ordered).alias("_rn"),
            F.count(F.lit(1)).over(whole).alias("_cn"),
            *[c.alias(n) for n, c in local.items()],
        )
        # Summaries and result both read the windowed rows; writing them keeps one window pass
        # per call, also when calls are chained.
        base = cut_lineage(base, "segments")
        inputs = base.select(
            *self.keys, SEG,
            *sorted({w.column for w in columns.values() if isinstance(w, (RunningSum, RunningMax, NextMin))} - set(self.keys)),
        )
        hot_inputs = inputs.filter(F.col(SEG) > 0)
        sums = [F.count(F.lit(1)).alias("_n")]
        for name, what in columns.items():
            if isinstance(what, RunningSum):
                sums.append(F.sum(what.column).alias(f"_s_{name}"))
            elif isinstance(what, RunningMax):
                sums.append(F.max(what.column).alias(f"_s_{name}"))
            elif isinstance(what, NextMin):
                sums.append(F.min(what.column).alias(f"_s_{name}"))
        summary = hot_inputs.groupBy(*self.keys, SEG).agg(*sums)
        if reach:
            tails = (
                base.filter((F.col(SEG) > 0) & (F.col("_cn") - F.col("_rn") < reach))
                .groupBy(*self.keys, SEG)
                .agg(F.array_sort(F.collect_list(F.struct("_rn", *lagged))).alias("_tail"))
            )
            joined = summary.alias("a").join(
                tails.select(*[F.col(c).alias(f"_k_{c}") for c in self.keys + [SEG]], "_tail").alias("b"),
                [F.col(f"a.{c}").eqNullSafe(F.col(f"b._k_{c}")) for c in self.keys + [SEG]],
                "left",
            )
            summary = joined.drop(*[f"_k_{c}" for c in self.keys + [SEG]])
        seg_order = Window.partitionBy(*([F.col(k) for k in self.keys] or [F.lit(0)])).orderBy(SEG)
        before = seg_order.rowsBetween(Window.unboundedPreceding, -1)
        after = seg_order.rowsBetween(1, Window.unboundedFollowing)
        all_segments = seg_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                   F.sum("_n").over(all_segments).alias("_all")]
        for name, what in columns.items():
            if isinstance(what, RunningSum):
                carried.append(F.sum(f"_s_{name}").over(before).alias(f"_c_{name}"))
            elif isinstance(what, RunningMax):
                carried.append(F.max(f"_s_{name}").over(before).alias(f"_c_{name}"))
            elif isinstance(what, NextMin):
                carried.append(F.min(f"_s_{name}").over(after).alias(f"_c_{name}"))
        if reach:
            carried.append(F.flatten(F.collect_list("_tail").over(seg_order.rowsBetween(-reach, -1))).alias("_tails"))
        carry = cut_lineage(summary.select(*self.keys, SEG, *carried), "carry")
        out = _attach(base, carry, self.keys + [SEG])
        final = {}
        for name, what in columns.items():
            here = F.col(name)
            if isinstance(what, Index):
                final[name] = (here + F.coalesce("_offset", F.lit(0))).cast("bigint")
            elif isinstance(what, Total):
                final[name] = F.coalesce("_all", here).cast("bigint")
            elif isinstance(what, RunningSum):
                carry_in = F.col(f"_c_{name}")
                final[name] = F.when(here.isNull(), carry_in).otherwise(here + F.coalesce(carry_in, F.lit(0)))
            elif isinstance(what, RunningMax):
                final[name] = F.greatest(here, F.col(f"_c_{name}"))
            elif isinstance(what, NextMin):
                final[name] = F.least(here, F.col(f"_c_{name}"))
            else:
                back = F.lit(what.offset) - F.col("_rn")
                item = F.get(F.col("_tails"), F.size("_tails") - 1 - back)
                final[name] = F.when(F.col("_rn") > what.offset, here).when(
                    F.col("_tails").isNotNull() & (F.size("_tails") > back), item[what.column]
                )
        kept = [c for c in self.df.columns]
        self.df = out.select(*kept, *[c.alias(n) for n, c in final.items()])
        return self

    def done(self) -> DataFrame:
        return self.df.drop(SEG)


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, alias: str = "q") -> DataFrame:
    """Interpolated quantile per group. Small groups use the built-in aggregate; a hot
    group is reduced to (value, count) and read off its running count."""
    keys = list(keys)
    df = df.select(*keys, value).filter(F.col(value).isNotNull())
    hot = hot_groups(df, keys)
    plain = F.percentile(value, F.lit(p)).alias(alias)
    if hot is None:
        return df.groupBy(*keys).agg(plain)
    big = hot_quantile(keep_hot(df, hot, keys), keys, value, p, alias)
    if not keys:
        return big
    return drop_hot(df, hot, keys).groupBy(*keys).agg(plain).unionByName(big)


def hot_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, alias: str) -> DataFrame:
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = OrderedGroups(counts, keys, [value]).add(_cum=RunningSum("_c")).done()
    ranked = _attach(ranked, cut_lineage(totals, "totals"), keys)
    place = F.lit(p) * (F.col("_n") - 1)
    lo, hi = F.floor(place), F.ceil(place)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= position) & (position < F.col("_cum")), F.col(value)))

    return (
        ranked.groupBy(*keys)
        .agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.max(place - lo).alias("_w"))
        .select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).cast("double").alias(alias))
    )


def value_quantiles(df: DataFrame, value: str, shares: dict[str, float], aggs: dict[str, Column] | None = None) -> DataFrame:
    """Several exact quantiles of one column as one row, with further aggregates over the
    counted values (columns ``value`` and ``_c``)."""
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    total = counts.agg(F.sum("_c")).first()[0] or 0
    ranked = OrderedGroups(counts, [], [value]).add(_cum=RunningSum("_c")).done()

    def at(place: int) -> Column:
        here = (F.col("_cum") - F.col("_c") <= place) & (F.lit(place) < F.col("_cum"))
        return F.max(F.when(here, F.col(value)))

    picks = []
    for name, share in shares.items():
        place = share * (total - 1)
        lo, hi = math.floor(place), math.ceil(place)
        picks.append((at(lo) + (at(hi) - at(lo)) * F.lit(place - lo)).cast("double").alias(name))
    return ranked.agg(*picks, *[e.alias(n) for n, e in (aggs or {}).items()])


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, Column],
    medians: dict[str, str],
    hot: DataFrame | None = None,
    probe: bool = True,
) -> DataFrame:
    """``groupBy`` with exact medians of arbitrary columns. Medians of hot groups are read
    off running counts instead of one task's buffer."""
    keys = list(keys)
    if hot is None and probe:
        hot = hot_groups(df, keys)
    plain = [e.alias(n) for n, e in aggs.items()]
    if hot is None:
        return df.groupBy(*keys).agg(*plain, *[F.percentile(c, F.lit(0.5)).alias(n) for n, c in medians.items()])
    flagged = _attach(df, hot.select(*keys, F.lit(True).alias("_hot")), keys)
    out = flagged.groupBy(*keys).agg(
        *plain, *[F.percentile(F.when(F.col("_hot").isNull(), F.col(c)), F.lit(0.5)).alias(n) for n, c in medians.items()]
    )
    few = keep_hot(df, hot, keys)
    for name, column in medians.items():
        out = _attach(out, hot_quantile(few, keys, column, 0.5, "_exact"), keys)
        out = out.withColumn(name, F.coalesce("_exact", name)).drop("_exact")
    return out


def spread_back(df: DataFrame, keys: Sequence[str], value: Column, name: str, hot: DataFrame | None) -> DataFrame:
    """A combinable per-group aggregate as a column of every row: a window over small groups,
    an aggregate joined back where a group is hot."""
    keys = list(keys)
    if hot is None:
        parts = [F.col(k) for k in keys] or [F.lit(0)]
        return df.withColumn(name, value.over(Window.partitionBy(*parts)))
    sizes = df.groupBy(*keys).agg(value.alias(name))
    return join_one_row(df, sizes, keys, hot, "left")
