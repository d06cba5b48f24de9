"""Queries for calibration, scorecard, uncertainty and modelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from duepath.functions import score as sc
from duepath.operators import calibrate, flags, modeling, ranking, uncertainty
from duepath.operators import features as ft
from duepath.operators.asof import parts_for
from duepath.plans.feature_queries import SQL as FEATURE_SQL
from duepath.plans.feature_queries import matrix
from duepath.plans.metric_queries import SPLIT
from duepath.plans.raw_oracle import RAW
from duepath.plans.registry import register, rounded
from duepath.plans.source_queries import assembled
from duepath.session import cut_lineage, fresh_path
from duepath.sources import tables as fx


def iso_sql(source: str) -> str:
    """Isotonic fit in SQL: the largest, over starts, of the smallest mean over ends."""
    return f"""select p.x, p.n, p.k, y from (
  select ib, max(m) as y from (
    select ia, ib, min(mean) over (partition by ia order by ib rows between current row and unbounded following) as m from (
      select a.i as ia, b.i as ib, (b.ck - a.ck + a.k) / (b.cn - a.cn + a.n) as mean from {source} a join {source} b on b.i >= a.i))
  group by ib) f join {source} p on p.i = f.ib"""


def points_sql(where: str) -> str:
    return f"""select raw as x, cast(count(*) as double) as n, cast(sum(target) as double) as k, row_number() over (order by raw) as i,
  cast(sum(count(*)) over (order by raw) as double) as cn, cast(sum(sum(target)) over (order by raw) as double) as ck
from dx_split where {where} group by raw"""


LOGIT = "ln(least(greatest({0}, 1e-9), 1 - 1e-9) / (1 - least(greatest({0}, 1e-9), 1 - 1e-9)))"
SCORE_OF = "(600 - 40 / ln(2.0) * ln(20.0) + 40 / ln(2.0) * ln((1 - least(greatest({0}, 1e-9), 1 - 1e-9)) / least(greatest({0}, 1e-9), 1 - 1e-9)))"
BAND = "case when {0} >= 720 then 'A' when {0} >= 660 then 'B' when {0} >= 600 then 'C' when {0} >= 540 then 'D' else 'E' end"
FLOOR = 0.0003
# The shared scores have about 500 distinct values; fewer bins make K02 pool them.
BINS = 60
REPLICATES = 500

CAL: dict[str, str] = {
    "dx_points": points_sql("slice = 'calib'"),
    "dx_knots": iso_sql("dx_points"),
    "dx_line": "",
    "dx_backbone": f"""
select (sum(n * l) - slope * sum(n * x)) / sum(n) as intercept, slope from (
  select *, (select sum(n * (x - xm) * (l - lm)) / sum(n * (x - xm) * (x - xm)) from (
      select n, x, {LOGIT.format('((k + 0.5) / (n + 1.0))')} as l, (select sum(n * x) / sum(n) from dx_knots) as xm,
        (select sum(n * {LOGIT.format('((k + 0.5) / (n + 1.0))')}) / sum(n) from dx_knots) as lm from dx_knots)) as slope
  from (select n, x, {LOGIT.format('((k + 0.5) / (n + 1.0))')} as l from dx_knots)) group by slope""",
    "dx_ends": """
select count(*) as n_knots, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max,
  count(*) filter (y <= (select min(y) from dx_knots) + 1e-12) - 1 as lead, count(*) - count(*) filter (y >= (select max(y) from dx_knots) - 1e-12) as trail,
  max(x) filter (y <= (select min(y) from dx_knots) + 1e-12) as lead_x, min(x) filter (y >= (select max(y) from dx_knots) - 1e-12) as trail_x from dx_knots""",
    "dx_within": """
select e.id, e.wk, e.target, e.raw, case when lo.x is null then hi.y when hi.x is null then lo.y when hi.x = lo.x then lo.y
  else lo.y + (hi.y - lo.y) * (e.raw - lo.x) / (hi.x - lo.x) end as within
from (select * from dx_split where slice = 'eval') e asof left join dx_knots lo on e.raw >= lo.x asof left join dx_knots hi on e.raw <= hi.x""",
    "dx_hybrid": f"""
select id, wk, target, raw, within, extrapolated, least(greatest(v, {FLOOR}), 1 - {FLOOR}) as pd from (
  select *, case when slope is not null and slope > 0 and raw < lo_x then 1 / (1 + exp(-(intercept + slope * raw + {LOGIT.format('y_min')} - (intercept + slope * lo_x))))
    when slope is not null and slope > 0 and raw > hi_x then 1 / (1 + exp(-(intercept + slope * raw + {LOGIT.format('y_max')} - (intercept + slope * hi_x))))
    when not (slope is not null and slope > 0) and raw < x_min then 1 / (1 + exp(-({LOGIT.format('y_min')} + flat * (raw - x_min))))
    when not (slope is not null and slope > 0) and raw > x_max then 1 / (1 + exp(-({LOGIT.format('y_max')} + flat * (raw - x_max))))
    else within end as v,
    case when slope is not null and slope > 0 then raw < lo_x or raw > hi_x else flat > 0 and (raw < x_min or raw > x_max) end as extrapolated
  from (select w.*, b.*, e.*, case when lead + 1 >= 2 and lead < n_knots - 1 then lead_x else x_min end as lo_x,
      case when n_knots - trail >= 2 and trail > 0 then trail_x else x_max end as hi_x,
      greatest(0, ({LOGIT.format('y_max')} - {LOGIT.format('y_min')}) / (x_max - x_min)) as flat
    from dx_within w, dx_backbone b, dx_ends e))""",
    "dx_blocks": """
select block, count(*) as knots, sum(n) as n, sum(k) as k, arg_min(y, x) as pd, min(x) as x_lo, max(x) as x_hi from (
  select *, sum(coalesce((y - py > 1e-15)::int, 0)) over (order by x) as block from (select *, lag(y) over (order by x) as py from dx_knots)) group by block""",
    "dx_policy": f"""
select pd_floor, sum(n) as pinned_n, sum(k) as pinned_k, {SCORE_OF.format('pd_floor')} as ceiling_score
from dx_blocks, (select min(pd) as pd_floor from dx_blocks where k >= 1) where pd <= pd_floor + 1e-12 group by pd_floor""",
    "dx_floored": """
select block, count(*) as knots, sum(n) as n, sum(k) as k, arg_min(y, x) as pd, min(x) as x_lo, max(x) as x_hi from (
  select *, sum(coalesce((y - py > 1e-12)::int, 0)) over (order by x) as block from (
    select *, lag(y) over (order by x) as py from (select x, n, k, greatest(y, 0.2) as y from dx_knots))) group by block""",
    "dx_edges": "select distinct unnest(quantile_cont(raw, [" + ", ".join(repr(i / BINS) for i in range(1, BINS)) + "])) as e from dx_split where slice = 'calib'",
    "dx_bin_points": """
select *, row_number() over (order by x) as i, sum(n) over (order by x) as cn, sum(k) over (order by x) as ck from (
  select avg(raw) as x, cast(count(*) as double) as n, cast(sum(target) as double) as k from (
    select raw, target, (select count(*) from dx_edges where e <= raw) as b from dx_split where slice = 'calib') group by b)""",
    "dx_bin_knots": iso_sql("dx_bin_points"),
    "dx_pd": f"select *, {SCORE_OF.format('pd')} as score from dx_hybrid",
    "dx_delong": """
with dx_c as (select raw as s, cast(sum(target) as double) as n1, cast(sum(1 - target) as double) as n0 from fx_scored group by raw),
dx_b as (select *, sum(n0) over (order by s) - n0 as b0, sum(n1) over (order by s) - n1 as b1, sum(n1) over () as m, sum(n0) over () as n from dx_c),
dx_v as (select *, (b0 + n0 / 2) / n as v1, 1 - (b1 + n1 / 2) / m as v0 from dx_b),
dx_m as (select *, sum(n1 * v1) over () / m as m1, sum(n0 * v0) over () / n as m0 from dx_v)
select max(m1) as auc, sum(n1 * (v1 - m1) * (v1 - m1)) / (max(m) - 1) / max(m) + sum(n0 * (v0 - m0) * (v0 - m0)) / (max(n) - 1) / max(n) as variance from dx_m""",
    "dx_weeks": "select wk, row_number() over (order by wk) - 1 as no, count(*) over () as c from (select distinct wk from fx_scored)",
    "dx_draws": f"""
select r as replicate, no, count(*) as times from (
  select r, j, cast(('0x' || md5(concat('42:', r, ':', j))[1:12]) as bigint) % (select max(c) from dx_weeks) as no
  from range(0, {REPLICATES}) a(r), range(0, (select max(c) from dx_weeks)) b(j)) group by r, no""",
    "dx_boot": """
select replicate, 2 * sum(cast(n1 as double) * (below + n0 / 2.0)) / (cast(sum(n1) as double) * sum(n0)) - 1 as gini from (
  select *, sum(n0) over (partition by replicate order by s) - n0 as below from (
    select replicate, raw as s, sum(times * target) as n1, sum(times * (1 - target)) as n0
    from dx_draws d join dx_weeks w on w.no = d.no join fx_scored f on f.wk = w.wk group by replicate, raw)) group by replicate""",
}
del CAL["dx_line"]


def q(name, sql=None, dates=()):
    return register(name, sql, {**RAW, **FEATURE_SQL, **SPLIT, **CAL}, dates)


def slices(spark, folder):
    rows = ranking.three_way_split(fx.scored(spark, folder))
    return rows.filter(F.col("slice") == "calib").drop("slice"), rows.filter(F.col("slice") == "eval").drop("slice")


def fitted(spark, folder, **options):
    calib, evals = slices(spark, folder)
    return calibrate.fit(calib, **options), evals


def predicted(spark, folder, **options):
    cal, evals = fitted(spark, folder, **options)
    return cal.predict(evals)


# -- J: lookups into the curve ---------------------------------------------------------------------


@q("j09_block_for_pd", """
select id, cast(arg_min(block, abs(b.pd - p.pd) * 1e6 + block / 1e6) as bigint) as block from dx_hybrid p, dx_blocks b group by id""")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    rows = calibrate.block_for_pd(cal.predict(evals), calibrate.blocks(cal.knots))
    return rows.select("id", F.col("block").cast("bigint").alias("block"))


@q("j10_block_for_score", """
select id, cast(arg_min(block, case when p.raw between x_lo and x_hi then -1 else least(abs(x_lo - p.raw), abs(x_hi - p.raw)) end * 1e6 + block / 1e6) as bigint) as block
from dx_hybrid p, dx_blocks b group by id""")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    rows = calibrate.block_for_score(evals, calibrate.blocks(cal.knots))
    return rows.select("id", F.col("block").cast("bigint").alias("block"))


@q("j11_interpolated_rate", "select id, round(within, 9) as pd from dx_within")
def _(spark, folder):
    return rounded(predicted(spark, folder, tail="clamp").select("id", "pd"), 9)


# -- K: calibration and scorecard ------------------------------------------------------------------


@q("k01_isotonic_knots", "select x, n, k, round(y, 9) as y from dx_knots")
def _(spark, folder):
    return rounded(fitted(spark, folder)[0].knots.select("x", "n", "k", "y"), 9)


@q("k02_binned_isotonic", "select round(x, 7) as x, n, k, round(y, 9) as y from dx_bin_knots")
def _(spark, folder):
    cal, _ = fitted(spark, folder, bins=BINS)
    return cal.knots.select(F.round("x", 7).alias("x"), "n", "k", F.round("y", 9).alias("y"))


@q("k03_backbone", "select round(case when slope > 0 then intercept end, 8) as intercept, round(case when slope > 0 then slope end, 9) as slope from dx_backbone")
def _(spark, folder):
    return calibrate.backbone_row(fitted(spark, folder)[0].knots).select(F.round("intercept", 8).alias("intercept"), F.round("slope", 9).alias("slope"))


@q("k04_terminal_runs", "select n_knots, lead, trail, lead_x, trail_x, round(y_min, 9) as y_min, round(y_max, 9) as y_max from dx_ends")
def _(spark, folder):
    ends = calibrate.terminal_runs(fitted(spark, folder)[0].knots)
    return ends.select("n_knots", "lead", "trail", "lead_x", "trail_x", F.round("y_min", 9).alias("y_min"), F.round("y_max", 9).alias("y_max"))


@q("k05_plateau_z", f"""
with dx_out as (select k.*, {LOGIT.format('((k + 0.5) / (n + 1.0))')} as l from dx_knots k, dx_ends e where not (k.x between e.x_min and e.lead_x)),
dx_fitl as (select xm, lm, sum(n * (x - xm) * (l - lm)) / sum(n * (x - xm) * (x - xm)) as slope from (
  select *, (select sum(n * x) / sum(n) from dx_out) as xm, (select sum(n * l) / sum(n) from dx_out) as lm from dx_out) group by xm, lm),
dx_in as (select k.*, 1 / (1 + exp(-(lm + slope * (x - xm)))) as p, slope from dx_knots k, dx_ends e, dx_fitl where k.x between e.x_min and e.lead_x)
select round(case when (select lead from dx_ends) < 1 or max(slope) <= 0 then 0 else (sum(k) - sum(n * p)) / sqrt(sum(n * p * (1 - p))) end, 6) as lower_z from dx_in""")
def _(spark, folder):
    cal, _ = fitted(spark, folder)
    return cal.knots.agg(F.round(F.lit(float(cal.lower_z)), 6).alias("lower_z"))


@q("k06_predicted_rate", "select id, round(pd, 8) as pd, extrapolated from dx_hybrid")
def _(spark, folder):
    return predicted(spark, folder).select("id", F.round("pd", 8).alias("pd"), F.col("pd_extrapolated").alias("extrapolated"))


@q("k07_margin_of_conservatism", f"""
select id, round(least(greatest(case when extrapolated then 1 / (1 + exp(-({LOGIT.format('v')} + 0.25))) else v end, {FLOOR}), 1 - {FLOOR}), 8) as pd
from (select *, pd as v from dx_hybrid)""")
def _(spark, folder):
    return rounded(predicted(spark, folder, moc_logodds=0.25).select("id", "pd"), 8)


@q("k08_central_tendency", "select 0.3 as target_rate, round(cast(0.3 as double), 6) as mean_pd")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    moved = cal.anchored_at(evals, 0.3).predict(evals)
    return moved.agg(F.lit(0.3).alias("target_rate"), F.round(F.avg("pd"), 6).alias("mean_pd"))


@q("k09_diagnose", """
select count(*) as n, round(avg(extrapolated::int), 8) as frac_extrapolated, round(avg((raw < x_min)::int), 8) as frac_below, round(avg((raw > x_max)::int), 8) as frac_above,
  cast(max(lead) + 1 as double) as lower_plateau_knots, cast(max(n_knots - trail) as double) as upper_plateau_knots, round(min(pd), 8) as pd_min, round(max(pd), 8) as pd_max,
  round(avg(pd), 8) as mean_pd, round(max(y_min), 8) as isotonic_min, round(max(y_max), 8) as isotonic_max from dx_hybrid, dx_ends""")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    return rounded(cal.diagnose(evals), 8)


@q("k10_brier", "select count(*) as n, round(avg((pd - target) * (pd - target)), 8) as brier from dx_hybrid")
def _(spark, folder):
    return rounded(calibrate.brier(predicted(spark, folder)), 8)


@q("k11_calibration_error", """
select round(sum(c * abs(p - y)) / sum(c), 8) as ece from (select count(*) as c, avg(p) as p, avg(target) as y from (
  select p, target, ntile(20) over (order by p, id) as b from (select raw / 500 as p, target, id from fx_scored)) group by b)""")
def _(spark, folder):
    rows = fx.scored(spark, folder).withColumn("p", F.col("raw") / 500)
    return rounded(calibrate.calibration_error(rows, "p"), 8)


@q("k12_reliability", """
with dx_p as (select least(raw / 500, 1.0) as p, target from fx_scored),
dx_r as (select (p >= 0.1)::int + (p >= 0.2)::int + (p >= 3 * cast(0.1 as double))::int + (p >= 0.4)::int + (p >= 0.5)::int + (p >= 6 * cast(0.1 as double))::int
  + (p >= 7 * cast(0.1 as double))::int + (p >= 0.8)::int + (p >= 0.9)::int as bin, p, target from dx_p)
select cast(b as int) as bin, count(p) as n, round(avg(p), 8) as mean_pd, round(avg(target), 8) as observed from range(0, 10) t(b) left join dx_r on bin = b group by b""")
def _(spark, folder):
    rows = fx.scored(spark, folder).withColumn("p", F.least(F.col("raw") / 500, F.lit(1.0)))
    return rounded(calibrate.reliability(rows, "p"), 8)


@q("k13_points", f"select id, round({SCORE_OF.format('(raw / 600)')}, 6) as score, round(1 / (1 + exp((raw - (600 - 40 / ln(2.0) * ln(20.0))) / (40 / ln(2.0)))), 9) as pd from fx_scored")
def _(spark, folder):
    s = fx.scored(spark, folder)
    return s.select("id", F.round(sc.pd_to_score(F.col("raw") / 600), 6).alias("score"), F.round(sc.score_to_pd(F.col("raw")), 9).alias("pd"))


@q("k14_bands", f"select id, {BAND.format('(raw + 300)')} as band from fx_scored")
def _(spark, folder):
    return fx.scored(spark, folder).select("id", sc.band(F.col("raw") + 300).alias("band"))


BLOCK = "cast(block as int) as block, knots, n, k, round(pd, 9) as pd, x_lo, x_hi"


@q("k15_blocks", f"select {BLOCK} from dx_blocks")
def _(spark, folder):
    return rounded(calibrate.blocks(fitted(spark, folder)[0].knots), 9)


@q("k16_floor_policy", "select round(pd_floor, 9) as pd_floor, pinned_n, pinned_k, round(ceiling_score, 6) as ceiling_score from dx_policy")
def _(spark, folder):
    out = calibrate.floor_policy(calibrate.blocks(fitted(spark, folder)[0].knots))
    return out.select(F.round("pd_floor", 9).alias("pd_floor"), "pinned_n", "pinned_k", F.round("ceiling_score", 6).alias("ceiling_score"))


@q("k17_floor_sensitivity", f"""
select m, n0, round(base_rate, 9) as base_rate, round(m * base_rate / (m + n0), 9) as post_mean, round({SCORE_OF.format('(m * base_rate / (m + n0))')}, 6) as post_score,
  round(case when n0 > 0 then 3 / n0 end, 9) as rule_of_three, cast(400.0 as double) as obs_needed from (
  select cast(unnest([20, 50, 100, 200, 500]) as double) as m, n0, base_rate from (select coalesce(sum(n) filter (x < x1), 0) as n0, sum(k) / sum(n) as base_rate
  from dx_knots, (select min(x) as x1 from dx_knots where k > 0)))""")
def _(spark, folder):
    out = calibrate.floor_sensitivity(fitted(spark, folder)[0].knots)
    return out.select("m", "n0", F.round("base_rate", 9).alias("base_rate"), F.round("post_mean", 9).alias("post_mean"),
                      F.round("post_score", 6).alias("post_score"), F.round("rule_of_three", 9).alias("rule_of_three"), F.round("obs_needed", 6).alias("obs_needed"))


@q("k17_floor_upper_bound")
def _(spark, folder):
    return rounded(calibrate.floor_sensitivity(fitted(spark, folder)[0].knots).select("m", "upper95"))


WILSON = """(k / n + 3.841458820694124 / (2 * n) {sign} 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)"""


@q("k18_wilson", f"""
select wk, round(greatest({WILSON.format(sign='-')}, 0), 8) as low, round(least({WILSON.format(sign='+')}, 1), 8) as high
from (select wk, cast(count(*) as double) as n, cast(sum(target) as double) as k from fx_scored group by wk)""")
def _(spark, folder):
    w = fx.scored(spark, folder).groupBy("wk").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("target").cast("double").alias("k"))
    low, high = sc.wilson(F.col("k"), F.col("n"))
    return w.select("wk", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@q("k19_block_intervals", f"""
with dx_i as (select *, greatest({WILSON.format(sign='-')}, 0) as pd_lo, least({WILSON.format(sign='+')}, 1) as pd_hi, (select {SCORE_OF.format('min(pd)')} from dx_floored) as ceiling from dx_floored),
dx_j as (select *, pd_lo <= 0 as none, {SCORE_OF.format('pd_lo')} as raw_hi, least({SCORE_OF.format('least(greatest(pd_hi, 1e-9), 0.5)')}, ceiling) as lo, least({SCORE_OF.format('pd')}, ceiling) as pt from dx_i),
dx_h as (select *, case when none then ceiling else least(raw_hi, ceiling) end as hi from dx_j)
select cast(block as int) as block, knots, n, k, round(pd, 8) as pd, round(pd_lo, 8) as pd_lo, round(pd_hi, 8) as pd_hi, round(pt, 1) as score, round(lo, 1) as score_lo, round(hi, 1) as score_hi,
  round(hi - lo, 1) as width, {BAND.format('pt')} as band, case when {BAND.format('lo')} = {BAND.format('hi')} then {BAND.format('lo')} else concat({BAND.format('lo')}, '-', {BAND.format('hi')}) end as band_range,
  none or raw_hi > ceiling + 1e-9 as upper_is_policy from dx_h""")
def _(spark, folder):
    table = calibrate.blocks(fitted(spark, folder)[0].knots, pd_floor=0.2, tol=1e-12)
    return rounded(calibrate.block_intervals(table), 8)


@q("k19_row_intervals", f"""
with dx_i as (select *, greatest({WILSON.format(sign='-')}, 0) as pd_lo, least({WILSON.format(sign='+')}, 1) as pd_hi, (select {SCORE_OF.format('min(pd)')} from dx_floored) as ceiling from dx_floored),
dx_j as (select *, pd_lo <= 0 as none, {SCORE_OF.format('pd_lo')} as raw_hi, least({SCORE_OF.format('least(greatest(pd_hi, 1e-9), 0.5)')}, ceiling) as lo, least({SCORE_OF.format('pd')}, ceiling) as pt from dx_i),
dx_h as (select *, case when none then ceiling else least(raw_hi, ceiling) end as hi from dx_j),
dx_near as (select id, arg_min(block, abs(b.pd - p.pd) * 1e6 + block / 1e6) as block from dx_hybrid p, dx_floored b group by id)
select id, round(pt, 1) as block_score, round(lo, 1) as score_lo, round(hi, 1) as score_hi, round(hi - lo, 1) as width,
  case when {BAND.format('lo')} = {BAND.format('hi')} then {BAND.format('lo')} else concat({BAND.format('lo')}, '-', {BAND.format('hi')}) end as band_range
from dx_near join dx_h using (block)""")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    table = calibrate.blocks(cal.knots, pd_floor=0.2, tol=1e-12)
    rows = calibrate.row_intervals(cal.predict(evals), table)
    return rounded(rows.select("id", "block_score", "score_lo", "score_hi", "width", "band_range"), 8)


@q("k06_reloaded_rate", "select id, round(pd, 8) as pd, extrapolated from dx_hybrid")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    path = fresh_path(spark, "calibrator")
    cal.save(path)
    return calibrate.Calibrator.load(spark, path).predict(evals).select("id", F.round("pd", 8).alias("pd"), F.col("pd_extrapolated").alias("extrapolated"))


@q("k20_pooled_evidence", """
with recursive dx_lists as (select list(cn order by i) as cn, list(ck order by i) as ck, list(n order by i) as n, list(k order by i) as k, count(*) as m from dx_points),
dx_wide as (select i, i as l, i as r, 0 as step from dx_points
  union all select i, l2, case when s.cn[r] - s.cn[l2] + s.n[l2] < 200 and r < m then r + 1 else r end, step + 1 from (
    select w.*, case when l > 1 then l - 1 else l end as l2 from dx_wide w, dx_lists s where s.cn[r] - s.cn[l] + s.n[l] < 200 and (l > 1 or r < m)) q, dx_lists s)
select cast(i - 1 as bigint) as knot, p.x, s.cn[r] - s.cn[l] + s.n[l] as n_local, s.ck[r] - s.ck[l] + s.k[l] as k_local, cast(r - l + 1 as int) as knots_used
from (select i, arg_max(l, step) as l, arg_max(r, step) as r from dx_wide group by i) e join dx_points p using (i), dx_lists s""")
def _(spark, folder):
    cal, _ = fitted(spark, folder)
    return calibrate.pooled_evidence(cal.knots)


@q("k21_band_confidence")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    rows = cal.predict(evals).withColumn("score", sc.pd_to_score(F.col("pd"))).withColumn("band", sc.band(F.col("score")))
    out = calibrate.evidence(rows, cal)
    return rounded(out.select("id", "band", "n_local", "k_local", "post_mean", "lower05", "upper95", "confidence", "score_lower", "score_upper"))


@q("k22_tail_modes")
def _(spark, folder):
    cal, evals = fitted(spark, folder)
    return rounded(calibrate.tail_modes(cal, evals), 8)


# -- U: uncertainty ----------------------------------------------------------------------------------


@q("u01_delong", "select round(auc, 9) as auc, round(variance, 12) as variance, round(2 * sqrt(variance), 9) as se_gini from dx_delong")
def _(spark, folder):
    d = uncertainty.delong(fx.scored(spark, folder))
    return d.select(F.round("auc", 9).alias("auc"), F.round("variance", 12).alias("variance"), F.round("se_gini", 9).alias("se_gini"))


def boot(spark, folder):
    return uncertainty.block_bootstrap(fx.scored(spark, folder), REPLICATES)


@q("u02_block_bootstrap", "select replicate, round(gini, 9) as gini from dx_boot")
def _(spark, folder):
    return rounded(boot(spark, folder), 9)


@q("u03_design_effect")
def _(spark, folder):
    rows = fx.scored(spark, folder)
    return uncertainty.design_effect(boot(spark, folder), uncertainty.row_bootstrap(rows, REPLICATES))


@q("u04_replicate_summary", """
select count(*) as n, round(avg(gini), 9) as mean, round(stddev_samp(gini), 9) as sd, round(avg(pow(gini - m, 3)) / pow(avg(pow(gini - m, 2)), 1.5), 7) as skew,
  round(quantile_cont(gini, 0.025), 9) as p025, round(quantile_cont(gini, 0.975), 9) as p975 from dx_boot, (select avg(gini) as m from dx_boot)""")
def _(spark, folder):
    s = uncertainty.summarise(boot(spark, folder))
    return s.select("n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round("skew", 7).alias("skew"), F.round("p025", 9).alias("p025"), F.round("p975", 9).alias("p975"))


@q("u05_refit_bootstrap")
def _(spark, folder):
    calib, _ = slices(spark, folder)
    cal = calibrate.fit(calib)
    refs = [(r["ref_score"], r["raw"]) for r in uncertainty.reference_raw(cal.knots, [480.0, 510.0]).collect()]
    return uncertainty.refit_bootstrap(calib, refs)


@q("u06_tail_evidence", """
select n, k, knots, round(3 / n, 9) as rule_of_three, round((100.0 * base + k) / (100.0 + n), 9) as posterior_mean from (
  select sum(n) as n, sum(k) as k, count(*) as knots, (select sum(k) / sum(n) from dx_knots) as base from dx_knots where y <= (select min(y) from dx_knots) + 1e-12)""")
def _(spark, folder):
    cal, _ = fitted(spark, folder)
    t = cal.knots.agg(F.sum("k") / F.sum("n")).first()[0]
    return rounded(uncertainty.tail_evidence(cal.knots, t), 9)


@q("u07_reference_raw", """
select ref_score, coalesce(min(x) filter (y >= 1 / (1 + exp((ref_score - (600 - 40 / ln(2.0) * ln(20.0))) / (40 / ln(2.0))))), max(x)) as raw
from dx_knots, (select unnest([cast(420 as double), 480, 600]) as ref_score) group by ref_score""")
def _(spark, folder):
    return uncertainty.reference_raw(fitted(spark, folder)[0].knots, [420, 480, 600])


# -- T: models ------------------------------------------------------------------------------------------

ASSEMBLED = ["max_dpd", "mean_dpd", "num_dpd_gt0", "num_dpd_ge30", "max_overdue", "total_overdue", "num_bureau_payments", "total_annuity",
             "max_annuity", "num_prev_apps", "monthly_income", "debt_to_income"]
# Parity features whose name an assembled column has already are marked.
PARITY = {c: f"{c}_parity" if c in ASSEMBLED else c for c in ft.PARITY_NAMES}
MODEL_COLS = ASSEMBLED + list(PARITY.values())
GRID = [{"maxIter": rounds, "maxDepth": depth, "stepSize": step} for rounds in (20, 40) for depth in (3, 4) for step in (0.05, 0.1)]


def labelled(spark, folder):
    """Labelled cases with all model columns and all parity features."""
    rows = assembled(spark, folder).filter(F.col("target").isNotNull())
    found = matrix(spark, folder, list(PARITY)).select(F.col("case_id").cast("bigint").alias("case_id"), *[F.col(c).alias(to) for c, to in PARITY.items()])
    rows = rows.withColumns({"case_id": F.col("case_id").cast("bigint"), "target": F.col("target").cast("double")}).join(found, "case_id", "left")
    # Training reads the rows many times over, so they are built once, in files that keep all cores busy.
    files = parts_for(fx.base(spark, folder).count() * len(MODEL_COLS), modeling.CELLS)
    return cut_lineage(rows.select("case_id", "target", "wk", *MODEL_COLS).repartition(files), "labelled")


def fit_and_late(spark, folder):
    parts = cut_lineage(ranking.two_way_split(labelled(spark, folder), "wk", "case_id"), "slices")
    return parts.filter(F.col("slice") == "fit").drop("slice"), parts.filter(F.col("slice") == "holdout").drop("slice")


@q("t01_linear_model")
def _(spark, folder):
    fit, late = fit_and_late(spark, folder)
    return modeling.LinearModel(fit, MODEL_COLS).predict(late).select("case_id", "target", F.round("raw", 6).alias("raw"))


@q("t02_boosted_model")
def _(spark, folder):
    fit, late = fit_and_late(spark, folder)
    marked = ranking.two_way_split(fit, "wk", "case_id").withColumn("_val", F.col("slice") == "holdout").drop("slice")
    model = modeling.BoostedModel(marked, MODEL_COLS, validation="_val")
    return model.predict(late).select("case_id", "target", F.round("raw", 6).alias("raw"))


@q("t03_monotone_audit", """
with dx_m as (select cast(mean_dpd as double) as x, max_dpd / 100 as p from dx_assembled), dx_v as (select x, count(*) as c, sum(p) as sp from dx_m group by x),
dx_c as (select *, sum(c) over (order by x) - c as before, sum(c) over () as t from dx_v),
dx_g as (select least(floor(before * 10 / t), 9) as bin, sum(c) as n, sum(sp) / sum(c) as mean_pred, min(x) as x_lo, max(x) as x_hi from dx_c group by 1)
select 'mean_dpd' as feature, cast(bin as int) as bin, cast(n as bigint) as n, round(x_lo, 6) as x_lo, round(x_hi, 6) as x_hi, round(mean_pred, 8) as mean_pred,
  coalesce(mean_pred - lag(mean_pred) over (order by bin) < -1e-12, false) as against from dx_g""")
def _(spark, folder):
    rows = assembled(spark, folder).withColumn("p", F.col("max_dpd") / 100)
    out = modeling.monotone_audit(rows, "mean_dpd", 1, "p")
    return out.select("feature", "bin", "n", F.round("x_lo", 6).alias("x_lo"), F.round("x_hi", 6).alias("x_hi"), F.round("mean_pred", 8).alias("mean_pred"), "against")


@q("t04_leave_one_out")
def _(spark, folder):
    fit, late = fit_and_late(spark, folder)
    return spark.createDataFrame(modeling.leave_one_out(fit, late, MODEL_COLS), "feature string, gini_drop double")


@q("t05_permutation_importance")
def _(spark, folder):
    fit, late = fit_and_late(spark, folder)
    model = modeling.LinearModel(fit, MODEL_COLS)
    return spark.createDataFrame(modeling.permutation_importance(model, late, MODEL_COLS), "feature string, gini_drop double")


DRAW = "cast(('0x' || md5(concat('5/mean_dpd:', {0}, ':', {1}))[1:12]) as bigint) % {2}"


@q("t05_permuted_column", f"""
with recursive dx_rows as (select case_id, mean_dpd, row_number() over (order by case_id) - 1 as place from dx_assembled),
dx_box as (select count(*) as n, cast(floor(sqrt(count(*))) as bigint) as a, cast(ceil(count(*) / floor(sqrt(count(*)))) as bigint) as b from dx_rows),
dx_walk as (select place as own, place, 0 as turn from dx_rows
  union all select own, l2 * b + (r1 + {DRAW.format(3, 'l2', 'b')}) % b, turn + 1 from (
    select *, (l1 + {DRAW.format(2, 'r1', 'a')}) % a as l2 from (
      select *, (r0 + {DRAW.format(1, 'l1', 'b')}) % b as r1 from (
        select own, turn, a, b, place % b as r0, (place // b + {DRAW.format(0, 'place % b', 'a')}) % a as l1 from dx_walk, dx_box where turn = 0 or place >= n))))
select t.case_id, round(f.mean_dpd, 6) as mean_dpd from (select own, arg_max(place, turn) as place from dx_walk group by own) m
join dx_rows f on f.place = m.own join dx_rows t on t.place = m.place""")
def _(spark, folder):
    rows = assembled(spark, folder).select(F.col("case_id").cast("bigint").alias("case_id"), F.col("mean_dpd").cast("double").alias("mean_dpd"))
    return rounded(modeling.shuffled(rows, "mean_dpd", 5))


@q("t06_null_importance")
def _(spark, folder):
    fit, _ = fit_and_late(spark, folder)
    rows = modeling.null_importance(fit, MODEL_COLS)
    return spark.createDataFrame(rows, "feature string, importance double, null_bar double, kept boolean")


@q("t07_selection_funnel")
def _(spark, folder):
    fit, _ = fit_and_late(spark, folder)
    rows = modeling.select_features(fit, MODEL_COLS, forced=["monthly_income"])
    return spark.createDataFrame(rows, "feature string, fate string")


@q("t08_random_search")
def _(spark, folder):
    fit, _ = fit_and_late(spark, folder)
    return spark.createDataFrame(modeling.random_search(fit, MODEL_COLS, GRID), "setting int, stability double")


@q("t09_logit_blend", f"select id, round(1 / (1 + exp(-(0.25 * {LOGIT.format('(raw / 600)')} + 0.75 * {LOGIT.format('(wk / 300000.0)')}))), 8) as blend from fx_scored")
def _(spark, folder):
    s = fx.scored(spark, folder).select("id", (F.col("raw") / 600).alias("a"), (F.col("wk") / 300000.0).alias("b"))
    return s.select("id", F.round(modeling.logit_blend(["a", "b"], [1, 3]), 8).alias("blend"))


@q("t10_batch_scores")
def _(spark, folder):
    fit, late = fit_and_late(spark, folder)
    model = modeling.LinearModel(fit, MODEL_COLS)
    cal = calibrate.fit(model.predict(fit))
    out = modeling.batch_score(late, model, cal)
    return rounded(out.select("case_id", "raw", "pd", "score", "band"))


@q("t11_reason_codes", """
with dx_st as (select avg(max_dpd) as m1, stddev_pop(max_dpd) as s1, avg(mean_dpd) as m2, stddev_pop(mean_dpd) as s2, avg(total_annuity) as m3, stddev_pop(total_annuity) as s3 from dx_assembled)
select case_id, array_to_string(list_transform(list_sort(list_filter([struct_pack(c := 0.5 * (max_dpd - m1) / s1, f := 'max_dpd'), struct_pack(c := 0.8 * (mean_dpd - m2) / s2, f := 'mean_dpd'),
  struct_pack(c := -0.3 * (total_annuity - m3) / s3, f := 'total_annuity')], lambda x: x.c > 0), 'desc')[:2], lambda x: x.f), ',') as reasons from dx_assembled, dx_st""")
def _(spark, folder):
    weights = {"max_dpd": 0.5, "mean_dpd": 0.8, "total_annuity": -0.3}
    rows = assembled(spark, folder)
    scaled = flags.standardise(rows, flags.moments(rows, list(weights)), list(weights))
    pushes = F.array(*[F.struct((F.lit(w) * F.col(c)).alias("contribution"), F.lit(c).alias("feature")) for c, w in weights.items()])
    return scaled.select("case_id", F.array_join(modeling.top_reasons(pushes, 2).feature, ",").alias("reasons"))


@q("m13_cross_representation")
def _(spark, folder):
    rows = labelled(spark, folder)
    noisy = rows.withColumn("mean_dpd", F.col("mean_dpd") * 0.8).withColumn("monthly_income", F.when(F.col("case_id") % 3 != 0, F.col("monthly_income")))
    out = modeling.cross_representation({"bureau": rows, "feed": noisy}, MODEL_COLS, [("bureau", "bureau"), ("bureau", "feed"), ("feed", "feed")])
    return spark.createDataFrame(out, "trained_on string, served_on string, gini double")
