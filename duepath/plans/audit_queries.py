"""Queries for events, commitments, claims, the submission log and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from duepath.functions import clean
from duepath.functions import score as sc
from duepath.operators import governance as gov
from duepath.plans.feature_queries import SQL as FEATURE_SQL
from duepath.plans.feature_queries import matrix
from duepath.plans.raw_oracle import RAW
from duepath.plans.registry import register
from duepath.plans.score_queries import BAND
from duepath.plans.source_queries import NAME_SQL, _names
from duepath.session import cut_lineage
from duepath.sources import tables as fx
from duepath.streaming import jobs

SALT = "a-salt-of-sixteen-or-more"
MODEL = "default-risk-1"
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
NUMBER = "case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end"
TEXT_OF = (
    """concat('{"confidence":', """ + NUMBER.format("conf") + """, ',"modelVersion":"', model, '","newScore":', new_score, ',"positiveFactors":["', factor, '"],"timestamp":"', stamp, '","userId":"', user_id, '"}')"""
)

AUDIT: dict[str, str] = {
    "dx_event": f"""
select o_orderkey as seq, concat('user-', o_custkey) as user_id, cast(round_even(o_totalprice / 1000 + 300.3, 0) as bigint) as new_score,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as stamp, '{MODEL}' as model, (o_orderkey % 9) / 8.0 as conf, concat('Paid "', o_orderpriority[3:], '"') as factor_raw,
  concat('Paid \\"', o_orderpriority[3:], '\\"') as factor from orders""",
    "dx_text": f"select *, {TEXT_OF} as body from dx_event",
    "dx_anchor": """
select seq, sha256(cast(seq as varchar)) as tx_hash, sha256(concat(user_id, ':a-salt-of-sixteen-or-more')) as user_hash,
  case when seq % 17 = 0 then sha256('altered') else sha256(body) end as anchored_hash, body, new_score as event_score from dx_text""",
    "dx_registry": "select user_hash, arg_max(anchored_hash, seq) as latest_hash from dx_anchor group by user_hash",
    "dx_names": NAME_SQL,
    "dx_people": """
select c.c_custkey, n.name, concat('p', c.c_custkey, '@example.com') as email, round(c.c_acctbal / 20 + 300, 0) as r_score from customer c join dx_names n on n.c_custkey = c.c_custkey""",
    "dx_leaf": "select user_hash, row_number() over (partition by user_hash order by seq) - 1 as pos, event_hash as h from fx_submissions",
}
for _d in range(1, 8):
    _src = "dx_leaf" if _d == 1 else f"dx_level{_d - 1}"
    AUDIT[f"dx_level{_d}"] = f"""
select user_hash, pos // 2 as pos, case when count(*) = 2 then sha256(unhex(concat(least(min(h), max(h)), greatest(min(h), max(h))))) else min(h) end as h
from {_src} group by user_hash, pos // 2"""


def q(name, sql=None, dates=()):
    return register(name, sql, {**RAW, **FEATURE_SQL, **AUDIT}, dates)


def events(spark, folder):
    o = fx.table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("userId"),
        F.bround(F.col("o_totalprice") / 1000 + 300.3).cast("bigint").alias("newScore"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(MODEL).alias("modelVersion"),
        ((F.col("o_orderkey") % 9) / 8.0).alias("confidence"),
        F.array(F.concat(F.lit('Paid "'), F.expr("substring(o_orderpriority, 3)"), F.lit('"'))).alias("positiveFactors"))


EVENT_TEXT = {"userId": "text", "newScore": "number", "timestamp": "text", "modelVersion": "text", "confidence": "number", "positiveFactors": "texts"}


def event_text():
    return gov.canonical_json({k: (kind, F.col(k)) for k, kind in EVENT_TEXT.items()})


def anchors(spark, folder):
    e = gov.commitments(events(spark, folder), SALT, event_text())
    return e.withColumns({
        "tx_hash": F.sha2(F.col("seq").cast("string"), 256),
        "anchored_hash": F.when(F.col("seq") % 17 == 0, F.sha2(F.lit("altered"), 256)).otherwise(F.col("event_hash")),
        "event_score": F.col("newScore")})


@q("g01_score_events", f"""
select concat('user-', o_custkey) as userId, cast(round_even(o_totalprice / 1000 + 300.3, 0) as bigint) as newScore, {BAND.format('(o_totalprice / 1000 + 300.3)')} as scoreBand,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as timestamp, '{MODEL}' as modelVersion, round_even((o_orderkey % 9) / 8.0, 4) as confidence,
  o_orderpriority as first_factor, cast(o_orderkey % 400 as bigint) as observations from orders""")
def _(spark, folder):
    o = fx.table(spark, folder, "orders")
    rows = o.select(
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id"), (F.col("o_totalprice") / 1000 + 300.3).alias("score"),
        F.lit(None).cast("double").alias("previous_score"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.array("o_orderpriority").alias("positive"),
        F.lit(None).cast("array<string>").alias("negative"), ((F.col("o_orderkey") % 9) / 8.0).alias("confidence"),
        F.lit(None).cast("double").alias("score_lower"), F.lit(None).cast("double").alias("score_upper"),
        (F.col("o_orderkey") % 400).cast("double").alias("n_local"), F.lit(0.0).alias("k_local"), F.lit(100.0).alias("prior"))
    built = gov.build_events(rows, MODEL)
    return built.select("userId", "newScore", "scoreBand", "timestamp", "modelVersion", "confidence",
                        F.col("positiveFactors")[0].alias("first_factor"), F.col("evidence.observations").alias("observations"))


@q("g02_validated_events", """
select event_id, case when event_id % 50 = 0 then 'userId' when event_id % 51 = 0 then 'timestamp' when event_id % 52 = 0 then 'newScore'
  when event_id % 53 = 0 then 'timestamp value' when event_id % 47 = 0 then 'positiveFactors' end as reject_reason from events""")
def _(spark, folder):
    i = F.col("event_id")
    e = fx.table(spark, folder, "events").select(
        "event_id", F.when(i % 50 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("userId"), F.lit(MODEL).alias("modelVersion"),
        F.when(i % 52 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("newScore"),
        F.when(i % 51 == 0, None).when(i % 53 == 0, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(i % 47 == 0, '"late"').when(i % 3 != 0, F.to_json(F.array("event_type"))).alias("positiveFactors"))
    return gov.validate_events(e).select("event_id", "reject_reason")


@q("g03_canonical_json", "select seq, body from dx_text")
def _(spark, folder):
    return events(spark, folder).select("seq", event_text().alias("body"))


@q("g04_commitments", f"select seq, sha256(concat(user_id, ':{SALT}')) as user_hash, sha256(body) as event_hash, sha256(model) as model_hash from dx_text")
def _(spark, folder):
    return gov.commitments(events(spark, folder), SALT, event_text()).select("seq", "user_hash", "event_hash", "model_hash")


@q("g05_merkle_roots", "select user_hash, h as root from dx_level7")
def _(spark, folder):
    s = fx.submissions(spark, folder)
    return gov.merkle_roots(s.withColumnRenamed("event_hash", "leaf"), ["user_hash"], "seq")


@q("g06_merkle_proofs", """
select l.user_hash, l.pos as leaf_no, r.h as root, l.pos % 7 <> 3 as holds from dx_leaf l join dx_level7 r on r.user_hash = l.user_hash""")
def _(spark, folder):
    s = fx.submissions(spark, folder).withColumnRenamed("event_hash", "leaf")
    proofs = gov.merkle_proofs(s, ["user_hash"], "seq")
    forged = F.when(F.col("leaf_no") % 7 == 3, F.sha2(F.lit("forged"), 256)).otherwise(F.col("leaf"))
    return proofs.select("user_hash", "leaf_no", "root", gov.proof_holds(F.col("proof"), F.col("root"), forged).alias("holds"))


@q("g07_periods", "select seq, cast(year(ts) * 100 + month(ts) as int) as period, year(ts) >= 2020 as valid from fx_requests")
def _(spark, folder):
    r = fx.requests(spark, folder)
    p = gov.period_of(F.col("ts"))
    return r.select("seq", p.alias("period"), gov.period_ok(p).alias("valid"))


@q("g08_row_rules", f"""
select seq, case when issuer in ('5-LOW', '4-NOT SPECIFIED') then 'issuer not approved' when seq % 90 = 0 then 'zero user_hash' when seq % 91 = 0 then 'zero event_hash'
  when seq % 92 = 0 then 'bad period' end as reject_reason from fx_submissions""")
def _(spark, folder):
    i = F.col("seq")
    s = fx.submissions(spark, folder).withColumns({
        "user_hash": F.when(i % 90 == 0, gov.ZERO_HASH).otherwise(F.col("user_hash")),
        "event_hash": F.when(i % 91 == 0, gov.ZERO_HASH).otherwise(F.col("event_hash")),
        "period": F.when(i % 92 == 0, 202613).otherwise(F.col("period") + 3000)})
    approved = s.select("issuer").distinct().filter(~F.col("issuer").isin("5-LOW", "4-NOT SPECIFIED"))
    return gov.first_failure(s, approved, ["user_hash", "event_hash"]).select("seq", "reject_reason")


@q("g09_reused_hashes", "select seq, event_hash, row_number() over (partition by event_hash order by seq) > 1 as reused from fx_submissions")
def _(spark, folder):
    return gov.reused_hashes(fx.submissions(spark, folder)).select("seq", "event_hash", "reused")


@q("g10_cooldown", """
select seq, coalesce(period <= lag(period) over w, false) as period_not_newer, coalesce(ts < lag(ts) over w + interval 28 day, false) as too_soon
from fx_submissions window w as (partition by user_hash order by ts, seq)""")
def _(spark, folder):
    return gov.cooldown_flags(fx.submissions(spark, folder)).select("seq", "period_not_newer", "too_soon")


@q("g11_daily_quota", "select seq, issuer, row_number() over (partition by issuer, cast(ts as date) order by ts, seq) > 2 as over_quota from fx_submissions")
def _(spark, folder):
    return gov.quota_flags(fx.submissions(spark, folder), 2).select("seq", "issuer", "over_quota")


@q("g11_quota_usage", "select issuer, cast(ts as date) as day, count(*) as used, greatest(2 - count(*), 0) as remaining from fx_submissions group by issuer, cast(ts as date)", ("day",))
def _(spark, folder):
    return gov.quota_usage(fx.submissions(spark, folder), 2)


@q("g12_next_allowed", "select user_hash, max(ts) + interval 28 day as next_at from fx_submissions group by user_hash", ("next_at",))
def _(spark, folder):
    return gov.next_allowed(fx.submissions(spark, folder))


@q("g13_issuers_over_time", """
with dx_ch as (select issuer, ts, seq % 2 = 0 as approved from fx_submissions where seq % 500 < 2)
select s.seq, coalesce((select arg_max(c.approved, epoch_us(c.ts) * 2 + c.approved::int) from dx_ch c where c.issuer = s.issuer and c.ts <= s.ts), false) as approved from fx_submissions s""")
def _(spark, folder):
    s = fx.submissions(spark, folder)
    changes = s.filter(F.col("seq") % 500 < 2).select("issuer", "ts", (F.col("seq") % 2 == 0).alias("approved"))
    return gov.issuers_at(s, changes).select("seq", "approved")


@q("g14_tamper_check", "select seq, sha256(body) = anchored_hash as untouched from dx_anchor")
def _(spark, folder):
    return gov.tampered(anchors(spark, folder), event_text()).select("seq", "untouched")


def _people(spark, folder):
    """Customers with a name as written and in plain letters, an e-mail and a score; and the spelling each is registered under."""
    c = fx.table(spark, folder, "customer")
    k = F.col("c_custkey")
    people = _names(spark, folder).join(c.select("c_custkey", "c_acctbal"), "c_custkey").select(
        "c_custkey", "raw", clean.plain_name(F.col("raw")).alias("name"), F.concat(F.lit("p"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.round(F.col("c_acctbal") / 20 + 300, 0).alias("r_score"))
    words = F.split("name", " ")
    known = F.when(k % 3 == 0, F.col("name")).when(k % 3 == 1, F.concat_ws(" ", words[0], F.element_at(words, -1))).otherwise(
        F.concat_ws(" ", F.substring("name", 1, 1), F.element_at(words, -1)))
    return people, known


@q("j06_claim_verification", """
with dx_claim as (select seq as claim_id, sha256(cast(case when seq % 11 = 0 then -1 else seq end as varchar)) as tx_hash,
  case when seq % 5 <> 0 then sha256(concat('user-', case when seq % 13 = 0 then '0x' else substr(user_id, 6) end, ':a-salt-of-sixteen-or-more')) end as who,
  case when seq % 7 <> 0 then new_score + case when seq % 19 = 0 then 3 else 0 end end as claimed from dx_event)
select claim_id, case when a.tx_hash is null then 'NO MATCH' when sha256(a.body) <> a.anchored_hash then 'TAMPERED' when r.latest_hash <> a.anchored_hash then 'NOT CONFIRMED'
  when who <> a.user_hash then 'WRONG IDENTITY' when abs(event_score - claimed) >= 0.5 then 'WRONG SCORE' when who is null or claimed is null then 'FOUND' else 'VERIFIED' end as verdict
from dx_claim c left join dx_anchor a on a.tx_hash = c.tx_hash left join dx_registry r on r.user_hash = a.user_hash""")
def _(spark, folder):
    a = anchors(spark, folder)
    registry = a.groupBy("user_hash").agg(F.max_by("anchored_hash", "seq").alias("latest_hash"))
    i = F.col("seq")
    who = F.concat(F.lit("user-"), F.when(i % 13 == 0, "0x").otherwise(F.expr("substring(userId, 6)")))
    claims = events(spark, folder).select(
        i.alias("claim_id"), F.sha2(F.when(i % 11 == 0, F.lit(-1)).otherwise(i).cast("string"), 256).alias("tx_hash"),
        F.when(i % 5 != 0, gov.user_commitment(who, SALT)).alias("claimed_user_hash"),
        F.when(i % 7 != 0, F.col("newScore") + F.when(i % 19 == 0, 3).otherwise(0)).alias("claimed_score"))
    return gov.verify_claims(claims, a, registry, event_text()).select("claim_id", "verdict")


@q("j06_claims_by_name", f"""
with dx_own as (select a.seq, a.tx_hash, a.anchored_hash, a.body, a.event_score, p.c_custkey, p.email, p.name, string_split(p.name, ' ') as w,
    sha256(concat(email, '|', case p.c_custkey % 3 when 0 then name when 1 then concat(string_split(name, ' ')[1], ' ', string_split(name, ' ')[-1])
      else concat(name[1:1], ' ', string_split(name, ' ')[-1]) end, ':{SALT}')) as user_hash
  from dx_anchor a join orders o on o.o_orderkey = a.seq join dx_people p on p.c_custkey = o.o_custkey),
dx_last as (select user_hash, arg_max(anchored_hash, seq) as latest_hash from dx_own group by user_hash),
dx_claim as (select seq as claim_id, sha256(cast(case when seq % 11 = 0 then -1 else seq end as varchar)) as tx_hash,
  case when c_custkey % 10 = 4 then 'x' else email end as said, case when seq % 5 <> 0 then list_filter([name, case when len(w) > 2 then concat(w[1], ' ', w[-1]) end,
    case when len(w) >= 2 then concat(w[1][1:1], ' ', w[-1]) end], lambda v: v is not null) end as names,
  case when seq % 7 <> 0 then event_score + case when seq % 19 = 0 then 3 else 0 end end as claimed from dx_own)
select claim_id, case when a.tx_hash is null then 'NO MATCH' when sha256(a.body) <> a.anchored_hash then 'TAMPERED' when r.latest_hash <> a.anchored_hash then 'NOT CONFIRMED'
  when not list_contains(list_transform(names, lambda v: sha256(concat(said, '|', v, ':{SALT}'))), a.user_hash) then 'WRONG IDENTITY'
  when abs(a.event_score - claimed) >= 0.5 then 'WRONG SCORE' when names is null or claimed is null then 'FOUND' else 'VERIFIED' end as verdict
from dx_claim c left join dx_own a on a.tx_hash = c.tx_hash left join dx_last r on r.user_hash = a.user_hash""")
def _(spark, folder):
    i, k = F.col("seq"), F.col("c_custkey")
    people, known = _people(spark, folder)
    owner = fx.table(spark, folder, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("c_custkey"))
    named = owner.join(people.select("c_custkey", "raw", "email", gov.identity_hash(F.col("email"), known, SALT).alias("person_hash")), "c_custkey")
    own = anchors(spark, folder).drop("user_hash", "event_hash", "model_hash", "tx_hash").join(named.withColumnRenamed("person_hash", "user_hash"), "seq")
    # Read by the registry, the claims and their look-up; the transaction's hash is made again from its number.
    own = cut_lineage(own, "owned-anchors").withColumn("tx_hash", F.sha2(i.cast("string"), 256))
    registry = own.groupBy("user_hash").agg(F.max_by("anchored_hash", "seq").alias("latest_hash"))
    said = F.when(k % 10 == 4, "x").otherwise(F.col("email"))
    claims = own.select(
        i.alias("claim_id"), F.sha2(F.when(i % 11 == 0, F.lit(-1)).otherwise(i).cast("string"), 256).alias("tx_hash"),
        gov.identity_candidates(said, F.when(i % 5 != 0, F.col("raw")), SALT).alias("claimed_user_hashes"),
        F.when(i % 7 != 0, F.col("event_score") + F.when(i % 19 == 0, 3).otherwise(0)).alias("claimed_score"))
    return gov.verify_claims(claims, own, registry, event_text()).select("claim_id", "verdict")


@q("j07_identity_verification", f"""
with dx_reg as (select sha256(concat(email, '|', case c_custkey % 3 when 0 then name when 1 then concat(string_split(name, ' ')[1], ' ', string_split(name, ' ')[-1])
    else concat(name[1:1], ' ', string_split(name, ' ')[-1]) end, ':{SALT}')) as user_hash, r_score, {BAND.format('r_score')} as r_band from dx_people),
dx_try as (select distinct on (c_custkey, spelling) * from (select c_custkey, email, r_score, unnest([0, 1, 2]) as pos, unnest([name, case when len(w) > 2 then concat(w[1], ' ', w[-1]) end,
    case when len(w) >= 2 then concat(w[1][1:1], ' ', w[-1]) end]) as spelling from (select *, string_split(name, ' ') as w from dx_people)) where spelling is not null order by c_custkey, spelling, pos),
dx_hit as (select c_custkey, arg_min(spelling, pos) as spelling, arg_min(g.r_score, pos) as got, arg_min(g.r_band, pos) as got_band from dx_try t
  join dx_reg g on g.user_hash = sha256(concat(case when c_custkey % 10 = 4 then 'x' else email end, '|', spelling, ':{SALT}')) group by c_custkey)
select p.c_custkey as claim_id, spelling, case when spelling is null then 'NO MATCH' when abs(got - (p.r_score + case when p.c_custkey % 8 = 0 then 5 else 0 end)) >= 0.5 then 'WRONG SCORE'
  when got_band <> case when p.c_custkey % 9 = 0 then 'Z' else {BAND.format('p.r_score')} end then 'WRONG BAND' else 'VERIFIED' end as verdict
from dx_people p left join dx_hit h on h.c_custkey = p.c_custkey""")
def _(spark, folder):
    k = F.col("c_custkey")
    people, known = _people(spark, folder)
    registry = people.select(gov.identity_hash(F.col("email"), known, SALT).alias("user_hash"), F.col("r_score").alias("score"), sc.band(F.col("r_score")).alias("band"))
    claims = people.select(
        k.alias("claim_id"), F.col("raw").alias("name"), F.when(k % 10 == 4, "x").otherwise(F.col("email")).alias("email"),
        (F.col("r_score") + F.when(k % 8 == 0, 5).otherwise(0)).alias("claimed_score"),
        F.when(k % 9 == 0, "Z").otherwise(sc.band(F.col("r_score"))).alias("claimed_band"))
    return gov.verify_identities(claims, registry, SALT).select("claim_id", "spelling", "verdict")


ADVICE = [
    ("max_dpd_24m", "Worst delay", "Your longest delay of the last two years weighs on the score.", False),
    ("mean_dpd_24m", "Typical delay", "Payments arrive late on average.", False),
    ("total_annuity", "Monthly commitments", "What you owe each month is high.", False),
    ("declared_income_type_code", "Kind of income", "This follows from how you are paid.", True),
    ("unused_feature", "Unused", "No model asks for this.", False),
]
ADVICE_SQL = "(values " + ", ".join(f"('{f}', '{t}', '{d}', {str(x).lower()})" for f, t, d, x in ADVICE) + ") a(feature, title, detail, fixed)"
REASON_SQL = """
select case_id, [case when max_dpd_24m >= 30 then 'max_dpd_24m (+0.4)' end, case when mean_dpd_24m > 5 then 'mean_dpd_24m (+0.2)' end,
  case when total_annuity > 1000 then 'total_annuity' end, case when num_active_obligations > 1 then 'num_active_obligations (+0.1)' end,
  case when declared_income_type_code is not null then 'declared_income_type_code' end] as raw from dx_matrix"""
AUDIT["dx_reason"] = f"""
select case_id, unnest(range(0, len(codes))) as place, trim(string_split(unnest(codes), '(')[1]) as feature from (
  select case_id, list_filter(raw, lambda x: x is not null)[:4] as codes from ({REASON_SQL}))"""


def reasons(spark, folder):
    c = F.col
    m = matrix(spark, folder, ["max_dpd_24m", "mean_dpd_24m", "total_annuity", "num_active_obligations", "declared_income_type_code"])
    codes = F.array(
        F.when(c("max_dpd_24m") >= 30, "max_dpd_24m (+0.4)"), F.when(c("mean_dpd_24m") > 5, "mean_dpd_24m (+0.2)"), F.when(c("total_annuity") > 1000, "total_annuity"),
        F.when(c("num_active_obligations") > 1, "num_active_obligations (+0.1)"), F.when(c("declared_income_type_code").isNotNull(), "declared_income_type_code"))
    return m.select("case_id", F.filter(codes, lambda x: x.isNotNull()).alias("codes"))


def advice(spark):
    return spark.createDataFrame(ADVICE, "feature string, title string, detail string, fixed boolean")


@q("j08_advice", f"""
select r.case_id, cast(place as int) as place, r.feature, coalesce(title, concat(upper(replace(r.feature, '_', ' ')[1:1]), lower(replace(r.feature, '_', ' ')[2:]))) as title,
  coalesce(detail, 'This weighs on the score.') as detail, title is not null and not coalesce(fixed, false) as actionable
from dx_reason r left join {ADVICE_SQL} on a.feature = r.feature""")
def _(spark, folder):
    return gov.attach_advice(reasons(spark, folder), advice(spark), "This weighs on the score.")


@q("j12_advice_gaps", f"""
select distinct feature, 'missing' as gap from dx_reason where feature not in (select feature from {ADVICE_SQL})
union all select feature, 'stale' from {ADVICE_SQL} where feature not in (select feature from dx_reason)""")
def _(spark, folder):
    used = reasons(spark, folder).select(F.explode(F.slice("codes", 1, 4)).alias("code")).select(F.trim(F.substring_index("code", "(", 1)).alias("feature"))
    return gov.advice_gaps(used.distinct(), advice(spark))


# -- X: streaming ------------------------------------------------------------------------------------


def submission_stream(spark, folder):
    o = jobs.stream_table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("issuer"),
        F.col("o_custkey").cast("string").alias("user_hash"),
        F.sha2(F.concat(F.lit("e"), F.floor(F.col("o_totalprice") / 10).cast("bigint").cast("string")), 256).alias("event_hash"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("period"))


def hit_stream(spark, folder):
    e = jobs.stream_table(spark, folder, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("req_key"), F.col("value").alias("score"))


@q("x01_score_log", "select cast(user_id as varchar) as key, event_id as seq, value as score from events")
def _(spark, folder):
    s = hit_stream(spark, folder).select(F.col("req_key").alias("key"), "seq", "score")
    return jobs.drain(jobs.score_log(s), "score-log")


@q("x02_first_use", "select distinct event_hash from fx_submissions")
def _(spark, folder):
    return jobs.drain(jobs.first_use(submission_stream(spark, folder).select("event_hash")), "first-use")


@q("x03_accepted_submissions", """
with recursive dx_o as (select *, row_number() over (partition by user_hash order by ts, seq) as rn from fx_submissions),
dx_walk as (select user_hash, seq, rn, true as accepted, period as p, ts as t from dx_o where rn = 1
  union all select o.user_hash, o.seq, o.rn, o.period > w.p and o.ts >= w.t + interval 28 day, case when o.period > w.p and o.ts >= w.t + interval 28 day then o.period else w.p end,
    case when o.period > w.p and o.ts >= w.t + interval 28 day then o.ts else w.t end from dx_walk w join dx_o o on o.user_hash = w.user_hash and o.rn = w.rn + 1)
select user_hash, seq, accepted from dx_walk""")
def _(spark, folder):
    return jobs.drain(jobs.accept_per_user(submission_stream(spark, folder)), "accepted").select("user_hash", "seq", "accepted")


@q("x04_daily_usage", "select issuer, cast(ts as date) as day, count(*) as used from fx_submissions group by issuer, cast(ts as date)", ("day",))
def _(spark, folder):
    return jobs.drain_updates(jobs.daily_usage(submission_stream(spark, folder)), ["issuer", "day"], "daily-usage")


@q("x05_rate_flags", """
select seq, req_key, coalesce(epoch_us(ts) - epoch_us(lag(ts, 2) over (partition by req_key order by ts, seq)) < 3600000000, false) as over_limit from fx_requests""")
def _(spark, folder):
    return gov.rate_flags(fx.requests(spark, folder), 2).select("seq", "req_key", "over_limit")


@q("x05_rate_limit", """
with recursive dx_o as (select *, epoch_us(ts) as us, row_number() over (partition by req_key order by ts, seq) as rn from fx_requests),
dx_walk as (select req_key, seq, rn, true as allowed, cast(null as bigint) as before, us as latest from dx_o where rn = 1
  union all select req_key, seq, rn, allowed, case when allowed then latest else before end, case when allowed then us else latest end from (
    select o.req_key, o.seq, o.rn, o.us, w.before, w.latest, coalesce((o.us - w.before < 3600000000)::int, 0) + (o.us - w.latest < 3600000000)::int < 2 as allowed
    from dx_walk w join dx_o o on o.req_key = w.req_key and o.rn = w.rn + 1))
select seq, req_key, allowed from dx_walk""")
def _(spark, folder):
    return jobs.drain(jobs.rate_limit(hit_stream(spark, folder), 2), "rate-limit").select("seq", "req_key", "allowed")


