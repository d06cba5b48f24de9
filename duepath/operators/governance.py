"""Score events, commitments, claims and the rules of a submission log."""

from __future__ import annotations

import json
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duepath.functions import clean, score
from duepath.operators.ordered import Index, Lag, OrderedGroups, RunningMax, hot_groups, join_one_row
from duepath.session import cut_lineage

COOLDOWN_DAYS = 28
ZERO_HASH = "0" * 64


# -- history ---------------------------------------------------------------------------------------


def recent_scores(history: DataFrame, limit: int = 10, digits: int = 1) -> DataFrame:
    """Newest scores of each key with the change against the next older one shown. Ranking
    with a limit is applied before the shuffle, so a busy key sends few rows."""
    newest = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq"))
    kept = history.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit)
    older = F.lead("score").over(Window.partitionBy("key").orderBy("_rn"))
    return kept.withColumn("delta", F.bround(F.col("score") - older, digits)).drop("_rn")


# -- events ----------------------------------------------------------------------------------------


def build_events(rows: DataFrame, model_version: str) -> DataFrame:
    """Event rows from scored rows: user_id, score, previous_score, ts, positive and negative
    factor lists, confidence, score_lower, score_upper, n_local, k_local, prior."""
    c = F.col
    return rows.select(
        c("user_id").alias("userId"), F.bround("score").cast("bigint").alias("newScore"),
        F.bround("previous_score").cast("bigint").alias("previousScore"), score.band(c("score")).alias("scoreBand"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(model_version).alias("modelVersion"),
        F.coalesce("positive", F.array().cast("array<string>")).alias("positiveFactors"),
        F.coalesce("negative", F.array().cast("array<string>")).alias("negativeFactors"),
        F.bround("confidence", 4).alias("confidence"),
        F.when(c("score_lower").isNotNull(), F.array(F.bround("score_lower").cast("bigint"), F.bround("score_upper").cast("bigint"))).alias("scoreInterval95"),
        F.when(c("n_local").isNotNull(), F.struct(
            c("n_local").cast("bigint").alias("observations"), c("k_local").cast("bigint").alias("defaults"),
            c("prior").cast("bigint").alias("priorStrength"), F.lit("beta-binomial posterior; band membership probability").alias("method"))).alias("evidence"),
    )


def validate_events(events: DataFrame) -> DataFrame:
    """First rule each event breaks, or null. Columns: userId, modelVersion, timestamp, newScore and, where there,
    positiveFactors and negativeFactors. A text column of a score or of factors holds the raw JSON of that field,
    so a quoted number is no score; a null one is an absent field."""
    c = F.col

    def blank(name: str) -> Column:
        return c(name).isNull() | (F.trim(c(name)) == "")

    value = clean.number("newScore")
    finite = value.isNotNull() & (F.abs(value) != float("inf"))
    reason = F.when(blank("userId"), "userId").when(blank("modelVersion"), "modelVersion").when(blank("timestamp"), "timestamp")
    reason = reason.when(~finite, "newScore").when(F.col("timestamp").try_cast("timestamp").isNull(), "timestamp value")
    kinds = dict(events.dtypes)
    for name in ("positiveFactors", "negativeFactors"):
        kind = kinds.get(name, "array")
        if not kind.startswith("array"):
            is_list = F.from_json(c(name), "array<string>").isNotNull() if kind == "string" else F.lit(False)
            reason = reason.when(c(name).isNotNull() & ~is_list, name)
    return events.withColumn("reject_reason", reason)


def _json_number(value: Column) -> Column:
    """Number text as JSON writers print it: integral values without a decimal point, plain
    digits between 1e-6 and 1e21, an exponent outside."""
    d = value.cast("double")
    size = F.abs(d)
    shortest = F.regexp_replace(F.lower(d.cast("string")), r"\.0e", "e")
    plain = F.regexp_replace(d.try_cast("decimal(38,23)").cast("string"), "0+$", "")
    whole = (d == F.rint(d)) & (size < 1e21)
    text = (
        F.when(whole, d.try_cast("decimal(38,0)").cast("string"))
        .when(size >= 1e21, F.regexp_replace(shortest, "e(?=[0-9])", "e+"))
        .when(size < 1e-6, shortest)
        .when((size < 1e-3) | (size >= 1e7), plain)
        .otherwise(d.cast("string"))
    )
    return F.when(value.isNull() | F.isnan(d) | (size == float("inf")), "null").otherwise(text)


def _json_text(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(short.get(chr(code), f"\\u{code:04x}")))
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def canonical_json(fields: Mapping[str, tuple[str, Column]]) -> Column:
    """JSON text of one object with its keys sorted. ``fields`` maps a key to (kind, column);
    kinds: number, text, numbers, texts, object (a column of JSON text)."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        kind, col = fields[key]
        if kind == "number":
            value = _json_number(col)
        elif kind == "text":
            value = _json_text(col)
        elif kind in ("numbers", "texts"):
            each = _json_number if kind == "numbers" else _json_text
            value = F.when(col.isNull(), "null").otherwise(
                F.concat(F.lit("["), F.array_join(F.transform(col, each), ","), F.lit("]")))
        else:
            value = F.coalesce(col, F.lit("null"))
        parts += [F.lit(("," if i else "{") + json.dumps(key) + ":"), value]
    return F.concat(*parts, F.lit("}"))


def commit(text: Column) -> Column:
    return F.sha2(text, 256)


def user_commitment(user_id: Column, salt: str) -> Column:
    return commit(F.concat(user_id, F.lit(":" + salt)))


def commitments(events: DataFrame, salt: str, event_text: Column) -> DataFrame:
    return events.withColumns({
        "user_hash": user_commitment(F.col("userId"), salt), "event_hash": commit(event_text),
        "model_hash": commit(F.col("modelVersion"))})


def tampered(stored: DataFrame, event_text: Column, anchored: str = "anchored_hash") -> DataFrame:
    return stored.withColumn("untouched", commit(event_text) == F.lower(F.col(anchored)))


# -- batch roots -----------------------------------------------------------------------------------


def pair_hash(a: Column, b: Column) -> Column:
    """Parent of two nodes; the smaller one comes first, so order does not matter."""
    return F.sha2(F.unhex(F.concat(F.least(a, b), F.greatest(a, b))), 256)


#: Levels of the tree that are folded inside one row; a block has 2 ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 10


def _levels(nodes: Column, count: int) -> Column:
    """The nodes of a block, their parents, and so on for ``count`` levels, as an array of arrays; an odd last node moves up as it is."""

    def parents(below: Column) -> Column:
        n = F.size(below)
        pair = lambda j: F.when(2 * j + 1 < n, pair_hash(F.get(below, 2 * j), F.get(below, 2 * j + 1))).otherwise(F.get(below, 2 * j))
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), pair)

    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.array(nodes), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))))


def _folded(leaves: DataFrame, batch: Sequence[str], order: str, leaf: str, levels: int) -> list[DataFrame]:
    """Blocks of leaves, blocks of those blocks' roots, and so on up to one block a batch: (batch, block, first, levels, root).

    A batch with nearly all leaves is spread over its blocks; each step divides its rows by the size of a block.
    """
    numbered = OrderedGroups(leaves.select(*batch, F.col(leaf).alias("h"), order), list(batch), [order]).add(pos=Index()).done()
    rows = numbered.select(*batch, "pos", "h")
    largest = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    out = []
    while not out or largest > 1:
        deep = max(1, min(levels, (largest - 1).bit_length()))
        block = F.shiftright("pos", deep)
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda n: n["h"])  # at most 2 ** levels
        blocks = rows.groupBy(*batch, block.alias("block")).agg(nodes.alias("nodes"))
        folded = blocks.select(*batch, "block", F.shiftleft("block", deep).alias("first"), _levels(F.col("nodes"), deep).alias("levels"))
        folded = cut_lineage(folded.withColumn("root", F.get(F.element_at("levels", -1), F.lit(0))), "merkle")
        out.append(folded)
        rows = folded.select(*batch, F.col("block").alias("pos"), F.col("root").alias("h"))
        largest = -(-largest // (1 << deep))
    return out


def merkle_roots(leaves: DataFrame, batch: Sequence[str], order: str, leaf: str = "leaf", levels: int = BLOCK_LEVELS) -> DataFrame:
    """Root hash of each batch, folded in blocks of 2 ** ``levels`` nodes; an odd last node of a level moves up as it is."""
    return _folded(leaves, batch, order, leaf, levels)[-1].select(*batch, "root")


def merkle_proofs(leaves: DataFrame, batch: Sequence[str], order: str, leaf: str = "leaf", levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every leaf with the sibling hashes on its way to the root: those inside its block, then those of the block, which
    one join for each step of blocks hands down, block by block."""
    above = None
    siblings = "filter(transform(sequence(0, size(levels) - 2), k -> get(get(levels, k), shiftright(i, k) ^ 1)), s -> s is not null)"
    for blocks in reversed(_folded(leaves, batch, order, leaf, levels)):
        if above is None:
            blocks = blocks.withColumn("rest", F.array().cast("array<string>"))
        else:
            # the root of a batch goes down with the proofs, so the batch is never joined as a whole
            handed = above.select(*batch, F.col("pos").alias("block"), "root", F.col("proof").alias("rest"))
            blocks = blocks.drop("root").join(handed, [*batch, "block"])
        nodes = F.expr(f"transform(levels[0], (h, i) -> struct(first + i as pos, h as h, concat({siblings}, rest) as proof))")
        above = blocks.select(*batch, "root", F.inline(nodes))
    return above.select(*batch, F.col("pos").alias("leaf_no"), F.col("h").alias("leaf"), "proof", "root")


def proof_holds(proof: Column, root: Column, leaf: Column) -> Column:
    return F.aggregate(proof, leaf, lambda acc, h: pair_hash(acc, h)) == root


# -- rules of the submission log -------------------------------------------------------------------


def period_of(ts: Column) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def period_ok(period: Column) -> Column:
    month = F.pmod(period, F.lit(100))
    return (F.floor(period / 100) >= 2020) & month.between(1, 12)


def issuers_at(log: DataFrame, changes: DataFrame, at: str = "ts") -> DataFrame:
    """Submissions with whether their issuer was approved at that time. The issuer changes
    and the submissions of an issuer are merged into one ordered sequence."""
    sub = log.select("*", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_change"))
    add = changes.select(
        "issuer", F.col("ts").alias(at), F.lit(0).alias("_kind"),
        (F.unix_micros("ts") * 2 + F.col("approved").cast("bigint")).alias("_change"))
    merged = sub.unionByName(add, allowMissingColumns=True)
    merged = merged.withColumn("_t", F.unix_micros(at) * 2 + F.col("_kind"))
    seen = OrderedGroups(merged, ["issuer"], ["_t"]).add(_last=RunningMax("_change")).done()
    approved = F.coalesce(F.pmod(F.col("_last"), F.lit(2)) == 1, F.lit(False))
    return seen.filter(F.col("_kind") == 1).withColumn("approved", approved).drop("_kind", "_change", "_t", "_last")


def first_failure(log: DataFrame, approved: DataFrame, hash_columns: Sequence[str]) -> DataFrame:
    """First row-level rule a submission breaks, in the order the registry checks them.
    ``approved`` has one row per issuer."""
    rows = join_one_row(log, approved.select("issuer", F.lit(True).alias("_ok")), ["issuer"], hot_groups(log, ["issuer"]), "left")
    reason = F.when(F.col("_ok").isNull(), "issuer not approved")
    for c in hash_columns:
        reason = reason.when(F.col(c).isNull() | (F.col(c) == ZERO_HASH), f"zero {c}")
    reason = reason.when(~period_ok(F.col("period")), "bad period")
    return rows.withColumn("reject_reason", reason).drop("_ok")


def reused_hashes(log: DataFrame, order: str = "seq") -> DataFrame:
    """Submissions whose event hash was used before. Only the earliest use per hash is kept
    aside, and a hash used very often is joined without a shuffle."""
    first = log.groupBy("event_hash").agg(F.min(order).alias("_first"))
    rows = join_one_row(log, first, ["event_hash"], hot_groups(log, ["event_hash"]))
    return rows.withColumn("reused", F.col(order) > F.col("_first")).drop("_first")


def cooldown_flags(log: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Against the user's previous row: period not newer, and inside the cooldown."""
    rows = OrderedGroups(log, ["user_hash"], list(order)).add(_period=Lag("period"), _ts=Lag("ts")).done()
    soon = F.col("ts") < F.col("_ts") + F.expr(f"INTERVAL {COOLDOWN_DAYS} DAYS")
    return rows.withColumns({
        "period_not_newer": F.coalesce(F.col("period") <= F.col("_period"), F.lit(False)),
        "too_soon": F.coalesce(soon, F.lit(False))}).drop("_period", "_ts")


def quota_flags(log: DataFrame, limit: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Submissions beyond the issuer's limit of a UTC day."""
    rows = log.withColumn("day", F.to_date("ts"))
    return OrderedGroups(rows, ["issuer", "day"], list(order)).add(_i=Index()).done().withColumn(
        "over_quota", F.col("_i") >= limit).drop("_i")


def quota_usage(log: DataFrame, limit: int) -> DataFrame:
    return log.groupBy("issuer", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used")).withColumn(
        "remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def rate_flags(hits: DataFrame, limit: int = 20, window_seconds: int = 3600) -> DataFrame:
    """Raw hits beyond ``limit`` per key and rolling window: a hit is one too many when the
    hit ``limit`` places earlier is still inside the window."""
    rows = OrderedGroups(hits, ["req_key"], ["ts", "seq"]).add(_back=Lag("ts", limit)).done()
    inside = F.unix_micros("ts") - F.unix_micros("_back") < F.lit(window_seconds * 1_000_000)
    return rows.withColumn("over_limit", F.coalesce(inside, F.lit(False))).drop("_back")


def next_allowed(log: DataFrame) -> DataFrame:
    return log.groupBy("user_hash").agg((F.max("ts") + F.expr(f"INTERVAL {COOLDOWN_DAYS} DAYS")).alias("next_at"))


# -- claims ----------------------------------------------------------------------------------------


def verify_claims(claims: DataFrame, anchors: DataFrame, registry: DataFrame, event_text: Column) -> DataFrame:
    """Claims by transaction: four checks and one verdict.

    claims: claim_id, tx_hash, claimed_score and either claimed_user_hash or claimed_user_hashes, the
    ``identity_candidates`` of the person, of which any may match; anchors: tx_hash, user_hash,
    anchored_hash, event columns, event_score; registry: user_hash, latest_hash."""
    c = F.col
    a = anchors.withColumn("recomputed", commit(event_text)).withColumn("integrity_ok", F.coalesce(c("recomputed") == F.lower("anchored_hash"), F.lit(False)))
    a = a.select("tx_hash", F.col("user_hash").alias("a_user"), "anchored_hash", "recomputed", "event_score", "integrity_ok")
    r = registry.select(F.col("user_hash").alias("a_user"), "latest_hash")
    rows = join_one_row(claims, a, ["tx_hash"], hot_groups(claims, ["tx_hash"]), "left")
    several = "claimed_user_hashes" in claims.columns
    # Checks that need no registry come before its join, so that their long columns stay behind where nobody asks for them.
    rows = rows.withColumns({
        "found": c("anchored_hash").isNotNull(),
        "integrity_ok": F.coalesce(c("integrity_ok"), F.lit(False)),
        "identity_match": F.array_contains("claimed_user_hashes", c("a_user")) if several else c("claimed_user_hash") == c("a_user"),
        "score_match": F.abs(c("event_score") - c("claimed_score")) < 0.5,
    })
    rows = join_one_row(rows, r, ["a_user"], hot_groups(rows, ["a_user"]), "left")
    rows = rows.withColumn("on_registry", F.coalesce(F.lower("latest_hash") == F.lower("anchored_hash"), F.lit(False)))
    verdict = (
        F.when(~c("found"), "NO MATCH")
        .when(~c("integrity_ok"), "TAMPERED")
        .when(~c("on_registry"), "NOT CONFIRMED")
        .when(c("identity_match") == False, "WRONG IDENTITY")  # noqa: E712
        .when(c("score_match") == False, "WRONG SCORE")  # noqa: E712
        .when(c("identity_match").isNull() | c("score_match").isNull(), "FOUND")
        .otherwise("VERIFIED")
    )
    return rows.withColumn("verdict", verdict)


def verify_identities(claims: DataFrame, registry: DataFrame, salt: str) -> DataFrame:
    """Claims by name and address: the spellings are tried in order, the first hit counts.

    claims: claim_id, name, email, claimed_score, claimed_band; registry: user_hash, score, band."""
    tried = claims.select("*", F.posexplode(clean.name_spellings(F.col("name"))).alias("pos", "spelling")).withColumn(
        "user_hash", identity_hash(F.col("email"), F.col("spelling"), salt))
    hits = join_one_row(tried, registry.select("user_hash", F.col("score").alias("r_score"), F.col("band").alias("r_band"), F.lit(True).alias("_hit")),
                        ["user_hash"], hot_groups(tried, ["user_hash"]), "inner")
    first = hits.groupBy("claim_id").agg(F.min_by(F.struct("spelling", "user_hash", "r_score", "r_band"), "pos").alias("h"))
    c = F.col
    rows = claims.join(first, "claim_id", "left").withColumns({
        "found": c("h").isNotNull(),
        "score_match": F.abs(c("h.r_score") - c("claimed_score")) < 0.5,
        "band_match": F.upper(F.trim("h.r_band")) == F.upper(F.trim("claimed_band")),
    })
    verdict = (
        F.when(~c("found"), "NO MATCH").when(c("score_match") == False, "WRONG SCORE")  # noqa: E712
        .when(c("band_match") == False, "WRONG BAND").when(c("score_match").isNull(), "FOUND").otherwise("VERIFIED")  # noqa: E712
    )
    return rows.withColumns({"verdict": verdict, "spelling": c("h.spelling")}).drop("h")


def identity_hash(email: Column, name: Column, salt: str) -> Column:
    return commit(F.concat(F.lower(F.trim(email)), F.lit("|"), clean.plain_name(name), F.lit(":" + salt)))


def identity_candidates(email: Column, name: Column, salt: str) -> Column:
    """Identity hashes of a person under every spelling of the name; null where e-mail or name is unknown."""
    tried = F.transform(clean.name_spellings(name), lambda n: commit(F.concat(F.lower(F.trim(email)), F.lit("|"), n, F.lit(":" + salt))))
    return F.when(email.isNotNull() & name.isNotNull(), tried)


# -- advice ----------------------------------------------------------------------------------------


def attach_advice(reasons: DataFrame, advice: DataFrame, generic: str, limit: int = 4) -> DataFrame:
    """The first reasons of each case with their text; ``reasons`` has case_id and an array of
    codes that may carry a value in brackets. ``advice`` is the short text table."""
    first = reasons.select("case_id", F.posexplode(F.slice("codes", 1, limit)).alias("place", "code"))
    keyed = first.withColumn("feature", F.trim(F.substring_index("code", "(", 1)))
    out = join_one_row(keyed, advice, ["feature"], hot_groups(keyed, ["feature"]), "left")
    known = F.col("title").isNotNull()
    plain = F.regexp_replace("feature", "_", " ")
    return out.select(
        "case_id", "place", "feature",
        F.coalesce("title", F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 30)))).alias("title"),
        F.coalesce("detail", F.lit(generic)).alias("detail"), (known & ~F.coalesce("fixed", F.lit(False))).alias("actionable"))


def advice_gaps(features: DataFrame, advice: DataFrame) -> DataFrame:
    """Features without a text, and texts without a feature."""
    missing = features.select("feature").distinct().join(advice.select("feature"), "feature", "left_anti").withColumn("gap", F.lit("missing"))
    stale = advice.select("feature").join(features.select("feature"), "feature", "left_anti").withColumn("gap", F.lit("stale"))
    return missing.unionByName(stale)
