"""Commitments, log rules, streaming against batch, sinks."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from frame_rows import rows_of
from duepath.operators import governance as gov
from duepath.plans.audit_queries import hit_stream, submission_stream
from duepath.sources import sinks
from duepath.sources import tables as fx
from duepath.streaming import jobs


def test_canonical_json(spark):
    values = [0.0, 0.82, 735.0, 1e-7, 0.00012, 12345678.5, 1e20, 1.5e22, -3.25, None]
    df = spark.createDataFrame([(v, 'say "hi"\n', ["a", "b\\c"]) for v in values], "z double, a string, l array<string>")
    text = [r[0] for r in df.select(gov.canonical_json({"z": ("number", F.col("z")), "a": ("text", F.col("a")), "l": ("texts", F.col("l"))})).collect()]
    shown = ["0", "0.82", "735", "1e-7", "0.00012", "12345678.5", "100000000000000000000", "1.5e+22", "-3.25", "null"]
    for got, want, v in zip(text, shown, values):
        assert got == '{"a":"say \\"hi\\"\\n","l":["a","b\\\\c"],"z":' + want + "}"
        assert json.loads(got)["z"] == v


def python_root(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        nxt = []
        for i in range(0, len(level), 2):
            pair = level[i:i + 2]
            nxt.append(hashlib.sha256(b"".join(sorted(pair))).digest() if len(pair) == 2 else pair[0])
        level = nxt
    return level[0].hex()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20])
def test_merkle(spark, size):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(size)]
    df = spark.createDataFrame([("b", i, h) for i, h in enumerate(leaves)], "batch string, seq bigint, leaf string")
    assert gov.merkle_roots(df, ["batch"], "seq").first()["root"] == python_root(leaves)
    proofs = gov.merkle_proofs(df, ["batch"], "seq")
    assert proofs.filter(~gov.proof_holds(F.col("proof"), F.col("root"), F.col("leaf"))).count() == 0
    assert proofs.count() == size


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_merkle_in_blocks(spark, levels):
    """One batch with 90 % of the leaves and many small ones: the roots and proofs of one tree each, whatever the blocks."""
    sizes = {"huge": 450, **{f"b{k}": k % 9 + 1 for k in range(10)}}
    leaves = {b: [hashlib.sha256(f"{b}{i}".encode()).hexdigest() for i in range(n)] for b, n in sizes.items()}
    df = spark.createDataFrame([(b, i, h) for b, hs in leaves.items() for i, h in enumerate(hs)], "batch string, seq bigint, leaf string").repartition(5)
    assert {r["batch"]: r["root"] for r in gov.merkle_roots(df, ["batch"], "seq", levels=levels).collect()} == {b: python_root(hs) for b, hs in leaves.items()}
    proofs = gov.merkle_proofs(df, ["batch"], "seq", levels=levels)
    held = proofs.withColumn("holds", gov.proof_holds(F.col("proof"), F.col("root"), F.col("leaf"))).collect()
    assert len(held) == sum(sizes.values()) and all(r["holds"] and r["leaf"] == leaves[r["batch"]][r["leaf_no"]] and r["root"] == python_root(leaves[r["batch"]]) for r in held)
    forged = proofs.withColumn("holds", gov.proof_holds(F.col("proof"), F.col("root"), F.sha2(F.col("leaf"), 256)))
    assert forged.filter("holds").count() == 0


def test_log_rules(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, "i", "u", "h1", 202401), (2, day + dt.timedelta(days=10), "i", "u", "h2", 202402), (3, day + dt.timedelta(days=40), "i", "u", "h1", 202402)]
    log = spark.createDataFrame(rows, "seq bigint, ts timestamp, issuer string, user_hash string, event_hash string, period int")
    flags = {r["seq"]: (r["period_not_newer"], r["too_soon"]) for r in gov.cooldown_flags(log).collect()}
    assert flags == {1: (False, False), 2: (False, True), 3: (True, False)}
    assert {r["seq"]: r["reused"] for r in gov.reused_hashes(log).collect()} == {1: False, 2: False, 3: True}
    bad = gov.first_failure(log.withColumn("period", F.lit(202613)), spark.createDataFrame([("i",)], "issuer string"), ["user_hash"])
    assert {r["reject_reason"] for r in bad.collect()} == {"bad period"}
    assert gov.next_allowed(log).first()["next_at"] == day + dt.timedelta(days=68)


def test_accept_is_sequential(spark, sf):
    """A rejected submission must not restart the cooldown."""
    got = {r["seq"]: r["accepted"] for r in jobs.drain(jobs.accept_per_user(submission_stream(spark, sf)), "t-accept").collect()}
    rows = sorted(fx.submissions(spark, sf).collect(), key=lambda r: (r["user_hash"], r["ts"], r["seq"]))
    last = {}
    for r in rows:
        before = last.get(r["user_hash"])
        ok = before is None or (r["period"] > before[0] and r["ts"] >= before[1] + dt.timedelta(days=28))
        assert got[r["seq"]] == ok
        if ok:
            last[r["user_hash"]] = (r["period"], r["ts"])


def test_rate_limit_is_sequential(spark, sf):
    got = {r["seq"]: r["allowed"] for r in jobs.drain(jobs.rate_limit(hit_stream(spark, sf), 1), "t-rate").collect()}
    hits = {}
    for r in sorted(fx.requests(spark, sf).collect(), key=lambda r: (r["ts"], r["seq"])):
        kept = [t for t in hits.get(r["req_key"], []) if (r["ts"] - t).total_seconds() < 3600]
        assert got[r["seq"]] == (len(kept) < 1)
        if len(kept) < 1:
            kept.append(r["ts"])
        hits[r["req_key"]] = kept


def test_streams_equal_batch(spark, sf):
    s = fx.submissions(spark, sf)
    once = jobs.drain(jobs.first_use(submission_stream(spark, sf).select("event_hash")), "t-first")
    assert rows_of(once) == rows_of(s.select("event_hash").distinct())
    used = jobs.drain_updates(jobs.daily_usage(submission_stream(spark, sf)), ["issuer", "day"], "t-usage")
    assert rows_of(used) == rows_of(gov.quota_usage(s, 2).select("issuer", "day", "used"))


def test_daily_usage_counts_late_rows(spark, tmp_path):
    path = str(tmp_path / "late")
    for day in (9, 3, 6, 3, 1):
        spark.createDataFrame([("a", dt.datetime(2026, 3, day, 12))], "issuer string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("issuer string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain_updates(jobs.daily_usage(stream), ["issuer", "day"], "t-late").collect()
    assert {(r["day"].day, r["used"]) for r in got} == {(9, 1), (3, 2), (6, 1), (1, 1)} and len(got) == 4


def test_claims_try_every_spelling(spark):
    salt = "a-salt-of-sixteen-or-more"
    made = hashlib.sha256(f"j@x.org|J DOE:{salt}".encode()).hexdigest()
    body = hashlib.sha256(b"event").hexdigest()
    anchor = spark.createDataFrame([("t", made, body, "event", 650.0)], "tx_hash string, user_hash string, anchored_hash string, body string, event_score double")
    registry = spark.createDataFrame([(made, body)], "user_hash string, latest_hash string")
    people = [(1, " J@x.org", "Mr Jon A. Doe", "VERIFIED"), (2, "j@x.org", "Doe Jon", "WRONG IDENTITY"), (3, None, "J Doe", "FOUND"), (4, "j@x.org", None, "FOUND"), (5, "j@x.org", "", "WRONG IDENTITY")]
    claims = spark.createDataFrame([(*p, "t", 650.0) for p in people], "claim_id int, email string, name string, want string, tx_hash string, claimed_score double")
    claims = claims.withColumn("claimed_user_hashes", gov.identity_candidates(F.col("email"), F.col("name"), salt))
    got = gov.verify_claims(claims, anchor, registry, F.col("body")).select("claim_id", "want", "verdict").collect()
    assert len(got) == 5 and [r for r in got if r["want"] != r["verdict"]] == []


def test_events_with_wrong_factor_lists(spark):
    good = ("u", "m", "2026-03-01T00:00:00Z", "650")
    cases = [(None, None, None), ("[]", '["a", "b"]', None), ('"late"', None, "positiveFactors"), ("null", None, "positiveFactors"), ("[]", '{"a": 1}', "negativeFactors"), ("", None, "positiveFactors")]
    rows = [(*good, p, n, want) for p, n, want in cases] + [("u", "m", good[2], '"650"', None, None, "newScore")]
    df = spark.createDataFrame(rows, "userId string, modelVersion string, timestamp string, newScore string, positiveFactors string, negativeFactors string, want string")
    assert [r for r in gov.validate_events(df).collect() if r["want"] != r["reject_reason"]] == []
    lists = df.select("userId", "modelVersion", "timestamp", F.lit(650.0).alias("newScore"), F.array(F.lit("a")).alias("positiveFactors"))
    assert gov.validate_events(lists).where("reject_reason is not null").isEmpty()


def test_incremental_build_refuses_other_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "case_id string, f double")
    sinks.append_new_cases(df.filter("case_id = '1'"), path, "v1")
    sinks.append_new_cases(df, path, "v1")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.append_new_cases(df, path, "v2")


def test_shared_folder_comes_from_the_session(spark):
    from types import SimpleNamespace as NS

    from duepath.session import shared_dir

    conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    named = NS(conf=NS(get=lambda k, d=None: conf.get(k, d)))
    assert shared_dir(named) == "hdfs:///shared"
    bare = NS(conf=NS(get=lambda k, d=None: d), sparkContext=NS(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_dir(bare)


def test_canonical_text_escapes_every_control_character(spark):
    import json

    from pyspark.sql import functions as F

    from duepath.operators import governance

    text = "".join(map(chr, range(32))) + 'a"b\\c/\u00e9\u007f'
    got = spark.createDataFrame([(text,)], "t string").select(governance._json_text(F.col("t"))).first()[0]
    assert got == json.dumps(text, ensure_ascii=False)


def test_stateful_rules_keep_one_state_for_many_keys(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i if i % 17 else None, start + dt.timedelta(days=i * 7 % 400, minutes=i), f"u{i % 40}" if i % 40 else None, 2024 * 12 + i * 7 % 400 // 30) for i in range(1, 800)]
    # the second batch must go on from the state of the first
    batches = sorted(rows, key=lambda r: r[1])[:400], sorted(rows, key=lambda r: r[1])[400:]
    schema = "seq bigint, ts timestamp, user_hash string, period int"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accepted, allowed, last, hits = [], [], {}, {}
    for seq, ts, user, period in sorted(rows, key=lambda r: r[1]):
        before = last.get(user)
        ok = before is None or (period > before[0] and ts >= before[1] + dt.timedelta(days=28))
        accepted.append((seq, user, ts, period, ok))
        if ok:
            last[user] = (period, ts)
        kept = [t for t in hits.get(user, []) if ts - t < dt.timedelta(days=60)]
        allowed.append((seq, user, ts, len(kept) < 2))
        hits[user] = kept + [ts] * (len(kept) < 2)
    limited = jobs.rate_limit(stream.withColumnRenamed("user_hash", "req_key"), 2, 60 * 24 * 3600, places=3)
    for name, job, columns, want in (("accept", jobs.accept_per_user(stream, places=3), ["seq", "user_hash", "ts", "period", "accepted"], accepted),
                                     ("limit", limited, ["seq", "req_key", "ts", "allowed"], allowed)):
        query = jobs.append_to(job, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3 and query.lastProgress["batchId"] == 1
        got = spark.read.parquet(str(tmp_path / name)).select(columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
