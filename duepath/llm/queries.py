"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duepath.llm import bpe, html, langid, leaks, minmax, naming, periods, pfor, pii, resample, toxicity, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op2_block_naming",
    r"""
    with t as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
    r as (select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by body) as group_size
          from t window w as (partition by body order by length(raw) desc, doc_id))
    select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from r
    """,
)
def op2_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return naming.exact_duplicates(table(spark, folder, "documents")).drop("key")


@query("op10_min_max")
def op10_min_max(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, folder, "documents")).drop("row", "body", "root")


def crc_rest(parts: int):
    """crc32 of doc_id as text, modulo ``parts``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


@query("op4_compression")
def op4_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", (crc_rest(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op1_embedded_edits")
def op1_embedded_edits(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_chunked_bpe")
def op6_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_subword_bags")
def op8_subword_bags(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), crc_rest(3) != 1)
    return toxicity.predict(docs, model).select("doc_id", (crc_rest(3) == 1).alias("held_out"), "score", "predicted")


@query("op3_shape_field")
def op3_shape_field(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query("op5_importance_resampling")
def op5_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_patched_blocks")
def op7_patched_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return pfor.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_text_blocks")
def op9_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def planted_fold(h: int, n: int) -> tuple[int, int] | None:
    """Every tenth document repeats itself from some word on: 3 to 10 periods."""
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query("op11_internal_patterns")
def op11_internal_patterns(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return periods.report(periods.find(docs, planted_fold, F.crc32(F.col("doc_id").cast("string").cast("binary"))))


@query(
    "op12_truncation_peeling",
    r"""
    with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i
               from conversations where conv_id is not null),
    c as (select distinct conv_id, conv_id - conv_id % 20 as base,
                 xor(list_reduce(flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: [ascii(ch)::bigint, 0, 0, 0, 0, 0, 0, 0])),
                                 lambda acc, e: xor(xor(acc, e) >> 1, 3988292384::bigint * (xor(acc, e) & 1)), 4294967295::bigint), 4294967295::bigint) % 4 as h
          from t),
    r as (select c.conv_id, 0 as part, t.i, t.role, t.text from c join t on t.conv_id = c.base and t.i <= c.h
          union all select c.conv_id, 1, t.i, t.role, t.text from c join t on t.conv_id = c.conv_id and t.i > c.h),
    s as (select conv_id, row_number() over (partition by conv_id order by part, i) as d, role, text from r),
    p as (select conv_id, d, list({'r': role, 'x': text}) over (partition by conv_id order by d) as path, text from s
          union all select conv_id, 0, [], null from c),
    f as (select conv_id, max(d) as n from p group by conv_id),
    k as (select p.d as depth, p.path, min(p.conv_id) as conv_id, count(*) as n_convs, any_value(p.text) as text,
                 coalesce(string_agg(p.conv_id, ',' order by p.conv_id) filter (where f.n = p.d), '') as ends
          from p join f using (conv_id) group by p.d, p.path),
    kid as (select depth - 1 as depth, list_slice(path, 1, depth - 1) as path, count(*) as n_children from k where depth > 0 group by all),
    u as (select k.*, coalesce(n_children, 0) as n_children,
                 (n_convs - 1) * len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as own from k left join kid using (depth, path)),
    e as (select unnest(range(0, depth + 1)) as up, path, own, n_children = 0 as leaf from u),
    a as (select up as depth, list_slice(path, 1, up) as path, sum(own) as saved_tokens, count(*) filter (where leaf) as n_leaves from e group by all)
    select u.conv_id, u.depth, o.conv_id as parent_conv_id, u.n_convs, u.n_children, a.n_leaves, cast(a.saved_tokens as bigint) as saved_tokens, sha256(u.ends) as ends_sha256
    from u join a using (depth, path) left join u o on o.depth = u.depth - 1 and o.path = list_slice(u.path, 1, u.depth - 1)
    """,
)
def op12_truncation_peeling(spark: SparkSession, folder: str) -> DataFrame:
    return trie.nodes(trie.with_shared_openings(trie.sequences(table(spark, folder, "conversations"))))


@query(
    "op13_sequential_reader",
    """
    with p as (select page_id, encode(coalesce(html, '')) as body, coalesce(html, '') as same from pages),
    r as (select *, octet_length(body) as n, max(page_id) over (partition by same) as best from p)
    select page_id, n as payload_bytes, sha1(body) as payload_digest,
           case when n >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
           case when n >= 1000 and page_id <> best then best end as refers_to
    from r
    """,
)
def op13_sequential_reader(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
