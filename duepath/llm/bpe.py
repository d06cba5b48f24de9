"""Byte-level BPE: chunks of long texts are pre-tokenised in parallel, stitched where their boundaries agree, and encoded.

A text of more than ``CHUNK`` code points becomes chunks that overlap by ``OVERLAP``. A chunk's pre-tokenisation may
start in the middle of a pre-token, so its first boundaries can be wrong; from the first boundary on that it shares
with the chunk before, both are the same, since matching only depends on what follows. There the chunks are joined.
A boundary within three code points of a cut end isn't trusted. If two chunks share none in the overlap (a pre-token
longer than it), the text is put together from the chunks' decoded ids and pre-tokenised in one run.

Chunks are shuffled by document and number, so one long text is the work of many tasks; its ids then meet in one row.
Decoding concatenates the raw bytes of the ids.

Defined cases: null text counts as empty and has no ids; null or repeated doc_ids keep a row each; empty tables give no
rows; other columns are ignored. The vocabulary's path must be readable on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, TRUSTED = 32_768, 1_024, 3
#: Rows of ids handed over at a time hold about so many ids.
BATCH_IDS = 1 << 18


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _id_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids) from pairs of a one-value Arrow array and a list of ids."""
    ids, lists, held = [], [], 0
    for doc_id, found in rows:
        ids.append(doc_id)
        lists.append(np.asarray(found, dtype=np.int32))
        held += len(found)
        if held >= BATCH_IDS or len(ids) >= 4096:
            yield _batch(ids, lists)
            ids, lists, held = [], [], 0
    if ids:
        yield _batch(ids, lists)


def _batch(ids: list, lists: list) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists) if ends[-1] else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])


def _by_token(enc: tiktoken.Encoding, text: str, bounds: list[int]) -> list[list[int]]:
    return [enc.encode_ordinary(text[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def chunk_ids(text: str, begin: int, last: bool, enc: tiktoken.Encoding, match: regex.Pattern, chunk: int, overlap: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Ids of a chunk, and in its first and last overlap the boundaries (in the document) with the number of ids before each."""
    bounds = [m.start() for m in match.finditer(text)] + [len(text)]
    starts = np.array(bounds)
    head = int(np.searchsorted(starts, overlap, "left")) if begin else 0
    tail = len(bounds) - 1 if last else max(head, int(np.searchsorted(starts, chunk, "left")))
    # a piece must not end in white space that the next pre-token could have taken
    middle = tail
    while middle > head and text[bounds[middle] - 1].isspace():
        middle -= 1
    ids, before = [], []
    for found in _by_token(enc, text, bounds[: head + 1]):
        before.append(len(ids))
        ids += found
    head_at = bounds[:head]
    ids += enc.encode_ordinary(text[bounds[head] : bounds[middle]])
    for found in _by_token(enc, text, bounds[middle : tail + 1]):
        ids += found
    tail_at, tail_before = [], []
    for b, found in zip(bounds[tail:], _by_token(enc, text, bounds[tail:])):
        if b <= len(text) - TRUSTED:
            tail_at.append(b)
            tail_before.append(len(ids))
        ids += found
    return ids, [begin + b for b in head_at], before, [begin + b for b in tail_at], tail_before


def stitched(chunks: list[dict], enc: tiktoken.Encoding, match: regex.Pattern, overlap: int) -> np.ndarray:
    """One document's ids from its chunks in order."""
    pieces, begin = [], 0
    for k, now in enumerate(chunks):
        if k + 1 == len(chunks):
            pieces.append(now["ids"][begin:])
            break
        following = chunks[k + 1]
        ahead = dict(zip(following["head_at"], following["head_before"]))
        joint = next(((n, ahead[at]) for at, n in zip(now["tail_at"], now["tail_before"]) if at in ahead and n >= begin), None)
        if joint is None:
            texts = [enc.decode_bytes(c["ids"].tolist()).decode() for c in chunks]
            whole = texts[0] + "".join(t[overlap:] for t in texts[1:])
            bounds = [m.start() for m in match.finditer(whole)] + [len(whole)]
            return np.array([i for found in _by_token(enc, whole, bounds) for i in found], dtype=np.int32)
        pieces.append(now["ids"][begin : joint[0]])
        begin = joint[1]
    return np.concatenate(pieces)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (array of int) for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a text that ends inside the overlap of its first chunk has only one
    is_long = F.char_length("text") > chunk + overlap

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        yield from _id_rows((batch.column("doc_id").slice(k, 1), enc.encode_ordinary(batch.column("text")[k].as_py())) for batch in it for k in range(batch.num_rows))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                text, n = batch.column("text")[k].as_py(), 0
                while True:
                    last = n * chunk + chunk + overlap >= len(text)
                    part = text[n * chunk : n * chunk + chunk + overlap]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(k, 1), batch.column("doc_id").slice(k, 1), pa.array([n], pa.int32()), pa.array([last]), pa.array([part])], names=["row", "doc_id", "chunk", "last", "text"])
                    if last:
                        break
                    n += 1

    lists = ["ids", "head_at", "head_before", "tail_at", "tail_before"]

    def pre_tokenised(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, match = encoding(path, pattern), _matcher(pattern)
        for batch in it:
            for k in range(batch.num_rows):
                n, last, text = (batch.column(c)[k].as_py() for c in ("chunk", "last", "text"))
                found = chunk_ids(text, n * chunk, last, enc, match, chunk, overlap)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in ("row", "doc_id", "chunk")] + [pa.array([v], pa.list_(pa.int64() if c.endswith("_at") else pa.int32())) for c, v in zip(lists, found)], names=["row", "doc_id", "chunk", *lists])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks = [{c: np.asarray(table.column(c)[k].values) for c in lists} for k in range(table.num_rows)]
        ids = stitched(chunks, encoding(path, pattern), _matcher(pattern), overlap)
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    short = source.where(~is_long).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    cuts = source.where(is_long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(cut, f"row bigint, doc_id {kind}, chunk int, last boolean, text string")
    parts = cuts.repartition("row", "chunk").mapInArrow(pre_tokenised, f"row bigint, doc_id {kind}, chunk int, ids array<int>, head_at array<bigint>, head_before array<int>, tail_at array<bigint>, tail_before array<int>")
    return short.unionByName(parts.groupBy("row").applyInArrow(joined, f"doc_id {kind}, ids array<int>"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and ``decoded``: the raw bytes of the ids, one after another."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in it:
            ids = batch.column("ids")
            raw = [enc.decode_bytes(np.asarray(ids[k].values).tolist()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(batches, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts encoded and decoded again."""
    there = decode(encode(docs, path, pattern, chunk, overlap), path, pattern)
    return there.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
