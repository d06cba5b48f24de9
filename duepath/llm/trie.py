"""The prefix trie of conversations, by peeling truncations from the deepest turn up.

A conversation is the sequence of its turns' digests; every distinct sequence of first d turns is a node. Equal
conversations are merged first. Then, from the deepest level up, the nodes of a level are the surviving ones of the level
below, less their last turn, together with the conversations that end there: one grouping by the sequence that is left
finds the nodes and adds up members, children, leaves and saved words at once. Every aggregate is a sum or a minimum, so
tasks add up their own rows before the shuffle and a node with a third of all rows (the root has them all) is no hot group.

A turn that no other distinct conversation has at its place has nothing to merge with. How deep a conversation shares its
turns is counted before, and all its deeper nodes are peeled in one step, as sums over its own turns; so there are as many
rounds as the deepest shared prefix has turns, not as the longest conversation.

A sequence is held as chained digests, one of 32 bytes a turn, each of the one before and of the turn's role and text; texts
are never shuffled. The ids of the conversations that end at a node are joined in pieces of ``PIECE`` possible ids and
hashed as a stream, as SHA-256 must be, so no list of ids is held as a whole.

Defined cases: rows without conv_id belong to no conversation and are ignored; null role or text counts as empty; null
turns come first; rows of one conversation with the same turn stand in the order of their turns' digests; repeated rows
are turns of their own; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duepath.session import cut_lineage

PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """A digest of a turn; the length of the role tells where the text begins."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", turn_digest(role, text).alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def with_shared_openings(seqs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversation c opens with the first h turns of conversation c - c % every, h = crc32(c) % (most + 1), instead of its own first h.

    All of them if it has fewer, none if there is none; the remainder has the sign of c.
    """
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    opening = F.slice(F.coalesce("opening", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(opening, own).alias("turns"))


def chained(seqs: DataFrame) -> DataFrame:
    """conv_id, keys (a digest of each prefix), words of each turn, and below: the words of each turn and all after it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, below = [], []
            for digests, words in zip(batch.column("digests").to_pylist(), batch.column("words").to_pylist()):
                key, own = b"", []
                for digest in digests:
                    key = hashlib.sha256(key + digest).digest()
                    own.append(key)
                keys.append(own)
                below.append(np.cumsum(np.array(words[::-1], np.int64))[::-1].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, pa.list_(pa.binary())), batch.column("words"), pa.array(below, pa.list_(pa.int64()))], names=["conv_id", "keys", "words", "below"])

    flat = seqs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    return flat.mapInArrow(batches, "conv_id bigint, keys array<binary>, words array<bigint>, below array<bigint>")


def _id(keys: Column) -> Column:
    """The identity of a sequence: its last key; that of no turns is empty."""
    return F.coalesce(F.try_element_at(keys, F.lit(-1)), F.lit(b""))


def ends(convs: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the joined ids of the conversations that are just this sequence."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        done: list[tuple[bytes, str]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "ends_sha256"])

        for batch in it:
            for own, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if own != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(done) > 10_000:
                yield made()
                done = []
        if state is not None:
            done.append((key, state.hexdigest()))
        if done:
            yield made()

    # at most PIECE ids a row, conv_id being distinct
    pieces = convs.groupBy(_id(F.col("keys")).alias("key"), F.floor(F.col("conv_id") / PIECE).alias("at")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("piece"))
    return pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(batches, "key binary, ends_sha256 string")


def merged(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence: keys, words, below, n (conversations), conv_id (smallest) and shared: the turns it has in common with another one."""
    whole = cut_lineage(convs.groupBy("keys", "words", "below").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")), "sequences")
    turns = whole.select(_id(F.col("keys")).alias("id"), F.posexplode("keys").alias("at", "key"))
    common = cut_lineage(turns.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "shared")
    depth = turns.join(common, "key").groupBy("id").agg((F.max("at") + 1).alias("shared"))
    return whole.withColumn("id", _id(F.col("keys"))).join(depth, "id", "left").select("keys", "words", "below", "n", "conv_id", F.coalesce("shared", F.lit(0)).alias("shared"))


def nodes(seqs: DataFrame) -> DataFrame:
    """The trie of ``seqs`` (conv_id, turns), a row per node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs = cut_lineage(chained(seqs), "chained")
    last = cut_lineage(ends(convs), "ends")
    # sorted, so a round skips what ends its sharing at other levels
    whole = cut_lineage(merged(convs).sortWithinPartitions("shared"), "merged")
    size = F.size("keys")

    # all nodes deeper than what their conversation shares
    own = whole.where(size > F.col("shared")).withColumn("d", F.explode(F.sequence(F.col("shared") + 1, size)))
    private = own.select(
        F.get("keys", F.col("d") - 1).alias("key"),
        F.when(F.col("d") == F.col("shared") + 1, F.coalesce(F.get("keys", F.col("d") - 2), F.lit(b""))).alias("above"),
        F.when(F.col("d") > F.col("shared") + 1, F.col("conv_id")).alias("parent"),
        "conv_id",
        F.col("d").cast("long").alias("depth"),
        F.col("n").alias("n_convs"),
        F.when(F.col("d") < size, 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.get("below", F.col("d") - 1)).alias("saved_tokens"),
    )

    def prefix(d: int) -> list[Column]:
        return [F.slice("keys", 1, d).alias("keys"), F.slice("words", 1, d).alias("words")]

    deepest = whole.agg(F.max("shared")).first()[0]
    levels, survivors = [], None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        here = whole.where(F.col("shared") == d)
        tail = size > d
        arriving = here.select(*prefix(d), "conv_id", "n", tail.cast("long").alias("child"), tail.cast("long").alias("leaves"), F.when(tail, (F.col("n") - 1) * F.get("below", F.lit(d))).otherwise(F.lit(0)).alias("saved"))
        if survivors is not None:
            arriving = arriving.unionByName(survivors.select(*prefix(d), "conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        group = arriving.groupBy("keys", "words").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        again = (F.col("n_convs") - 1) * F.get("words", F.lit(d - 1)) if d else F.lit(0)
        survivors = cut_lineage(group.select("keys", "words", "conv_id", "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + again).alias("saved_tokens")), f"level-{d}")
        levels.append(
            survivors.select(_id(F.col("keys")).alias("key"), (F.coalesce(F.try_element_at("keys", F.lit(-2)), F.lit(b"")) if d else F.lit(None).cast("binary")).alias("above"), F.lit(None).cast("long").alias("parent"), "conv_id", F.lit(d).cast("long").alias("depth"), "n_convs", "n_children", "n_leaves", "saved_tokens")
        )
    shared = None
    for level in levels:
        shared = level if shared is None else shared.unionByName(level)
    if shared is None:  # an empty table
        shared = private.limit(0)
    everything = cut_lineage(private.unionByName(shared), "nodes")
    # only a shared node can be the parent of a node that isn't its own conversation's
    parents = everything.where("parent is null").select(F.col("key").alias("above"), F.col("conv_id").alias("parent_of"))
    asking = everything.where("above is not null").join(cut_lineage(parents, "parents"), "above", "left")
    told = everything.where("above is null").withColumn("parent_of", F.col("parent"))
    every = told.unionByName(asking.select(*told.columns)).join(last, "key", "left")
    return every.select("conv_id", "depth", F.col("parent_of").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
