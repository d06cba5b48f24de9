"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt to files by ranges of doc_id, so files in order of their number hold ids in order of doc_id. A file
holds the ids of its documents one after another, cut into blocks of ``BLOCK``. Of a block the minimum is subtracted and
the rest packed at the width that ``PERCENTILE`` percent of its values need; the low bits of larger values are packed
too, and their high bits stand in a list of exceptions (place and high part).

File: blocks; the block index (u64 place of each block); the document index (u32 ids of each document); the doc_ids as an
Arrow stream; and at the end b"PFOR", u32 version, u64 ids, u64 documents, u64 blocks, u64 place of the block index.
Block: u32 minimum, u16 ids, u8 width, u8 0, u16 exceptions, packed bits, u16 places, u32 high parts. Little-endian.

A task writes under a name of its own attempt and hands over that name with its rows, so files of failed or repeated
attempts are never read; the manifest of names is written before files are read.

The words of a text are encoded by the tokenizers library once each and remembered: its normaliser and pre-tokeniser
never join what white space or the string of a special token separates, and such a string is its token, as in the library;
tests hold it against whole texts.

Defined cases: null text counts as empty and gives the end id alone; null doc_ids come first; repeated ids keep a row
each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duepath.llm import text as tx
from duepath.llm.files import locate
from duepath.session import cut_lineage, fresh_path

BLOCK, PERCENTILE, VERSION = 256, 95, 1
TAIL = struct.Struct("<4sIQQQQ")
BLOCK_HEAD = struct.Struct("<IHBBH")
#: Words a task's process remembers before it starts anew; about 200 bytes each.
REMEMBERED = 1_000_000


# ---- file format -------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids, and the place of each block."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(0, np.uint64)
    padded = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(blocks, BLOCK)
    low = padded.min(1)
    rest = padded - low[:, None]
    need = np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.ceil(np.log2(need.astype(float) + 1)).astype(np.uint8)
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        values = rest[which]
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(which), BLOCK, 4), axis=2, bitorder="little")
        packed = np.packbits(bits[:, :, : int(w)].reshape(len(which), -1), axis=1, bitorder="little")
        high = values >> np.uint32(w) if w < 32 else np.zeros_like(values)
        high[np.arange(BLOCK) >= size[which][:, None]] = 0
        row, at = np.nonzero(high)
        odd, at, to = high[row, at].astype("<u4"), at.astype("<u2"), np.searchsorted(row, np.arange(len(which) + 1))
        for k, (b, one, end) in enumerate(zip(which.tolist(), to[:-1].tolist(), to[1:].tolist())):
            parts[b] = BLOCK_HEAD.pack(int(low[b]), int(size[b]), int(w), 0, end - one) + packed[k].tobytes() + at[one:end].tobytes() + odd[one:end].tobytes()
    place = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.uint64)
    return b"".join(parts), place


def unpack(raw: bytes, places: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``places``."""
    heads = [BLOCK_HEAD.unpack_from(raw, int(p)) for p in places]
    out = [np.zeros(0, np.uint32)] * len(heads)
    widths = np.array([h[2] for h in heads])
    for w in np.unique(widths):
        which, size = np.flatnonzero(widths == w), BLOCK * int(w) // 8
        packed = np.stack([np.frombuffer(raw, np.uint8, size, int(places[b]) + BLOCK_HEAD.size) for b in which])
        bits = np.zeros((len(which), BLOCK, 32), np.uint8)
        bits[:, :, : int(w)] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
        values = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(which), BLOCK).astype(np.uint32)
        for k, b in enumerate(which):
            low, n, _, _, odd = heads[b]
            at = int(places[b]) + BLOCK_HEAD.size + size
            where = np.frombuffer(raw, "<u2", odd, at)
            values[k, where] += np.frombuffer(raw, "<u4", odd, at + 2 * odd) << np.uint32(w)
            out[b] = values[k, :n] + np.uint32(low)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Writer:
    """One file; ids are packed as they come, so a task holds about ``HELD`` of them."""

    HELD = 1 << 20

    def __init__(self, out):
        self.out, self.waiting, self.held = out, [], 0
        self.places, self.sizes, self.names, self.at, self.ids = [], [], [], 0, 0

    def add(self, doc_id: pa.Array, ids: np.ndarray) -> None:
        """``doc_id`` is an array of one value."""
        self.names.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids.astype(np.uint32))
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.HELD:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        raw, places = pack(ids[:cut])
        self.out.write(raw)
        self.places.append(places + np.uint64(self.at))
        self.at += len(raw)
        self.waiting, self.held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        places = np.concatenate(self.places).astype("<u8")
        self.out.write(places.tobytes())
        self.out.write(np.array(self.sizes, "<u4").tobytes())
        names = pa.record_batch([pa.concat_arrays(self.names)], names=["doc_id"])
        with pa.ipc.new_stream(self.out, names.schema) as stream:
            stream.write_batch(names)
        self.out.write(TAIL.pack(b"PFOR", VERSION, self.ids, len(self.sizes), len(places), self.at))


def read_file(raw: bytes) -> tuple[pa.Array, Iterator[np.ndarray]]:
    """The doc_ids of a file, and the ids of each document in order."""
    magic, version, _, documents, blocks, at = TAIL.unpack_from(raw, len(raw) - TAIL.size)
    if magic != b"PFOR" or version != VERSION:
        raise ValueError("not a file of this format")
    places = np.frombuffer(raw, "<u8", blocks, at)
    sizes = np.frombuffer(raw, "<u4", documents, at + 8 * blocks)
    names = pa.ipc.open_stream(pa.py_buffer(raw)[at + 8 * blocks + 4 * documents :]).read_all().column("doc_id").combine_chunks()

    def documents_in_order() -> Iterator[np.ndarray]:
        held, block = np.zeros(0, np.uint32), 0
        for size in sizes:
            while len(held) < size:
                group = places[block : block + 1024]
                held = np.concatenate([held, unpack(raw, group)])
                block += len(group)
            yield held[:size]
            held = held[size:]

    return names, documents_in_order()


# ---- encoding ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, list[int], bytes, re.Pattern, np.ndarray | None]:
    """The library's tokenizer for the words between special tokens; of the latter the ids, what their strings begin with,
    and a pattern of the strings, longest first; and which ids end a word, if the vocabulary marks them."""
    made = Tokenizer.from_file(path)
    special = sorted(made.get_added_tokens_decoder().items(), key=lambda t: (-len(t[1].content), t[0]))
    if any(t.single_word or t.lstrip or t.rstrip or t.normalized for _, t in special):
        raise ValueError("only added tokens that match as they stand are known here")
    made.encode_special_tokens = True  # a word that reads like one when lower-cased is none
    strings = [t.content.encode() for _, t in special]
    suffix = json.loads(made.to_str())["model"].get("end_of_word_suffix")
    last = None
    if suffix:
        last = np.zeros(max(made.get_vocab().values()) + 1, bool)
        last[[i for t, i in made.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
    return made, [i for i, _ in special], os.path.commonprefix(strings), re.compile(b"|".join(b"(%s)" % re.escape(t) for t in strings)), last


def _specials(raw: np.ndarray, offsets: np.ndarray, begin: bytes, strings: re.Pattern) -> np.ndarray:
    """Rows of start, end and place in the list of special tokens, for each of their strings in the texts."""
    out, flat = [], raw.tobytes()
    if strings.groups and begin in flat:
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out += [(m.start(), m.end(), m.lastindex - 1) for m in strings.finditer(flat, a, b)]
    return np.array(out, np.int64).reshape(-1, 3)


_memory: dict[str, dict[bytes, bytes]] = {}

_SPACE_BYTES = tx.table(tx.SPACES)
_LETTER = tx.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_NUMBER = tx.table(bytes(range(48, 58)))


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs between white space; those of ASCII without an apostrophe are cut where letters, digits and signs meet."""
    plain = (raw < 128) & (raw != 39)
    kind = np.where(_SPACE_BYTES[raw], 0, np.where(_LETTER[raw], 1, np.where(_NUMBER[raw], 2, 3))).astype(np.int8)
    inside = kind > 0
    starts, ends, bounds = tx.words(raw, offsets, inside)
    if len(raw) < 2:
        return starts, ends, bounds
    foreign = np.concatenate([[0], np.cumsum(~plain)])
    pure = foreign[ends] == foreign[starts]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    word = np.searchsorted(starts, change, "right") - 1
    ok = (word >= 0) & (change > starts[np.maximum(word, 0)]) & (change < ends[np.maximum(word, 0)]) & pure[np.maximum(word, 0)]
    cut = change[ok]
    all_starts = np.sort(np.concatenate([starts, cut]))
    all_ends = np.sort(np.concatenate([ends, cut]))
    return all_starts, all_ends, np.searchsorted(all_starts, offsets, "left")


def _learn(words: list[bytes], made: Tokenizer, last_of_word: np.ndarray | None, kind: np.dtype, known: dict[bytes, bytes]) -> None:
    """Adds the ids of new words to ``known``.

    A word of ASCII letters is one word to the tokenizer too. So such words are encoded as lines of one text, and its ids
    parted where a token ends a word; the others are encoded one by one.
    """
    plain = [w for w in words if w.isalpha()] if last_of_word is not None else []  # of bytes: ASCII letters only
    if plain:
        ids = np.array(made.encode_batch_fast([b"\n".join(plain).decode()], add_special_tokens=False)[0].ids, kind)
        ends = np.flatnonzero(last_of_word[ids]) + 1
        if len(ends) == len(plain) and ends[-1] == len(ids):
            flat = ids.tobytes()
            places = (np.concatenate([[0], ends]) * kind.itemsize).tolist()
            known.update(zip(plain, (flat[a:b] for a, b in zip(places, places[1:]))))
            words = [w for w in words if not w.isalpha()]
    for word, found in zip(words, made.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
        known[word] = np.array(found.ids, kind).tobytes()


def encode(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text, in order."""
    made, special_ids, begin, strings, last_of_word = _tokenizer(path)
    kind = np.dtype("<u2" if made.get_vocab_size() <= 1 << 16 else "<u4")
    known = _memory.setdefault(path, {})
    for _, raw, offsets in tx.slices(column):
        body = tx.lower_ascii(raw)
        special = _specials(raw, offsets, begin, strings)
        for a, b in special[:, :2].tolist():
            body[a:b] = 32  # they part words as blanks do
        starts, ends, bounds = _pieces(body, offsets)
        if len(special):
            names = np.full(len(starts), -1)
            order = np.argsort(np.concatenate([starts, special[:, 0]]), kind="stable")
            starts, ends, names = (np.concatenate(v)[order] for v in ((starts, special[:, 0]), (ends, special[:, 1]), (names, special[:, 2])))
            bounds = np.searchsorted(starts, offsets, "left")
        if not len(starts):
            for _ in range(len(offsets) - 1):
                yield np.zeros(0, np.uint32)
            continue
        hashes = tx.word_hashes(body, starts, ends)
        if len(special):
            hashes[names >= 0] = names[names >= 0]
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        flat = body.tobytes()
        words = [flat[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(known) > REMEMBERED:
            known.clear()
        own = {at: special_ids[names[k]] for at, k in enumerate(first.tolist()) if names[k] >= 0} if len(special) else {}
        fresh = [w for at, w in enumerate(words) if w not in known and at not in own] if own else [w for w in words if w not in known]
        for at in range(0, len(fresh), 8192):
            _learn(fresh[at : at + 8192], made, last_of_word, kind, known)
        lists = [known[w] if at not in own else np.array([own[at]], kind).tobytes() for at, w in enumerate(words)] if own else [known[w] for w in words]
        size = np.array(list(map(len, lists))) // kind.itemsize
        joined = np.frombuffer(b"".join(lists), kind).astype(np.uint32)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[place]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = joined[np.repeat(begin[place] - to[:-1], n) + np.arange(to[-1])]
        for a, b in zip(to[bounds[:-1]].tolist(), to[bounds[1:]].tolist()):
            yield ids[a:b]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files and returns the manifest, a written table of number, file, n_ids and n_documents."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    end = np.array([end_id], np.uint32)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, name = task.partitionId(), f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
        writer = stream = None
        for batch in it:
            for k, ids in enumerate(encode(batch.column("text"), tokenizer)):
                if writer is None:
                    system, path = locate(folder)
                    system.create_dir(path, recursive=True)
                    stream = system.open_output_stream(f"{path}/{name.rpartition('/')[2]}")
                    writer = Writer(stream)
                writer.add(batch.column("doc_id").slice(k, 1), np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([writer.ids], pa.int64()), pa.array([len(writer.sizes)], pa.int64())], names=["number", "file", "n_ids", "n_documents"])

    return cut_lineage(source.mapInArrow(batches, "number int, file string, n_ids bigint, n_documents bigint"), "manifest")


def read(manifest: DataFrame, doc_kind: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document of the files."""
    # one row per file
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                system, path = locate(batch.column("file")[k].as_py())
                with system.open_input_stream(path) as stream:
                    names, documents = read_file(stream.read())
                counts, sums = [], []
                for ids in documents:
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                start = batch.column("first_id")[k].as_py() + np.cumsum([0, *counts[:-1]])
                for at in range(0, len(counts), 8192):
                    part = slice(at, at + 8192)
                    yield pa.RecordBatch.from_arrays([names.slice(at, 8192), pa.array(start[part], pa.int64()), pa.array(counts[part], pa.int64()), pa.array(sums[part], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.withColumn("first_id", before).select("number", "file", "first_id").repartitionByRange(max(1, manifest.count()), "number")
    return files.mapInArrow(batches, f"doc_id {doc_kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the documents' ids to a fresh folder in the shared one and reads them back."""
    manifest = write(docs, fresh_path(docs.sparkSession, "ids"), tokenizer, end_id)
    return read(manifest, docs.schema["doc_id"].dataType.simpleString())
