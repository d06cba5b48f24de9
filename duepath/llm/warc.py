"""Pages in WARC archives: written once per payload, read back record by record.

Writing: every page becomes one record, its payload the html in UTF-8. Pages with equal payloads of at least ``LEAST``
bytes share one response record, that of the largest page_id; the others become revisit records that name it and carry
its digest but no payload. Only one copy of each such payload is shuffled: tasks drop their own repeats first, and
revisits are made from a written table of digests without the html.

File: records, each a gzip member of its own; the first is a warcinfo record. A response's block is an HTTP response
head and the payload; a revisit's block is the head alone, whose Content-Length still is that of the payload. A task
writes under a name of its own attempt and hands over that name, so files of failed or repeated attempts are never read;
the manifest of names is written before files are read.

Reading: a sequential reader inflates a file piece by piece, takes the named fields of a record up to the blank line and
then exactly Content-Length bytes of block, and checks the digests of block and payload and the end of the member. It
holds one piece, and the payload only if asked for it.

Defined cases: null html is an empty payload; pages without an id sort before all others and stay without one; of rows
alike in page_id and url too, one is the response; blanks and control characters of a url are percent-encoded in its
named field, a null url has none; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duepath.llm.files import locate
from duepath.session import cut_lineage, fresh_path

LEAST, PIECE = 1000, 1 << 16
DATE = "1970-01-01T00:00:00Z"  # the pages carry no fetch time
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Malformed(ValueError):
    """An archive that breaks the format, or whose digests don't agree."""


# ---- records -----------------------------------------------------------------------------------------------------


def tagged(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def untagged(text: str) -> str:
    """Bare lower-case hex of a tagged digest."""
    return base64.b32decode(text.removeprefix("sha1:")).hex()


def record_name(row: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"page row {row}").urn


def field_safe(url: str) -> str:
    """A url as the value of a named field: blanks and control characters percent-encoded."""
    return "".join(c if c > " " and not "\x7f" <= c <= "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _uri(name: str, url: str | None) -> list[tuple[str, str]]:
    return [] if url is None else [(name, field_safe(url))]


def _page(name: str, page_id: object) -> list[tuple[str, str]]:
    return [] if page_id is None else [(name, str(page_id))]


def member(fields: list[tuple[str, str]], block: list[bytes]) -> bytes:
    """One record as one gzip member."""
    digest = hashlib.sha1()
    for part in block:
        digest.update(part)
    fields = [*fields, ("WARC-Block-Digest", tagged(digest.digest())), ("Content-Length", str(sum(map(len, block))))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([made.compress(head.encode()), *map(made.compress, block), made.compress(b"\r\n\r\n"), made.flush()])


def page_member(row: int, page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, original: dict | None = None) -> bytes:
    """A response record, or without a payload the revisit of ``original`` (row, page_id, url)."""
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", f"<{record_name(row)}>"), ("WARC-Date", DATE)]
    fields += _uri("WARC-Target-URI", url)
    fields += [("WARC-Payload-Digest", tagged(bytes.fromhex(digest))), ("Content-Type", "application/http; msgtype=response")]
    fields += _page("Page-ID", page_id)
    if payload is None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{record_name(original['row'])}>")]
        fields += _uri("WARC-Refers-To-Target-URI", original["url"])
        fields += _page("Refers-To-Page-ID", original["page_id"])
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return member(fields, [head] if payload is None else [head, payload])


class Reader:
    """The records of one archive in order: (named fields, HTTP fields, payload bytes, payload or None).

    Every record must be a gzip member of its own, end with two line ends and agree with its digests.
    """

    def __init__(self, stream: BinaryIO, payloads: bool = False):
        self.stream, self.payloads, self.rest = stream, payloads, b""

    def __iter__(self) -> Iterator[tuple[dict[str, str], dict[str, str], int, bytes | None]]:
        while self.rest or (more := self.stream.read(PIECE)):
            if not self.rest:
                self.rest = more
            yield self._record()

    def _inflate(self) -> bool:
        """Adds a piece of the member to ``self.have``; False at its end."""
        while not self.inflater.eof:
            raw = self.inflater.unconsumed_tail or self.rest or self.stream.read(PIECE)
            if raw is self.rest:
                self.rest = b""
            if not raw:
                raise Malformed("the file ends inside a record")
            try:
                got = self.inflater.decompress(raw, PIECE)
            except zlib.error as e:
                raise Malformed(str(e)) from e
            if self.inflater.eof:
                self.rest = self.inflater.unused_data + self.rest
            if got:
                self.have += got
                return True
        return False

    def _fields(self, most: int | None = None) -> tuple[str, dict[str, str], int]:
        """First line and fields up to the blank line, and the bytes they took; at most ``most``."""
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if most is not None and len(self.have) >= most or not self._inflate():
                raise Malformed("fields without an end")
        head, self.have = self.have[: end + 4], self.have[end + 4 :]
        lines = head[:-4].decode().split("\r\n")
        return lines[0], {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, len(head)

    def _record(self) -> tuple[dict[str, str], dict[str, str], int, bytes | None]:
        self.inflater, self.have = zlib.decompressobj(31), b""
        version, fields, _ = self._fields()
        if not version.startswith("WARC/1.") or not fields.get("content-length", "").isdigit():
            raise Malformed("no WARC record")
        left, block, payload, size, held, http = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1(), 0, [], {}
        if fields.get("content-type", "").startswith("application/http"):
            while b"\r\n\r\n" not in self.have and len(self.have) < left and self._inflate():
                pass
            before = self.have
            _, http, n = self._fields(left)
            if n > left:
                raise Malformed("the HTTP head is longer than the block")
            block.update(before[:n])
            left -= n
        while left:
            if not self.have and not self._inflate():
                raise Malformed("a block shorter than its Content-Length")
            part, self.have = self.have[:left], self.have[left:]
            left -= len(part)
            size += len(part)
            block.update(part)
            payload.update(part)
            if self.payloads:
                held.append(part)
        while self._inflate():
            if len(self.have) > 4:
                break
        if self.have != b"\r\n\r\n":
            raise Malformed("a record must end after its block with two line ends, and its member with it")
        if "warc-block-digest" in fields and fields["warc-block-digest"] != tagged(block.digest()):
            raise Malformed("block digest")
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != tagged(payload.digest()):
            raise Malformed("payload digest")
        return fields, http, size, b"".join(held) if self.payloads else None


# ---- writing -----------------------------------------------------------------------------------------------------


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.col("page_id"), F.col("url"), payload.alias("payload"))


def plan(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two written tables without payloads: all pages (row, page_id, url, size, digest, same), and the response of each shared payload (same, best)."""
    facts = _payloads(pages).select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same")
    )
    facts = cut_lineage(facts, "pages")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("has_url"), "url", "row")).alias("best")
    return facts, cut_lineage(facts.where(F.col("size") >= least).groupBy("same").agg(best), "responses")


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per record: row, page_id, url, size, digest, payload (null for revisits), original (row, page_id, url of the response)."""
    facts, responses = plan(pages, least)
    none = F.lit(None).cast(T.StructType([T.StructField("row", T.LongType()), T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType())]))
    whole = _payloads(pages).withColumn("size", F.octet_length("payload").cast("long"))
    # the number of a short page's record only has to differ from the others
    short = whole.where(F.col("size") < least).select((-1 - F.monotonically_increasing_id()).alias("row"), "page_id", "url", "size", F.sha1("payload").alias("digest"), "payload", none.alias("original"))
    copies = whole.where(F.col("size") >= least).groupBy(F.sha2("payload", 256).alias("same")).agg(F.first("payload").alias("payload"))
    large = copies.join(responses, "same").select("best.row", "best.page_id", "best.url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), "payload", none.alias("original"))
    again = facts.where(F.col("size") >= least).join(responses, "same").where(F.col("row") != F.col("best.row"))
    again = again.select("row", "page_id", "url", "size", "digest", F.lit(None).cast("binary").alias("payload"), F.struct("best.row", "best.page_id", "best.url").alias("original"))
    return short.unionByName(large).unionByName(again)


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives and returns the manifest, a written table of file and n_records."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stream, n = TaskContext.get(), None, 0
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in it:
            columns = [batch.column(c) for c in ("row", "page_id", "url", "size", "digest", "payload", "original")]
            for k in range(batch.num_rows):
                if stream is None:
                    system, path = locate(folder)
                    system.create_dir(path, recursive=True)
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)  # not by the name
                    stream.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_OID, name).urn}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], [b"format: WARC File Format 1.1\r\n"]))
                stream.write(page_member(*(c[k].as_py() for c in columns)))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return cut_lineage(records(pages, least).mapInArrow(batches, "file string, n_records bigint"), "manifest")


def read(manifest: DataFrame, id_kind: str = "bigint", payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every page record, read one file after another in each task.

    With ``payloads`` also payload, null for revisits.
    """
    convert: Callable[[str | None], object] = (lambda x: x) if id_kind == "string" else (lambda x: None if x is None else int(x))
    schema = f"page_id {id_kind}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_kind}" + ", payload binary" * payloads
    kinds = pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.binary() if f.dataType.typeName() == "binary" else {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in T._parse_datatype_string(schema)])

    def rows(path: str, expected: int) -> Iterator[tuple]:
        system, path = locate(path)
        seen = 0
        with system.open_input_stream(path, compression=None) as stream:
            for fields, http, size, payload in Reader(stream, payloads):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                seen += 1
                full = int(http["content-length"])
                if kind == "response" and full != size:
                    raise Malformed("the payload is not as long as its HTTP head says")
                row = (convert(fields.get("page-id")), fields.get("warc-target-uri"), full, untagged(fields["warc-payload-digest"]), kind, convert(fields.get("refers-to-page-id")))
                yield row + ((payload if kind == "response" else None),) * payloads
        if seen != expected:
            raise Malformed(f"{path} holds {seen} page records instead of {expected}")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, n in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist()):
                held, weight = [], 0
                for row in rows(file, n):
                    held.append(row)
                    weight += 100 + (len(row[-1] or b"") if payloads else 0)
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    # one row per file
    files = manifest.repartitionByRange(max(1, manifest.count()), "file")
    return files.mapInArrow(batches, schema)


def unresolved(pages: DataFrame) -> DataFrame:
    """Revisits of a read archive whose response is missing or has another digest or size."""
    found = pages.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return pages.where("record_type = 'revisit' and refers_to is not null").join(found, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the pages to archives in a fresh folder of the shared one and reads them back."""
    manifest = write(pages, fresh_path(pages.sparkSession, "archive"), least)
    return read(manifest, pages.schema["page_id"].dataType.simpleString())
