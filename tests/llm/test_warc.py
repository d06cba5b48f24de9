"""Archives: exact round trip, revisits, and broken files."""

import gzip
import hashlib
import io

import pytest

from duepath.llm import warc

SCHEMA = "page_id long, url string, html string, row string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def expected(rows):
    body = lambda html: (html or "").encode()
    best = {}
    for k, (page_id, url, html) in enumerate(rows):
        if len(body(html)) >= 1000:
            order = (page_id is not None, page_id or 0)
            if body(html) not in best or order > best[body(html)][0]:
                best[body(html)] = (order, k)
    out = []
    for k, (page_id, url, html) in enumerate(rows):
        own = best.get(body(html), (None, k))[1] == k
        out.append((page_id, len(body(html)), hashlib.sha1(body(html)).hexdigest(), "response" if own else "revisit", None if own else rows[best[body(html)][1]][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ROWS = [(i, f"http://a.example/{i}", ["short", "x" * 1000, "é" * 499 + "a", "é" * 500, None, "", "p" * 300_000][i % 7]) for i in range(60)]
ROWS += [(70, "http://a.example/a b\r\nWARC-Type: fake\tc", "y" * 1500), (71, None, "y" * 1500), (None, None, "z" * 2000), (None, None, "z" * 2000), (72, "u", "line\r\n\r\nWARC/1.1\r\n" * 200), (-5, "über", "y" * 1500)]
ROWS += [(80, "same", "w" * 1200)] * 4


def test_round_trip(spark):
    got = warc.round_trip(pages_of(spark, ROWS).repartition(5))
    assert rows_of(got) == expected(ROWS)
    assert warc.unresolved(got).count() == 0
    assert got.where("page_id = 70").first().url == "http://a.example/a%20b%0D%0AWARC-Type:%20fake%09c"


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_payloads_come_back(spark, tmp_path):
    manifest = warc.write(pages_of(spark, ROWS), str(tmp_path / "archive"))
    back = {r.page_id: bytes(r.payload) for r in warc.read(manifest, payloads=True).where("record_type = 'response' and page_id is not null").collect()}
    by_id = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert back and all(by_id[k] == v for k, v in back.items())
    # every record is a member of its own, and any gzip reader gets the same stream
    raw = (tmp_path / "archive").glob("*.warc.gz").__next__().read_bytes()
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def record(payload=b"hello" * 50):
    return warc.page_member(3, 9, "http://a.example", len(payload), hashlib.sha1(payload).hexdigest(), payload)


def test_reader_takes_pieces_of_any_size(monkeypatch):
    payload = bytes(range(256)) * 400
    for piece in (1, 7, 100_000):
        monkeypatch.setattr(warc, "PIECE", piece)
        fields, http, size, body = next(iter(warc.Reader(io.BytesIO(record(payload)[:]), payloads=True)))
        assert (fields["page-id"], http["content-length"], size, body) == ("9", str(len(payload)), len(payload), payload)


def changed(**what):
    """The same record with some text replaced, compressed again."""
    raw = gzip.decompress(record())
    for old, new in what.items():
        raw = raw.replace(old.encode(), new.encode())
    return gzip.compress(raw)


@pytest.mark.parametrize(
    "raw",
    [
        record()[:-9],
        gzip.compress(gzip.decompress(record())[:-2]),
        gzip.compress(gzip.decompress(record()) + b"x"),
        gzip.compress(gzip.decompress(record()) * 2),
        changed(hello="jello"),
        gzip.compress(gzip.decompress(record()).replace(b"Content-Length: 3", b"Content-Length: 2", 1)),
        gzip.compress(b"no record\r\n\r\n"),
        b"plain text",
        gzip.compress(b"WARC/1.1\r\nContent-Length: 5"),
    ],
    ids=["cut", "no end", "trailing", "two in one member", "digest", "length", "no version", "no gzip", "no blank line"],
)
def test_broken_records_are_refused(raw):
    with pytest.raises(warc.Malformed):
        list(warc.Reader(io.BytesIO(raw)))
