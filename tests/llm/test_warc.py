"""Archives: what is written is read back, byte by byte, and every payload is stored once."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from loomwright.llm import queries, warc


def sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


TRAP = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/x y\r\nWARC-Type: revisit", TRAP), (6, "http://a/6", TRAP),
    (7, "é", "\r\n\r\nline\n\n\r"), (8, "u", "é🙂" * 50_000), (9, "v", "é🙂" * 50_000), (None, "w", "<p>one</p>"), (None, "z", "nobody"), (None, "z", "nobody"), (10, "t", "tie"), (10, "t", "tie"), (11, "t", "tie"), (-5, "n", "nul\x00byte"),
]


def expected(rows, least=0):
    first: dict[bytes, int | None] = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None and first.get(raw) is None or raw not in first:
            first[raw] = page
        elif page is not None:
            first[raw] = min(first[raw], page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        one = first[raw] is None or page == first[raw] or len(raw) < least
        out.append((page, len(raw), sha1(raw), "response" if one else "revisit", None if one else first[raw]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, record_type string")


@pytest.mark.parametrize("least", [0, 8])
def test_pages_by_brute_force(spark, tmp_path, least):
    warc.write_archives(warc.deduplicated(warc.page_records(frame(spark, PAGES)), least), f"{tmp_path}/a")
    got = warc.resolved(warc.read_archives(spark, f"{tmp_path}/a")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == expected(PAGES, least)


def test_query_and_empty_table(spark, tmp_path):
    frame(spark, PAGES).write.parquet(f"{tmp_path}/full/pages.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert sorted(map(tuple, queries.op11_warc(spark, f"{tmp_path}/full").collect()), key=repr) == expected(PAGES)
    assert queries.op11_warc(spark, f"{tmp_path}/none").collect() == []


def test_files_follow_the_format(spark, tmp_path):
    """A plain reader that knows nothing of ours finds the same records; each file begins with its warcinfo record."""
    warc.write_archives(warc.deduplicated(warc.page_records(frame(spark, PAGES))), f"{tmp_path}/a", "2020-01-02T03:04:05Z")
    stored, revisits, ids = [], [], set()
    for name in glob.glob(f"{tmp_path}/a/*.gz"):
        raw = gzip.open(name).read()
        assert not raw or raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            block, raw = rest[:size], rest[size + 4 :]
            assert rest[size : size + 4] == b"\r\n\r\n" and fields[b"WARC-Date"] == b"2020-01-02T03:04:05Z"
            if fields[b"WARC-Type"] == b"response":
                stored.append(block.partition(b"\r\n\r\n")[2])
                ids.add(fields[b"WARC-Record-ID"])
                assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + sha1(stored[-1])
            elif fields[b"WARC-Type"] == b"revisit":
                revisits.append(fields[b"WARC-Refers-To"])
                assert block.endswith(b"\r\n\r\n") and fields[b"WARC-Profile"].endswith(b"identical-payload-digest")
    assert len(stored) == sum(r[3] == "response" for r in expected(PAGES)) and len(revisits) == sum(r[3] == "revisit" for r in expected(PAGES))
    assert set(revisits) <= ids


def test_payloads_that_are_no_text(spark, tmp_path):
    raw = bytes(range(256)) * 3
    records = warc._described(spark.createDataFrame([(1, "a", bytearray(raw)), (2, "b", bytearray(raw))], "page_id long, url string, payload binary"))
    warc.write_archives(warc.deduplicated(records), f"{tmp_path}/a")
    got = {r["page_id"]: r for r in warc.read_archives(spark, f"{tmp_path}/a").where("page_id IS NOT NULL").collect()}
    assert bytes(got[1]["payload"]) == raw and got[2]["payload"] is None and got[2]["payload_digest"] == sha1(raw)


def record(kind: str, page: int, payload: bytes | None, digest: str, url: str = "http://s/") -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + (payload or b"")
    return (f"WARC/1.0\r\nwarc-type: {kind}\r\nX-Page-Id: {page}\r\nWARC-Target-URI: {url}{page}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_revisits_of_other_archives_are_resolved(spark, tmp_path):
    """Archives with revisits, of one another's responses too, one of something unknown, and one file that is cut off."""
    one, two = b"first payload", b"second\nWARC/1.0\r\n"
    files = {
        "a": record("response", 5, one, sha1(one)) + record("revisit", 6, None, sha1(two)) + record("metadata", 1, b"x", sha1(b"x")),
        "b": record("response", 3, two, sha1(two)) + record("response", 9, one, sha1(one)) + record("revisit", 2, None, sha1(b"unknown")),
        "c": record("response", 12, b"last", sha1(b"last")) + record("response", 13, b"cut off", sha1(b"cut off"))[:-9],
        "d": record("response", 14, b"not what it says", sha1(b"other")),
    }
    (tmp_path / "in").mkdir()
    for name, raw in files.items():
        half = raw.index(b"WARC/1.0", 1) if raw.count(b"warc-type") > 1 else len(raw)
        (tmp_path / "in" / f"{name}.warc.gz").write_bytes(gzip.compress(raw[:half]) + (gzip.compress(raw[half:]) if raw[half:] else b""))
    read = warc.read_archives(spark, f"{tmp_path}/in")
    assert sorted(r["error"] for r in read.where("error IS NOT NULL").collect()) == ["the last record isn't complete", "the payload isn't what its digest says"]
    warc.rewritten(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    got = warc.resolved(warc.read_archives(spark, f"{tmp_path}/out")).select("page_id", "record_type", "refers_to", "payload_digest", F.col("payload").cast("string")).collect()
    assert sorted(map(tuple, got)) == [
        (2, "revisit", None, sha1(b"unknown"), None), (3, "response", None, sha1(two), two.decode()), (5, "response", None, sha1(one), one.decode()),
        (6, "revisit", 3, sha1(two), None), (9, "revisit", 5, sha1(one), None), (12, "response", None, sha1(b"last"), "last"),
    ]
