"""Web archives (WARC 1.1) with every payload stored once.

Headers are shuffled by payload digest: of the records with one payload that with the smallest
page id is the response, the others become revisits of it. Archives are written by Spark's own
text writer, so they go wherever it can write: one gzip file for each task, which begins with
a ``warcinfo`` record. Reading goes by the lines of each file in order and by the lengths that
the headers state, never by what a payload looks like; revisits are joined to the original
responses by payload digest again. So ``rewritten`` takes archives that hold revisits already,
and gives all their records fresh headers.

Headers of a common payload are counted before their shuffle, and rows with payloads are dealt
by digest and a salt, so a payload that a third of all pages have is spread over ``SALTS`` tasks.
Digests are SHA-1, as is usual; payloads count as equal if another hash and their sizes are, too.

Cases: a null payload is an empty one, which is a payload like any other. A null url gives no
target; control characters and spaces in urls are written as percent codes. Pages without an id
are the last of their payload; where nothing but such pages has it, all of them are responses.
Rows that repeat the smallest id are all responses, as are payloads below the least size. An
empty table gives archives without records. A damaged file gives the records before the damage
and one row with ``error``. Other columns are not read and may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import let
from .storage import Workspace, small_batches

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAGE_ID = "X-Page-Id"
#: Tasks that the rows of one payload are spread over.
SALTS = 16
#: Bytes that the headers of a record have at most; a longer one is damage.
LONGEST_HEAD = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 text of a payload's SHA-1, five bits for each letter."""

    def letters(hex_: Column) -> Column:
        def eight(at: Column) -> Column:
            bits = F.conv(F.substring(hex_, at, F.lit(10)), 16, 10).cast("long")
            one = lambda by: F.substring(F.lit(BASE32), (F.call_function("shiftright", bits, by).bitwiseAND(31) + 1).cast("int"), F.lit(1))
            return F.array_join(F.transform(F.sequence(F.lit(35), F.lit(0), F.lit(-5)), one), "")

        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31), F.lit(10)), eight), "")

    return let(F.sha1(payload), letters)


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` and what is known of the payload, for rows of ``page_id, url, html``."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return _described(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")))


def _described(records: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return records.withColumns({"payload_digest": base32_sha1(payload), "payload_bytes": F.octet_length(payload).cast("long"), "alike": F.xxhash64(payload)})


def _with_group(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with one row for each key; a key's rows are dealt over ``SALTS`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("shuffle_hash"), [*keys, "salt"], "left").drop("salt")


def deduplicated(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``record_type``, ``refers_to`` (the response's page id) and ``refers_to_url`` to described records.

    Payloads with fewer than ``least`` bytes stay as they are.
    """
    keys = ["payload_digest", "payload_bytes", "alike"]
    heads = records.where(F.col("payload_bytes") >= least).select(*keys, "page_id", "url")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = heads.groupBy(*keys).agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    joined = _with_group(records, groups, keys)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    kind = F.when(again, "revisit").otherwise("response")
    return joined.withColumns({"record_type": kind, "refers_to": F.when(again, F.col("first.page_id")), "refers_to_url": F.when(again, F.col("first.url"))}).drop("first")


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A name made of the content, so that a task that runs again writes the same."""
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.concat(F.lit("url:"), url), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _plain(url: Column) -> Column:
    """The url without control characters and spaces, which would break a header."""
    bad = r"[\x00-\x20\x7F]"
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(bad), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(bad), F.array_join(coded, "")).otherwise(url)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, path: str, date: str | None = None) -> None:
    """Writes records with ``record_type`` and ``refers_to`` as gzip archives, with fresh headers; ``date`` is that of the headers, by default now."""
    when = F.lit(date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    digest, revisit = F.col("payload_digest"), F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    original = _record_id(F.col("refers_to"), F.col("refers_to_url"), digest)
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), digest)), _line("WARC-Date", when),
        _line("WARC-Target-URI", _plain(F.col("url"))), _line(PAGE_ID, F.col("page_id").cast("string")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", original), _line("WARC-Refers-To-Target-URI", _plain(F.col("refers_to_url"))), _line("WARC-Refers-To-Date", when))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    about = "software: loomwright\r\nformat: WARC File Format 1.1\r\n"
    info = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: warcinfo\r\n"), _line("WARC-Record-ID", _record_id(F.lit(-1), F.lit(""), F.spark_partition_id().cast("string"))), _line("WARC-Date", when), F.lit(f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    # The writer ends each row with the second of the two line ends after a record.
    whole = let(body, lambda b: F.concat(F.when(F.col("is_first"), F.col("info")).otherwise(""), F.col("head"), _line("Content-Length", F.octet_length(b).cast("string")), F.lit("\r\n"), b, F.lit("\r\n")))
    rows = records.withColumns({"is_first": first, "info": info, "head": head}).select(whole.alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


RECORD = "record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, alike_sha256 string, payload binary, error string"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())


class _Archive:
    """Reads one archive as it comes and holds no more than the record that isn't complete."""

    def __init__(self, with_payload: bool):
        self.with_payload = with_payload
        self.chunks: list[bytes] = []
        self.size = self.need = 0
        self.dead = False

    def feed(self, data: bytes) -> Iterator[tuple]:
        if self.dead:
            return
        self.chunks.append(data)
        self.size += len(data)
        if self.size < self.need:
            return
        raw, at = b"".join(self.chunks), 0
        self.need = 0
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at, at + LONGEST_HEAD)
            if end < 0:
                if not raw.startswith(b"WARC/1."[: len(raw) - at], at) or len(raw) - at >= LONGEST_HEAD:
                    yield self._damage("a record without headers")
                    return
                break
            lines = raw[at:end].split(b"\r\n")
            fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(b":") for x in lines[1:])}
            size = fields.get(b"content-length", b"")
            if not lines[0].startswith(b"WARC/1.") or not size.isdigit():
                yield self._damage("no version or no length")
                return
            begin, stop = end + 4, end + 4 + int(size)
            if stop + 4 > len(raw):
                self.need = stop + 4 - at
                break
            if raw[stop : stop + 4] != b"\r\n\r\n":
                yield self._damage("a record that ends before or after its length")
                return
            yield self._row(fields, raw[begin:stop])
            at = stop + 4
        self.chunks, self.size = ([raw[at:]], len(raw) - at) if at < len(raw) else ([], 0)

    def close(self) -> Iterator[tuple]:
        if self.size and not self.dead:
            yield self._damage("the last record isn't complete")

    def _damage(self, why: str) -> tuple:
        self.dead, self.chunks, self.size = True, [], 0
        return (*(None for _ in _NAMES[:-1]), why)

    def _row(self, fields: dict[bytes, bytes], block: bytes) -> tuple:
        text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
        kind, page = text(b"warc-type"), text(PAGE_ID.lower().encode())
        page_id = int(page) if page and re.fullmatch(r"-?[0-9]{1,18}", page) else None
        stated = (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None
        record = (kind, text(b"warc-record-id"), page_id, text(b"warc-target-uri"))
        http, payload = b"", block
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
            return (*record, stated, int(size[1]) if size else None, None, None, None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        error = "the payload isn't what its digest says" if kind == "response" and stated not in (None, digest) else None
        return (*record, digest, len(payload), hashlib.sha256(payload).hexdigest(), payload if self.with_payload else None, error)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of gzip archives; the payload's digest and size are those of what is stored, for revisits those that they state.

    A file is read by one task, as a stream; ``warcinfo`` records are rows as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, file = _Archive(with_payload), None

        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _KINDS)], _NAMES)

        for batch in batches:
            files, lines = batch.column("file").to_pylist(), batch.column("line").to_pylist()
            rows: list[tuple] = []
            at = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                if files[at] != file:
                    rows += archive.close()
                    archive, file = _Archive(with_payload), files[at]
                rows += archive.feed(b"\n".join(lines[at:to]) + b"\n")
                at = to
            yield from told(rows)
        yield from told(list(archive.close()))

    lines = spark.read.option("lineSep", "\n").text(path)
    return small_batches(lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))).mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits, these with ``refers_to, refers_to_url`` and the size of the original response of their digest.

    The original is the response with the smallest page id, then url. A revisit without one keeps its own size and refers to nothing.
    """
    revisits, responses = (records.where(F.col("record_type") == kind) for kind in ("revisit", "response"))
    wanted = revisits.select("payload_digest").distinct()
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url", F.col("payload_bytes").alias("size"), F.col("alike_sha256").alias("same")))
    originals = responses.where("error IS NULL").groupBy("payload_digest").agg(first.alias("first")).join(wanted, "payload_digest", "left_semi")
    found = _with_group(revisits, originals, ["payload_digest"])
    joined = found.withColumns({"payload_bytes": F.coalesce("first.size", "payload_bytes"), "alike_sha256": F.col("first.same"), "refers_to": F.col("first.page_id"), "refers_to_url": F.col("first.url")}).drop("first")
    own = responses.withColumns({"refers_to": F.lit(None).cast("long"), "refers_to_url": F.lit(None).cast("string")})
    return own.unionByName(joined)


def rewritten(spark: SparkSession, source: str, target: str, least: int = 0) -> None:
    """Archives with every payload of ``source`` stored once, all records with fresh headers.

    Revisits without an original in ``source`` stay revisits that refer to nothing, of the size that they state, if any. Records of other kinds are left out.
    """
    known = resolved(read_archives(spark, source)).withColumn("alike", F.xxhash64("alike_sha256"))
    stored = known.where("record_type = 'response' AND error IS NULL").drop("refers_to", "refers_to_url", "record_type")
    revisits = known.where("record_type = 'revisit'")
    write_archives(deduplicated(stored, least).unionByName(revisits.select(*deduplicated(stored, least).columns)), target)


def digest(pages: DataFrame) -> DataFrame:
    """One row for each page, as the archives say that were written of them and read back."""
    spark = pages.sparkSession
    path = f"{Workspace(spark).path}/archives"
    write_archives(deduplicated(page_records(pages)), path)
    return resolved(read_archives(spark, path, with_payload=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
