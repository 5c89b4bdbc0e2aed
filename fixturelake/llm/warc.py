"""WARC archives: writer with revisit records and a salvage reader.

Writing. Every page becomes a ``response`` record, or a ``revisit`` record if
a page of smaller id has the same payload. Each record is a gzip member of its
own. Spark's text writer puts the members into files in the shared folder; its
line separator is an empty gzip member, so that a file is a plain sequence of
members, written through the job's committer like any other output.

Reading. A file is read member by member (or, if it isn't compressed, record
by record). Each record is checked: version line, headers, declared length,
closing blank lines and payload digest. After a failed check the reader
searches for the next place that opens a valid member or has a version line,
goes on there and logs the bytes between as a quarantined gap, so one damaged
record costs itself only.

Scale: the smallest id of each payload is found with partial aggregation, and
only payloads that occur more than once are kept and stored, so the pages are
joined with a plain stored table: it is broadcast if Spark finds it small, and
otherwise the pages of a hot payload can be split. A file holds at most
``RECORDS_PER_FILE`` records and about ``FILE_BYTES`` bytes, or one record, and is
read by one task; reading and writing need no more memory than one file.

Defined results: a null payload is written as an empty one; a null url is
``urn:page:<id>``; among rows of one payload all rows of the smallest id are
responses; a null id is never smaller than
another and is written as ``<urn:page:>``; control characters in a
url are percent-encoded; an empty table gives an empty archive and no rows;
columns of other names are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import materialise, new_path

RECORDS_PER_FILE, FILE_BYTES = 4_000, 32_000_000
#: Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 4_096
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
REQUIRED = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Write one record per row of pages (page_id, url, html) under path."""
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    again = full.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = full.join(materialise(again.select("sha", "first_id"), "repeated-payloads"), "sha", "left").select("page_id", "url", "html", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["members"])

        for batch in batches:
            for page, url, html, first_id in zip(*batch.columns, strict=True):
                page, first_id, payload = page.as_py(), first_id.as_py(), html.as_py().encode()
                is_revisit = first_id is not None and page != first_id
                record = record_bytes(page, url.as_py(), payload, digest_of(payload), first_id, is_revisit, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                if out and (len(out) == RECORDS_PER_FILE or size + len(member) > FILE_BYTES):
                    yield file()
                    out, size = [], 0
                out.append(member)
                size += len(member)
        if out:
            yield file()

    # A row of members is a file of its own.
    (
        marked.mapInArrow(run, "members binary")
        .select(F.col("members").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


class Found(NamedTuple):
    """A record (problem is None) or a quarantined gap of [start, end)."""

    start: int
    end: int
    problem: str | None
    record_type: str | None = None
    record_id: str | None = None
    refers_to: str | None = None
    uri: str | None = None
    payload: bytes | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None


def _parse(data: bytes, at: int) -> tuple[Found | None, int, str | None]:
    """(record, end, problem) of the uncompressed record that starts at a version line."""
    if not _VERSION.match(data, at):
        return None, at, "no version line"
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        return None, at, "headers do not end"
    head = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "broken header"
        head[name.strip().lower()] = value.strip()
    if not REQUIRED <= head.keys():
        return None, at, "required header missing"
    if not head.get(b"content-length", b"").isdigit():
        return None, at, "no length"
    body += 4
    end = body + int(head[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "length does not fit"
    kind = head.get(b"warc-type", b"").decode("latin-1")
    block, payload, size = data[body:end], None, None
    stated = head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:") or None
    if block.startswith(b"HTTP/"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            return None, at, "HTTP headers do not end"
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
        size = int(length[1]) if length else len(payload)
        if kind == "revisit":
            payload = None
        elif length and size != len(payload):
            return None, at, "payload length does not fit"
    elif kind != "revisit":
        payload, size = block, len(block)
    if payload is not None:
        real = digest_of(payload)
        if stated and stated != real:
            return None, at, "payload digest does not fit"
        stated = real
    text = lambda k: head[k].decode("utf-8", "replace") if k in head else None
    found = Found(at, end + 4, None, kind, text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri"), payload, size, stated)
    return found, end + 4, None


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """(content, end) of the gzip member at a place; None if it is damaged or cut off."""
    reader, view, out = zlib.decompressobj(31), memoryview(data), []
    while at < len(data):
        # In small steps, since what follows the member is copied.
        part = view[at : at + _STEP]
        try:
            out.append(reader.decompress(part))
        except zlib.error:
            return None, at
        at += len(part)
        if reader.eof:
            return b"".join(out), at - len(reader.unused_data)
    return None, at


def salvage(data: bytes) -> Iterator[Found]:
    """Records and quarantined gaps of a whole archive, in order."""
    at, n = 0, len(data)
    gap, why = None, None
    while at < n:
        found, problem, end = [], None, at
        if data.startswith(GZIP_MAGIC, at):
            content, end = _member(data, at)
            if content is None:
                problem = "damaged member"
            else:
                inside = 0
                while inside < len(content) and problem is None:
                    record, inside, problem = _parse(content, inside)
                    if record:
                        found.append(record._replace(start=at, end=end))
        else:
            record, end, problem = _parse(data, at)
            if record:
                found.append(record)
        if problem is None:
            if gap is not None:
                yield Found(gap, at, why)
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, why = at, problem
        at = _next_start(data, at + 1)
    if gap is not None:
        yield Found(gap, n, why)


def _next_start(data: bytes, at: int) -> int:
    """The next place from at with a version line or a member that opens with one; the end if there is none."""
    # Not at line starts only: the bytes before may be cut off. The checks tell text that merely looks like one.
    line = _VERSION.search(data, at)
    text_at = line.start() if line else len(data)
    while True:
        member_at = data.find(GZIP_MAGIC, at, min(len(data), text_at + 2))
        if member_at < 0 or member_at >= text_at:
            return text_at
        try:
            if zlib.decompressobj(31).decompress(memoryview(data)[member_at : member_at + _STEP], 16).startswith(b"WARC/1."):
                return member_at
        except zlib.error:
            pass
        at = member_at + 1


RECORD_SCHEMA = (
    "path string, start long, end long, problem string, record_type string, record_id string, refers_to string, uri string, "
    "payload binary, payload_bytes long, payload_digest string"
)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all files under path; gaps have a problem and no record_type."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = ["start", "end", "problem", "record_type", "record_id", "refers_to", "uri", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.int64()] + [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [x if with_payload else x._replace(payload=None) for x in salvage(content.as_py())]
                columns = [pa.array([getattr(x, f) for x in rows], k) for f, k in zip(fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), *columns], names=["path", *fields])

    return files.mapInArrow(run, RECORD_SCHEMA)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes: path, start, end, problem."""
    return records.where(F.col("problem").isNotNull()).select("path", "start", "end", "problem")


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from the archives written and read back."""
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_archive(spark, path, with_payload=False).where(F.col("problem").isNull())
    number = lambda c: F.nullif(page_of(F.col(c)), F.lit("")).cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
