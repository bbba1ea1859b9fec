"""WARC archives: a writer of gzip members, one for each record, and a splittable reader.

The reader deals byte ranges of the archives out to tasks. A task scans its range for the gzip
magic, takes a candidate for a member only if it inflates to a WARC version line with whole
headers of any length, and owns the records that start inside its range; the last of them may reach beyond it.

Cases at the edge: null html is an empty payload; a null url gives a target made of the id; rows
with a null page_id are responses; rows that share the smallest page_id of a payload are all
responses; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the formats.
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
#: So many bytes of a candidate are at hand when its first inflated bytes are looked at.
PROBE_BYTES = 64 << 10


# ---- files: local ones directly, all others by their scheme


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem | None, str]:
    if re.match("[a-z][a-z0-9+.-]*:/", uri) and not uri.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(uri)
    return None, re.sub("^file:/+", "/", uri)


def open_write(uri: str) -> BinaryIO:
    fs, path = _filesystem(uri)
    if fs:
        return fs.open_output_stream(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")


def open_read(uri: str) -> BinaryIO:
    fs, path = _filesystem(uri)
    return fs.open_input_file(path) if fs else open(path, "rb")


# ---- records


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page_id}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its HTTP head and payload, or a revisit with the head alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    data = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def parse_headers(data: bytes) -> dict[str, str] | None:
    """The headers of an inflated record's start; None if it is not one, or they do not end in it."""
    if not data.startswith(VERSION[:5]) or (end := data.find(b"\r\n\r\n")) < 0:
        return None
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return headers if headers.get("content-length", "").isdigit() and "warc-type" in headers else None


def _may_be_member(data: bytes, at: int) -> bool:
    """False if what starts there is no gzip member or does not inflate to the start of a WARC version line."""
    z, mark = zlib.decompressobj(31), VERSION[:5]
    try:
        start = z.decompress(data[at : at + PROBE_BYTES], len(mark))
    except zlib.error:
        return False
    return mark.startswith(start) and not (z.eof and start != mark)


def records_in(f: BinaryIO, start: int, end: int) -> Iterator[Record]:
    """Records whose first byte is in [start, end). Reads on beyond the end only to finish the last one."""
    f.seek(start)
    base, data, at = start, b"", start  # data is what was read from base on; at is where the search stands

    def more() -> bool:
        nonlocal base, data
        piece = f.read(READ_BYTES)
        data, base = data[at - base :] + piece, at
        return bool(piece)

    while at < end:
        found = data.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(data) - len(MAGIC) + 1)
            if not more():
                return
            continue
        at = base + found
        if at >= end:
            return
        while len(data) - (at - base) < PROBE_BYTES and more():
            pass
        if not _may_be_member(data, at - base):
            at += 1
            continue
        z, parts, piece = zlib.decompressobj(31), [], data[at - base :]
        try:
            while piece and not z.eof:
                parts.append(z.decompress(piece))
                piece = b"" if z.eof else f.read(READ_BYTES)
        except zlib.error:  # damaged: not a record
            parts = []
        whole = b"".join(parts)
        headers = parse_headers(whole)
        if headers is None:
            at += 1
            f.seek(at)
            base, data = at, b""
            continue
        if not z.eof:
            return  # the archive breaks off inside this record
        skip = whole.find(b"\r\n\r\n") + 4
        yield Record(at, headers, whole[skip : skip + int(headers["content-length"])])
        data = z.unused_data
        base = at = f.tell() - len(data)


# ---- on Spark


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload, refers_to): of equal payloads the smallest page_id stands, others refer to it."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("page_id").alias("n")).where("n > 1").select("digest", "first_id")
    first = common.checked(common.written(first, "repeated"))  # payloads travel only where this table is too large
    refers = F.when((F.length("payload") >= min_bytes) & (F.col("page_id") > F.col("first_id")), F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write one archive for each partition; returns the manifest (path, n_bytes, n_records).

    An attempt writes a file of its own name, and only the manifest rows of the attempts that Spark
    takes name files, so a task that runs twice leaves no record twice.
    """
    common.small_batches(pages.sparkSession)
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            f = f or open_write(path)
            for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = record_bytes(page_id, url, payload, refers)
                f.write(data)
                size, n = size + len(data), n + 1
        if f:
            f.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_bytes": size, "n_records": n}], schema=schema)

    manifest = with_originals(pages, min_bytes).mapInArrow(run, "path string, n_bytes bigint, n_records bigint")
    return common.written(manifest, "manifest")


def splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, end): byte ranges of the archives, whatever the places of their records."""
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes)))
    return manifest.select("path", "n_bytes", cut.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "n_bytes").alias("end"))


def read_archives(ranges: DataFrame, tasks: int) -> DataFrame:
    """The records of byte ranges: offset, type, id, target, what it refers to, digest and payload."""
    fields = [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(fields)

    def row(path: str, r: Record) -> dict:
        h = r.headers
        said = re.search(rb"(?im)^content-length: *([0-9]+)", r.block.partition(b"\r\n\r\n")[0])
        whole = h["warc-type"] == "response"
        return {
            "path": path, "offset": r.offset, "record_type": h["warc-type"], "record_id": h.get("warc-record-id", "").strip("<>"), "target": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": digest32(r.payload) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(r.payload) if whole else int(said[1]) if said else None, "payload": r.payload if whole else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                with open_read(path) as f:
                    held, size = [], 0
                    for r in records_in(f, start, end):
                        held.append(row(path, r))
                        size += len(r.block)
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.repartition(tasks).mapInArrow(run, ", ".join(f"`{n}` {'bigint' if t == pa.int64() else str(t)}" for n, t in fields))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    ranges = splits(manifest)
    tasks = max(1, ranges.count())
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    read = read_archives(ranges, tasks).select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
    return checked_count(common.written(read, "records"), manifest)


def checked_count(read: DataFrame, manifest: DataFrame) -> DataFrame:
    """What was read, if it has as many rows as the manifest has records."""
    wrote, found = manifest.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0], read.count()
    if wrote != found:
        raise ValueError(f"{found} records were read of {wrote} in the archives")
    return read


_CHUNK = "('0x' || substr(h, {0}, 5))::BIGINT"
_SYMBOLS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_CHUNK.format(5 * i + 1)} >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_SYMBOLS} AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p
"""
