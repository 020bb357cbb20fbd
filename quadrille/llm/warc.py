"""WARC archives: a writer in DataFrame functions and a reader that salvages damaged files.

The writer lays each record out as one string and lets Spark's text sink end it with the two
line ends that close a WARC record, so archives of any number are written by the executors
to any store that Spark can write. The reader takes plain archives and archives of one gzip
member per record. When a check fails (version line, headers, length, record end, block or
payload digest), it searches for the next version line or gzip member that starts a valid
record, goes on from there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import warnings
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import materialize, small

#: Payloads shorter than this are stored again rather than referred to.
REVISIT_BYTES = 100
#: Size of an archive that the writer aims at.
ARCHIVE_BYTES = 24 << 20
#: Bytes that a gzip member is fed in, and the content of one, at most.
CHUNK, MEMBER_BYTES = 1 << 16, 1 << 30
RECORD_END = "\r\n\r\n"

_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


# --- reading ----------------------------------------------------------------------------

class Damaged(Exception):
    pass


def _digest_matches(stated: str, data: bytes) -> bool:
    name, _, value = stated.partition(":")
    try:
        digest = hashlib.new(name.strip().lower().replace("-", ""), data)
    except ValueError:
        return True  # an algorithm we cannot check
    value = value.strip()
    return value.lower() == digest.hexdigest() or value.upper() == b32encode(digest.digest()).decode()


def _plain_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record that starts at `at`; raises Damaged."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    start, end = head + 4, head + 4 + int(length)
    if end + 4 > len(data):
        raise Damaged("truncated block")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[start:end]
    if "warc-block-digest" in headers and not _digest_matches(headers["warc-block-digest"], block):
        raise Damaged("block digest differs")
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers and not _digest_matches(headers["warc-payload-digest"], payload_of(headers, block)):
        raise Damaged("payload digest differs")
    return headers, block, end + 4


def payload_of(headers: dict, block: bytes) -> bytes:
    """What follows the HTTP headers of an HTTP block; else the block."""
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at `at`, and where it ends; fed in chunks, so that what follows
    the member is not touched, and given up beyond MEMBER_BYTES."""
    member, view, out, held, place = zlib.decompressobj(31), memoryview(data), [], 0, at
    try:
        while not member.eof and place < len(data):
            chunk = view[place : place + CHUNK]
            place += len(chunk)
            while True:
                out.append(member.decompress(chunk, MEMBER_BYTES + 1 - held))
                held += len(out[-1])
                if held > MEMBER_BYTES:
                    raise Damaged("gzip member too large")
                chunk = member.unconsumed_tail
                if not chunk:
                    break
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not member.eof:
        raise Damaged("truncated gzip member")
    return b"".join(out), place - len(member.unused_data)


def _record(data: bytes, at: int) -> tuple[list[tuple[dict, bytes]], int]:
    """The records of the plain record or gzip member at `at`, and where it ends."""
    if data[at : at + 2] != b"\x1f\x8b":
        headers, block, end = _plain_record(data, at)
        return [(headers, block)], end
    inner, after = _inflated(data, at)
    found, place = [], 0
    while place < len(inner):
        headers, block, place = _plain_record(inner, place)
        found.append((headers, block))
    return found, after


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None, bytes | str]]:
    """('record', start, end, headers, block) and ('gap', start, end, None, reason), in file order.

    Every byte of data lies in exactly one of them.
    """
    at, size = 0, len(data)
    while at < size:
        try:
            found, end = _record(data, at)
        except Damaged as e:
            reason, place = str(e), at + 1
            while (m := _START.search(data, place)) is not None:
                try:
                    _record(data, m.start())
                    break
                except Damaged:
                    place = m.start() + 1
            end = m.start() if m else size
            yield "gap", at, end, None, reason
        else:
            for headers, block in found:
                yield "record", at, end, headers, block
        at = end


_READ = pa.schema(
    [
        ("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
_READ_DDL = "kind string, path string, start long, end long, reason string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                rows, held = [], 0
                for kind, start, end, headers, block in salvage(data):
                    row = {"kind": kind, "path": path, "start": start, "end": end}
                    if headers is None:
                        row["reason"] = block
                    else:
                        body = payload_of(headers, block)
                        row |= {"record_id": headers.get("warc-record-id", "").strip("<>"), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri")}
                        if row["record_type"] == "revisit":
                            row |= {"refers_to": headers.get("warc-refers-to", "").strip("<>"), "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2]}
                            row["payload_bytes"] = int(headers["x-payload-length"]) if headers.get("x-payload-length", "").isdigit() else None
                        else:
                            row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}
                            if with_payload:
                                row["payload"] = body
                                held += len(body)
                    rows.append(row)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record and each gap of the archives at path, read by Spark's binary source.

    kind is 'record' or 'gap'. A gap has the file, its byte range and the reason; a record has
    its id, type, target, digest (hex SHA-256 of what was read; of a revisit, what it states),
    payload size and, if asked for, the payload.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), _READ_DDL)


def log_gaps(read: DataFrame, path: str) -> tuple[int, int]:
    """Writes the gaps of `read`, a written table of what read_warc gives, to path as Parquet, and warns
    of them: (number of gaps, bytes in them). Nothing is written if there is none."""
    gaps = read.where("kind = 'gap'").select("path", "start", "end", "reason")
    n, lost = gaps.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    if n:
        gaps.write.mode("append").parquet(path)
        warnings.warn(f"{n} damaged byte ranges, {lost} bytes, are left out; see {path}", stacklevel=2)
    return n, lost


# --- writing ----------------------------------------------------------------------------

def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row. Of records with equal payloads of at least REVISIT_BYTES,
    the one with the least id is a response and the others revisit it.

    A null payload is empty, a null address is the record's own id, other columns are
    ignored; rows that repeat the least id of their payload are all responses. An empty table
    writes archives without records.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("html"))
    keyed = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    digests = materialize(keyed.select("page_id", "digest", "bytes"), "digests")
    firsts = materialize(
        digests.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts"
    )
    total, rows = digests.agg(F.sum("bytes"), F.count("*")).first()
    per_file = max(1, int(ARCHIVE_BYTES * rows / (total + 600 * rows))) if rows else 1
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    address = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:")), r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )
    (
        keyed.join(small(firsts, 100), "digest", "left")
        .select(head.alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def gzip_members(records: list[bytes]) -> bytes:
    """Whole records (with their ends) as one gzip member each."""
    out = []
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(r) + z.flush())
    return b"".join(out)
