"""WARC archives: records of pages, written and read by Spark, with a reader that goes on behind damage.

Archives are gzip files in which every record is a member of its own. Spark's text writer puts a separator behind
each row; here that is an empty gzip member, so any gzip reader reads the files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from notegraph.operators.materialise import shared_folder

#: Records of an archive at most; a reader holds one archive in memory.
RECORDS_PER_ARCHIVE = 5_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_next = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit holds the HTTP head only; its payload is described by digest and size."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode()]
    head.append(b"WARC-Date: " + date.encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"\s", "%20", url).encode())
    head.append(b"WARC-Payload-Digest: sha1:" + payload_digest(payload).encode())
    head.append(b"X-Payload-Length: %d" % len(payload))
    block = HTTP_HEAD
    if kind == "revisit":
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
    else:
        block += payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record, or (with a reason) a gap of bytes that was set aside. Of what is inside a member, `offset` and `length`
    are the member's, and `inside` counts from the start of what it holds, `size` in its bytes."""

    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes | None = None
    reason: str | None = None
    inside: int | None = None
    size: int | None = None


def parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record that starts at a byte: where it ends, its headers, its payload. ValueError if a check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    payload = data[start:stop]
    if headers.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest[5:] != payload_digest(payload):
        raise ValueError("payload digest differs")
    return stop + 4, headers, payload


def inflate(data: bytes, at: int) -> tuple[int, bytes, str | None]:
    """The gzip member that starts at a byte: where it ends, what it holds, and what is wrong with it, if anything. Of a
    damaged member what came out before the damage is given, and its end is the first byte that was not understood or,
    where only the check sum or the length differs, the byte behind it."""
    engine, out, place = zlib.decompressobj(31), [], at
    while not engine.eof and place < len(data):
        # Smaller steps behind an error, since a step that fails gives nothing of what it had read.
        step = 65536
        while True:
            before = engine.copy()
            try:
                out.append(engine.decompress(data[place : place + step]))
                break
            except zlib.error as error:
                if step == 1:
                    return place, b"".join(out), f"member: {error}"
                engine, step = before, max(1, step // 16)
        place += step
    if not engine.eof:
        return len(data), b"".join(out), "member without end"
    return min(place, len(data)) - len(engine.unused_data), b"".join(out), None


def _records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes | None, str | None]]:
    """Records and gaps of plain bytes: start, end, headers, payload, reason. After a failed check the search goes on one
    byte further for the next version line whose record passes."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            end, headers, payload = parse(data, at)
        except ValueError as error:
            if gap < 0:
                gap, reason = at, str(error)
            following = data.find(VERSION, at + 1)
            at = following if following >= 0 else len(data)
            continue
        if gap >= 0:
            yield gap, at, {}, None, reason
            gap = -1
        yield at, end, headers, payload, None
        at = end
    if gap >= 0:
        yield gap, len(data), {}, None, reason


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive, plain or gzip, in order. After a failed check the search goes on one byte further for
    the next gzip member or version line that passes; what lies between is reported once, as a gap. Of a member, damaged
    or not, all records that pass are given, and what lies between them is a gap inside it; behind a damaged member the
    search goes on where it was last understood. A damaged member without a record is part of the gap around it."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        inside, wrong, following = [], None, len(data)
        if data.startswith(MEMBER, at):
            end, inner, wrong = inflate(data, at)
            parts = list(_records(inner))
            if wrong or any(x[4] for x in parts):
                whole = any(x[4] is None for x in parts)
                wrong = wrong or (None if whole else parts[0][4])
                if wrong:
                    # What was read may hold the start of another member: its bytes are searched too, unless it gave records.
                    hit = _next.search(data, max(at + 1, end) if whole else at + 1)
                    following = hit.start() if hit else len(data)
                    end = following if whole else end
                if not whole:
                    parts = []
                elif wrong:
                    # The rest of a broken member is one gap, its last one.
                    last = parts.pop() if parts[-1][4] else (len(inner), len(inner))
                    parts.append((last[0], len(inner), {}, None, wrong))
            inside = [Found(at, end - at, h, p, why, a, b - a) for a, b, h, p, why in parts]
        else:
            try:
                end, headers, payload = parse(data, at)
                inside = [Found(at, end - at, headers, payload)]
            except ValueError as error:
                wrong = str(error)
                hit = _next.search(data, at + 1)
                following = hit.start() if hit else len(data)
        if wrong and not inside:
            if gap < 0:
                gap, reason = at, wrong
            at = following
            continue
        if gap >= 0:
            yield Found(gap, at - gap, {}, None, reason)
            gap = -1
        yield from inside
        at = end
    if gap >= 0:
        yield Found(gap, len(data) - gap, {}, None, reason)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to. Of equal payloads of at least `min_bytes` bytes the one with the
    largest page_id is the response and the others revisit it; rows that repeat that id are responses too. Null html
    is an empty payload. Payloads are compared by SHA-256; a payload that a third of the pages share is one row on the
    small side of an inner join, whose large side adaptive execution splits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    # A null id takes part as the smallest.
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("same"))
    kept = pages.select("page_id", F.sha2(payload.cast("binary"), 256).alias("same"))
    kept = kept.groupBy("same").agg(F.max("page_id").alias("kept"))
    copy = (F.octet_length("payload") >= min_bytes) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.join(kept, "same").select(
        "page_id", "url", "payload", F.when(copy, "revisit").otherwise("response").alias("record_type"), F.when(copy, F.col("kept")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", most: int = RECORDS_PER_ARCHIVE) -> None:
    """Writes records (see `plan_records`) as archives of at most `most` records. An empty table gives an empty folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to")))
            members = [gzip.compress(record(p, u, x.encode(), k, r, date), 4, mtime=0) for p, u, x, k, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    built = records.mapInArrow(build, "member binary").select(F.col("member").cast("string"))
    writer = built.write.mode("overwrite").option("maxRecordsPerFile", most).option("encoding", "ISO-8859-1")
    writer.option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of all archives in a folder: path, offset, length, reason (null for records), record_id,
    record_type, target_uri, payload_digest, payload_bytes, refers_to, payload (null for gaps and revisits), inside, size (place and bytes within
    what the member at `offset` holds; null outside of members). Empty files give no rows, records without a header that
    names it null there."""

    def recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for x in salvage(content.as_py() or b""):
                    h = x.headers
                    revisit = h.get("warc-type") == "revisit"
                    size = int(h.get("x-payload-length", 0)) if revisit else x.payload and len(x.payload)
                    rows.append(
                        (path, x.offset, x.length, x.reason, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"),
                         h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if x.reason else size or 0,
                         h.get("warc-refers-to"), None if revisit else x.payload, x.inside, x.size)
                    )
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARCHIVE_ROWS)], schema=ARCHIVE_ROWS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARCHIVE_ROWS)], schema=ARCHIVE_ROWS)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(
        recover,
        "path string, offset bigint, length bigint, reason string, record_id string, record_type string, target_uri string, "
        "payload_digest string, payload_bytes bigint, refers_to string, payload binary, inside bigint, size bigint",
    )


_text, _long = pa.string(), pa.int64()
ARCHIVE_ROWS = pa.schema(
    [("path", _text), ("offset", _long), ("length", _long), ("reason", _text), ("record_id", _text), ("record_type", _text),
     ("target_uri", _text), ("payload_digest", _text), ("payload_bytes", _long), ("refers_to", _text), ("payload", pa.binary()), ("inside", _long), ("size", _long)]
)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: `read_archives` of what was written."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages, min_bytes), folder)
    return read_archives(spark, folder)
