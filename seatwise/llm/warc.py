"""WARC archives with segmented records: writing pages, reading archives, reassembling segments.

A page becomes an HTTP response with chunked transfer framing. A block longer than one segment is cut: the
first record keeps the headers, the rest are continuation records that name the first by its identifier
and carry their number, the last also the total length. Reading parses each file in a stream, groups the
segments of a record by origin identifier, orders them by number, verifies that they are all there and
of the stated total length, and decodes the chunked framing. Of records with equal payloads, all but
one are written as revisits, without payload.

Spark writes the archives, as gzip text whose rows are whole records, and reads them as binary files. A
file holds a bounded number of records of a bounded length, so a task's memory is bounded too.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm.common import least_row, lookup, row_ids, scratch_path, stage

VERSION = b"WARC/1.1"
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 2048
DATE = "2024-01-01T00:00:00Z"

#: Compressed bytes that are opened at once.
READ_BYTES = 1 << 20

_RECORD = ("record_id string, origin_id string, segment int, total long, type string, page_id long, uri string, "
           "digest string, payload_length long, refers_to long, block binary")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for at in range(0, len(payload), size) if (part := payload[at:at + size])]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at:at + n])
        at += n + 2


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response with chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record without its last line end, which the writer of lines adds."""
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def _records(page_id: int | None, name: str, url: str | None, payload: bytes, digest: str, refers_to: int | None,
             first: str | None, segment_bytes: int) -> Iterator[bytes]:
    uri = None if url is None else "".join(url.split("\r")).replace("\n", "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
    own = f"<urn:page:{name}>"
    if first is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common,
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      ("WARC-Refers-To", f"<urn:page:{first}>"), ("Refers-To-Page-ID", refers_to)], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common,
                  ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{n}>"), ("WARC-Date", DATE),
                      ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
                      ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of ``page_id, url, html`` under ``path``.

    The payload is the html in UTF-8, null empty. Of payloads that are equal and have ``least_bytes`` or
    more, the row with the smallest page_id (nulls last; one of the rows that repeat it) is written as a
    response and the others as revisits of it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = row_ids(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                payload.alias("payload")))
    rows = stage(rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload")), "payloads", "zstd")
    firsts = (rows.filter(F.col("size") >= least_bytes).groupBy("sha", "size")
              .agg(least_row("page_id", "_row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    rows = lookup(rows, firsts, ["sha", "size"], F.col("_row"))
    name, first = uuid.uuid4().hex[:8], F.col("first")
    revisit = first.isNotNull() & (first["_row"] != F.col("_row"))
    rows = rows.select("page_id", "_row", "url", "payload", F.when(revisit, first["page_id"]).alias("refers_to"),
                       F.when(revisit, first["_row"]).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for page, row, url, payload, refers_to, first in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    out += _records(page, f"{name}-{row}", url, payload, base32_sha1(payload), refers_to,
                                    None if first is None else f"{name}-{first}", segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse(read: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record in a stream of bytes."""
    buffer = b""

    def more(n: int) -> None:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < n:
            part = next(read, None)
            if part is None:
                break
            parts.append(part)
            have += len(part)
        buffer = b"".join(parts)

    while True:
        more(1)
        buffer = buffer.lstrip(b"\r\n")
        if not buffer:
            more(1)
            if not buffer.strip(b"\r\n"):
                return
            continue
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            had = len(buffer)
            more(had + 1)
            if len(buffer) == had:
                raise ValueError("an archive ends within a header")
        lines = buffer[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        more(end + 4 + n)
        if len(buffer) < end + 4 + n:
            raise ValueError("an archive ends within a block")
        yield fields, buffer[end + 4:end + 4 + n]
        buffer = buffer[end + 4 + n:]


def _opened(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, plain or of any number of gzip members, a part at a time."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        gz = zlib.decompressobj(31)
        while data and not gz.eof:
            yield gz.decompress(data, READ_BYTES)
            data = gz.unconsumed_tail or (gz.unused_data if gz.eof else b"")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, segments apart."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                 pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, block in parse(_opened(content.as_py())):
                    digest = f.get("warc-payload-digest")
                    out.append((f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]),
                                number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f["warc-type"],
                                number(f.get("page-id")), f.get("warc-target-uri"), digest and digest.removeprefix("sha1:"),
                                number(f.get("payload-length")), number(f.get("refers-to-page-id")), block))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return files.mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: the segments of an origin joined in order, where numbers and total length agree.

    Adds ``complete``: false where a segment is missing or repeated or the total length differs; the block
    of such a record is null. Continuations without a first record have type null.
    """
    whole = records.filter("segment IS NULL").withColumn("complete", F.lit(True))
    part = F.sort_array(F.collect_list(F.struct("segment", "block")))
    head = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    own = ["type", "page_id", "uri", "digest", "payload_length", "refers_to"]
    cut = (records.filter("segment IS NOT NULL").groupBy("origin_id")
           .agg(*[head(c) for c in own], part.alias("parts"), F.max("total").alias("total"), F.max("segment").alias("segments")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["block"]))
    in_order = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.col("segments"))
    cut = cut.withColumn("block", joined).withColumn(
        "complete", F.coalesce(in_order & (F.length("block") == F.col("total")), F.lit(False)))
    cut = cut.withColumn("block", F.when(F.col("complete"), F.col("block")))
    names = ["origin_id", *own, "block", "complete"]
    return whole.select(*names).unionByName(cut.select(*names))


def payloads(records: DataFrame) -> DataFrame:
    """``page_id, uri, payload, payload_bytes, payload_digest, record_type, refers_to, intact`` per whole record.

    A revisit has no payload of its own: its length and digest are its header's. ``intact`` is whether a
    response's payload has the digest of its header.
    """
    rows = records.select("page_id", "uri", "type", "digest", "payload_length", "refers_to", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, uri, kind, digest, length, refers_to, block in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload_of(block) if kind != "revisit" and block is not None else None
                if payload is None:
                    out.append((page, uri, None, length, digest, kind, refers_to, kind == "revisit"))
                else:
                    own = base32_sha1(payload)
                    out.append((page, uri, payload, len(payload), own, kind, None, own == digest))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                ["page_id", "uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    return rows.mapInArrow(run, "page_id long, uri string, payload binary, payload_bytes long, payload_digest string, "
                                "record_type string, refers_to long, intact boolean")


def round_trip(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; an empty table gives an empty result."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, least_bytes, segment_bytes)
    return payloads(reassemble(read_records(spark, path)))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p),
n AS (
  SELECT *, [16 * position(substr(h, 1 + i * 5 // 4, 1) in '0123456789abcdef') - 17
             + position(substr(h, 2 + i * 5 // 4, 1) in '0123456789abcdef') for i in range(32)] AS pairs FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((pairs[i + 1] >> CAST(3 - i % 4 AS INT)) & 31), 1)
                        for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""
