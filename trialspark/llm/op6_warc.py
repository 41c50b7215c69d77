"""WARC archives: written from pages, read back, and assembled to one nested row per capture.

A capture is three records: the request, the response (or the revisit of another response with the same payload),
and metadata. Request and metadata name the capture in WARC-Concurrent-To; `captures` joins the three through it.

Archives are WARC 1.1 files of one gzip member a record, written by Spark's text sink into the shared folder, and read
as binary files, parsed record by record as they unpack. The sink's rows are runs of members of about MEMBER_RUN bytes,
whose last byte, always zero, the sink adds as its line end; a file has FILE_RUNS rows, and a larger record counts as
several, so a file holds no more than that and one record.

Rows: a null payload is empty. Of equal payloads the capture with the largest page_id is the response, others revisit
it; a row without a page_id is always a response and nothing refers to it. Rows that repeat page_id, url and payload
are one capture. Null urls become empty ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import save, shared_dir, table

ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS response FROM p GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha1(p.html), 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1), '' ORDER BY k)
   FROM range(32) AS r(k)) AS payload_digest,
  CASE WHEN p.page_id = g.response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> g.response THEN g.response END AS refers_to
FROM p JOIN g ON p.html = g.html
"""

#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
#: Bytes of a row of the sink, and rows of a file.
MEMBER_RUN, FILE_RUNS = 1 << 20, 64
#: A member of no bytes. It ends, as every member of under 16 MB does, with a zero.
NOTHING = gzip.compress(b"", mtime=0)
#: All records carry this date: pages have none.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, salt: Column, kind: str) -> Column:
    """A UUID (version 8) that holds the page_id."""
    own, rest = F.lpad(F.hex(F.coalesce(page_id.cast("long"), F.lit(0))), 16, "0"), F.md5(F.concat(salt, F.lit(kind)))
    parts = [own.substr(1, 8), F.lit("-"), own.substr(9, 4), F.lit("-8"), own.substr(13, 3), F.lit("-8"), own.substr(16, 1), rest.substr(1, 2), F.lit("-"), rest.substr(3, 12)]
    return F.lower(F.concat(F.lit("<urn:uuid:"), *parts, F.lit(">")))


def page_of(record_id: Column) -> Column:
    """The page_id in a record id."""
    at = len("<urn:uuid:")
    digits = F.concat(record_id.substr(at + 1, 8), record_id.substr(at + 10, 4), record_id.substr(at + 16, 3), record_id.substr(at + 21, 1))
    return F.conv(digits, 16, -10).cast("long")


def _record(kind: str | Column, own: Column, block: Column, content_type: str, *fields: tuple[str, Column]) -> Column:
    parts = [F.lit(f"{VERSION}{LINE}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{LINE}WARC-Record-ID: "), own, F.lit(f"{LINE}WARC-Date: {DATE}{LINE}Content-Type: {content_type}{LINE}")]
    for name, value in fields:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(LINE))).otherwise(""))
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(LINE + LINE), block]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write request, response or revisit, and metadata of every page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).withColumn("salt", F.concat_ws(" ", "url", "digest", F.col("page").isNull().cast("string")))
    shared = (
        rows.where("page IS NOT NULL").groupBy("digest")
        .agg(F.max(F.struct("page", "url", "salt")).alias("of"), F.count("*").alias("n")).where("n > 1").select("digest", "of")
    )
    shared = save(shared, "op6-shared")
    rows = rows.join(shared, "digest", "left")
    again = F.col("of").isNotNull() & F.col("page").isNotNull() & (F.col("page") != F.col("of.page"))
    capture = _record_id(F.col("page"), F.col("salt"), "response")
    target = F.nullif(F.col("url"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.octet_length("body").cast("string"), F.lit(LINE + LINE))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = _record("request", _record_id(F.col("page"), F.col("salt"), "request"), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{LINE}Host: "), host, F.lit(LINE + LINE)), "application/http; msgtype=request", ("WARC-Target-URI", target), ("WARC-Concurrent-To", capture))
    response = _record(
        F.when(again, "revisit").otherwise("response"), capture, F.when(again, head).otherwise(F.concat(head, F.col("body"))), "application/http; msgtype=response",
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, SAME_PAYLOAD)), ("WARC-Refers-To", F.when(again, _record_id(F.col("of.page"), F.col("of.salt"), "response"))),
        ("WARC-Refers-To-Target-URI", F.when(again, F.nullif(F.col("of.url"), F.lit("")))),
    )
    metadata = _record("metadata", _record_id(F.col("page"), F.col("salt"), "metadata"), F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit(LINE))), "application/warc-fields", ("WARC-Target-URI", target), ("WARC-Concurrent-To", capture))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.mapInArrow(_members, "value string").write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RUNS).text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of gzip members without their last zero byte, as strings that are no text."""

    def rows(runs: list[bytes]) -> pa.RecordBatch:
        column = pa.array(runs, pa.binary())
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(column), *column.buffers()[1:])], ["value"])

    def held(run: bytearray) -> pa.RecordBatch:
        more = min(-(-len(run) // MEMBER_RUN), FILE_RUNS) - 1
        return rows([bytes(run[:-1])] + [NOTHING[:-1]] * more)

    run = bytearray()
    for batch in batches:
        for record in batch.column("value"):
            member = gzip.compress(record.as_buffer().to_pybytes() + 2 * LINE.encode(), mtime=0)
            member = member if not member[-1] else member + NOTHING
            if run and len(run) + len(member) > MEMBER_RUN:
                yield held(run)
                run.clear()
            run += member
    if run:
        yield held(run)


def _parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


_RECORD = "type string, record_id string, concurrent_to string, target_uri string, date string, refers_to string, head string, payload binary, payload_bytes long, payload_digest string"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of an archive. The payload of a response is its body: measured and digested as read, and given if asked for.
    A revisit has what its headers say of the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                stream = pa.BufferReader(raw)
                packed = raw.size > 2 and raw.slice(0, 2).to_pybytes() == b"\x1f\x8b"
                rows, held = [], 0
                for fields, block in _parse(io.BufferedReader(gzip.GzipFile(fileobj=stream) if packed else io.BytesIO(raw.to_pybytes()))):
                    kind, head, body = fields.get("warc-type"), None, block
                    size = digest = None
                    if "application/http" in fields.get("content-type", ""):
                        top, _, body = block.partition(b"\r\n\r\n")
                        head = top.decode("utf-8", "replace")
                    if kind == "response":
                        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif kind == "revisit":
                        lines = dict(x.lower().split(":", 1) for x in (head or "").split("\r\n")[1:] if ":" in x)
                        size = int(lines["content-length"]) if "content-length" in lines else None
                        digest, body = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                    keep = body if with_payload or kind == "metadata" else None
                    rows.append((kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), head, keep, size, digest))
                    held += len(keep or b"") + 400
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: `capture_id`, and the structs `request`, `response` and `metadata` (null where missing).
    A request or metadata record without WARC-Concurrent-To is a capture of its own."""
    own = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    part = F.struct(*(n for n in _NAMES))
    return records.where(F.col("type").isin("request", "response", "revisit", "metadata")).groupBy(own.alias("capture_id")).agg(
        *(F.first(F.when(F.col("type").isin(*kinds), part), ignorenulls=True).alias(name) for name, kinds in (("request", ["request"]), ("response", ["response", "revisit"]), ("metadata", ["metadata"])))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = f"{shared_dir(spark)}/op6-archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    found = captures(read_archive(spark, path, with_payload=False))
    said = F.regexp_extract(F.col("metadata.payload").cast("string"), r"page-id: (-?\d+)", 1)
    return found.select(
        F.nullif(said, F.lit("")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), page_of(F.col("response.refers_to")).alias("refers_to"),
    )
