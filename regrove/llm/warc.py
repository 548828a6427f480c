"""WARC archives of web pages: written by Spark, read back, and assembled into one nested row per capture.

Writing: each page becomes a response (or revisit), a request and a metadata record; the latter two name the first in
WARC-Concurrent-To. A record is header lines, an empty line, the block and two line ends, so Spark's text writer with that line
end writes valid archives to any file system with its usual commit (files are gzip-compressed as a whole).

Of records with equal payloads of at least `min_bytes` bytes, that with the smallest page id is the response (null ids last, then
the first row); the others are revisits that refer to it. Smaller payloads are always responses. Equality is that of the SHA-1.

Files hold `FILE_RECORDS` records at most. Reading: each comes as one compressed value, is unpacked and parsed by Content-Length as a
stream, a record at a time, and transactions are assembled by one grouping on the capture that each record belongs to: its own id for responses and revisits, else the id behind
WARC-Concurrent-To, followed over one request if need be.

Defined cases: null html is the empty payload; null urls become about:blank in the archive; null page ids come back as null;
repeated rows are captures of their own; records whose capture has no response give a row with a null response; an empty table
writes no record and reads back as an empty frame.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.llm.common import pick, table, written
from regrove.session import scratch_path

END = "\r\n"
#: Records of one archive: what a reading task holds in compressed form.
FILE_RECORDS = 6_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, kind string, concurrent_to string, target_uri string, refers_to string, payload_bytes long, payload_digest string, "
    "page_id string, payload binary"
)


def base32_of_hex(digest: str) -> str:
    """SQL: 40 hex digits as 32 base-32 digits, five hex digits (20 bits) at a time."""
    return "concat(" + ", ".join(
        f"substr('{BASE32}', cast(shiftright(cast(conv(substr({digest}, {5 * group + 1}, 5), 16, 10) as int), {shift}) & 31 as int) + 1, 1)"
        for group in range(8) for shift in (15, 10, 5, 0)
    ) + ")"


def _urn(*parts: Column | str) -> Column:
    """A record id from values: the md5 of its parts in the shape of a UUID."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: Column, record_id: Column, uri: Column, content_type: str, block: Column, date: str, *more: tuple[str, Column]) -> Column:
    """Header lines and block; `more` lines whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in more]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block)


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every row of `pages` (a table's scan, whose row numbers stay the same when a task is run again) as WARC files under `path`."""
    named = pick(pages, id, url, html).select(
        F.col(id).cast("string").alias("page"), F.col(id).alias("key"), F.coalesce(html, F.lit("")).alias("payload"),
        F.regexp_replace(F.coalesce(url, F.lit("about:blank")), "[\\x00-\\x20\\x7f]", "%20").alias("uri"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("sha", F.sha1("payload"))
    # the first of each payload; narrow rows, partial minima before the shuffle
    first = named.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min(F.struct(F.isnull("key").alias("n"), "key", "row")).alias("first"))
    rows = named.join(first.select("sha", F.col("first.row").alias("first_row")), "sha", "left")
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    rows = rows.select(
        "page", "payload", "uri", F.expr(base32_of_hex("sha")).alias("digest"), again.alias("again"),
        _urn(F.col("row").cast("string"), F.lit("capture")).alias("id"), _urn(F.col("row").cast("string"), F.lit("request")).alias("request"),
        _urn(F.col("row").cast("string"), F.lit("metadata")).alias("metadata"), _urn(F.col("first_row").cast("string"), F.lit("capture")).alias("first"),
    )
    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END * 2),
        F.when(F.col("again"), "").otherwise(F.col("payload")),
    )
    host = F.regexp_extract("uri", "^[a-z]+://([^/?#]+)", 1)
    only_again = lambda value: F.when(F.col("again"), value)
    capture = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), F.col("id"), F.col("uri"), "application/http;msgtype=response", answer, date,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Refers-To", only_again(F.col("first"))), ("WARC-Profile", only_again(F.lit(REVISIT_PROFILE))),
    )
    asked = F.concat(F.lit("GET "), "uri", F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2))
    request = _record(F.lit("request"), F.col("request"), F.col("uri"), "application/http;msgtype=request", asked, date, ("WARC-Concurrent-To", F.col("id")))
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), "page", F.lit(END)), F.lit("")), F.lit(f"via: table{END}"))
    metadata = _record(F.lit("metadata"), F.col("metadata"), F.col("uri"), "application/warc-fields", facts, date, ("WARC-Concurrent-To", F.col("id")))
    rows.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, one held at a time; ValueError where the bytes are no WARC record."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    number = 0
    while line := stream.readline():
        number += 1
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at record {number}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record {number} ends in its headers")
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} doesn't end after its {headers['content-length']} bytes")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, payload, size, digest, page = headers["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            payload, size, found = body, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            if digest and digest != found:
                raise ValueError(f"payload of {headers['warc-record-id']} has digest {found}, not {digest}")
            digest = found
        else:  # the HTTP headers of a revisit state the full length
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
    elif kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
        page = fields.get("page-id")
    return (headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"),
            size, digest, page, payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, step: int = 1_000) -> DataFrame:
    """One row per record (RECORDS). Payloads are checked against their digests."""
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for content in part.column(0):
                rows = []
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(_row(headers, block, with_payload))
                    if len(rows) == step:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, page_id, response (struct), requests and metadata (arrays of structs)."""
    asked = records.where("kind = 'request'").select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("behind"))
    told = records.where("kind = 'metadata'").join(asked, F.col("concurrent_to") == F.col("via"), "left")
    fields = ("record_id", "kind", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")
    member = lambda *c: F.struct(*c)
    main = records.where("kind in ('response', 'revisit')").select(
        F.col("record_id").alias("capture"), member(*fields).alias("response"), F.lit(None).cast("struct<record_id:string,target_uri:string>").alias("request"),
        F.lit(None).cast("struct<record_id:string,page_id:string>").alias("metadata"))
    requests = records.where("kind = 'request'").select(
        F.col("concurrent_to").alias("capture"), F.lit(None).cast(main.schema["response"].dataType).alias("response"), member("record_id", "target_uri").alias("request"),
        F.lit(None).cast("struct<record_id:string,page_id:string>").alias("metadata"))
    facts = told.select(
        F.coalesce("behind", "concurrent_to").alias("capture"), F.lit(None).cast(main.schema["response"].dataType).alias("response"),
        F.lit(None).cast("struct<record_id:string,target_uri:string>").alias("request"), member("record_id", "page_id").alias("metadata"))
    grouped = main.union(requests).union(facts).groupBy("capture").agg(
        F.first("response", ignorenulls=True).alias("response"), F.collect_list("request").alias("requests"), F.collect_list("metadata").alias("metadata"))
    return grouped.select(F.col("capture").alias("record_id"), F.expr("get(metadata, 0).page_id").alias("page_id"), "response", "requests", "metadata")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    records = written(read_archives(spark, path, with_payload=False), "records")
    kind = pages.schema["page_id"].dataType
    captures = assemble(records).select(
        F.col("page_id").cast(kind).alias("page_id"), "record_id", "response.payload_bytes", "response.payload_digest",
        F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("of"))
    captures = written(captures, "captures")
    first = captures.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = captures.where("of is not null").join(first, "of", "left").select(*columns)  # most rows refer to none and meet nobody
    return again.union(captures.where("of is null").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to")))


_SHA_DIGITS = ", ".join(f"(('0x' || substr(sha, {5 * g + 1}, 5))::INTEGER >> {s}) & 31" for g in range(8) for s in (15, 10, 5, 0))

OP8_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY sha ORDER BY page_id NULLS LAST, r))
SELECT page_id, CAST(octet_length(encode(payload)) AS bigint) AS payload_bytes,
       array_to_string(list_transform([{_SHA_DIGITS}], lambda x: substr('{BASE32}', x + 1, 1)), '') AS payload_digest,
       CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r = first_r THEN NULL ELSE first_id END AS refers_to
FROM f
"""
