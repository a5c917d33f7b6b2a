"""WARC archives with revisit resolution.

Headers (digest, id) are shuffled by payload digest without payloads; each digest that several records share gets one
original, and the others are written as revisit records that refer to it. Archives are gzip files of plain WARC/1.1
records, written by Spark's own writer (any Hadoop store) and read back by content length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import base32_of_sha1, new_path, write_table

#: The profile of revisit records with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def with_headers(pages: DataFrame) -> DataFrame:
    """Columns for one record a page row: page_id, uri, payload (null html: empty), payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20"), F.lit("urn:unknown"))
    return pages.select(
        "page_id", uri.alias("uri"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_of_sha1(payload.cast("binary")).alias("payload_digest"),
    )


def resolve_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of records with equal payloads of ``least_bytes`` or more, the largest page_id
    is the response and the others revisit it; smaller ones are all responses.

    Rows that repeat the original's page_id are responses too. A null page_id is never an original unless all are
    null. Only digest, id and length are aggregated; the originals of shared digests become a table of their own, so
    AQE can split a digest that a third of all records share.
    """
    shared = write_table(
        records.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null").select("payload_digest", "original"),
        "warc-originals",
    )
    revisit = F.col("original").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (
        records.join(shared, "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("original")))
        .drop("original")
    )


def _record(date: str) -> Column:
    """The text of a record without the blank lines that end it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"),
        F.lit("\r\n\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")),
    )


#: Payload bytes that records of one archive have at most; a larger record has an archive of its own.
ARCHIVE_BYTES = 128 << 20
#: Records of up to so many payload bytes share archives with their like.
SIZES = (16 << 10, 1 << 20)


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes records (page_id, uri, payload, payload_bytes, payload_digest, record_type, refers_to) as gzip archives.

    Records are written by size, so that a number of records bounds the bytes of an archive. White space and controls in
    a URI are written as %20. Records that share a page_id share a record id.
    """
    largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    for low, high in zip((-1, *SIZES), (*SIZES, 1 << 62)):
        if low < largest:
            part = records.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
            (
                part.select(_record(date).alias("value")).write.mode("append")
                .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // high)).text(path)
            )


def _parse(archive: bytes) -> Iterator[tuple]:
    """Records of one archive, one at a time, each cut out by its content length."""
    with gzip.GzipFile(fileobj=io.BytesIO(archive)) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record starts here: {line[:40]!r}")
            fields = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                key, _, value = line.partition(b":")
                fields[key.strip().lower()] = value.strip()
            block = stream.read(int(fields[b"content-length"]))
            stream.read(4)
            head, _, payload = block.partition(b"\r\n\r\n")
            http = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            kind = fields[b"warc-type"].decode()
            digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
            size = len(payload) if kind == "response" else int(http[b"Content-Length"])
            if kind == "response" and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload and digest differ in {fields[b'warc-record-id']!r}")
            number = lambda x: int(n) if (n := x.strip(b"<>").rpartition(b":")[2]) else None
            yield (number(fields[b"warc-record-id"]), kind, fields[b"warc-target-uri"].decode(), digest, size, number(fields.get(b"warc-refers-to", b"")), payload if kind == "response" else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``; each response's payload is held against its digest.

    A revisit's payload is null; its payload_bytes come from the HTTP header that it repeats.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["content"]:
                rows, held = [], 0
                for row in _parse(archive):
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(row[-1] or b"") if payloads else 100
                    if held > 8_000_000:
                        yield _typed(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _typed(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page row, revisits resolved, and reads the archives back, without payloads.

    Null html is an empty payload; repeated rows are records of their own; an empty table gives no records.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(resolve_revisits(with_headers(pages), least_bytes), path)
    return read_archives(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
