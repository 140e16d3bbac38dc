"""WARC archives without repeated payloads: revisit records point to one response per payload."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.functions.lineage import shared_folder
from tabscout.llm.ship import ship

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one archive file at most: a reader holds one file at a time.
FILE_RECORDS = 20_000
_READ = "record_id string, record_type string, url string, page_id bigint, payload_digest string, payload_bytes bigint, refers_to bigint"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal number of a multiple of 20 bits, as SHA-1 has."""
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def originals(headers: DataFrame, least_bytes: int) -> DataFrame:
    """``digest, original, original_url``: for each payload held by several pages the one with the largest id.

    Only headers are shuffled, summed up per payload before they leave a task,
    so that a payload that a third of all pages share is one row per task.
    """
    return (
        headers.where(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.max("page_id").alias("original"),
            F.max_by("url", "page_id").alias("original_url"),
        )
        .where("pages > 1")
        .select(F.col("digest").alias("_digest"), "original", "original_url")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one WARC record per page (``page_id, url, html``) to gzipped archives under ``path``.

    Of pages whose payloads are equal and at least ``least_bytes`` long, the one
    with the largest page_id is a response; the others are revisits that carry
    its record id, address and the digest, but no payload. Any other page is a
    response. Rows that tie at the largest id are all responses, rows without a
    page_id revisit it, and if no copy has an id all are responses. A null html
    is an empty payload, a null url leaves its header out, line ends in a url
    are escaped. The text writer commits whole files, so a task that is run
    again leaves no half-written archive.

    Payload digests with several pages are few; where they are not small enough
    to broadcast, Spark joins by digest and splits a hot digest (skew join).
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id",
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
        base32(F.sha1(html)).alias("digest"),
        F.octet_length(html).cast("bigint").alias("bytes"),
    )
    known = originals(rows.select("page_id", "url", "digest", "bytes"), least_bytes)
    joined = rows.join(known, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id")) & (F.col("bytes") >= least_bytes)
    typed = joined.withColumn("revisit", revisit)

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), field("Content-Length", F.col("bytes")), F.lit(END)
    )
    body = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("X-Page-ID", F.col("page_id")),
        F.when(
            F.col("revisit"),
            F.concat(
                field("WARC-Profile", F.lit(PROFILE)),
                field("WARC-Refers-To", record_id(F.col("original"), F.col("original_url"), F.col("digest"))),
                field("WARC-Refers-To-Target-URI", F.col("original_url")),
                field("WARC-Refers-To-Date", F.lit(date)),
                field("X-Refers-To-Page-ID", F.col("original")),
            ),
        ).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", body),
        F.lit(END),
        http,
        F.when(F.col("revisit"), "").otherwise(F.col("payload")),
    )
    # A record ends with two line ends, which is what the text writer puts after each value.
    typed.select(record.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """The same record has the same id in every run."""
    digits = F.md5(F.concat_ws("|", page_id.cast("string"), url, digest).cast("binary"))
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of every record."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := archive.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = archive.read(int(fields["content-length"]))
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def _parsed(content: bytes, payloads: bool) -> Iterator[tuple]:
    plain = io.BytesIO(content)
    archive = gzip.GzipFile(fileobj=plain) if content[:2] == b"\x1f\x8b" else plain
    for fields, block in records(io.BufferedReader(archive)):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response":
            size = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
        else:
            size, payload = int(http[b"Content-Length"]), None
        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        row = (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), page and int(page), digest, size)
        yield (*row, refers and int(refers), *([payload] if payloads else []))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; with ``payload`` (null for revisits) if asked for.

    A task reads archive by archive, checks that every record ends where its
    length says and that every payload has its digest, and fails otherwise.
    ``payload_bytes`` and ``payload_digest`` are of the full payload.
    """
    ship(spark)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    kinds += [pa.binary()] if payloads else []
    schema = _READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in _parsed(content.as_py(), payloads):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives (to a new shared folder if ``path`` is None) and returns their records."""
    path = path or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
