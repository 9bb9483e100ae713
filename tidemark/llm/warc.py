"""Web archives with revisit records for payloads that came before."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, join_counted, materialize, scratch, table, text_of

#: Fixed values of the format: https://iipc.github.io/warc-specifications/
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of an archive at most, bytes of payloads in it, and of a payload that counts as large: a task reads an archive record by record.
RECORDS, ARCHIVE_BYTES, LARGE = 2_000, 256 << 20, 128 << 10
RECORD_ID = "urn:page:"
#: Repeated digests that are broadcast at most.
BROADCAST_DIGESTS = 500_000


def digest_of(payload: Column) -> Column:
    """Bare base32 SHA-1: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    four = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*four), BASE32_FROM, BASE32_TO)


def originals(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``payload_digest, original, copies`` of the digests that several of ``page_id, payload_digest, payload_bytes`` have: the largest id."""
    counted = headers.where(F.col("payload_bytes") >= min_bytes)
    return counted.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def resolve_revisits(rows: DataFrame, headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``rows`` (``page_id, payload_digest, payload_bytes`` and more) with ``record_type, refers_to``; ``headers`` has those three of all.

    Of the records with one digest and at least ``min_bytes`` of payload, that
    with the largest id is the response; the others refer to it. Rows that
    repeat the largest id are responses too. A null id refers to the largest
    other; where all are null, all are responses. Headers alone are shuffled:
    the repeated digests are joined where the rows are, and beyond a bounded
    number of them those with a fixed share of all copies.
    """
    found = materialize(originals(headers, min_bytes), "originals")
    if found.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(found), "payload_digest", "left")
    else:
        joined = join_counted(rows, found, "payload_digest", "copies", found.agg(F.sum("copies")).first()[0])
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("original"))}).drop("original", "copies")


def records(pages: DataFrame, min_bytes: int, date: str, id_col: str, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """``record, payload_bytes``: the records' text, without the two line ends that close each, and the headers written first."""
    # An address can't break its header line: control characters and spaces are escaped.
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    for code in [*range(0x21), 0x7F]:
        if code:
            url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    payload = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest_of(F.col("payload"))})
    headers = materialize(rows.select("page_id", "payload_digest", "payload_bytes"), "headers")
    found = resolve_revisits(rows, headers, min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload"))).otherwise(http)
    length = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    ]
    return found.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("record"), "payload_bytes"), headers


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per row to gzipped archives in the folder ``path``.

    The payload is the page in UTF-8; a null page has the empty payload. Of
    equal payloads one is written, by a response; the others are revisits that
    carry the HTTP header and name it. Large pages are written apart, so many
    to an archive as keep its size bounded, and each is one record. Rows that
    repeat are a record each. An empty table makes an empty folder. A null id
    is written as the empty name; other columns are ignored.
    """
    lines, headers = records(pages, min_bytes, date, id_col, url_col, html_col)
    # The text writer ends each row with the line separator, here the end of a record.
    write = lambda df, n: df.select("record").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", n).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    write(lines.where(F.col("payload_bytes") <= LARGE), RECORDS)
    largest = headers.agg(F.coalesce(F.max("payload_bytes"), F.lit(0))).first()[0]
    if largest > LARGE:
        write(lines.where(F.col("payload_bytes") > LARGE), max(1, min(RECORDS, ARCHIVE_BYTES // largest)))
    discard(headers)


def parse(archive: BinaryIO) -> Iterator[tuple]:
    """The records of an archive, one by one: id, address, type, digest, payload's bytes in all, id that it refers to, payload (null for a revisit)."""

    def lines() -> list[str]:
        found = []
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends within a record")
            found.append(line.decode().removesuffix("\r\n"))
        return found

    fields = lambda found: dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in found)
    while version := archive.readline():
        if version.decode().removesuffix("\r\n") != VERSION:
            raise ValueError(f"no record begins with {version[:40]!r}")
        header = fields(lines())
        http = lines()
        size, kind = int(fields(http[1:])["Content-Length"]), header["WARC-Type"]
        payload = archive.read(size) if kind == "response" else None
        name = lambda k: header[k][len(RECORD_ID) + 1 : -1] or None if k in header else None
        yield name("WARC-Record-ID"), header["WARC-Target-URI"], kind, header["WARC-Payload-Digest"].removeprefix("sha1:"), size, name("WARC-Refers-To"), payload
        whole = len("\r\n".join(http).encode()) + len(END) + len(payload or b"")
        if archive.read(len(END)) != END.encode() or whole != int(header["Content-Length"]):
            raise ValueError(f"the record {header['WARC-Record-ID']} isn't closed")


def read_archives(spark: SparkSession, path: str, payloads: bool = True, id_type: str = "bigint") -> DataFrame:
    """``page_id, url, record_type, payload_digest, payload_bytes, refers_to`` of all records, and ``payload`` (null for a revisit).

    An archive is decompressed and read record by record, so a task holds it
    compressed, and few records beside. Ids are cast to ``id_type``; an empty
    one is null. An empty folder gives no rows; a broken record raises
    ValueError.
    """
    columns = {"page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary()}
    kept = list(columns)[: None if payloads else -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content.as_py())) as archive:
                    for row in parse(archive):
                        rows.append(row)
                        held += len(row[-1] or b"") if payloads else 0
                        if len(rows) == 1000 or held > 4_000_000:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], columns[c]) for i, c in enumerate(kept)], kept)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(run, ", ".join(f"{c} {kinds[columns[c]]}" for c in kept))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (
  SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS original FROM p
), b AS (
  SELECT page_id, payload_bytes, original, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(('0x' || substr(x, 5 * g + 1, 5)) AS INT) >> (15 - 5 * k)) & 31) + 1 AS INT), 1), '' ORDER BY g, k) AS payload_digest
  FROM h, (SELECT unnest(range(8)) AS g), (SELECT unnest(range(4)) AS k) GROUP BY page_id, payload_bytes, original, x
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM b
"""
