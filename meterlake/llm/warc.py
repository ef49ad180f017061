"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256; exact record headers are stored apart; original
records come back by joining the two. Everything is DataFrame expressions, so no payload leaves the
JVM.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.staging import shared_dir

#: Fixed values of the WARC 1.1 format and of base 32 (RFC 4648).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of SHA-1: five hex digits are twenty bits, which are four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS32, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> str:
    """Write ``path/payloads`` (address, payload) and ``path/headers`` (address, header); return ``path``.

    A null payload is empty. Among records with equal payloads of at least ``min_revisit_bytes``
    bytes the one with the smallest identifier (nulls last; of repeated rows, one) is a response and
    the others revisit it; shorter ones are all responses. A payload counts as equal only if
    SHA-256, SHA-1, CRC-32 and length all agree, else the write fails. A null identifier or URL
    leaves its header line out. Line ends within a URL, which no URI may hold, are written as %0D
    and %0A, so that no URL makes header lines. An empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload"))
    base = base.withColumn("address", F.sha2("payload", 256))
    (base.groupBy("address").agg(F.first("payload").alias("payload"))).write.parquet(f"{path}/payloads")

    rows = base.select(
        "id", "url", "address", base32_sha1(F.col("payload")).alias("digest"), F.crc32("payload").alias("crc"),
        F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("seq"))
    # Written once with its numbers, which tell repeated rows apart, and read from there by all that follows.
    rows.write.parquet(f"{path}/rows")
    rows = pages.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    check = F.struct("digest", "crc", "size")
    first = rows.groupBy("address").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "seq")).alias("first"),
        F.assert_true(F.min(check) == F.max(check), F.lit("payloads differ under one digest")).alias("ok"),
    )
    revisit = (F.col("size") >= min_revisit_bytes) & (F.col("seq") != F.col("first.seq"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("id"))), _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("first.id")))), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("size")).cast("string")), F.lit("\r\n"))
    joined = rows.join(first, "address").filter(F.col("ok").isNull())
    joined.select("address", header.alias("header")).write.parquet(f"{path}/headers")
    return path


def _field(name: str) -> Column:
    """The value of a header line; null where there is no such line, empty where it has no value."""
    line = rf"(?:^|\n){name}: ([^\r]*)\r"
    return F.when(F.regexp_like("header", F.lit(line)), F.regexp_extract("header", line, 1))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header rows with their fields: address, header, page_id, url, record_type, refers_to, digest, body_bytes."""
    number = lambda name: F.regexp_extract(_field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        "address", "header", number("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha1:(\w+)$", 1).alias("digest"), _field("Content-Length").cast("long").alias("body_bytes"))


def _checked(spark: SparkSession, path: str, *stored: Column) -> DataFrame:
    """Header rows joined with ``stored`` columns of their payloads. Fails where a payload is missing or no
    longer has its address, and where length or digest differ from the header's."""
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address", (F.sha2("payload", 256) == F.col("address")).alias("_whole"), F.octet_length("payload").cast("long").alias("_size"), base32_sha1(F.col("payload")).alias("_digest"), *stored)
    rows = read_headers(spark, path).join(payloads, "address", "left")
    body = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("_size"))
    tests = [
        F.assert_true(F.col("_whole").isNotNull(), F.lit("a stored payload is missing")), F.assert_true(F.col("_whole"), F.lit("stored payload is damaged")),
        F.assert_true(F.col("digest") == F.col("_digest"), F.lit("header and payload digests differ")), F.assert_true(F.col("body_bytes") == body, F.lit("header and body lengths differ")),
    ]
    return rows.filter(F.coalesce(*tests).isNull())


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Original records by join: the header fields, ``payload`` (of revisits too) and ``record``, the
    exact bytes of the record as it stands in a WARC file. Every record of the archive comes back, or
    reading fails: where a stored payload is missing, no longer has its address, or has another length
    or digest than its header says."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "utf-8"), body, F.lit(b"\r\n\r\n"))
    return _checked(spark, path, F.col("payload")).withColumn("record", record).drop("_whole", "_size", "_digest")


def record_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived record, read back with the checks of :func:`reconstruct`: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Length and digest are taken anew from the stored bytes,
    where they are stored, so that payloads are not moved."""
    return _checked(spark, path).select("page_id", F.col("_size").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archive ``pages`` in the shared folder and return :func:`record_table` of it."""
    spark = pages.sparkSession
    return record_table(spark, write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", **options))
