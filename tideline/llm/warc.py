"""Content-addressed web archive: each payload's bytes are stored once under their SHA-256, record headers stand apart, and
records are put together again by joins.

An archive is a folder with two tables. payloads: address, payload. headers: header (the exact bytes of a WARC/1.1 record
header with its blank line) and the payload's address. Reading recomputes the digest of every stored payload and fails on a
payload that is missing or doesn't fit its address.

Equal payloads need no gathering: a map-side aggregate leaves one row per payload and task, however many copies there are. It
also holds a second hash and the sizes of all copies against each other, so payloads that shared an address by chance would fail.
Defined results: a null html is an empty payload; rows that share the largest page_id of their payload are all responses;
null page_ids are revisits where another page holds the payload; line breaks in urls become spaces; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are written as responses even if they repeat.
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Writes one record per row of pages (page_id, url, html) into the archive at path."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    once = rows.withColumn("also", F.struct(F.xxhash64("payload"), F.octet_length("payload"))).groupBy("address").agg(F.first("payload").alias("payload"), F.max("page_id").alias("holder"), F.min("also").alias("least"), F.max("also").alias("most"))
    same = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads at "), F.col("address"))))
    once.select("address", same.alias("payload"), "holder").write.parquet(f"{path}/payloads")
    holders = spark.read.parquet(f"{path}/payloads").select("address", "holder")
    narrow = rows.select("page_id", "url", "address", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    joined = narrow.join(holders, "address")
    revisit = (F.col("size") >= min_revisit) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("holder"), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string"), F.lit("\r\n\r\n"),
    )
    joined.select(F.encode(header, "UTF-8").alias("header"), "address").write.parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each held against its address."""
    rows = spark.read.parquet(f"{path}/payloads").select("address", "payload")
    return rows.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't fit its address "), F.col("address")))))


def _joined(spark: SparkSession, path: str, *columns) -> DataFrame:
    found = payloads(spark, path).select("address", F.lit(True).alias("found"), *columns)
    rows = spark.read.parquet(f"{path}/headers").join(found, "address", "left")
    return rows.withColumn("header", F.when(F.col("found"), F.col("header")).otherwise(F.raise_error(F.concat(F.lit("no payload at "), F.col("address")))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: what its header says, and size and digest of its full payload as stored."""
    rows = _joined(spark, path, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    text = F.decode("header", "UTF-8")
    field = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    rows = rows.select(
        field(r"\r\nWARC-Record-ID: <urn:page:([^>]*)>").try_cast("long").alias("page_id"),
        "payload_bytes", "payload_digest",
        field(r"\r\nWARC-Type: (\w+)").alias("record_type"),
        field(r"\r\nWARC-Refers-To: <urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
        field(r"\r\nWARC-Payload-Digest: sha1:(\w+)").alias("named"),
        field(r"\r\nWARC-Target-URI: ([^\r]*)").alias("url"),
    )
    fits = F.when(F.col("named") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header names another digest than "), F.col("payload_digest"))))
    return rows.withColumn("payload_digest", fits).drop("named")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original records as bytes: header, block (empty for revisits) and the closing blank lines."""
    rows = _joined(spark, path, "payload")
    block = F.when(F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return rows.select(F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


SQL = """
WITH p AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), ' '), chr(10), ' ') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT html, max(page_id) AS holder FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id <> holder THEN holder END AS refers_to, url
FROM p JOIN h USING (html)
"""
