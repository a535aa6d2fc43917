"""Content-addressed WARC archive: payload bytes once, record headers apart, records by joins.

An archive is a folder with two Parquet tables.  ``payloads`` holds each distinct payload once,
compressed, under the SHA-256 of its bytes; ``headers`` holds the exact header block of every record
and the key of its payload.
Writing checks that rows of one key agree in length and SHA-1; reading recomputes the SHA-256 of
every stored payload and fails on a difference.  Reading a record back is a join of both.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W

from splatlake.llm import query
from splatlake.llm.common import base32, bound_batches, scratch_path, table

DATE = "2024-01-01T00:00:00Z"
END = "\r\n"


def compressed(payload: str) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(zstandard.ZstdCompressor(level=3).compress)

    return F.pandas_udf(run, T.BinaryType())(payload)


def expanded(stored: str) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(zstandard.ZstdDecompressor().decompress)

    return F.pandas_udf(run, T.BinaryType())(stored)


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, key, sha1, payload_bytes); a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the largest
    page_id is the response and the others revisit it.  Repeated rows with one page_id are the same
    capture, so each is a response.  A null page_id never is the largest unless all are null; null
    urls become empty; an empty table gives an empty archive.
    """
    bound_batches(pages.sparkSession)
    rows = captures(pages)
    slim = rows.select("page_id", "url", "key", "sha1", "payload_bytes")
    kept = slim.groupBy("key").agg(
        F.max("page_id").alias("response_id"), F.min("sha1").alias("_a"), F.max("sha1").alias("_b"), F.min("payload_bytes").alias("_c"),
        F.max("payload_bytes").alias("_d"))
    kept = kept.select("key", F.when((F.col("_a") == F.col("_b")) & (F.col("_c") == F.col("_d")), F.col("response_id")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads share the digest "), "key")).cast("bigint")).alias("response_id"))
    first = W.partitionBy("key", "page_id").orderBy("page_id")
    # payloads are packed before they travel, which halves the shuffle
    chosen = rows.select("page_id", "key", compressed("payload").alias("payload")).join(
        kept.select(F.col("key").alias("_k"), "response_id"), (F.col("key") == F.col("_k")) & F.col("page_id").eqNullSafe(F.col("response_id")))
    chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("key", "payload").write.option("compression", "none").parquet(
        f"{path}/payloads")
    long = F.col("payload_bytes") >= min_revisit_bytes
    revisit = long & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    told = slim.join(kept, "key").select(
        "page_id", "key", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"), base32(F.col("sha1")).alias("digest"), "payload_bytes", "url")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisited = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), "record_type", F.lit(f"{END}WARC-Record-ID: "), urn("page_id"), F.lit(f"{END}WARC-Date: {DATE}{END}"),
        F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""), F.lit(f"{END}WARC-Payload-Digest: sha1:"), "digest",
        F.when(revisited, F.concat(F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "),
                                   urn("refers_to"))).otherwise(F.lit("")),
        F.lit(f"{END}Content-Type: text/html{END}Content-Length: "), F.when(revisited, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"),
        F.lit(END))
    told.select("page_id", "key", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload) with every payload checked against its key."""
    bound_batches(spark)
    stored = spark.read.parquet(f"{path}/payloads").select("key", expanded("payload").alias("payload"))
    right = F.sha2("payload", 256) == F.col("key")
    return stored.select("key", F.when(right, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "key")).cast("binary")).alias("payload"))


def header_field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, key, header, record_type, refers_to, digest, url) parsed from the header blocks."""
    number = lambda name: F.regexp_extract("header", rf"(?m)^{name}: <urn:page:(-?\d+)>", 1)
    as_id = lambda c: F.when(c != "", c.cast("bigint"))
    return spark.read.parquet(f"{path}/headers").select(
        as_id(number("WARC-Record-ID")).alias("page_id"), "key", "header", header_field("WARC-Type").alias("record_type"),
        as_id(number("WARC-Refers-To")).alias("refers_to"), F.substring(header_field("WARC-Payload-Digest"), 6, 32).alias("digest"),
        header_field("WARC-Target-URI").alias("url"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the record bytes as a WARC file would hold them; a revisit has no block."""
    heads = read_headers(spark, path).withColumn("_key", F.when(F.col("record_type") == "response", F.col("key")))
    stored = read_payloads(spark, path).withColumnRenamed("key", "_key")
    block = F.coalesce("payload", F.lit(b""))
    return heads.join(stored, "_key", "left").select(
        "page_id", F.concat(F.encode(F.concat("header", F.lit(END)), "UTF-8"), block, F.lit(END.encode() * 2)).alias("record"))


def restore_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of every record, revisits filled from the payload they share."""
    return read_headers(spark, path).join(read_payloads(spark, path), "key").select("page_id", "url", F.decode("payload", "UTF-8").alias("html"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = m.top THEN NULL ELSE m.top END AS refers_to
FROM p JOIN m ON p.body = m.body"""


@query("op2_warc_archive", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    # digests are taken from the stored bytes, once per payload, before copies meet it
    stored = read_payloads(spark, path).select("key", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                                               base32(F.sha1("payload")).alias("payload_digest"))
    return read_headers(spark, path).join(stored, "key").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
