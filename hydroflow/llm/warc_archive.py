"""WARC records in a content-addressed archive.

Payload bytes are stored once under their SHA-256 digest, after the digest has been
recomputed from the bytes; the exact header bytes of every record are kept in a
second table. Records are put together again by a join of the two.

Defined results: a null or empty payload is a record with an empty payload; a null url
gives a record without target line, control characters and line ends of any kind in a url are percent-encoded; rows with the same page id and payload are all kept
and are all responses if that id is the payload's smallest; a payload of which no row has
an id has responses only; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records with smaller payloads are never written as revisits.
LEAST_REVISIT_BYTES = 100
CRLF = "\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: Column, digest: Column) -> Column:
    """The same page and payload always get the same record id."""
    h = F.sha2(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest), 256)
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


#: Characters that end a line for one reader or another, and other controls; they are percent-encoded in a url.
CONTROLS = [chr(c) for c in (*range(32), 0x7F, 0x85, 0x2028, 0x2029)]


def _one_line(url: Column) -> Column:
    """The url with control characters percent-encoded, so that it cannot end its header line."""
    encoded = url
    for c in CONTROLS:
        encoded = F.replace(encoded, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    return F.when(url.rlike("[\\x00-\\x1F\\x7F\\x85\\u2028\\u2029]"), encoded).otherwise(url)


def _lines(*lines: Column) -> Column:
    """Header lines, each ended by CRLF; null ones are left out."""
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, digest and length of each page's payload; the payload itself stays behind."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, digest and the exact header bytes of one record per page.

    A payload's first page (the smallest id) is found by an aggregate of digests, which
    sums up each task's rows before anything is shuffled; a digest that a third of all
    pages share is one row per task. Joining it back moves digests, not payloads.
    """
    found = digests(pages)
    first = found.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = found.join(first, "digest")
    revisit = F.coalesce((F.col("length") >= LEAST_REVISIT_BYTES) & (F.col("page_id") > F.col("first_id")), F.lit(False)) | (
        (F.col("length") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNull() & F.col("first_id").isNotNull())
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("length").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("revisit"), F.octet_length(http)).otherwise(F.octet_length(http) + F.col("length"))
    rows = rows.withColumn("revisit", revisit)
    warc = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit("WARC-Date: " + WARC_DATE),
        F.concat(F.lit("X-Page: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id"), F.col("digest")))),
        F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Page: "), F.col("first_id").cast("string"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")))
    return rows.select("page_id", "digest", F.encode(F.concat(warc, http), "UTF-8").alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """Each payload once: digest, bytes.

    Each task reduces its own pages to one per digest before payloads are shuffled, so a payload
    that a third of all pages share moves once per task.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload")
    return rows.groupBy("digest").agg(F.first("payload").alias("payload"))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write both tables of the archive. Stored bytes are checked against their digest while they are written."""
    headers(pages).write.mode("overwrite").parquet(f"{folder}/records")
    stored = payloads(pages)
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))))
    stored.select("digest", verified.alias("payload")).write.mode("overwrite").parquet(f"{folder}/payloads")


def field(header: Column, name: str) -> Column:
    """The value of a header line, or null."""
    value = F.regexp_extract(header, f"(?md)^{name}: ([^\\r\\n]*)", 1)
    return F.when(value != "", value)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive: page_id, parsed header fields, header bytes, payload bytes.

    The header names the digest; the join with the stored payloads gives the bytes back, for
    revisits too. A record whose payload is missing or altered raises.
    """
    records = spark.read.parquet(f"{folder}/records").withColumn("head", F.decode("header", "UTF-8"))
    records = records.select(
        field(F.col("head"), "X-Page").cast("long").alias("page_id"), field(F.col("head"), "WARC-Type").alias("record_type"),
        field(F.col("head"), "X-Refers-To-Page").cast("long").alias("refers_to"),
        F.regexp_extract("head", "(?md)^WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("payload_digest"), "header")
    stored = spark.read.parquet(f"{folder}/payloads").select(
        F.col("digest").alias("stored_digest"),
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("stored payload was altered: "), F.col("digest")))).alias("payload"))
    joined = records.join(stored, records["payload_digest"] == stored["stored_digest"], "left")
    whole = F.when(F.col("stored_digest").isNotNull(), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("no payload for digest "), F.col("payload_digest"))))
    return joined.select("page_id", "record_type", "refers_to", "payload_digest", "header", whole.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The original records, byte for byte: header, payload (none in a revisit), closing blank lines."""
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select("page_id", "record_type", F.concat("header", body, F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("record"))


def page_digests(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader of the archive finds per page, from the header bytes and the stored payloads.

    Payload lengths and digests are taken from the stored bytes once per payload, so records
    are joined with two numbers and not with their bytes.
    """
    records = spark.read.parquet(f"{folder}/records").select(F.decode("header", "UTF-8").alias("head"))
    records = records.select(
        field(F.col("head"), "X-Page").cast("long").alias("page_id"), field(F.col("head"), "WARC-Type").alias("record_type"),
        field(F.col("head"), "X-Refers-To-Page").cast("long").alias("refers_to"),
        F.regexp_extract("head", "(?md)^WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("named"))
    stored = spark.read.parquet(f"{folder}/payloads").select(
        F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    joined = records.join(stored, records["named"] == stored["payload_digest"], "left")
    known = F.when(F.col("payload_digest").isNotNull(), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("no payload for digest "), F.col("named"))))
    return joined.select("page_id", "payload_bytes", known.alias("payload_digest"), "record_type", "refers_to")
