"""Content-addressed web archive.

An archive folder holds two tables. ``payloads``: every distinct payload once, under
its SHA-256 digest. ``headers``: the exact header bytes of every record, with the digest
of its payload. A record is its header, its payload (nothing for a revisit) and two
line ends; records come back by joining the two tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.session import shared_dir

SMALLEST_REVISIT = 100
_END = "\r\n"


def new_archive(spark: SparkSession) -> str:
    """A new archive folder among those that all executors see."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def _one_line(c: Column) -> Column:
    """A header value: white space and control characters percent-encoded or blanked."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f]", " ")


def _header(page: Column, url: Column, kind: Column, refers: Column, digest: Column, size: Column) -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), size.cast("string"), F.lit(_END + _END))
    length = F.octet_length(http) + F.when(kind == "response", size).otherwise(0)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_END))

    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))),
    )
    named = F.coalesce(page.cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), named, F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", _one_line(url)),
        F.when(kind == "revisit", revisit).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(_END),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record for every row of ``pages`` into the archive ``folder``.

    Of records with equal payloads of at least ``SMALLEST_REVISIT`` bytes, the one with
    the smallest key is a response and the others are revisits that name it; smaller
    ones are all responses. Each distinct payload is stored once in any case.

    Defined cases: a null page is an empty payload; a null url is an empty one. A null
    key is written as an empty name and can't be referred to: it is a revisit if an equal
    payload has a key, else a response. Rows that repeat the smallest key are all
    responses. Equal digests of unequal payloads stop the write. Other columns are
    not stored.

    Scale: payloads combine by digest on the map side, so a page that a third of all
    rows share is sent once per task; keys and digests are joined without payloads.
    """
    base = pages.select(
        F.col(key).cast("long").alias("page"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    stored = base.groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{folder}/payloads")
    narrow = base.select("page", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("check"))
    heads = (
        narrow.groupBy("digest")
        .agg(F.min("page").alias("head"), (F.min(F.struct("size", "check")) == F.max(F.struct("size", "check"))).alias("same"))
        .withColumn("head", F.when(F.col("same"), F.col("head")).otherwise(F.raise_error(F.lit("unequal payloads with one digest")).cast("long")))
        .select("digest", "head")
    )
    kind = F.when((F.col("size") >= SMALLEST_REVISIT) & F.col("head").isNotNull() & ~F.col("page").eqNullSafe(F.col("head")), "revisit").otherwise("response")
    (
        narrow.join(heads, "digest")
        .withColumn("kind", kind)
        .select("digest", _header(F.col("page"), F.col("url"), F.col("kind"), F.col("head"), F.col("digest"), F.col("size")).alias("header"))
        .write.parquet(f"{folder}/headers")
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """header, payload, record: every record of the archive, its payload verified.

    ``payload`` is the full one, for revisits that of the record they refer to;
    ``record`` has the exact bytes of the original record. A payload that doesn't
    have its digest stops the read.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("damaged payload")).cast("binary"))
        .alias("payload"),
    )
    headers = spark.read.parquet(f"{folder}/headers")
    body = F.when(_value("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return headers.join(payloads, "digest").select(
        "header", "payload", F.concat("header", body, F.lit(_END + _END).cast("binary")).alias("record")
    )


def _value(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def record_index(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from records."""
    page, refers = (F.regexp_extract(_value(n), "^<urn:page:(.*)>$", 1) for n in ("WARC-Record-ID", "WARC-Refers-To"))
    return records.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        _value("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )
