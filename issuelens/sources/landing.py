"""Readers and landing clean-ups: tables, report files, market payloads and web pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import ci, extract, norm_id, norm_name, num, strip_html, tokens
from ..operators.ordering import top_per_group
from .schemas import CHART, REPORT


def clean_header(name: str) -> str:
    """Column name without a leading '~' and without markup from '<' on."""
    return name.lstrip("~").split("<")[0].strip()


def clean_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: clean_header(c) for c in df.columns if clean_header(c) != c})


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV table with a header; the schema fixes the types, ids stay text."""
    return clean_headers(spark.read.schema(schema).option("header", True).csv(path))


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Lists many folders in a few tasks a core; the default is a task a folder."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_reports(spark: SparkSession, path: str, key_pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """Report corpus, one JSON document per file of any depth of lines; broken files drop out.

    The key is the first group of ``key_pattern`` in the file's path: the file's stem, or
    a folder's name for layouts of one folder a report. A file without a key drops out.
    """
    with _few_listing_tasks(spark):
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    key = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1), F.lit(""))
    parsed = F.from_json("value", REPORT, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select(key.alias("cg_ipo_id"), parsed.alias("r")) \
        .filter(F.col("cg_ipo_id").isNotNull() & F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()) \
        .select("cg_ipo_id", "r.*").drop("_corrupt_record")


def clean_rows(df: DataFrame, markup: str, id_pattern: str, url_pattern: str,
               id_fallback: str | None = None) -> DataFrame:
    """Landed report rows: id and url from the link markup, plain text as the name.

    Rows that end without a name or an id are dropped; every other text column loses
    its markup.
    """
    ident = extract(F.col(markup), id_pattern)
    if id_fallback:
        ident = F.coalesce(ident, F.nullif(norm_id(F.col(id_fallback)), F.lit("")))
    texts = [c for c, t in df.dtypes if t == "string" and c != markup]
    out = df.select(
        ident.alias("cg_ipo_id"),
        F.coalesce(extract(F.col(markup), url_pattern), F.lit("")).alias("detail_url"),
        strip_html(F.col(markup)).alias("company"),
        *[strip_html(F.col(c)).alias(clean_header(c)) if c in texts
          else F.col(c).alias(clean_header(c)) for c in df.columns if c != markup])
    return out.filter((F.col("company") != "") & F.col("cg_ipo_id").isNotNull())


def html_matches(df: DataFrame, html: str, pattern: str, groups: Sequence[str],
                 keep: Sequence[str] = ()) -> DataFrame:
    """One row per match of a multi-group pattern, with the match's position."""
    found = F.arrays_zip(*[
        F.regexp_extract_all(F.col(html), F.lit(pattern), i + 1).alias(g)
        for i, g in enumerate(groups)])
    return df.select(*keep, F.posexplode(found).alias("pos", "m")) \
        .select(*keep, "pos", *[F.col(f"m.{g}").alias(g) for g in groups])


def filings(df: DataFrame, html: str, pattern: str, order: Sequence[str], stop_pattern: str
            = vocab.TITLE_BLACKLIST) -> DataFrame:
    """Filing list from listing pages: (date, url, title) once per url, notices dropped."""
    rows = html_matches(df, html, pattern, ["date", "url", "title"], order)
    kept = rows.filter(~F.col("title").rlike(ci(stop_pattern)))
    first = top_per_group(kept, ["url"], [*[F.col(c) for c in order], F.col("pos")], 1)
    return first.select(F.try_to_date("date", "MMM dd, yyyy").alias("date"), "url",
                        F.trim("title").alias("title"), tokens(F.col("title")).alias("toks"))


def html_rows(df: DataFrame, html: str, order: Sequence[str], row_tag: str, marker: str,
              name_pattern: str, value_pattern: str, stop: Sequence[str] = vocab.TITLE_STOP
              ) -> DataFrame:
    """Table rows that carry a marker word -> normalised name and number, last row per name."""
    parts = F.split(html, f"<{row_tag}[ >]")
    rows = df.select(*order, F.posexplode(parts).alias("pos", "cell")).filter(F.col("pos") > 0) \
        .withColumn("txt", strip_html(F.regexp_extract(
            F.concat(F.lit("<x "), F.col("cell")), rf"(?s)^(.*?)(?:</{row_tag}>|$)", 1), " ")) \
        .filter(F.col("txt").contains(marker))
    keyed = rows.withColumn("name", norm_name(extract(F.col("txt"), name_pattern), stop)) \
        .withColumn("amount", num(extract(F.col("txt"), value_pattern))) \
        .filter((F.col("name") != "") & F.col("amount").isNotNull())
    back = [F.col(c).desc() for c in order]
    return top_per_group(keyed, ["name"], [*back, F.col("pos").desc()], 1).select("name", "amount")


def chart_closes(df: DataFrame, payload: str, symbol: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """Chart payload (parallel arrays) -> one close per symbol and local day."""
    result = F.get(F.from_json(payload, CHART)["chart"]["result"], F.lit(0))
    points = F.arrays_zip(
        result["timestamp"].alias("ts"),
        F.get(result["indicators"]["quote"], F.lit(0))["close"].alias("close"))
    rows = df.select(symbol, F.explode(points).alias("p")) \
        .select(symbol, F.timestamp_seconds("p.ts").alias("ts"), F.col("p.close").alias("close"))
    local = F.to_date(F.from_utc_timestamp("ts", zone))
    return daily_close(rows.withColumn("session_date", local), symbol, "session_date", "close", ["ts"])


def daily_close(df: DataFrame, symbol: str, day: str, value: str, order: Sequence[str]) -> DataFrame:
    """Last non-null value of each symbol and day."""
    return df.filter(F.col(value).isNotNull()).groupBy(symbol, day) \
        .agg(F.max_by(value, F.struct(*order)).alias(value))


def register_documents(files: DataFrame, name: Column, content: Column) -> DataFrame:
    """Hash, size and kind of landed documents; drafts are recognised by file name."""
    lowered = F.lower(name)
    kind = F.when(lowered.contains("drhp") | lowered.contains("draft"), "DRHP").otherwise("RHP")
    return files.select("*", F.sha2(content, 256).alias("sha256"),
                        F.octet_length(content).alias("file_size"), kind.alias("doc_type"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Binary landing zone of documents, registered by content hash."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.element_at(F.split("path", "/"), -1)
    return register_documents(files.select("path", "content", stem.alias("filename")),
                              F.col("filename"), F.col("content")).drop("content")


def reservation(text: Column, patterns: dict[str, list[str]] = vocab.RESERVATION_PATTERNS,
                anchor_of: str = "pct_qib", anchor: str = "pct_anchor") -> list[Column]:
    """Reserved shares from page text: first pattern with a plausible percentage wins."""
    outs, base = [], None
    for name, options in patterns.items():
        hits = [F.round(extract(text, ci(p)).try_cast("double"), 2) for p in options]
        value = F.coalesce(*[F.when((h > 0) & (h <= 100), h) for h in hits])
        base = value if name == anchor_of else base
        outs.append(value.alias(name))
    return [*outs, F.round(base * vocab.ANCHOR_SHARE, 2).alias(anchor)]


def kpi_block(text: Column, marker: str = vocab.KPI_MARKER, chars: int = vocab.KPI_BLOCK_CHARS,
              patterns: dict[str, str] = vocab.KPI_PATTERNS, pair: str | None = vocab.KPI_PE,
              pair_name: str = "kpi_post_ipo_pe") -> list[Column]:
    """Latest figure after each label of the indicator block that follows a marker."""
    at = F.locate(marker, text)
    block = F.when(at > 0, F.substring(text, at, F.lit(chars)))
    outs = [F.round(extract(block, ci(p + r"\s+(-?[\d.]+)\s*%?")).try_cast("double"), 2).alias(k)
            for k, p in patterns.items()]
    if pair:
        second = F.coalesce(extract(block, ci(pair), 2), extract(block, ci(pair), 1))
        outs.append(F.round(second.try_cast("double"), 2).alias(pair_name))
    return outs
