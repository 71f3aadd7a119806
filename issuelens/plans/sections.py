"""Chapters of a document: locating, verifying, merging, spans and texts.

Tables: pages (doc_id, n, text), toc (doc_id, level, title, page); chapters come as a
rule list (key, titles, heading pattern) and fold into expressions or a small
broadcast table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import extract
from ..operators.ordering import top_per_group

Chapter = tuple[str, list[str], str]


def chapter_table(spark: SparkSession, chapters: Sequence[Chapter]) -> DataFrame:
    rows = [(i, key, titles[0].title()) for i, (key, titles, _) in enumerate(chapters)]
    return spark.createDataFrame(rows, "canon int, key string, default_title string")


def normal_title(c: Column) -> Column:
    """Lower-case title of letters and blanks, without a leading section number."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"section\s+[ivxlc]+\s*[-–:.]?\s*", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z ]+", " "))


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence length, bit-parallel over the first string."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


@lru_cache(maxsize=4096)
def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def token_set_ratio(a: str, b: str) -> float:
    """Token-set similarity 0..100: containment is 100, else the best indel ratio of the parts."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    rest_x, rest_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not rest_x or not rest_y):
        return 100.0
    left = f"{shared} {rest_x}".strip()
    right = f"{shared} {rest_y}".strip()
    best = _indel(left, right)
    if shared:
        best = max(best, _indel(shared, left), _indel(shared, right))
    return best


def match_titles(df: DataFrame, title: str, chapters: Sequence[Chapter],
                 threshold: float = vocab.TITLE_THRESHOLD) -> DataFrame:
    """Best chapter per distinct title, at least ``threshold`` similar.

    Only distinct normalised titles reach Python, in Arrow batches; earlier chapters win
    ties. Adds key and score to every input row that matches.
    """
    names = [(key, t) for key, titles, _ in chapters for t in titles]

    @F.pandas_udf("struct<key string, score double>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                key, score = None, None
                for k, name in names:
                    s = token_set_ratio(text, name)
                    if s >= threshold and (score is None or s > score):
                        key, score = k, s
                out.append((key, score))
            yield pd.DataFrame(out, columns=["key", "score"])

    normed = df.withColumn("__t", normal_title(F.col(title)))
    found = normed.select("__t").filter(F.col("__t") != "").distinct() \
        .withColumn("m", best("__t")).filter(F.col("m.key").isNotNull()) \
        .select("__t", F.col("m.key").alias("key"), F.round("m.score", 4).alias("score"))
    return normed.join(found, "__t").drop("__t")


def from_bookmarks(toc: DataFrame, chapters: Sequence[Chapter] = vocab.CHAPTERS) -> DataFrame:
    """Chapter starts from bookmarks of level 1 or 2; the best score wins, then document order."""
    marks = toc.filter((F.col("level") <= 2) & (F.col("page") >= 1))
    hits = match_titles(marks, "title", chapters)
    best = top_per_group(hits, ["doc_id", "key"], [F.col("score").desc(), F.col("page"), F.col("title")])
    return best.select("doc_id", "key", F.trim("title").alias("title"),
                       F.col("page").alias("page_start"), F.lit("toc").alias("method"))


def toc_lines(pages: DataFrame) -> DataFrame:
    """Printed contents lines 'TITLE ..... 28', wherever in the document they stand."""
    lines = pages.select("doc_id", "n", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    pattern = vocab.TOC_LINE
    line = F.trim("line")
    return lines.filter(line.rlike(pattern)).select(
        "doc_id", "n", "pos", F.trim(F.regexp_extract(line, pattern, 1)).alias("title"),
        F.regexp_extract(line, pattern, 2).cast("int").alias("page"))


def from_printed_toc(pages: DataFrame, chapters: Sequence[Chapter] = vocab.CHAPTERS) -> DataFrame:
    """Chapter starts from printed contents lines, first line per chapter, page inside the document."""
    counts = pages.groupBy("doc_id").agg(F.max("n").alias("pages"))
    hits = match_titles(toc_lines(pages), "title", chapters).join(counts, "doc_id") \
        .filter(F.col("page").between(1, F.col("pages")))
    first = top_per_group(hits, ["doc_id", "key"], [F.col("n"), F.col("pos")])
    return first.select("doc_id", "key", "title", F.col("page").alias("page_start"),
                        F.lit("printed_toc").alias("method"))


def heading_pages(pages: DataFrame, chapters: Sequence[Chapter] = vocab.CHAPTERS,
                  prefix: str = vocab.HEADING_PREFIX) -> DataFrame:
    """(doc_id, key, n) of every page with a line that is a chapter heading.

    All chapters are tested in one narrow pass.
    """
    top = F.split("text", r"\r?\n")

    def test(key: str, heading: str) -> Column:
        pattern = rf"^\s*{prefix}(?:{heading})\s*$"
        return F.when(F.exists(top, lambda line: line.rlike(pattern)), F.lit(key))

    keys = F.array_compact(F.array(*[test(key, heading) for key, _, heading in chapters]))
    return pages.select("doc_id", "n", F.explode(keys).alias("key"))


def from_headings(pages: DataFrame, spark: SparkSession,
                  chapters: Sequence[Chapter] = vocab.CHAPTERS) -> DataFrame:
    first = heading_pages(pages, chapters).groupBy("doc_id", "key").agg(F.min("n").alias("page_start"))
    names = chapter_table(spark, chapters)
    return first.join(F.broadcast(names), "key").select(
        "doc_id", "key", F.col("default_title").alias("title"), "page_start",
        F.lit("heading_scan").alias("method"))


def verify_pages(claims: DataFrame, headings: DataFrame) -> DataFrame:
    """Claimed start moved to the nearest page with the heading; later page on a tie."""
    near = claims.join(headings, ["doc_id", "key"]) \
        .groupBy("doc_id", "key").agg(F.min_by("n", F.struct(
            F.abs(F.col("n") - F.col("page_start")), -F.col("n"))).alias("found_page"))
    return claims.join(near, ["doc_id", "key"], "left") \
        .withColumn("page_start", F.coalesce("found_page", "page_start")).drop("found_page")


def merge_sections(located: DataFrame, docs: DataFrame, spark: SparkSession,
                   chapters: Sequence[Chapter] = vocab.CHAPTERS) -> DataFrame:
    """Best method per chapter (bookmarks, printed contents, headings); absent chapters are listed."""
    order = F.when(F.col("method") == "toc", 0).when(F.col("method") == "printed_toc", 1).otherwise(2)
    best = top_per_group(located.withColumn("__m", order), ["doc_id", "key"],
                         [F.col("__m"), F.col("page_start")]).drop("__m")
    names = chapter_table(spark, chapters)
    wanted = docs.select("doc_id").withColumn("__c", F.explode(F.array(*[
        F.struct(F.lit(i).alias("canon"), F.lit(k).alias("key"), F.lit(t[0].title()).alias("dt"))
        for i, (k, t, _) in enumerate(chapters)])))
    wanted = wanted.select("doc_id", F.col("__c.canon").alias("canon"), F.col("__c.key").alias("key"),
                           F.col("__c.dt").alias("default_title"))
    return wanted.join(best, ["doc_id", "key"], "left").select(
        "doc_id", "key", "canon", F.coalesce("title", "default_title").alias("title"),
        "page_start", "method", F.col("page_start").isNotNull().alias("found"))


def section_spans(sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """End page of each found chapter: before the next start, the last one runs to the end."""
    found = sections.filter("found").join(page_counts, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("page_start", "canon")
    nxt = F.lead("page_start").over(w)
    end = F.when(nxt.isNull(), F.col("pages")) \
        .when(nxt > F.col("page_start"), nxt - 1).otherwise(F.col("page_start"))
    return found.withColumn("page_end", F.greatest(end, F.col("page_start"))).drop("pages")


def section_text(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of each chapter, pages in order (a chapter is bounded by its document)."""
    joined = spans.select("doc_id", "key", "page_start", "page_end").join(pages, "doc_id") \
        .filter(F.col("n").between(F.col("page_start"), F.col("page_end")))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return joined.groupBy("doc_id", "key", "page_start", "page_end").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def hit_rate(sections: DataFrame, core: Sequence[str] = vocab.CORE_CHAPTERS) -> DataFrame:
    return sections.filter(F.col("key").isin(*core)).groupBy("doc_id").agg(
        (F.sum(F.col("found").cast("int")) / len(core)).alias("section_hit_rate"))


def locate_sections(pages: DataFrame, toc: DataFrame, spark: SparkSession,
                    chapters: Sequence[Chapter] = vocab.CHAPTERS) -> DataFrame:
    """All chapters of all documents with method, start and end page and text."""
    headings = heading_pages(pages, chapters)
    printed = verify_pages(from_printed_toc(pages, chapters), headings)
    located = from_bookmarks(toc, chapters).unionByName(printed) \
        .unionByName(from_headings(pages, spark, chapters))
    counts = pages.groupBy("doc_id").agg(F.max("n").alias("pages"))
    merged = merge_sections(located, counts, spark, chapters)
    spans = section_spans(merged, counts).select("doc_id", "key", "page_end")
    full = merged.join(spans, ["doc_id", "key"], "left")
    texts = section_text(full.filter("found"), pages).select("doc_id", "key", "text")
    return full.join(texts, ["doc_id", "key"], "left") \
        .withColumn("text", F.coalesce("text", F.lit("")))


def low_text(pages: DataFrame, min_chars: int = 40) -> DataFrame:
    """Unreadable pages per document and the readable share."""
    low = F.length(F.trim("text")) < min_chars
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count(F.when(low, 1)).alias("low_pages"),
        F.round(F.avg(F.when(low, 0.0).otherwise(1.0)), 4).alias("readable_ratio"))


def doc_lines(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def pages_of_lines(docs: DataFrame, lines_per_page: int, text: str = "text") -> DataFrame:
    """Pages of a fixed number of lines, cut inside the row (no shuffle)."""
    lines = F.split(text, "\n")
    count = F.ceil(F.size(lines) / lines_per_page).cast("int")
    return docs.withColumn("__l", lines) \
        .select("doc_id", "__l", F.explode(F.sequence(F.lit(1), count)).alias("n")) \
        .select("doc_id", "n", F.array_join(F.slice(
            "__l", (F.col("n") - 1) * lines_per_page + 1, F.lit(lines_per_page)), "\n").alias("text"))


def company_name(first_pages: DataFrame, text: str = "text") -> DataFrame:
    """Issuer name on the cover: a capitals-only line first, then a mixed-case one."""
    caps = extract(F.col(text), "(?m)" + vocab.COMPANY_CAPS)
    mixed = extract(F.col(text), "(?m)" + vocab.COMPANY_MIXED)
    return first_pages.withColumn("company_name", F.trim(F.initcap(F.coalesce(caps, mixed))))


def issuer_names(pages: DataFrame) -> DataFrame:
    """(doc_id, company_name, name_page): the name on the first page of a document that has one.

    Names are cut from each page first, so the grouping moves no text.
    """
    named = company_name(pages).select("doc_id", "n", "company_name").filter(F.col("company_name").isNotNull())
    return named.groupBy("doc_id").agg(F.min_by("company_name", "n").alias("company_name"), F.min("n").alias("name_page"))
