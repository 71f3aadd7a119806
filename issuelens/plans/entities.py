"""Issue details and disclosures read from document pages and table cells."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import amount, ci, extract, first_match, first_of, head, rescale, to_crore
from ..operators.ordering import top_per_group

TABLE = ["doc_id", "page", "table_no"]


def page_ranges(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered page ranges of the given chapters: (doc_id, rank, lo, hi)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    return spans.filter(F.col("key").isin(*keys)).select(
        "doc_id", rank.alias("rank"), F.col("page_start").alias("lo"), F.col("page_end").alias("hi"))


def cover_range(docs: DataFrame, pages: int = 8) -> DataFrame:
    """The cover pages, which are read first."""
    return docs.select("doc_id", F.lit(0).cast("bigint").alias("rank"), F.lit(1).alias("lo"),
                       F.lit(pages).alias("hi"))


def rest_range(docs: DataFrame) -> DataFrame:
    """The whole document, which is read last."""
    return docs.select("doc_id", F.lit(1_000).cast("bigint").alias("rank"), F.lit(1).alias("lo"),
                       F.lit(2**31 - 1).alias("hi"))


def first_hits(pages: DataFrame, ranges: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """First non-null value per name over ordered page ranges, with its page.

    The expressions are evaluated on the page scan, so only pages with a hit and none
    of their text reach the range join.
    """
    hits = pages.select("doc_id", "n", *[v.alias(k) for k, v in values.items()]) \
        .filter(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in values]))
    joined = hits.join(ranges, "doc_id").filter(F.col("n").between(F.col("lo"), F.col("hi")))
    best = [F.min(F.when(F.col(k).isNotNull(), F.struct(
        F.col("rank"), F.col("n"), F.col(k).alias("v")))).alias(k) for k in values]
    out = joined.groupBy("doc_id").agg(*best)
    cols = []
    for k in values:
        cols += [F.col(f"{k}.v").alias(k), F.col(f"{k}.n").alias(f"{k}_page")]
    return out.select("doc_id", *cols)


def _groups(text: Column, pattern: str, count: int) -> Column:
    """Struct of the groups of the first match, NULL without a match."""
    p = "(?is)" + pattern
    parts = [F.regexp_extract(text, p, i + 1).alias(f"g{i + 1}") for i in range(count)]
    return F.when(text.rlike(p), F.struct(*parts))


def issue_details(pages: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Price band, sizes, lot and holdings of every document."""
    text = F.col("text")
    front = cover_range(docs).unionByName(page_ranges(spans, [
        "offer_structure", "terms_of_offer", "capital_structure", "general_information",
        "offer_summary", "basis_for_offer_price"])).unionByName(rest_range(docs))
    shape = vocab.ISSUE_PATTERNS
    groups = {"band": 2, "fixed": 1, "face": 1, "fresh": 2, "ofs": 2, "lot": 1}
    found = first_hits(pages, front, {
        **{k: _groups(text, shape[k], n) for k, n in groups.items()},
        "both": F.when(text.rlike("(?is)" + shape["exchanges"]), F.lit("BSE, NSE"))})
    capital = page_ranges(spans, ["capital_structure"])
    holds = first_hits(pages, _or_whole(capital, docs, pages), {
        k: _groups(text, shape[k], 1) for k in ("pre_a", "pre_b", "post_a", "post_b")})
    out = docs.select("doc_id").join(found, "doc_id", "left").join(holds, "doc_id", "left")
    low, high = amount(F.col("band.g1")), amount(F.col("band.g2"))
    single = F.when(low.isNull(), amount(F.col("fixed.g1")))
    fresh = to_crore(F.col("fresh.g1"), F.col("fresh.g2"))
    ofs = to_crore(F.col("ofs.g1"), F.col("ofs.g2"))
    zero = F.lit(0.0)
    return out.select(
        "doc_id", F.coalesce(low, single).alias("price_band_low"),
        F.when(low.isNotNull(), high).otherwise(single).alias("price_band_high"),
        amount(F.col("face.g1")).alias("face_value"), fresh.alias("fresh_issue_cr"),
        ofs.alias("ofs_cr"),
        F.when(fresh.isNotNull() | ofs.isNotNull(),
               F.round(F.coalesce(fresh, zero) + F.coalesce(ofs, zero), 2)).alias("total_issue_cr"),
        F.col("lot.g1").cast("int").alias("lot_size"), F.col("both").alias("listing_at"),
        amount(F.coalesce("pre_a.g1", "pre_b.g1")).alias("pre_issue_promoter_pct"),
        amount(F.coalesce("post_a.g1", "post_b.g1")).alias("post_issue_promoter_pct"),
        F.coalesce("post_a_page", "post_b_page").alias("post_issue_page"))


def _or_whole(ranges: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The given ranges, or the whole document where it has none."""
    rest = docs.select("doc_id").join(ranges.select("doc_id").distinct(), "doc_id", "left_anti") \
        .join(pages.groupBy("doc_id").agg(F.max("n").alias("hi")), "doc_id")
    return ranges.unionByName(rest.select(
        "doc_id", F.lit(0).cast("bigint").alias("rank"), F.lit(1).alias("lo"), "hi"))


# ------------------------------------------------------------------ tables

def fold_header(cells: DataFrame) -> DataFrame:
    """Header text per column: all rows above the first data row joined in order.

    A data row has a name of three or more characters and at least two numbers.
    """
    first = F.max(F.when(F.col("col_no") == 0, F.trim("text"))).alias("name")
    numbers = F.count(F.when((F.col("col_no") > 0) & amount(F.col("text")).isNotNull(), 1)).alias("nums")
    rows = cells.groupBy(*TABLE, "row_no").agg(first, numbers)
    data = rows.filter((F.length("name") >= 3) & F.col("name").rlike("[A-Za-z]") & (F.col("nums") >= 2))
    start = data.groupBy(*TABLE).agg(F.min("row_no").alias("start")).filter(F.col("start") > 0)
    above = cells.join(start, TABLE).filter(F.col("row_no") < F.col("start"))
    parts = F.array_sort(F.collect_list(F.struct("row_no", F.coalesce("text", F.lit("")).alias("t"))))
    return above.groupBy(*TABLE, "start", "col_no").agg(F.lower(F.trim(F.array_join(
        F.transform(parts, lambda p: p["t"]), " "))).alias("header"))


def _columns(headers: DataFrame, wanted: Mapping[str, Sequence[str]], last: Sequence[str] = ()) -> DataFrame:
    """Column number of each wanted header per table: first (or last) that matches."""
    aggs = []
    for name, patterns in wanted.items():
        hits = [F.when(F.col("header").rlike(p), F.col("col_no")) for p in patterns]
        aggs.append((F.max(hits[0]) if name in last
                     else F.coalesce(*[F.min(h) for h in hits])).alias(name))
    return headers.groupBy(*TABLE, "start").agg(*aggs)


def _body(cells: DataFrame, picked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Data rows of the picked tables: label and the text of each wanted column."""
    body = cells.join(picked, TABLE).filter(F.col("row_no") >= F.col("start"))
    return body.groupBy(*TABLE, "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.trim("text"))).alias("label"),
        *[F.max(F.when(F.col("col_no") == F.col(f"__{c}"), F.col("text"))).alias(c) for c in names])


def _first_table(rows: DataFrame) -> DataFrame:
    """Rows of the first table (page, table order) of each document that has any."""
    first = rows.groupBy("doc_id").agg(F.min(F.struct("page", "table_no")).alias("__f"))
    return rows.join(first, "doc_id").filter(
        (F.col("page") == F.col("__f.page")) & (F.col("table_no") == F.col("__f.table_no"))).drop("__f")


def peers(cells: DataFrame, companies: DataFrame) -> DataFrame:
    """Listed-peer table of each document: name, P/E, EPS and RoNW; the issuer's row is tagged.

    ``cells`` are those of the pricing chapter, ``companies`` (doc_id, company_name).
    """
    cols = _columns(fold_header(cells), {
        "__eps": [vocab.EPS_BASIC_COLUMN, vocab.EPS_COLUMN], "__pe": [vocab.PE_COLUMN],
        "__ronw": [vocab.RONW_COLUMN]})
    picked = cols.filter(F.col("__pe").isNotNull() & F.col("__eps").isNotNull())
    rows = _body(cells, picked, ["pe", "eps", "ronw"])
    kept = rows.filter((F.col("label") != "") & ~F.col("label").rlike(
        ci(vocab.NOT_A_PEER)))
    name = F.regexp_replace(F.regexp_replace("label", r"\s+", " "), r"[#*^~†\s]+$", "")
    valued = kept.select("doc_id", "page", "table_no", "row_no", name.alias("name"),
                         *[amount(F.col(c)).alias(c) for c in ("pe", "eps", "ronw")]) \
        .filter(F.col("pe").isNotNull() | F.col("eps").isNotNull())
    words = F.filter(F.split(F.lower(F.coalesce("company_name", F.lit(""))), r"\W+"),
                     lambda w: (w != "") & ~w.isin("limited", "ltd", "private", "pvt"))
    issuer = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.lower("name"), w))
    return _first_table(valued).join(companies, "doc_id", "left") \
        .withColumn("is_issuer", issuer).drop("company_name", "table_no", "row_no")


def weighted_eps(cells: DataFrame) -> DataFrame:
    """Issuer EPS: the document's own weighted row, else the mean over (year, weight)."""
    cols = _columns(fold_header(cells), {
        "__basic": [vocab.EPS_BASIC_COLUMN, r"\beps\b"], "__weight": [r"weight"]})
    picked = cols.filter(F.col("__basic").isNotNull() & F.col("__weight").isNotNull())
    rows = _body(cells, picked, ["basic", "weight"]) \
        .withColumn("v", amount(F.col("basic"))).withColumn("w", amount(F.col("weight")))
    own = F.lower("label").contains("weighted")
    fiscal = F.lower("label").rlike(vocab.FISCAL_ROW) & ~own
    return weighted_mean(rows, TABLE, F.when(own & (F.col("v") != 0), F.col("v")),
                         F.when(fiscal, F.col("v")), F.when(fiscal, F.nullif("w", F.lit(0.0)))) \
        .filter(F.col("value").isNotNull()).transform(_first_table).select("doc_id", F.col("value").alias("eps"))


def weighted_mean(df: DataFrame, keys: Sequence[str], own: Column, value: Column,
                  weight: Column) -> DataFrame:
    """Σ value·weight / Σ weight over complete pairs, unless the group states its own mean."""
    pair = value.isNotNull() & weight.isNotNull()
    total = F.sum(F.when(pair, value * weight)) / F.nullif(F.sum(F.when(pair, weight)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.round(F.coalesce(F.max(own), total), 2).alias("value"))


def post_issue_holding(cells: DataFrame) -> DataFrame:
    """Promoter holding after the issue from the shareholding table (last % column)."""
    head = fold_header(cells)
    cols = _columns(head, {"__post": [vocab.POST_ISSUE], "__pct": [vocab.PERCENT_COLUMN]}, last=["__pct"])
    picked = cols.filter(F.col("__post").isNotNull() & F.col("__pct").isNotNull())
    rows = _body(cells, picked, ["pct"]).withColumn("v", amount(F.col("pct"))).filter(
        F.col("label").rlike(ci("promoter")) & ~F.col("label").rlike(ci(vocab.NOT_PROMOTER))
        & (F.col("v") > 0) & (F.col("v") <= 100))
    return top_per_group(rows, ["doc_id"], [F.col("page"), F.col("table_no"), F.col("row_no")]) \
        .select("doc_id", F.col("v").alias("post_issue_promoter_pct"), "page")


def total_rows(cells: DataFrame, label: str) -> DataFrame:
    """First positive number of the first row with the label, per page."""
    rows = cells.filter((F.col("col_no") == 0) & F.col("text").rlike(ci(label))) \
        .select(*TABLE, "row_no")
    values = cells.filter(F.col("col_no") > 0).withColumn("v", amount(F.col("text"))).filter("v > 0")
    return values.join(rows, [*TABLE, "row_no"]).groupBy("doc_id", "page").agg(
        F.min_by("v", F.struct("table_no", "row_no", "col_no")).alias("table_total"))


def note_total(pages: DataFrame, cells: DataFrame, found: str, patterns: Sequence[str],
               label: str) -> DataFrame:
    """Note total in crore on the first page that carries the note.

    Printed amount first; otherwise the total row of a table on that page in the
    page's unit, refused when the unit is unknown.
    """
    text = F.col("text")
    noted = pages.filter(text.rlike(ci(found)))
    first = top_per_group(noted, ["doc_id"], [F.col("n")])
    printed = F.coalesce(*[F.when(text.rlike(ci(p)), to_crore(
        F.regexp_extract(text, ci(p), 1), F.regexp_extract(text, ci(p), 2))) for p in patterns])
    unit = F.lower(extract(text, ci(vocab.PAGE_UNIT)))
    stated = F.lit(False)
    for p in patterns:
        stated = stated | text.rlike(ci(p))
    sums = total_rows(cells, label).withColumnRenamed("page", "n")
    return first.join(sums, ["doc_id", "n"], "left").select(
        "doc_id", F.col("n").alias("source_page"), F.when(stated, printed).otherwise(
            rescale(F.col("table_total"), unit)).alias("total_cr"))


def related_party(pages: DataFrame, cells: DataFrame) -> DataFrame:
    return note_total(pages, cells, vocab.RELATED_PARTY, vocab.RELATED_PARTY_AMOUNTS, vocab.TOTAL_ROW)


def contingent(pages: DataFrame, cells: DataFrame) -> DataFrame:
    return note_total(pages, cells, vocab.CONTINGENT, vocab.CONTINGENT_AMOUNTS, vocab.CONTINGENT_ROW)


# ------------------------------------------------------------------ chapter texts

def objects(lines: DataFrame, limit: int | None = None, chars: int | None = None,
            categories: Sequence[tuple[str, str]] = vocab.OBJECT_CATEGORIES) -> DataFrame:
    """Use-of-proceeds lines: first category, amount, distinct per (category, amount)."""
    line = F.trim("line")
    rows = lines.withColumn("category", first_match(line, categories)) \
        .filter(F.col("category").isNotNull()) \
        .withColumn("amount_cr", F.when(line.rlike(ci(vocab.AMOUNT)), to_crore(
            F.regexp_extract(line, ci(vocab.AMOUNT), 1), F.regexp_extract(line, ci(vocab.AMOUNT), 2))))
    once = top_per_group(rows, ["doc_id", "category", "amount_cr"], [F.col("line_no")])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    ranked = once.withColumn("rank", place)
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)) \
        .select("doc_id", "rank", head(line, chars).alias("purpose"), "category", "amount_cr")


def litigation_counts(text: Column, kinds: Sequence[tuple[str, str]] = vocab.LITIGATION_KINDS
                      ) -> dict[str, Column]:
    return {k: extract(text, ci(p)).cast("int") for k, p in kinds}


def litigation_amount(text: Column) -> Column:
    p = ci(vocab.LITIGATION_AMOUNT)
    return F.when(text.rlike(p), to_crore(F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)))


def tri_state(text: Column, negative: str, positive: str) -> Column:
    """False when denied, True when stated, NULL when the text is silent."""
    return F.when(text.rlike(ci(negative)), False).when(text.rlike(ci(positive)), True)


def dividend(text: Column) -> Column:
    return tri_state(text, vocab.NO_DIVIDEND, vocab.DIVIDEND)


def pledging(pages: DataFrame, ranges: DataFrame, pattern: str = vocab.PLEDGE,
             negation: str = vocab.NO_PLEDGE, chars: int | None = None) -> DataFrame:
    """First pledge statement per chapter; a denial there moves on to the next chapter."""
    hit = F.trim(F.regexp_replace(extract(F.col("text"), ci(pattern)), r"\s+", " "))
    hits = pages.select("doc_id", "n", hit.alias("evidence")).filter(F.col("evidence").isNotNull())
    per = hits.join(ranges, "doc_id").filter(F.col("n").between(F.col("lo"), F.col("hi"))) \
        .groupBy("doc_id", "rank").agg(F.min_by(F.struct("n", "evidence"), "n").alias("h"))
    real = per.filter(~F.col("h.evidence").rlike(ci(negation)))
    return real.groupBy("doc_id").agg(F.min_by("h", "rank").alias("h")).select(
        "doc_id", F.lit(True).alias("pledged"), head(F.col("h.evidence"), chars).alias("evidence"),
        F.col("h.n").alias("source_page"))


def auditor_flags(pages: DataFrame, qualified: str = vocab.QUALIFIED_OPINION,
                  emphasis: str = vocab.EMPHASIS) -> DataFrame:
    """Reservation flags; the page is the last qualified one, else the first emphasis."""
    q, e = F.col("text").rlike(ci(qualified)), F.col("text").rlike(ci(emphasis))
    return pages.select("doc_id", "n", q.alias("q"), e.alias("e")).groupBy("doc_id").agg(
        F.bool_or("q").alias("qualified"), F.bool_or("e").alias("emphasis_of_matter"),
        F.coalesce(F.max(F.when(F.col("q"), F.col("n"))), F.min(F.when(F.col("e"), F.col("n"))))
        .alias("source_page"))


def issuer_pe(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """P/E printed at the price band."""
    text = F.col("text")
    hits = first_hits(pages, ranges, {
        k: extract(text, "(?is)" + p) for k, p in vocab.ISSUER_PE_PATTERNS.items()})
    return hits.select("doc_id", amount(F.coalesce("a", "b")).alias("issuer_pe"),
                       F.coalesce("a_page", "b_page").alias("issuer_pe_page"))


def promoter_names(text: Column, limit: int | None = None) -> Column:
    """Distinct promoter names of the chapter; an enumerating sentence is the fallback."""
    stated = F.regexp_extract_all(text, F.lit(vocab.PROMOTER_STATED), 1)
    names = first_of(F.filter(F.array_distinct(stated), lambda x: ~x.rlike("Company|Limited")), limit)
    listed = F.split(F.regexp_extract(text, vocab.PROMOTERS_LISTED, 1),
                     r",\s*|\s+and\s+")
    fallback = first_of(F.filter(F.transform(listed, lambda x: F.trim(x)),
                                 lambda x: (F.length(x) > 3) & (F.length(x) < 60)), limit)
    return F.when(F.size(names) > 0, names).otherwise(fallback)


def experience_claims(text: Column, minimum: int = 3, limit: int | None = None) -> Column:
    years = F.regexp_extract_all(text, F.lit(ci(vocab.EXPERIENCE)), 1)
    return numeric_claims(years, minimum, limit)


def numeric_claims(found: Column, minimum: int, limit: int | None = None) -> Column:
    """Distinct claimed numbers of at least ``minimum``, largest first."""
    numbers = F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x >= minimum)
    return first_of(F.sort_array(F.array_distinct(numbers), False), limit)


def promoters(chapters: DataFrame) -> DataFrame:
    """chapters: (doc_id, promoters, management, group_companies) texts."""
    p, m, g = (F.coalesce(c, F.lit("")) for c in ("promoters", "management", "group_companies"))
    return chapters.select(
        "doc_id", promoter_names(p).alias("names"), experience_claims(F.concat(p, m)).alias("experience_claims"),
        F.regexp_count(m, F.lit(ci(vocab.INDEPENDENT_DIRECTOR))).alias("independent_director_mentions"),
        F.regexp_count(m, F.lit(ci(vocab.WOMAN_DIRECTOR))).alias("woman_director_mentions"),
        F.concat(g, p).rlike(ci(vocab.CONFLICT)).alias("group_company_conflicts"),
        p.rlike(ci(vocab.PAST_VENTURE)).alias("past_ventures_mentioned"))


def keyword_retrieval(sections: DataFrame, question: str, keys: Sequence[str], section_id: str,
                      text: str = "text", k: int = 4, before: int = 500, chars: int = 4000) -> DataFrame:
    """Top ``k`` sections per document by occurrences of the question's words, with an excerpt.

    Every word counts as often as the question holds it; whole texts are searched. Only
    scores are ranked, the winners' texts are joined back by ``section_id`` (unique).
    """
    words = [w for w in re.findall(r"[a-z]{3,}", question.lower()) if w not in vocab.QUESTION_STOP]
    low = F.col("__low")
    score = reduce(lambda a, b: a + b, [
        (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words])
    lowered = sections.withColumn("__low", F.lower(text))
    scored = lowered.filter(low.rlike("|".join(sorted(set(words))))) \
        .select(*keys, section_id, F.round(score).cast("bigint").alias("score"))
    best = top_per_group(scored, keys, [F.col("score").desc(), F.col(section_id)], k, "rank")
    found = lowered.join(best.select(section_id, "score", "rank"), section_id)
    spots = F.array(*[F.nullif(F.locate(w, low), F.lit(0)) for w in words])
    start = F.greatest(F.coalesce(F.array_min(spots), F.lit(1)) - before, F.lit(1))
    return found.withColumn("excerpt", F.substring(text, start, F.lit(chars))).drop("__low")
