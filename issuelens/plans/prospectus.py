"""The whole path from decoded pages to scored reports, for all documents at once.

One declarative job per stage; a stage's table is written (checkpointed) once because
several later stages read it. A missing input anywhere becomes NULL through left joins
and excludes its rules; no document fails another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import ci
from ..session import materialise
from . import analysis, entities, facts, report, risks, sections

STATEMENTS = ["financial_statements", "other_financial_info", "offer_summary"]
CHAPTER_TEXTS = ["risk_factors", "our_business", "promoters", "management", "group_companies",
                 "objects_of_offer", "litigation", "dividend_policy", "mdna", "industry_overview"]


def analyse(spark: SparkSession, pages: DataFrame, toc: DataFrame, cells: DataFrame,
            prices: DataFrame | None = None, lens: str = "balanced") -> dict[str, DataFrame]:
    """Tables sections, facts, issue, findings, rules, scores and reports.

    pages (doc_id, n, text), toc (doc_id, level, title, page), cells (doc_id, page,
    table_no, row_no, col_no, text); prices (doc_id, offer_price) fills the price of
    drafts that print none.
    """
    docs = materialise(sections.low_text(pages).withColumnRenamed("pages", "page_count"))
    located = materialise(sections.locate_sections(pages, toc, spark))
    spans = located.filter("found").select("doc_id", "key", "page_start", "page_end")

    scan = facts.anchor_pages(pages, spans, STATEMENTS)
    found = materialise(facts.extract_facts(pages, cells, scan))
    years = facts.series(facts.wide_years(found))

    texts = located.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("text"))).alias(k) for k in CHAPTER_TEXTS],
        F.max(F.when(F.col("key") == "risk_factors", F.col("page_start"))).alias("risk_page"),
        F.max(F.when(F.col("key") == "litigation", F.col("page_start"))).alias("litigation_page"))
    covers = sections.issuer_names(pages).select("doc_id", "company_name")
    pricing = entities.page_ranges(spans, ["basis_for_offer_price"])
    priced = _cells_within(cells, pricing)
    capital = _cells_within(cells, entities.page_ranges(spans, ["capital_structure"]))
    statements = entities.page_ranges(spans, ["financial_statements"])
    audited = _pages_within(pages, statements)

    issue = _issue(pages, spans, docs, capital, prices)
    kinds = entities.litigation_counts(F.coalesce("litigation", F.lit("")))
    told = texts.select(
        "doc_id", *CHAPTER_TEXTS, "risk_page", "litigation_page", *[c.alias(f"cases_{k}") for k, c in kinds.items()],
        entities.dividend(F.coalesce("dividend_policy", F.lit(""))).alias("dividend_declared"),
        F.coalesce("our_business", F.lit("")).rlike(ci(vocab.LEADERSHIP_CLAIM)).alias("leadership_claim"))
    cases = [F.coalesce(f"cases_{k}", F.lit(0)) for k in kinds]
    pledge = entities.pledging(pages, entities.page_ranges(spans, ["capital_structure", "risk_factors"])) \
        .select("doc_id", "pledged", F.col("evidence").alias("pledge_evidence"), F.col("source_page").alias("pledge_page"))

    joined = docs.join(covers, "doc_id", "left").join(years, "doc_id", "left").join(told, "doc_id", "left") \
        .withColumn("years", F.coalesce("years", F.array().cast(years.schema["years"].dataType)))
    for extra in (
            issue, facts.source_pages(found), pledge,
            entities.auditor_flags(audited).drop("source_page"),
            entities.related_party(audited, cells).select("doc_id", F.col("total_cr").alias("rpt_cr")),
            entities.contingent(audited, cells).select("doc_id", F.col("total_cr").alias("contingent_cr")),
            entities.issuer_pe(pages, pricing).select("doc_id", "issuer_pe"),
            entities.weighted_eps(priced).select("doc_id", F.col("eps").alias("issuer_eps")),
            analysis.peer_medians(entities.peers(priced, covers))):
        joined = joined.join(extra, "doc_id", "left")
    staged = joined.withColumns({
        "risk_text": F.coalesce("risk_factors", F.lit("")), "business_text": F.coalesce("our_business", F.lit("")),
        "criminal": F.col("cases_criminal"), "total_cases": sum(cases[1:], cases[0]),
        "price_high": F.col("price_band_high"),
        "source_pages": F.coalesce("source_pages", F.create_map().cast("map<string,int>"))})
    profile = materialise(analysis.valuation(analysis.ratios(analysis.forensics(staged))))

    findings = materialise(risks.risk_findings(profile))
    profile = profile.join(risks.penalty_score(findings, docs), "doc_id", "left")
    rules = materialise(analysis.rubric(profile))
    scores = analysis.category_scores(rules)
    overall = analysis.overall_scores(scores, profile.select("doc_id", "cap_triggered")).filter(F.col("lens") == lens)
    flags = profile.select("doc_id", F.posexplode("flags").alias("ord", "x")).select("doc_id", "ord", "x.rule")
    object_lines = entities.objects(sections.doc_lines(
        profile.select("doc_id", F.coalesce("objects_of_offer", F.lit("")).alias("text"))))
    boilerplate = profile.select("doc_id", *risks.specificity(F.col("risk_text")))
    base = profile.join(overall, "doc_id").withColumn(
        "verdict", report.verdict(F.col("overall"), F.col("call"), F.col("risk_score")))
    reports = report.assemble(
        base.select("doc_id", "company_name", "page_count", "readable_ratio", "lens", "overall", "capped", "coverage",
                    "confidence", "verdict", "call", "relative", "issuer_pe", "peer_pe_median", "risk_score",
                    *analysis.RATIOS),
        rules, findings, report.case_lists(rules, findings, flags),
        report.questions(profile, object_lines, findings, rules, boilerplate),
        located, report.summary_lines(base))
    return {"sections": located, "facts": found, "issue": issue, "findings": findings, "rules": rules,
            "scores": scores, "reports": reports.join(sections.hit_rate(located), "doc_id", "left")}


def _pages_within(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    return pages.join(ranges, "doc_id").filter(F.col("n").between(F.col("lo"), F.col("hi"))) \
        .select("doc_id", "n", "text")


def _cells_within(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    inside = cells.join(ranges, "doc_id").filter(F.col("page").between(F.col("lo"), F.col("hi")))
    return inside.select("doc_id", "page", "table_no", "row_no", "col_no", "text")


def _issue(pages: DataFrame, spans: DataFrame, docs: DataFrame, capital: DataFrame,
           prices: DataFrame | None) -> DataFrame:
    """Issue details with the table fallback for the holding and the known price."""
    details = entities.issue_details(pages, spans, docs)
    held = entities.post_issue_holding(capital).select(
        "doc_id", F.col("post_issue_promoter_pct").alias("__held"))
    out = details.join(held, "doc_id", "left").withColumn(
        "post_issue_promoter_pct", F.coalesce("post_issue_promoter_pct", "__held")).drop("__held")
    if prices is None:
        return out
    known = out.join(prices.select("doc_id", "offer_price"), "doc_id", "left")
    return analysis.fill_price(known, "price_band_low", "price_band_high", "offer_price").drop("offer_price")
