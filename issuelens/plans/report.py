"""Report assembly: verdict, cases, questions and the nested report row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import fmt_cr, lookup, severity_rank, tier
from ..operators.ordering import top_per_group
from .facts import year


def verdict(overall: Column, call: Column, risk: Column) -> Column:
    label = F.coalesce(lookup(call, vocab.CALL_LABELS), F.lit(vocab.CALL_LABELS["indeterminate"]))
    return F.concat_ws(" · ", tier(overall, vocab.QUALITY_TIERS, vocab.QUALITY_FLOOR), label,
                       tier(F.coalesce(risk, F.lit(50.0)), vocab.RISK_TIERS, vocab.RISK_FLOOR))


def strong_weak(rules: DataFrame, k: int = 7) -> DataFrame:
    """Strongest (ratio at least .72) and weakest (at most .35) rules of each document, k a side."""
    ratio = F.col("points") / F.col("max_points")
    rated = rules.filter("included AND max_points >= 5").withColumn("ratio", ratio)
    strong = rated.filter("ratio >= 0.72").withColumn("side", F.lit("strong")) \
        .withColumn("key", -F.col("ratio") * F.col("max_points"))
    weak = rated.filter("ratio <= 0.35").withColumn("side", F.lit("weak")) \
        .withColumn("key", F.col("ratio") - F.col("max_points") / 30)
    return top_per_group(strong.unionByName(weak), ["doc_id", "side"],
                         [F.col("key"), F.col("ord")], k, "rank").drop("key")


def case_lists(rules: DataFrame, findings: DataFrame, flags: DataFrame) -> DataFrame:
    """Bull, bear and neutral statements under their caps.

    Bear: weakest rules, then severe findings up to nine entries, then forensic flags
    up to ten. Neutral: up to eight rules without an answer. Bull: strongest rules.
    """
    sides = strong_weak(rules)
    text = F.translate("rule", "_", " ")
    bull = sides.filter("side = 'strong'").select(
        "doc_id", F.lit("bull").alias("side"), F.lit(0).alias("source"), F.col("rank").alias("ord"), text.alias("text"))
    weak = sides.filter("side = 'weak'").select(
        "doc_id", F.lit("bear").alias("side"), F.lit(0).alias("source"), F.col("rank").alias("ord"), text.alias("text"))
    severe = findings.filter(severity_rank(F.col("severity")) >= 2).select(
        "doc_id", F.lit("bear").alias("side"), F.lit(1).alias("source"),
        (F.col("ord") - 1000 * severity_rank(F.col("severity"))).alias("ord"), F.col("title").alias("text"))
    marks = flags.select("doc_id", F.lit("bear").alias("side"), F.lit(2).alias("source"), "ord",
                         F.translate("rule", "_", " ").alias("text"))
    unknown = rules.filter(~F.col("included")).select(
        "doc_id", F.lit("neutral").alias("side"), F.lit(0).alias("source"), "ord", text.alias("text"))
    every = bull.unionByName(weak).unionByName(severe).unionByName(marks).unionByName(unknown)
    return capped_lists(every, ["doc_id"])


def capped_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Union of ranked sources under the caps of the report.

    rows: keys, side, source, ord, text. Source 1 may fill a bear list to nine entries,
    source 2 to ten.
    """
    ranked = top_per_group(rows, [*keys, "side", "source"], [F.col("ord"), F.col("text")], 10, "__r")
    at = top_per_group(ranked.filter("source < 2"), [*keys, "side"],
                       [F.col("source"), F.col("__r")], 9, "rank")
    used = at.groupBy(*keys, "side").agg(F.max("rank").alias("__u"))
    extra = ranked.filter("source = 2").join(used, [*keys, "side"], "left") \
        .withColumn("rank", F.coalesce("__u", F.lit(0)) + F.col("__r")).drop("__u")
    every = at.unionByName(extra.select(at.columns)).drop("__r")
    cap = F.when(F.col("side") == "bear", 10).when(F.col("side") == "neutral", 8).otherwise(7)
    return every.filter(F.col("rank") <= cap)


def ordered_distinct(rows: DataFrame, keys: list[str], text: str, ordinal: str, limit: int = 10) -> DataFrame:
    """Distinct texts in order of first appearance, at most ``limit`` per group."""
    once = rows.groupBy(*keys, text).agg(F.min(ordinal).alias(ordinal))
    return top_per_group(once, keys, [F.col(ordinal), F.col(text)], limit, "rank")


def questions(issue: DataFrame, objects: DataFrame, findings: DataFrame, rules: DataFrame,
              boilerplate: DataFrame) -> DataFrame:
    """Questions a reader should put to management, distinct and at most ten a document."""
    def ask(df: DataFrame, when: Column, base: Column, text: Column | str) -> DataFrame:
        t = F.lit(text) if isinstance(text, str) else text
        return df.filter(when).select("doc_id", base.cast("bigint").alias("ord"), t.alias("question"))

    severe = F.col("severity").isin("high", "critical")
    at = F.col("ord").cast("bigint")
    unknown = top_per_group(rules.filter(~F.col("included")), ["doc_id"], [F.col("ord")], 5, "u")
    parts = [
        ask(issue, (F.col("ofs_cr") > 0) & (F.coalesce("fresh_issue_cr", F.lit(0.0)) < F.col("ofs_cr")), F.lit(0),
            "Why do existing holders sell more than the company raises?"),
        ask(objects, F.col("category") == "debt_repayment", 1000 + F.col("rank") * 2,
            "What did the debt to be repaid finance, and what did it return?"),
        ask(objects, F.col("category") == "general_corporate", 1001 + F.col("rank") * 2,
            "What exactly will the general corporate money pay for?"),
        ask(findings, (F.col("risk_type") == "customer_concentration") & severe, 2000 + at,
            "Which contracts protect the revenue of the top customers, and when do they renew?"),
        ask(findings, F.col("risk_type") == "negative_cash_flow", 2000 + at,
            "When will operating cash flow turn positive for good?"),
        ask(findings, F.col("risk_type") == "promoter_pledging", 2000 + at,
            "How and when will the promoters release their pledge?"),
        ask(unknown, F.lit(True), 4000 + F.col("u"), F.concat(
            F.lit("The document is silent on "), F.translate("rule", "_", " "), F.lit(": what is the answer?"))),
        ask(boilerplate, F.col("specificity_ratio") < 0.35, F.lit(5000),
            "Most risk factors are generic: which five worry management most?"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return ordered_distinct(rows, ["doc_id"], "question", "ord")


def summary_lines(df: DataFrame) -> DataFrame:
    """Summary paragraphs of each report from its facts, one row per paragraph."""
    rev, pat = year("revenue"), year("pat")
    fresh, ofs = F.coalesce("fresh_issue_cr", F.lit(0.0)), F.coalesce("ofs_cr", F.lit(0.0))
    lines = F.array(
        F.when(rev.isNotNull(), F.concat(F.lit("Revenue "), fmt_cr(rev), F.lit(", profit after tax "), fmt_cr(pat), F.when(
            F.col("revenue_cagr").isNotNull(),
            F.concat(F.lit(", revenue growing "), F.format_number(F.col("revenue_cagr") * 100, 0), F.lit("% a year")))
            .otherwise(F.lit("")))),
        F.when(F.col("total_issue_cr") > 0, F.concat(
            F.lit("Offer "), fmt_cr(F.col("total_issue_cr")), F.lit(": "), fmt_cr(fresh), F.lit(" fresh, "), fmt_cr(ofs),
            F.lit(" sold by holders ("), F.format_number(
                ofs / F.nullif("total_issue_cr", F.lit(0.0)) * 100, 0), F.lit("%)"))),
        F.when(F.col("issuer_pe").isNotNull() & F.col("peer_pe_median").isNotNull(), F.concat(
            F.lit("Priced at "), F.format_number("issuer_pe", 1), F.lit("x earnings, peers at "),
            F.format_number("peer_pe_median", 1), F.lit("x"))),
        F.concat(F.col("verdict"), F.lit(" — "), F.format_number("overall", 0), F.lit("/100")))
    return df.select("doc_id", F.posexplode(lines).alias("ord", "text")).filter(F.col("text").isNotNull())


def assemble(base: DataFrame, rules: DataFrame, findings: DataFrame, cases: DataFrame,
             asked: DataFrame, sections: DataFrame, lines: DataFrame) -> DataFrame:
    """One nested report row per document; every list is bounded by its own caps or rule set."""
    def listed(df: DataFrame, name: str, order: str, cols: list[str]) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(
            F.struct(order, *[c for c in cols if c != order]))).alias(name))

    out = base
    for part in (listed(rules, "rules", "ord", ["category", "rule", "points", "max_points", "value", "included"]),
                 listed(findings, "findings", "ord", ["risk_type", "severity", "title"]),
                 listed(asked, "questions", "rank", ["question"]),
                 listed(sections, "sections_index", "canon", ["key", "title", "found", "page_start", "page_end", "method"]),
                 listed(lines, "executive_summary", "ord", ["text"])):
        out = out.join(part, "doc_id", "left")
    sides = cases.groupBy("doc_id").pivot("side", ["bull", "bear", "neutral"]).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))))
    packed = sides.select("doc_id", F.struct("bull", "bear", "neutral").alias("cases"))
    return out.join(packed, "doc_id", "left")
