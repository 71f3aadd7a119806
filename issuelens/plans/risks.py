"""Risk findings, their ranking and the derived scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import ci, extract, let, literal_map, pct_severity, severity_rank, snippet
from .facts import year


def _finding(fires: Column, kind: str, severity: Column | str, title: Column | str,
             metric: str | None = None, value: Column | None = None,
             evidence: Column | None = None, page: Column | None = None) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    head = F.lit(title) if isinstance(title, str) else title
    none = F.lit(None)
    return F.when(fires, F.struct(
        F.lit(kind).alias("risk_type"), sev.alias("severity"), head.alias("title"),
        (evidence if evidence is not None else none.cast("string")).alias("evidence_text"),
        (page if page is not None else none).cast("int").alias("source_page"),
        F.lit(metric).cast("string").alias("metric"),
        (value if value is not None else none).cast("double").alias("value")))


_REACH = 120
_CONTEXT = rf"[^.\n]{{0,{_REACH}}}"


def _core(pattern: str) -> str:
    """Pattern without its optional context, which widens the evidence but never decides."""
    return pattern.removeprefix(_CONTEXT).removesuffix(_CONTEXT).removesuffix(r"[^.\n]{0,100}")


def _around(text: Column, pattern: str) -> Column:
    """Context of the first match."""
    return let(F.regexp_extract(text, pattern, 0), lambda match: snippet(text, F.position(match, text), F.length(match)))


def _with_context(text: Column, pattern: str, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(start, match)`` of the first match of a pattern with optional context, in a text that holds its core.

    The match begins up to ``_REACH`` characters before the first match of the core, behind the
    last stop or line end there. Searched from the start of the text, the context would be tried
    at every character.
    """
    def begin(core: Column) -> Column:
        at = F.position(core, text)
        before = F.substring(text, F.greatest(at - _REACH, F.lit(1)), F.least(at - 1, F.lit(_REACH)))
        return at - F.length(F.substring_index(F.substring_index(before, ".", -1), "\n", -1))

    found = let(F.regexp_extract(text, ci(_core(pattern)), 0), begin)
    whole = lambda start: F.regexp_extract(F.substring(text, start, F.length(text)), ci(pattern), 0)
    return let(found, lambda start: let(whole(start), lambda match: fn(start, match)))


def risk_findings(profile: DataFrame) -> DataFrame:
    """All rules of all documents in one narrow pass, one row per finding.

    profile: doc_id, risk_text, business_text, risk_page, source_pages, years, criminal, total_cases,
    litigation_page, pledged, pledge_evidence, pledge_page.
    """
    exports = ci(vocab.EXPORT_SHARE)
    shares = {kind: ci(vocab.CONCENTRATION.format(noun=noun)) for kind, (noun, _, _) in vocab.CONCENTRATION_BANDS.items()}
    profile = profile.withColumn("__both", F.concat_ws("\n", "risk_text", "business_text"))
    risk, both = F.col("risk_text"), F.col("__both")
    # figures of the text that several columns of a finding need, each searched once
    profile = profile.withColumns({f"__{kind}": extract(both, share) for kind, share in {**shares, "exports": exports}.items()})
    rp = F.col("risk_page")

    def stated(metric: str) -> Column:
        """Page of the statement that a figure was read from."""
        return F.coalesce(F.try_element_at("source_pages", F.lit(metric)), rp)

    found: list[Column] = []
    for kind, (noun, label, bands) in vocab.CONCENTRATION_BANDS.items():
        pct = F.col(f"__{kind}").cast("double")
        found.append(_finding(pct.isNotNull(), kind, pct_severity(pct, bands),
                              F.concat(F.lit(f"Top {label} concentration: "), F.format_number(pct, 0), F.lit("%")),
                              f"top_{label}_share_pct", pct, _around(both, shares[kind]), rp))
        vague = ci(vocab.DEPENDENCE.format(noun=noun))
        found.append(_finding(pct.isNull() & both.rlike(vague), kind, "medium",
                              f"Dependence on limited {label}s (unquantified)", page=rp))

    debt, worth = year("total_debt"), year("net_worth")
    de = F.when(worth > 0, debt / F.nullif(worth, F.lit(0.0)))
    found.append(_finding(de >= 0.75, "debt_burden",
                          F.when(de >= 2, "critical").when(de >= 1.25, "high").otherwise("medium"),
                          F.concat(F.lit("Debt/Equity "), F.format_number(de, 2)),
                          "debt_equity", F.round(de, 2), page=stated("total_debt")))
    assets, owed = year("current_assets"), year("current_liabilities")
    cr = F.when(owed > 0, assets / F.nullif(owed, F.lit(0.0)))
    found.append(_finding(cr < 1.1, "working_capital",
                          F.when(cr < 0.9, "high").otherwise("medium"),
                          F.concat(F.lit("Current ratio "), F.format_number(cr, 2)),
                          "current_ratio", F.round(cr, 2), page=stated("current_assets")))
    found.append(_finding(~F.coalesce(cr < 1.1, F.lit(False)) & both.rlike(ci(_core(vocab.NEGATIVE_WORKING_CAPITAL))), "working_capital", "medium",
                          "Negative working capital disclosed", evidence=_with_context(both, vocab.NEGATIVE_WORKING_CAPITAL, lambda start, match: match), page=rp))
    minus = F.filter("years", lambda y: y["cfo"] < 0)
    n_minus = F.size(minus)
    fys = F.array_join(F.transform(minus, lambda y: F.concat(F.lit("FY"), F.lpad(
        y["fy"].cast("string"), 2, "0"))), ", ")
    found.append(_finding(n_minus > 0, "negative_cash_flow",
                          F.when(n_minus >= 2, "high").otherwise("medium"),
                          F.concat(F.lit("Negative operating cash flow in "), fys),
                          "cfo_negative_years", n_minus, page=stated("cfo")))
    found.append(_finding(F.coalesce(n_minus, F.lit(0)).isin(0, -1) & risk.rlike(ci(vocab.NEGATIVE_CASH_FLOW)),
                          "negative_cash_flow", "medium",
                          "Company discloses history of negative cash flows", page=rp))
    crim = F.col("criminal")
    lp = F.coalesce("litigation_page", "risk_page")
    found.append(_finding(crim > 0, "litigation", F.when(crim > 2, "high").otherwise("medium"),
                          F.concat(crim.cast("string"), F.lit(" criminal proceeding(s) outstanding")),
                          "criminal_cases", crim, page=lp))
    cases = F.col("total_cases")
    found.append(_finding(cases > 20, "litigation", "medium",
                          F.concat(cases.cast("string"), F.lit(" total legal proceedings outstanding")), page=lp))
    found.append(_finding(F.col("pledged"), "promoter_pledging", "high", "Promoter share pledging disclosed",
                          evidence=F.col("pledge_evidence"), page=F.coalesce("pledge_page", "risk_page")))
    for kind, pattern, severity, title in vocab.RISK_PATTERNS:
        found.append(_finding(risk.rlike(ci(_core(pattern))), kind, severity, title,
                              evidence=_with_context(risk, pattern, lambda start, match: snippet(risk, start, F.length(match))), page=rp))
    share = F.col("__exports").cast("double")
    found.append(_finding(share >= 30, "forex_exposure", "medium",
                          F.concat(F.lit("Exports ≈ "), F.col("__exports"), F.lit("% of revenue")),
                          "export_share_pct", share, _around(both, exports), rp))
    rows = profile.select("doc_id", F.posexplode(F.array(*found)).alias("ord", "f")) \
        .filter(F.col("f").isNotNull()).select("doc_id", "ord", "f.*")
    return dedupe_max(rows, ["doc_id", "risk_type"], "title", "severity", "ord")


def dedupe_max(findings: DataFrame, keys: Sequence[str], title: str, severity: str,
               order: str) -> DataFrame:
    """Most severe finding per key and title; a tie keeps the first."""
    rest = [c for c in findings.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(severity_rank(F.col(severity)), -F.col(order))).alias("b")
    return findings.withColumn("__t", F.col(title)).groupBy(*keys, "__t").agg(best) \
        .select(*keys, "b.*")


def heatmap(findings: DataFrame, docs: DataFrame, classes: Sequence[str] = tuple(vocab.RISK_CLASSES)
            ) -> DataFrame:
    """Worst severity and count per document and risk class, 'none' where there is nothing."""
    per = findings.groupBy("doc_id", "risk_type").agg(
        F.max(severity_rank(F.col("severity"))).alias("sev"), F.count("*").alias("count"))
    grid = docs.select("doc_id", F.explode(F.array(*[F.lit(c) for c in classes])).alias("risk_type"))
    names = F.get(F.array(*[F.lit(s) for s in vocab.SEVERITIES]), F.col("sev"))
    return grid.join(per, ["doc_id", "risk_type"], "left").select(
        "doc_id", "risk_type", F.coalesce(names, F.lit("none")).alias("severity"),
        F.coalesce("count", F.lit(0)).alias("count"))


def penalty_score(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """100 less the penalties of all findings, never below zero."""
    penalty = F.try_element_at(literal_map(vocab.SEVERITY_PENALTY), F.col("severity"))
    per = findings.groupBy("doc_id").agg(F.sum(penalty).alias("p"))
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.greatest(F.lit(0.0), 100 - F.coalesce("p", F.lit(0.0))).alias("risk_score"))


def severity_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key).pivot("severity", vocab.SEVERITIES).count().fillna(0, vocab.SEVERITIES)


def specificity(text: Column, split: str = vocab.PARAGRAPH_BREAK, min_chars: int = 200,
                specific: str = vocab.SPECIFIC_FIGURE) -> list[Column]:
    """Long paragraphs of a risk chapter and how many of them state a figure."""
    paras = F.filter(F.split(text, split), lambda p: F.length(F.trim(p)) > min_chars)
    stated = F.filter(paras, lambda p: p.rlike(specific))
    total, hits = F.size(paras), F.size(stated)
    ratio = F.round(hits / F.nullif(total.cast("double"), F.lit(0.0)), 2)
    return [total.alias("total_factors"), hits.alias("specific"), ratio.alias("specificity_ratio")]


def narrative_check(text: Column, revenue_cagr: Column, claim: str = vocab.GROWTH_CLAIM) -> Column:
    """True when the text praises growth that the figures do not show."""
    return text.rlike(ci(claim)) & (revenue_cagr < vocab.GROWTH_CLAIM_MIN_CAGR)
