"""Ratios, valuation call, forensic screens, the rubric and its scores.

Everything here is a projection of one row per document (its ``years`` array and the
extracted inputs), so a corpus of any size is scored without a further shuffle; the
rules then fan out as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import all_not_null, any_not_null, array_median, array_pstdev, band, lookup, safe_div, stable_round
from .facts import cagr, year

RATIOS = [
    "operating_margin", "net_margin", "roe", "roce", "debt_equity", "current_ratio",
    "asset_turnover", "cfo_to_pat", "cfo_to_ebitda", "interest_cover", "revenue_cagr", "pat_cagr",
]


def ratios(series: DataFrame) -> DataFrame:
    """Classic ratios of the latest year, growth over all years and the margin series."""
    ebit = year("pbt") + year("finance_costs")
    margins = F.transform("years", lambda y: F.struct(
        y["fy"].alias("fy"), safe_div(y["pat"], y["revenue"]).alias("net_margin"),
        safe_div(y["ebitda"], y["revenue"]).alias("operating_margin")))
    return series.withColumns({
        "operating_margin": safe_div(year("ebitda"), year("revenue")),
        "net_margin": safe_div(year("pat"), year("revenue")),
        "roe": safe_div(year("pat"), year("net_worth")),
        "roce": safe_div(ebit, year("net_worth") + year("total_debt")),
        "debt_equity": safe_div(year("total_debt"), year("net_worth")),
        "current_ratio": safe_div(year("current_assets"), year("current_liabilities")),
        "asset_turnover": safe_div(year("revenue"), year("total_assets")),
        "cfo_to_pat": F.when(year("pat") > 0, safe_div(year("cfo"), year("pat"))),
        "cfo_to_ebitda": F.when(year("ebitda") > 0, safe_div(year("cfo"), year("ebitda"))),
        "interest_cover": F.when(year("finance_costs") > 0, safe_div(ebit, year("finance_costs"))),
        "revenue_cagr": cagr("revenue"), "pat_cagr": cagr("pat"), "margin_series": margins,
    })


def growth_steps(metric: str) -> Column:
    """Year-over-year rises of a metric that is known in every year, NULL otherwise."""
    vals = F.transform("years", lambda y: y[metric])
    n = F.size(vals)
    full = F.forall(vals, lambda v: v.isNotNull())
    later, earlier = F.slice(vals, F.lit(1), n - 1), F.slice(vals, F.lit(2), n - 1)
    ups = F.size(F.filter(F.zip_with(later, earlier, lambda a, b: a > b), lambda x: x))
    return F.when((n >= 2) & full, ups)


def peer_medians(peers: DataFrame) -> DataFrame:
    """Median P/E (0 < P/E < 400) and RoNW of each document's listed peers (a printed table)."""
    other = ~F.coalesce("is_issuer", F.lit(False))
    return peers.groupBy("doc_id").agg(
        array_median(F.collect_list(F.when(other & (F.col("pe") > 0) & (F.col("pe") < 400), F.col("pe"))))
        .alias("peer_median"),
        array_median(F.collect_list("ronw")).alias("peer_ronw_median"),
        F.max(F.when(F.col("is_issuer") & (F.col("eps") > 0), F.col("eps"))).alias("issuer_row_eps"))


def valuation(df: DataFrame) -> DataFrame:
    """Peer-relative valuation call with its reasons.

    df: issuer_pe, price_high, issuer_eps, issuer_row_eps, peer_median, pat_cagr. The
    issue P/E is the printed one, else price over the weighted EPS, else price over the
    EPS of the issuer's peer row.
    """
    eps = F.coalesce(F.when(F.col("issuer_eps") > 0, F.col("issuer_eps")), F.col("issuer_row_eps"))
    derived = stable_round(F.nullif("price_high", F.lit(0.0)) / eps, 2)
    pe = F.coalesce("issuer_pe", derived)
    rel = F.when(pe != 0, pe / F.col("peer_median"))
    call = F.when(rel.isNull(), "indeterminate").when(rel < 0.7, "undervalued") \
        .when(rel <= 1.1, "fairly_valued").when(rel <= 1.5, "fairly_valued_expensive") \
        .otherwise("overvalued")
    reasons = F.array_compact(F.array(
        F.when(F.col("issuer_pe").isNull() & derived.isNotNull(),
               F.lit("issue P/E derived from the offer price and the EPS table")),
        F.when(F.col("peer_median").isNull(), F.lit("no usable peer P/E")),
        F.when(pe.isNull(), F.lit("issuer P/E not found")),
        F.when(rel.isNotNull(), F.concat(
            F.lit("issue P/E "), F.format_number(pe, 1), F.lit("x against a peer median of "),
            F.format_number("peer_median", 1), F.lit("x"))),
        F.when((rel > 1.1) & (F.col("pat_cagr") > 0.30), F.lit("premium partly backed by profit growth")),
        F.when(rel.isNotNull(), F.lit("the peer set is chosen by the issuer"))))
    return df.withColumn("__rel", rel).withColumn("__pe", pe).select(
        *[c for c in df.columns if c != "issuer_pe"], F.col("__pe").alias("issuer_pe"),
        (F.col("issuer_pe").isNull() & derived.isNotNull()).alias("issuer_pe_derived"),
        F.round("peer_median", 1).alias("peer_pe_median"), F.round("__rel", 2).alias("relative"),
        call.alias("call"), reasons.alias("reasoning"))


def fill_price(df: DataFrame, low: str, high: str, known: str) -> DataFrame:
    """Known offer price where the document prints none, with a flag."""
    blank = F.col(high).isNull() & F.col(known).isNotNull()
    return df.withColumns({
        low: F.when(blank, F.coalesce(low, known)).otherwise(F.col(low)),
        high: F.coalesce(high, known), "price_injected": blank})


# ------------------------------------------------------------------ forensics

def _nonzero(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & (c != 0)
    return out


def _check(known: Column, name: str, passed: Column, value: Column, decimals: int) -> Column:
    return F.when(known, F.struct(F.lit(name).alias("check"), passed.alias("passed"),
                                  F.round(value, decimals).alias("value")))


def _flag(fires: Column, rule: str, severity: str, value: Column) -> Column:
    return F.when(fires, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                                  F.round(value, 3).alias("value")))


def forensics(series: DataFrame) -> DataFrame:
    """Earnings-quality flags, strength checks, strength score and the score-cap trigger."""
    rev, rev0 = year("revenue"), year("revenue", 1)
    rec, rec0 = year("receivables"), year("receivables", 1)
    pat, pat0 = year("pat"), year("pat", 1)
    cfo, assets = year("cfo"), year("total_assets")
    nw, nw0 = year("net_worth"), year("net_worth", 1)
    debt, debt0 = year("total_debt"), year("total_debt", 1)
    ca, cl = year("current_assets"), year("current_liabilities")
    ca0, cl0 = year("current_assets", 1), year("current_liabilities", 1)
    dsri = safe_div(safe_div(rec, rev), safe_div(rec0, rev0))
    accruals = safe_div(pat - cfo, assets)
    lev, lev0 = safe_div(debt, nw), safe_div(debt0, nw0)
    roe_step = safe_div(pat, nw) - safe_div(pat0, nw0)
    liq, liq0 = safe_div(ca, cl), safe_div(ca0, cl0)
    sales = safe_div(rev, rev0)
    spurt = (safe_div(pat, pat0) - 1) - (sales - 1)
    turns = _nonzero(rev, rev0, rec, rec0)
    worth = _nonzero(nw, nw0)
    flags = F.array(
        _flag(turns & (dsri > 1.4), "receivables_outpace_sales", "high", dsri),
        _flag(_nonzero(assets) & (accruals > 0.10), "high_accruals", "high", accruals),
        _flag(worth & (lev > lev0 + 0.5), "leverage_spike", "medium", lev - lev0),
        _flag(_nonzero(rev, rev0) & (sales > 1.6), "extreme_sales_growth", "medium", sales),
        _flag(_nonzero(pat, pat0, rev, rev0) & (pat0 > 0) & (spurt > 0.5)
              & (safe_div(pat, pat0) - 1 > 0.5), "pre_ipo_profit_spurt", "medium", spurt))
    checks = F.array(
        _check(turns, "receivables_in_line_with_sales", dsri <= 1.4, dsri, 2),
        _check(all_not_null(pat, cfo) & _nonzero(assets), "cfo_exceeds_pat", cfo >= pat, cfo - pat, 1),
        _check(pat.isNotNull() & _nonzero(assets), "positive_roa", pat > 0, safe_div(pat, assets), 3),
        _check(cfo.isNotNull(), "positive_cfo", cfo > 0, cfo, 2),
        _check(all_not_null(pat, pat0) & worth, "improving_roe", roe_step > 0, roe_step, 3),
        _check(all_not_null(debt, debt0) & worth, "leverage_not_rising", lev <= lev0 + 0.05, lev - lev0, 2),
        _check(_nonzero(ca, cl, ca0, cl0), "improving_liquidity", liq >= liq0, liq - liq0, 2))
    return series.withColumn("flags", F.array_compact(flags)) \
        .withColumn("checks", F.array_compact(checks)) \
        .withColumn("strength_passed", F.size(F.filter("checks", lambda c: c["passed"]))) \
        .withColumn("strength_total", F.size("checks")) \
        .withColumn("cap_triggered", F.exists("flags", lambda f: f["severity"] == "high"))


# ------------------------------------------------------------------ rubric

@dataclass
class Rule:
    """One scoring rule: its input value and either own points or a band table."""

    category: str
    rule: str
    points: Column | None
    most: float
    value: Column
    exists: Column | None = None
    bands: str | None = None
    lower: bool = False
    page: str | None = None


def _rule(category: str, rule: str, points: Column, most: float, value: Column,
          exists: Column | None = None, page: str | None = None) -> Rule:
    return Rule(category, rule, points, most, value, exists, page=page)


def _banded(category: str, rule: str, value: Column, most: float, bands: str, lower: bool = False,
            exists: Column | None = None, page: str | None = None) -> Rule:
    return Rule(category, rule, None, most, value, exists, bands, lower, page)


def _rule_rows(profile: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per document and rule.

    Inputs are taken once each in a narrow explode; bands are looked up behind it, so the
    plan holds every input expression once however many bands test it.
    """
    none = F.lit(None)
    cells = F.array(*[F.struct(
        (none if r.points is None else r.points).cast("double").alias("points"), r.value.cast("double").alias("value"),
        F.coalesce(F.lit(True) if r.exists is None else r.exists, F.lit(False)).alias("exists"),
        (F.try_element_at(F.col("source_pages"), F.lit(r.page)) if r.page else none.cast("int")).alias("page"))
        for r in rules])
    rows = profile.select("doc_id", F.posexplode(cells).alias("ord", "r")).filter("r.exists")
    points = F.col("r.points")
    for i, r in enumerate(rules):
        if r.bands:
            points = F.when(F.col("ord") == i, band(F.col("r.value"), vocab.BANDS[r.bands], r.lower)).otherwise(points)

    def fixed(of: Callable[[Rule], str | float]) -> Column:
        return F.element_at(F.array(*[F.lit(of(r)) for r in rules]), F.col("ord") + 1)

    scored = rows.select("doc_id", "ord", "r", points.cast("double").alias("p"))
    return scored.select(
        "doc_id", "ord", fixed(lambda r: r.category).alias("category"), fixed(lambda r: r.rule).alias("rule"),
        F.round("p", 1).alias("points"), fixed(lambda r: float(r.most)).alias("max_points"),
        F.round("r.value", 3).alias("value"),
        fixed(lambda r: " · ".join(f"{t:g}→{p:g}" for t, p in vocab.BANDS[r.bands]) if r.bands else "").alias("thresholds"),
        F.col("r.page").alias("source_page"), F.col("p").isNotNull().alias("included"))


def rubric(profile: DataFrame) -> DataFrame:
    """All scoring rules of all documents, one row per rule.

    profile: years, source_pages (map), the ratio columns, contingent_cr, rpt_cr, call,
    relative, issuer_pe, pre/post_issue_promoter_pct, fresh_issue_cr, ofs_cr, pledged,
    criminal, qualified, emphasis_of_matter, dividend_declared, risk_score,
    peer_ronw_median, leadership_claim. A missing input gives points NULL and
    included false, never zero.
    """
    c = F.col
    zero = F.lit(0.0)
    net = F.filter(F.transform("margin_series", lambda m: m["net_margin"]), lambda x: x.isNotNull())
    spread = F.when(F.size(net) >= 2, array_pstdev(net) * 100)
    rev, nw = year("revenue"), year("net_worth")
    ups, n = growth_steps("revenue"), F.size("years")
    peg = F.when((c("issuer_pe") != 0) & (c("pat_cagr") > 0), c("issuer_pe") / F.nullif(c("pat_cagr") * 100, zero))
    total = F.coalesce("fresh_issue_cr", zero) + F.coalesce("ofs_cr", zero)
    ofs_share = F.when(any_not_null(c("fresh_issue_cr"), c("ofs_cr")),
                       F.coalesce(F.coalesce("ofs_cr", zero) / F.nullif(total, zero) * 100, zero))
    dilution = c("pre_issue_promoter_pct") - c("post_issue_promoter_pct")
    known_cfo = F.filter(F.transform("years", lambda y: y["cfo"]), lambda x: x.isNotNull())
    positive = F.size(F.filter(known_cfo, lambda x: x > 0))
    fcf = year("cfo") - F.abs(year("capex"))
    qualified, emphasis = F.coalesce("qualified", F.lit(False)), F.coalesce("emphasis_of_matter", F.lit(False))
    pledged = F.coalesce("pledged", F.lit(False))
    flag = {True: 1.0, False: 0.0}
    return _rule_rows(profile, [
        _banded("business_quality", "operating_margin_level", c("operating_margin") * 100, 20, "operating_margin_level", page="ebitda"),
        _banded("business_quality", "margin_stability", spread, 10, "margin_stability", True, page="pat"),
        _banded("business_quality", "revenue_scale", rev, 10, "revenue_scale", page="revenue"),
        _banded("financial_health", "debt_to_equity", c("debt_equity"), 25, "debt_to_equity", True, page="total_debt"),
        _banded("financial_health", "current_ratio", c("current_ratio"), 15, "current_ratio", page="current_assets"),
        _banded("financial_health", "interest_cover", c("interest_cover"), 10, "interest_cover", page="finance_costs"),
        _banded("financial_health", "contingent_liabilities", c("contingent_cr") / F.nullif(nw, zero) * 100, 10,
                "contingent_liabilities", True),
        _banded("growth", "revenue_cagr", c("revenue_cagr") * 100, 20, "cagr", page="revenue"),
        _banded("growth", "pat_cagr", c("pat_cagr") * 100, 20, "cagr", page="pat"),
        _rule("growth", "growth_consistency", 10.0 * ups / F.nullif((n - 1).cast("double"), zero), 10, ups,
              exists=(n >= 3) & ups.isNotNull(), page="revenue"),
        _rule("valuation", "peer_relative_pe", lookup(c("call"), vocab.CALL_POINTS), 30, c("relative")),
        _banded("valuation", "absolute_pe", c("issuer_pe"), 10, "absolute_pe", True),
        _banded("valuation", "growth_adjusted_pe", peg, 10, "growth_adjusted_pe", True),
        _banded("promoter_quality", "post_issue_holding", c("post_issue_promoter_pct"), 15, "post_issue_holding"),
        _banded("promoter_quality", "ofs_share_of_issue", ofs_share, 15, "ofs_share_of_issue", True),
        _rule("promoter_quality", "no_pledging", F.when(pledged, 0.0).otherwise(10.0), 10,
              F.when(pledged, flag[True]).otherwise(flag[False])),
        _banded("promoter_quality", "dilution_size", dilution, 10, "dilution_size", True, exists=dilution.isNotNull()),
        _banded("governance", "rpt_intensity", c("rpt_cr") / F.nullif(rev, zero) * 100, 10, "rpt_intensity", True),
        _rule("governance", "criminal_proceedings",
              F.when(c("criminal") == 0, 10.0).when(c("criminal") <= 2, 4.0).when(c("criminal") > 2, 0.0),
              10, c("criminal")),
        _rule("governance", "audit_opinion", F.when(qualified, 0.0).when(emphasis, 5.0).otherwise(10.0), 10,
              F.lit(None)),
        _rule("governance", "dividend_track", F.when(c("dividend_declared"), 5.0).when(~c("dividend_declared"), 3.0), 5,
              c("dividend_declared").cast("int")),
        _rule("risk_level", "risk_penalty_model", F.coalesce("risk_score", F.lit(50.0)), 100,
              F.coalesce("risk_score", F.lit(50.0))),
        _banded("competitive_position", "returns_vs_peers", c("roe") * 100 - c("peer_ronw_median"), 15, "returns_vs_peers"),
        _rule("competitive_position", "market_position_claim",
              F.when(c("leadership_claim"), 5.0).otherwise(3.0), 5,
              F.coalesce("leadership_claim", F.lit(False)).cast("int")),
        _banded("capital_efficiency", "roe", c("roe") * 100, 15, "return_on_capital", page="pat"),
        _banded("capital_efficiency", "roce", c("roce") * 100, 15, "return_on_capital", page="pbt"),
        _rule("cash_generation", "cfo_positive_years",
              F.when(F.size(known_cfo) > 0, 10.0 * positive / F.nullif(F.size(known_cfo).cast("double"), zero)), 10,
              F.when(F.size(known_cfo) > 0, positive), exists=n > 0, page="cfo"),
        _banded("cash_generation", "cfo_to_pat", c("cfo_to_pat"), 20, "cfo_to_pat", page="cfo"),
        _rule("cash_generation", "free_cash_flow", F.when(fcf > 0, 10.0).when(fcf.isNotNull(), 3.0), 10, fcf,
              page="capex")])


def category_scores(rules: DataFrame) -> DataFrame:
    """Score 0..100 (50 without any included rule) and coverage per document and category."""
    got = F.sum(F.when(F.col("included"), F.col("points")))
    most = F.sum(F.when(F.col("included"), F.col("max_points")))
    per = rules.groupBy("doc_id", "category").agg(
        got.alias("g"), most.alias("m"), F.sum("max_points").alias("all"))
    return per.select(
        "doc_id", "category",
        F.coalesce(stable_round(100 * F.col("g") / F.nullif("m", F.lit(0.0)), 1), F.lit(50.0)).alias("score"),
        stable_round(F.coalesce("m", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("all")), 2).alias("coverage"))


def overall_scores(scores: DataFrame, caps: DataFrame,
                   lenses: Mapping[str, Sequence[float]] = vocab.LENSES,
                   categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Weighted overall score of every lens in one pass, with the forensic cap and confidence.

    A category without rules counts 50 with no coverage. caps: (doc_id, cap_triggered).
    """
    aggs = []
    for cat in categories:
        hit = F.col("category") == cat
        aggs += [F.coalesce(F.max(F.when(hit, F.col("score"))), F.lit(50.0)).alias(f"s_{cat}"),
                 F.coalesce(F.max(F.when(hit, F.col("coverage"))), F.lit(0.0)).alias(f"c_{cat}")]
    wide = scores.groupBy("doc_id").agg(*aggs).join(caps, "doc_id", "left")

    def weighted(prefix: str, weights: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for cat, w in zip(categories, weights):
            out = out + F.col(f"{prefix}_{cat}") * w
        return out

    per_lens = F.array(*[F.struct(F.lit(lens).alias("lens"), stable_round(weighted("s", w), 1).alias("raw"),
                                  F.round(weighted("c", w), 6).alias("cov")) for lens, w in lenses.items()])
    rows = wide.select("doc_id", "cap_triggered", F.explode(per_lens).alias("l"))
    capped = F.coalesce("cap_triggered", F.lit(False)) & (F.col("l.raw") > vocab.FORENSIC_CAP)
    cov = F.col("l.cov")
    return rows.select(
        "doc_id", F.col("l.lens").alias("lens"),
        F.when(capped, F.lit(vocab.FORENSIC_CAP)).otherwise(F.col("l.raw")).alias("overall"),
        capped.alias("capped"), F.round(cov, 2).alias("coverage"),
        F.when(cov >= 0.8, "high").when(cov >= 0.5, "medium").otherwise("low").alias("confidence"))
