"""Analysis rules: ratios, valuation, forensics, rubric, scores, report and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import lookup
from ..plans import analysis, dataset, forecast, report, risks
from ..session import materialise
from .base import R, SUBSCRIPTION, WIDE, fiscal_series, query, subscription, table

_RATIO_SQL = {
    "operating_margin": "t0.ebitda / nullif(t0.revenue, 0)", "net_margin": "t0.pat / nullif(t0.revenue, 0)",
    "roe": "t0.pat / nullif(t0.net_worth, 0)",
    "roce": "(t0.pbt + t0.finance_costs) / nullif(t0.net_worth + t0.total_debt, 0)",
    "debt_equity": "t0.total_debt / nullif(t0.net_worth, 0)",
    "current_ratio": "t0.current_assets / nullif(t0.current_liabilities, 0)",
    "asset_turnover": "t0.revenue / nullif(t0.total_assets, 0)",
    "cfo_to_pat": "CASE WHEN t0.pat > 0 THEN t0.cfo / t0.pat END",
    "cfo_to_ebitda": "CASE WHEN t0.ebitda > 0 THEN t0.cfo / t0.ebitda END",
    "interest_cover": "CASE WHEN t0.finance_costs > 0 THEN (t0.pbt + t0.finance_costs) / t0.finance_costs END",
    "revenue_cagr": "CASE WHEN t0.n_years >= 2 AND t0.revenue > 0 AND told.revenue > 0 THEN pow(t0.revenue / told.revenue, 1.0 / (t0.n_years - 1)) - 1 END",
    "pat_cagr": "CASE WHEN t0.n_years >= 2 AND t0.pat > 0 AND told.pat > 0 THEN pow(t0.pat / told.pat, 1.0 / (t0.n_years - 1)) - 1 END",
}
RATIOS = f"""{WIDE}, ratios AS (SELECT t0.doc_id, t0.n_years, {', '.join(f'{e} AS {n}' for n, e in _RATIO_SQL.items())}
  FROM t0 JOIN told USING (doc_id))"""


@query("ratios", f"WITH {RATIOS} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in _RATIO_SQL)} FROM ratios")
def ratios(spark, sf):
    r = analysis.ratios(fiscal_series(spark, sf))
    return r.select("doc_id", *[F.round(c, 6).alias(c) for c in analysis.RATIOS])


# --- disclosures of a document: taken from its customer row and orders --------------------
def disclosures(spark, sf):
    """Extracted inputs per customer: issue sizes, holdings and disclosure flags."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("fresh_issue_cr"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2).alias("ofs_cr"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))), 2).alias("contingent_cr"),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"),
        F.count("*").alias("orders"), F.max("o_totalprice").alias("price_high"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_acctbal", "c_mktsegment", "c_nationkey")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    pre = F.when(bal > 0, bal / 100)
    return o.join(c, "doc_id").select(
        "doc_id", "fresh_issue_cr", "ofs_cr", "contingent_cr", "price_high", "c_nationkey", "orders",
        F.round(F.col("contingent_cr") / 20, 2).alias("rpt_cr"),
        F.when(F.col("urgent") < 6, F.col("urgent") - 1).alias("criminal_raw"),
        pre.alias("pre_issue_promoter_pct"), (pre * 0.8).alias("post_issue_promoter_pct"),
        (bal < -500).alias("pledged"), ((seg == "MACHINERY") & (bal > 5000)).alias("qualified"),
        ((seg == "BUILDING") & (bal > 5000)).alias("emphasis_of_matter"),
        F.when(seg == "FURNITURE", True).when(seg == "AUTOMOBILE", False).alias("dividend_declared"),
        (F.col("orders") % 3 == 0).alias("leadership_claim"))


DISC = """disc AS (
  SELECT c_custkey AS doc_id, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS fresh_issue_cr,
    round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS ofs_cr, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS contingent_cr,
    CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') < 6 THEN count(*) FILTER (o_orderpriority = '1-URGENT') - 1 END AS criminal_raw,
    count(*) AS orders, max(o_totalprice) AS price_high, any_value(c_nationkey) AS c_nationkey, any_value(c_acctbal) AS bal, any_value(c_mktsegment) AS seg
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
disclosures AS (SELECT *, round(contingent_cr / 20, 2) AS rpt_cr, CASE WHEN bal > 0 THEN bal / 100 END AS pre, CASE WHEN bal > 0 THEN bal / 100 * 0.8 END AS post,
  bal < -500 AS pledged, seg = 'MACHINERY' AND bal > 5000 AS qualified, seg = 'BUILDING' AND bal > 5000 AS emphasis,
  CASE seg WHEN 'FURNITURE' THEN true WHEN 'AUTOMOBILE' THEN false END AS dividend, orders % 3 = 0 AS claim,
  CASE WHEN criminal_raw >= 0 THEN criminal_raw END AS criminal FROM disc)"""


def peer_rows(spark, sf):
    """Peers of a customer: the supplier nations it buys from (at most 25 rows a document)."""
    li, o, s = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")) \
        .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")) \
        .groupBy("o_custkey", "s_nationkey").agg(
            F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_tax")).alias("t"))
    return rows.join(c, "o_custkey").select(
        F.col("o_custkey").alias("doc_id"), (F.col("p") / F.col("q") / 100).alias("pe"),
        F.round(F.col("q") * 10, 2).alias("eps"), (F.col("t") / F.col("q") * 100).alias("ronw"),
        (F.col("s_nationkey") == F.col("c_nationkey")).alias("is_issuer"))


PEERS = """pr AS (SELECT o_custkey AS doc_id, s_nationkey = any_value(c_nationkey) AS is_issuer, sum(l_extendedprice) / sum(l_quantity) / 100 AS pe,
    round(sum(l_quantity) * 10, 2) AS eps, sum(l_quantity * l_tax) / sum(l_quantity) * 100 AS ronw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  GROUP BY o_custkey, s_nationkey),
pm AS (SELECT doc_id, median(pe) FILTER (NOT is_issuer AND pe > 0 AND pe < 400) AS peer_median, median(ronw) AS peer_ronw_median,
  max(eps) FILTER (is_issuer AND eps > 0) AS row_eps FROM pr GROUP BY 1)"""


def valued(spark, sf):
    r = analysis.ratios(analysis.forensics(fiscal_series(spark, sf)))
    d = disclosures(spark, sf)
    joined = r.join(d, "doc_id").join(analysis.peer_medians(peer_rows(spark, sf)), "doc_id", "left")
    staged = joined.withColumns({
        "issuer_pe": F.when(F.col("orders") % 5 == 0, F.lit(12.5)),
        "issuer_eps": F.when(F.col("orders") % 2 == 0, F.col("orders") * 700.0),
        "criminal": F.when(F.col("criminal_raw") >= 0, F.col("criminal_raw"))})
    return analysis.valuation(staged)


VAL = f"""{RATIOS}, {DISC}, {PEERS},
v0 AS (SELECT r.*, d.* EXCLUDE (doc_id), pm.peer_median, pm.peer_ronw_median, CASE WHEN orders % 5 = 0 THEN 12.5
    ELSE CAST(round(CAST(nullif(price_high, 0) / coalesce(CASE WHEN orders % 2 = 0 THEN orders * 700.0 END, row_eps) AS DECIMAL(38,8)), 2) AS DOUBLE) END AS issuer_pe,
    orders % 5 <> 0 AND coalesce(CASE WHEN orders % 2 = 0 THEN 1.0 END, row_eps) IS NOT NULL AS derived
  FROM ratios r JOIN disclosures d USING (doc_id) LEFT JOIN pm USING (doc_id)),
val AS (SELECT *, CASE WHEN issuer_pe <> 0 THEN issuer_pe / peer_median END AS rel FROM v0),
called AS (SELECT *, CASE WHEN rel IS NULL THEN 'indeterminate' WHEN rel < 0.7 THEN 'undervalued' WHEN rel <= 1.1 THEN 'fairly_valued'
  WHEN rel <= 1.5 THEN 'fairly_valued_expensive' ELSE 'overvalued' END AS call FROM val)"""


@query("valuation_call", f"""
WITH {VAL} SELECT doc_id, issuer_pe, derived AS issuer_pe_derived, round(rel, 6) AS relative, call FROM called""")
def valuation_call(spark, sf):
    v = valued(spark, sf)
    exact = F.when(F.col("issuer_pe") != 0, F.col("issuer_pe") / F.col("peer_median"))
    return v.select("doc_id", "issuer_pe", "issuer_pe_derived", F.round(exact, 6).alias("relative"), "call")


@query("price_fill", """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS high, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice + 1 END AS known FROM orders)
SELECT o_orderkey, CASE WHEN high IS NULL THEN known ELSE high END AS low, coalesce(high, known) AS high, high IS NULL AND known IS NOT NULL AS price_injected FROM p""")
def price_fill(spark, sf):
    high = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    p = table(spark, sf, "orders").select("o_orderkey", high.alias("low"), high.alias("high"),
                                          F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") + 1).alias("known"))
    return analysis.fill_price(p, "low", "high", "known").drop("known")


_NZ = lambda *cols: " AND ".join(f"{c} IS NOT NULL AND {c} <> 0" for c in cols)
_X = """x AS (SELECT t0.doc_id, t0.revenue r0, t1.revenue r1, t0.receivables c0, t1.receivables c1, t0.pat p0, t1.pat p1, t0.cfo f0,
  t0.total_assets a0, t0.net_worth n0, t1.net_worth n1, t0.total_debt d0, t1.total_debt d1, t0.current_assets ca0, t1.current_assets ca1,
  t0.current_liabilities cl0, t1.current_liabilities cl1 FROM t0 LEFT JOIN t1 USING (doc_id))"""
_FOR = f"{WIDE}, {_X}"
_FLAGS = [
    ("receivables_outpace_sales", "high", "(c0 / r0) / (c1 / r1)", f"{_NZ('r0', 'r1', 'c0', 'c1')} AND (c0 / r0) / (c1 / r1) > 1.4"),
    ("high_accruals", "high", "(p0 - f0) / a0", "a0 <> 0 AND (p0 - f0) / a0 > 0.10"),
    ("leverage_spike", "medium", "d0 / n0 - d1 / n1", f"{_NZ('n0', 'n1')} AND d0 / n0 > d1 / n1 + 0.5"),
    ("extreme_sales_growth", "medium", "r0 / r1", f"{_NZ('r0', 'r1')} AND r0 / r1 > 1.6"),
    ("pre_ipo_profit_spurt", "medium", "p0 / p1 - r0 / r1",
     f"{_NZ('p0', 'p1', 'r0', 'r1')} AND p1 > 0 AND (p0 / p1 - 1) - (r0 / r1 - 1) > 0.5 AND p0 / p1 - 1 > 0.5"),
]
_FLAG_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, '{s}' AS severity, {v} AS value FROM x WHERE {w}" for n, s, v, w in _FLAGS)


@query("forensic_flags", f"WITH {_FOR} SELECT doc_id, rule, severity FROM ({_FLAG_SQL})")
def forensic_flags(spark, sf):
    f = analysis.forensics(fiscal_series(spark, sf))
    return f.select("doc_id", F.explode("flags").alias("x")).select("doc_id", "x.rule", "x.severity")


_CHECKS = [
    (_NZ("r0", "r1", "c0", "c1"), "(c0 / r0) / (c1 / r1) <= 1.4"), ("p0 IS NOT NULL AND f0 IS NOT NULL AND a0 <> 0", "f0 >= p0"),
    ("p0 IS NOT NULL AND a0 <> 0", "p0 > 0"), ("f0 IS NOT NULL", "f0 > 0"),
    (f"p0 IS NOT NULL AND p1 IS NOT NULL AND {_NZ('n0', 'n1')}", "p0 / n0 > p1 / n1"),
    (f"d0 IS NOT NULL AND d1 IS NOT NULL AND {_NZ('n0', 'n1')}", "d0 / n0 <= d1 / n1 + 0.05"),
    (_NZ("ca0", "cl0", "ca1", "cl1"), "ca0 / cl0 >= ca1 / cl1"),
]


@query("strength", f"""
WITH {_FOR}, fl AS ({_FLAG_SQL}), h AS (SELECT DISTINCT doc_id FROM fl WHERE severity = 'high')
SELECT x.doc_id, {' + '.join(f'CASE WHEN {k} AND {p} THEN 1 ELSE 0 END' for k, p in _CHECKS)} AS passed,
  {' + '.join(f'CASE WHEN {k} THEN 1 ELSE 0 END' for k, _ in _CHECKS)} AS total, h.doc_id IS NOT NULL AS cap_triggered
FROM x LEFT JOIN h USING (doc_id)""")
def strength(spark, sf):
    f = analysis.forensics(fiscal_series(spark, sf))
    return f.select("doc_id", F.col("strength_passed").alias("passed"), F.col("strength_total").alias("total"), "cap_triggered")


# ------------------------------------------------------------------ rubric

def profile(spark, sf):
    v = valued(spark, sf)
    findings = F.least(F.col("orders") * 4, F.lit(100)).cast("double")
    return v.withColumn("risk_score", 100 - findings).withColumn("source_pages", F.create_map().cast("map<string,int>"))


def rules_of(spark, sf):
    return analysis.rubric(profile(spark, sf))


def _staged(spark, sf):
    """Profiles and rules as tables: several branches of a report read each."""
    staged = materialise(profile(spark, sf))
    return staged, materialise(analysis.rubric(staged))


def _flag_rows(profiles):
    return profiles.select("doc_id", F.posexplode("flags").alias("ord", "x")).select("doc_id", "ord", "x.rule")


def _band_sql(expr: str, name: str, lower: bool = False) -> str:
    cmp = ">" if lower else ">="
    arms = " ".join(f"WHEN {expr} {cmp} {t} THEN {float(p)}" for t, p in vocab.BANDS[name])
    return f"CASE WHEN {expr} IS NULL THEN NULL {arms} ELSE {float(vocab.BANDS[name][-1][1])} END"


_B = _band_sql
_OFS = "CASE WHEN fresh_issue_cr IS NULL AND ofs_cr IS NULL THEN NULL ELSE coalesce(coalesce(ofs_cr, 0) / nullif(coalesce(fresh_issue_cr, 0) + coalesce(ofs_cr, 0), 0) * 100, 0) END"
_PEG = "CASE WHEN issuer_pe <> 0 AND pat_cagr > 0 THEN issuer_pe / (pat_cagr * 100) END"
_RUBRIC = [
    ("business_quality", "operating_margin_level", 20, _B("operating_margin * 100", "operating_margin_level"), None),
    ("business_quality", "margin_stability", 10, _B("spread", "margin_stability", True), None),
    ("business_quality", "revenue_scale", 10, _B("rev", "revenue_scale"), None),
    ("financial_health", "debt_to_equity", 25, _B("debt_equity", "debt_to_equity", True), None),
    ("financial_health", "current_ratio", 15, _B("current_ratio", "current_ratio"), None),
    ("financial_health", "interest_cover", 10, _B("interest_cover", "interest_cover"), None),
    ("financial_health", "contingent_liabilities", 10, _B("(contingent_cr / nullif(nw, 0) * 100)", "contingent_liabilities", True), None),
    ("growth", "revenue_cagr", 20, _B("revenue_cagr * 100", "cagr"), None),
    ("growth", "pat_cagr", 20, _B("pat_cagr * 100", "cagr"), None),
    ("growth", "growth_consistency", 10, "CAST(round(CAST(10.0 * ups / nullif(n_years - 1, 0) AS DECIMAL(38,8)), 1) AS DOUBLE)", "n_years >= 3"),
    ("valuation", "peer_relative_pe", 30, "CASE call WHEN 'undervalued' THEN 30.0 WHEN 'fairly_valued' THEN 22.0 WHEN 'fairly_valued_expensive' THEN 12.0 WHEN 'overvalued' THEN 4.0 END", None),
    ("valuation", "absolute_pe", 10, _B("issuer_pe", "absolute_pe", True), None),
    ("valuation", "growth_adjusted_pe", 10, _B(f"({_PEG})", "growth_adjusted_pe", True), None),
    ("promoter_quality", "post_issue_holding", 15, _B("post", "post_issue_holding"), None),
    ("promoter_quality", "ofs_share_of_issue", 15, _B(f"({_OFS})", "ofs_share_of_issue", True), None),
    ("promoter_quality", "no_pledging", 10, "CASE WHEN pledged THEN 0.0 ELSE 10.0 END", None),
    ("promoter_quality", "dilution_size", 10, _B("(pre - post)", "dilution_size", True), "pre IS NOT NULL AND post IS NOT NULL"),
    ("governance", "rpt_intensity", 10, _B("(rpt_cr / nullif(rev, 0) * 100)", "rpt_intensity", True), None),
    ("governance", "criminal_proceedings", 10, "CASE WHEN criminal = 0 THEN 10.0 WHEN criminal <= 2 THEN 4.0 WHEN criminal > 2 THEN 0.0 END", None),
    ("governance", "audit_opinion", 10, "CASE WHEN qualified THEN 0.0 WHEN emphasis THEN 5.0 ELSE 10.0 END", None),
    ("governance", "dividend_track", 5, "CASE WHEN dividend THEN 5.0 WHEN NOT dividend THEN 3.0 END", None),
    ("risk_level", "risk_penalty_model", 100, "100.0 - least(orders * 4, 100)", None),
    ("competitive_position", "returns_vs_peers", 15, _B("(roe * 100 - peer_ronw_median)", "returns_vs_peers"), None),
    ("competitive_position", "market_position_claim", 5, "CASE WHEN claim THEN 5.0 ELSE 3.0 END", None),
    ("capital_efficiency", "roe", 15, _B("roe * 100", "return_on_capital"), None),
    ("capital_efficiency", "roce", 15, _B("roce * 100", "return_on_capital"), None),
    ("cash_generation", "cfo_positive_years", 10, "CASE WHEN cfo_known > 0 THEN CAST(round(CAST(10.0 * cfo_pos / cfo_known AS DECIMAL(38,8)), 1) AS DOUBLE) END", None),
    ("cash_generation", "cfo_to_pat", 20, _B("cfo_to_pat", "cfo_to_pat"), None),
    ("cash_generation", "free_cash_flow", 10, "CASE WHEN cfo0 - abs(capex0) > 0 THEN 10.0 WHEN cfo0 - abs(capex0) IS NOT NULL THEN 3.0 END", None),
]
RULES = f"""{VAL}, st AS (SELECT doc_id, CASE WHEN count(pat / nullif(revenue, 0)) >= 2 THEN stddev_pop(pat / nullif(revenue, 0)) * 100 END AS spread,
    count(cfo) AS cfo_known, count(*) FILTER (cfo > 0) AS cfo_pos FROM wide GROUP BY 1),
up AS (SELECT doc_id, count(*) FILTER (revenue > prev) AS ups FROM (SELECT doc_id, revenue, lag(revenue) OVER (PARTITION BY doc_id ORDER BY fy) AS prev FROM wide) GROUP BY 1),
prof AS (SELECT called.*, st.* EXCLUDE (doc_id), ups, t0.revenue AS rev, t0.net_worth AS nw, t0.cfo AS cfo0, t0.capex AS capex0
  FROM called JOIN st USING (doc_id) JOIN up USING (doc_id) JOIN t0 USING (doc_id)),
rules AS ({' UNION ALL '.join(
    f"SELECT doc_id, {i} AS ord, '{c}' AS category, '{r}' AS rule, ({p})::DOUBLE AS points, {float(m)} AS max_points FROM prof{f' WHERE {w}' if w else ''}"
    for i, (c, r, m, p, w) in enumerate(_RUBRIC))})"""


@query("rubric", f"WITH {RULES} SELECT doc_id, category, rule, points, max_points, points IS NOT NULL AS included FROM rules")
def rubric(spark, sf):
    return rules_of(spark, sf).select("doc_id", "category", "rule", "points", "max_points", "included")


_CAT = """cat AS (SELECT doc_id, category, sum(points) AS g, sum(max_points) FILTER (points IS NOT NULL) AS m, sum(max_points) AS a FROM rules GROUP BY 1, 2),
scores AS (SELECT doc_id, category, coalesce(CAST(round(CAST(100 * g / nullif(m, 0) AS DECIMAL(38,8)), 1) AS DOUBLE), 50.0) AS score,
  CAST(round(CAST(coalesce(m, 0) / greatest(1, a) AS DECIMAL(38,8)), 2) AS DOUBLE) AS coverage FROM cat)"""


@query("category_score", f"WITH {RULES}, {_CAT} SELECT doc_id, category, score, coverage FROM scores")
def category_score(spark, sf):
    return analysis.category_scores(rules_of(spark, sf))


_LENS = " UNION ALL ".join(
    f"SELECT '{lens}' AS lens, '{c}' AS category, {w} AS w" for lens, ws in vocab.LENSES.items() for c, w in zip(vocab.CATEGORIES, ws))


@query("overall_score", f"""
WITH {RULES}, {_CAT}, lens AS ({_LENS}), {_X}, fl AS ({_FLAG_SQL}), hi AS (SELECT DISTINCT doc_id FROM fl WHERE severity = 'high'),
o AS (SELECT doc_id, l.lens, {R('sum(coalesce(score, 50) * w)', 1)} AS raw, round(sum(coalesce(coverage, 0) * w), 6) AS cov FROM (SELECT DISTINCT doc_id FROM rules) d
  CROSS JOIN lens l LEFT JOIN scores s USING (doc_id, category) GROUP BY 1, 2)
SELECT doc_id, lens, CASE WHEN hi.doc_id IS NOT NULL AND raw > 55 THEN 55.0 ELSE raw END AS overall, hi.doc_id IS NOT NULL AND raw > 55 AS capped,
  CASE WHEN cov >= 0.8 THEN 'high' WHEN cov >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM o LEFT JOIN hi USING (doc_id)""")
def overall_score(spark, sf):
    staged, rules = _staged(spark, sf)
    out = analysis.overall_scores(analysis.category_scores(rules), staged.select("doc_id", "cap_triggered"))
    return out.select("doc_id", "lens", "overall", "capped", "confidence")


@query("verdict", f"""
WITH {VAL}, s AS (SELECT *, 30 + orders * 2.0 AS overall, 100.0 - least(orders * 4, 100) AS risk FROM called)
SELECT doc_id, concat_ws(' · ', CASE WHEN overall >= 75 THEN 'Strong fundamentals' WHEN overall >= 60 THEN 'Solid fundamentals' WHEN overall >= 45 THEN 'Mixed fundamentals' ELSE 'Weak fundamentals' END,
  CASE call WHEN 'undervalued' THEN 'Undervalued vs peers' WHEN 'fairly_valued' THEN 'Fairly valued vs peers' WHEN 'fairly_valued_expensive' THEN 'Expensive side of fair'
    WHEN 'overvalued' THEN 'Overvalued vs peers' ELSE 'Valuation indeterminate' END,
  CASE WHEN risk >= 75 THEN 'low risk profile' WHEN risk >= 55 THEN 'moderate risk profile' WHEN risk >= 35 THEN 'elevated risk profile' ELSE 'high risk profile' END) AS verdict FROM s""")
def verdict(spark, sf):
    v = valued(spark, sf)
    risk = 100.0 - F.least(F.col("orders") * 4, F.lit(100))
    return v.select("doc_id", report.verdict(30 + F.col("orders") * 2.0, F.col("call"), risk).alias("verdict"))


_SW = """sw AS (SELECT doc_id, 'strong' AS side, ord, rule, -(points / max_points) * max_points AS k FROM rules WHERE points IS NOT NULL AND max_points >= 5 AND points / max_points >= 0.72
  UNION ALL SELECT doc_id, 'weak', ord, rule, points / max_points - max_points / 30 FROM rules WHERE points IS NOT NULL AND max_points >= 5 AND points / max_points <= 0.35),
swr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY round(k, 9), ord) AS rank FROM sw)"""


@query("strong_weak", f"WITH {RULES}, {_SW} SELECT doc_id, side, rank, rule FROM swr WHERE rank <= 7")
def strong_weak(spark, sf):
    return report.strong_weak(rules_of(spark, sf)).select("doc_id", "side", "rank", "rule")


_LFIND = """lf AS (SELECT o_custkey AS doc_id, l_returnflag || ' line ' || l_linenumber AS title, min(l_linenumber * 10 + ascii(l_returnflag)) AS ord,
  CASE WHEN max(l_quantity) > 49 THEN 'critical' WHEN max(l_quantity) > 45 THEN 'high' ELSE 'medium' END AS severity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _line_findings(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Numbers first: a maximum of texts would sort every line, so the flag is a key until few rows are left.
    per_flag = li.groupBy(F.col("o_custkey").alias("doc_id"), F.concat("l_returnflag", F.lit(" line "), F.col("l_linenumber").cast("string")).alias("title"), "l_returnflag").agg(
        F.min(F.col("l_linenumber") * 10 + F.ascii("l_returnflag")).alias("ord"), F.max("l_quantity").alias("top"))
    top = F.max("top")
    return per_flag.groupBy("doc_id", "title").agg(
        F.min("ord").alias("ord"),
        F.when(top > 49, "critical").when(top > 45, "high").otherwise("medium").alias("severity"),
        F.max("l_returnflag").alias("risk_type"))


@query("case_lists", f"""
WITH {RULES}, {_SW}, {_LFIND}, {_X}, fl AS ({_FLAG_SQL}),
flo AS (SELECT doc_id, rule, CASE rule WHEN 'receivables_outpace_sales' THEN 0 WHEN 'high_accruals' THEN 1 WHEN 'leverage_spike' THEN 2 WHEN 'extreme_sales_growth' THEN 3 ELSE 4 END AS o FROM fl),
bearrows AS (SELECT doc_id, 0 AS source, rank AS o, replace(rule, '_', ' ') AS text FROM swr WHERE side = 'weak' AND rank <= 7
  UNION ALL SELECT doc_id, 1, ord - 1000 * CASE severity WHEN 'critical' THEN 3 ELSE 2 END, title FROM lf WHERE severity <> 'medium'),
b1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source, o, text) AS rank FROM bearrows),
b2 AS (SELECT * FROM b1 WHERE rank <= 9), bn AS (SELECT doc_id, max(rank) AS u FROM b2 GROUP BY 1),
b3 AS (SELECT f.doc_id, replace(rule, '_', ' ') AS text, coalesce(u, 0) + row_number() OVER (PARTITION BY f.doc_id ORDER BY o) AS rank FROM flo f LEFT JOIN bn USING (doc_id)),
neu AS (SELECT doc_id, replace(rule, '_', ' ') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rank FROM rules WHERE points IS NULL)
SELECT doc_id, 'bull' AS side, rank, replace(rule, '_', ' ') AS text FROM swr WHERE side = 'strong' AND rank <= 7
UNION ALL SELECT doc_id, 'bear', rank, text FROM b2 UNION ALL SELECT doc_id, 'bear', rank, text FROM b3 WHERE rank <= 10
UNION ALL SELECT doc_id, 'neutral', rank, text FROM neu WHERE rank <= 8""")
def case_lists(spark, sf):
    staged, rules = _staged(spark, sf)
    out = report.case_lists(rules, _line_findings(spark, sf), _flag_rows(staged))
    return out.select("doc_id", "side", "rank", "text")


def _ask_parts(spark, sf):
    issue = disclosures(spark, sf)
    findings = _line_findings(spark, sf).withColumn("risk_type", F.when(F.col("risk_type") == "A", "customer_concentration")
                                                    .when(F.col("risk_type") == "N", "negative_cash_flow").otherwise("promoter_pledging"))
    objects = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.when(
        F.col("o_orderpriority") == "1-URGENT", "debt_repayment").when(F.col("o_orderpriority") == "5-LOW", "general_corporate")
        .otherwise("capex").alias("category")).agg(F.min("o_orderkey").alias("rank"))
    return issue, objects, findings


@query("questions", f"""
WITH {RULES}, {_LFIND}, ob AS (SELECT o_custkey AS doc_id, o_orderpriority AS p, min(o_orderkey) AS rank FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2),
unk AS (SELECT doc_id, rule, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS u FROM rules WHERE points IS NULL),
q AS (SELECT doc_id, 0 AS o, 'Why do existing holders sell more than the company raises?' AS question FROM disclosures WHERE ofs_cr > 0 AND coalesce(fresh_issue_cr, 0) < ofs_cr
  UNION ALL SELECT doc_id, 1000 + rank * 2, 'What did the debt to be repaid finance, and what did it return?' FROM ob WHERE p = '1-URGENT'
  UNION ALL SELECT doc_id, 1001 + rank * 2, 'What exactly will the general corporate money pay for?' FROM ob WHERE p = '5-LOW'
  UNION ALL SELECT doc_id, 2000 + ord, 'Which contracts protect the revenue of the top customers, and when do they renew?' FROM lf WHERE title LIKE 'A%' AND severity <> 'medium'
  UNION ALL SELECT doc_id, 2000 + ord, 'When will operating cash flow turn positive for good?' FROM lf WHERE title LIKE 'N%'
  UNION ALL SELECT doc_id, 2000 + ord, 'How and when will the promoters release their pledge?' FROM lf WHERE title LIKE 'R%'
  UNION ALL SELECT doc_id, 4000 + u, 'The document is silent on ' || replace(rule, '_', ' ') || ': what is the answer?' FROM unk WHERE u <= 5
  UNION ALL SELECT doc_id, 5000, 'Most risk factors are generic: which five worry management most?' FROM disclosures WHERE orders < 8),
d AS (SELECT doc_id, question, min(o) AS o FROM q GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, question) AS rank FROM d)
SELECT doc_id, rank, question FROM r WHERE rank <= 10""")
def questions(spark, sf):
    issue, objects, findings = _ask_parts(spark, sf)
    boiler = issue.select("doc_id", F.when(F.col("orders") < 8, 0.1).otherwise(0.9).alias("specificity_ratio"))
    out = report.questions(issue, objects, findings, rules_of(spark, sf), boiler)
    return out.select("doc_id", "rank", "question")


@query("risk_findings")
def risk_findings(spark, sf):
    """Composed chapter texts and the fiscal series of every customer."""
    from .text_q import _prospectus

    pages = _prospectus(spark, sf).select("doc_id", F.col("text").alias("risk_text"))
    d = disclosures(spark, sf)
    p = fiscal_series(spark, sf).join(pages, "doc_id").join(d, "doc_id").select(
        "doc_id", "years", "risk_text", F.lit("").alias("business_text"), F.lit(1).alias("risk_page"),
        F.create_map(*[x for m, n in (("total_debt", 21), ("current_assets", 22), ("cfo", 23)) for x in (F.lit(m), F.lit(n))]).alias("source_pages"),
        F.when(F.col("criminal_raw") >= 0, F.col("criminal_raw")).alias("criminal"), F.col("orders").alias("total_cases"),
        F.lit(2).alias("litigation_page"), "pledged", F.lit("pledge of promoter shares").alias("pledge_evidence"), F.lit(3).alias("pledge_page"))
    return risks.risk_findings(p).select("doc_id", "risk_type", "severity", "title", "value", "source_page")


@query("narrative_check", f"""
WITH {RATIOS} SELECT c_custkey AS doc_id, revenue_cagr < 0.08 AND c_mktsegment LIKE '%ING%' AS mismatch FROM ratios JOIN customer ON doc_id = c_custkey""")
def narrative_check(spark, sf):
    r = analysis.ratios(fiscal_series(spark, sf)).select("doc_id", "revenue_cagr")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(
        F.col("c_mktsegment").contains("ING"), "We delivered Robust growth").otherwise("steady").alias("text"))
    return r.join(c, "doc_id").select(
        "doc_id", risks.narrative_check(F.col("text"), F.col("revenue_cagr")).alias("mismatch"))


@query("report")
def full_report(spark, sf):
    """Nested report per customer, flattened to its counts."""
    v, rules = _staged(spark, sf)
    issue, objects, findings = _ask_parts(spark, sf)
    findings = materialise(findings)
    cases = report.case_lists(rules, findings, _flag_rows(v))
    boiler = issue.select("doc_id", F.lit(None).cast("double").alias("specificity_ratio"))
    asked = report.questions(issue, objects, findings, rules, boiler)
    scored = analysis.overall_scores(analysis.category_scores(rules), v.select("doc_id", "cap_triggered")).filter("lens = 'balanced'")
    base = v.join(scored.select("doc_id", "overall", "coverage", "confidence"), "doc_id") \
        .withColumn("verdict", report.verdict(F.col("overall"), F.col("call"), F.lit(60.0))) \
        .withColumn("total_issue_cr", F.coalesce("fresh_issue_cr", F.lit(0.0)) + F.coalesce("ofs_cr", F.lit(0.0)))
    lines = report.summary_lines(base)
    index = base.select("doc_id", F.lit(0).alias("canon"), F.lit("risk_factors").alias("key"), F.lit("Risk Factors").alias("title"),
                        F.lit(True).alias("found"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("toc").alias("method"))
    out = report.assemble(base.select("doc_id", "overall", "coverage", "confidence", "verdict"), rules, findings, cases, asked, index, lines)
    return out.select("doc_id", "overall", "confidence", "verdict", F.size("rules").alias("rules"), F.size("findings").alias("findings"),
                      F.size("questions").alias("questions"), F.size("cases.bull").alias("bull"), F.size("cases.bear").alias("bear"),
                      F.size("executive_summary").alias("summary"))


# ------------------------------------------------------------------ forecasts and sectors

_FEAT = """ft AS (SELECT doc_id, orders * 4.0 AS overall, CASE WHEN orders % 4 = 0 THEN 'overvalued' WHEN orders % 4 = 1 THEN 'fairly_valued' ELSE 'indeterminate' END AS call,
  CASE WHEN coalesce(fresh_issue_cr, 0) + coalesce(ofs_cr, 0) > 0 THEN CAST(round(CAST(coalesce(ofs_cr, 0) / (coalesce(fresh_issue_cr, 0) + coalesce(ofs_cr, 0)) AS DECIMAL(38,8)), 2) AS DOUBLE) END AS ofs_share,
  CASE WHEN coalesce(fresh_issue_cr, 0) + coalesce(ofs_cr, 0) > 0 THEN round(log10(coalesce(fresh_issue_cr, 0) + coalesce(ofs_cr, 0)), 2) END AS issue_size_log,
  CASE seg WHEN 'FURNITURE' THEN 'consumer' WHEN 'HOUSEHOLD' THEN 'pharma_health' WHEN 'MACHINERY' THEN 'industrial' WHEN 'BUILDING' THEN 'energy_infra' ELSE 'other' END AS sector,
  orders < 8 AND bal < 3000 AS loss_making FROM disclosures)"""


def _features(spark, sf):
    d = disclosures(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_acctbal", "c_mktsegment"), "doc_id")
    words = {"FURNITURE": "A retail furniture maker", "HOUSEHOLD": "Drug stores", "MACHINERY": "Precision engineering", "BUILDING": "Construction", "AUTOMOBILE": "Cars"}
    n = F.col("orders")
    return forecast.features(d.select(
        "doc_id", (n * 4.0).alias("overall"), F.when(n < 8, 10.0).otherwise(90.0).alias("growth_score"),
        F.when(F.col("c_acctbal") < 3000, 10.0).otherwise(90.0).alias("cash_score"), F.lit(None).cast("double").alias("relative"),
        F.when(n % 4 == 0, "overvalued").when(n % 4 == 1, "fairly_valued").otherwise("indeterminate").alias("call"),
        F.col("fresh_issue_cr").alias("fresh_cr"), "ofs_cr", F.lit(None).cast("double").alias("total_cr"), lookup(F.col("c_mktsegment"), words).alias("excerpt"),
        (n % 6).cast("int").alias("flag_count"), F.least(n * 5, F.lit(100)).cast("double").alias("risk_score")))


@query("features", f"WITH {DISC}, {_FEAT} SELECT doc_id, ofs_share, issue_size_log, sector, loss_making FROM ft")
def features(spark, sf):
    return _features(spark, sf).select("doc_id", "ofs_share", "issue_size_log", "sector", "loss_making")


@query("rule_forecast", f"""
WITH {DISC}, {_FEAT}, r AS (SELECT *, call = 'overvalued' AS over_, least(greatest(6 + (overall - 60) * 0.45 - CASE WHEN call = 'overvalued' THEN 8 ELSE 0 END
    - CASE WHEN ofs_share >= 0.7 THEN 4 ELSE 0 END - CASE WHEN issue_size_log >= 3.7 THEN 3 ELSE 0 END, -8), 35) AS prem FROM ft)
SELECT doc_id, round(prem, 4) AS premium, CASE WHEN overall >= 72 AND NOT over_ THEN 0.25 WHEN overall >= 60 AND NOT over_ THEN 0.6 ELSE 0.85 END AS p_below_offer,
  CASE WHEN overall >= 72 AND NOT over_ THEN 0 WHEN overall >= 60 AND NOT over_ THEN 40 ELSE 60 END AS bottom_from,
  CASE WHEN overall >= 72 AND NOT over_ THEN 60 WHEN overall >= 60 AND NOT over_ THEN 250 END AS recover_listing_to FROM r""")
def rule_forecast(spark, sf):
    f = forecast.rule_forecast(_features(spark, sf))
    return f.select("doc_id", F.round("premium_pct", 4).alias("premium"), "p_below_offer", "bottom_from", "recover_listing_to")


@query("sector_cascade", r"""
WITH s AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'Financial Services' WHEN c_custkey % 5 = 1 THEN 'Space Mining' END AS prof,
  CASE WHEN c_custkey % 5 = 0 THEN 'Banks - Regional' END AS ind, CASE WHEN c_custkey % 5 = 2 THEN 'consumer' END AS bucket,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Acme Machinery' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home Hospitals REIT' ELSE 'Acme' END AS name FROM customer),
k AS (SELECT *, CASE WHEN prof = 'Financial Services' THEN 'Financials' WHEN prof IS NOT NULL THEN prof WHEN bucket = 'consumer' THEN 'Consumer Discretionary'
  WHEN name = 'Acme Machinery' THEN 'Industrials' WHEN name LIKE 'Home%' THEN 'Healthcare' ELSE 'Other' END AS sector FROM s)
SELECT doc_id, sector, CASE WHEN prof IS NOT NULL THEN 'yahoo' WHEN bucket IS NOT NULL THEN 'rhp' WHEN name <> 'Acme' THEN 'name' ELSE 'unknown' END AS source,
  CASE WHEN name LIKE '%REIT' THEN 'reit' ELSE 'equity' END AS instrument, CASE WHEN ind IS NOT NULL OR sector = 'Financials' THEN 1 ELSE 0 END AS is_financial FROM k""")
def sector_cascade(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    c = table(spark, sf, "customer").select(
        k.alias("doc_id"), F.when(k % 5 == 0, "Financial Services").when(k % 5 == 1, "Space Mining").alias("yahoo_sector"),
        F.when(k % 5 == 0, "Banks - Regional").alias("yahoo_industry"), F.when(k % 5 == 2, "consumer").alias("report_sector"),
        F.when(seg == "MACHINERY", "Acme Machinery").when(seg == "HOUSEHOLD", "Home Hospitals REIT").otherwise("Acme").alias("company"))
    return dataset.sector_cascade(c).select("doc_id", "sector", "source", "instrument", "is_financial")


@query("repair", f"""
WITH {SUBSCRIPTION} SELECT o_orderkey, coalesce(round(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice + 5 END - o_totalprice, 2), qib) AS gmp FROM subscription""")
def repair(spark, sf):
    s = subscription(spark, sf)
    estimate = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") + 5)
    return s.select("o_orderkey", dataset.repair_gmp(estimate, F.col("o_totalprice"), F.col("qib")).alias("gmp"))
