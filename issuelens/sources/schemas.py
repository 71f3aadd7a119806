"""Explicit schemas of the tables and nested documents the engine reads and writes."""

from __future__ import annotations

ISSUE = (
    "cg_ipo_id string, company string, detail_url string, `Pricing Method` string, "
    "`Opening Date` string, `Closing Date` string, `Listing Date` string, "
    "`Issue Price (Rs.)` string, `Total Issue Amount (Incl.Firm reservations) (Rs.cr.)` string, "
    "`Fresh Capital (Rs.cr.)` string, `Offer for sale (Rs.cr.)` string, `Left Lead Manager` string"
)
SUBSCRIPTION = (
    "cg_ipo_id string, `QIB (x)` double, `bNII (x)` double, `sNII (x)` double, `NII (x)` double, "
    "`Retail (x)` double, `Employee (x)` double, `Total (x)` double, Applications bigint"
)
LISTING = (
    "cg_ipo_id string, id string, company string, `Listing Date` string, ISIN string, "
    "`NSE Symbol` string, `BSE Scrip Code` string, `Issue Price (Rs.)` string, "
    "`Close Price on Listing (Rs.)` string, "
    "`% Gain/Loss (Issue price v/s close price on Listing)` string"
)
OUTCOMES = (
    "cg_ipo_id string, company string, listing_date date, issue_price double, ret_1d double, "
    "ret_6m double, ret_12m double, ret_24m double, current_ret double, delisted boolean, "
    "yahoo_last_date date, yahoo_symbol string, bottom_so_far_pct double, "
    "bottom_so_far_session int, bottom_12m_pct double, sessions_to_bottom int, "
    "peak_24m_pct double, sessions_to_peak int"
)
DETAILS = (
    "cg_ipo_id string, sector string, pct_qib double, pct_retail double, pct_nii double, "
    "pct_anchor double, kpi_roe double, kpi_roce double, kpi_debt_equity double, "
    "kpi_pat_margin double, kpi_ebitda_margin double, kpi_pb double, kpi_post_ipo_pe double, "
    "details_fetched date"
)
GMP = "cg_ipo_id string, company string, gmp double, estimated_price double, gmp_fetched date"
SECTOR = (
    "cg_ipo_id string, symbol string, yahoo_sector string, yahoo_industry string, sector string, "
    "instrument string, is_financial int, is_realestate int, source string"
)
CHART = (
    "struct<chart: struct<result: array<struct<timestamp: array<bigint>, "
    "indicators: struct<quote: array<struct<close: array<double>>>>>>>>"
)
SIGNALS = (
    "analysis_id string, gmp double, sub_qib double, sub_nii double, sub_rii double, "
    "sub_bnii double, sub_snii double, day1_gain double, noted_at timestamp, source string"
)
LEDGER = (
    "cg_ipo_id string, company string, opened date, recorded_at timestamp, rule_says string, "
    "qib double, retail double, qib_bar double, retail_bar double, "
    "ret_6m_from_listing double, ret_12m_from_listing double"
)

_RULE = (
    "struct<category: string, rule: string, points: double, max_points: double, value: string, "
    "thresholds: string, evidence: string, source_pages: array<int>, confidence: double, "
    "rationale: string, included: boolean>"
)
REPORT = (
    "scoring struct<overall: double, lens: string, weights: map<string,double>, cap_note: string, "
    f"categories: map<string, struct<score: double, weight: double, coverage: double, rules: array<{_RULE}>>>>, "
    "snapshot struct<price_band: array<double>, face_value: double, lot_size: int, "
    "fresh_issue_cr: double, ofs_cr: double, total_issue_cr: double, listing_at: string, "
    "pre_issue_promoter_pct: double, post_issue_promoter_pct: double, "
    "objects: array<struct<purpose: string, category: string, amount_cr: double, source_page: int>>, "
    "source_pages: map<string,int>>, "
    "valuation struct<issuer_pe: double, peer_pe_median: double, relative: double, call: string, "
    "reasoning: array<string>, issuer_pe_page: int, "
    "peers: array<struct<name: string, pe: double, eps: double, ronw: double, source_page: int, "
    "is_issuer: boolean>>, call_label: string>, "
    "risk struct<score: double, boilerplate: struct<total_factors: int, specific: int, "
    "specificity_ratio: double>, top: array<struct<title: string, severity: string>>, "
    "findings: array<struct<risk_type: string, title: string, severity: string>>>, "
    "forensic struct<flags: array<struct<rule: string, name: string, detail: string>>>, "
    "verdict string, "
    "meta struct<company_name: string, page_count: int, doc_type: string, confidence: string, "
    "coverage: double, readable_ratio: double, section_hit_rate: double, llm_enhanced: boolean, "
    "disclaimer: string>, "
    "industry struct<excerpt: string>, "
    "cases struct<bull: array<struct<text: string>>, bear: array<struct<text: string>>>, "
    "financials struct<ratios: struct<net_margin: double, operating_margin: double, roe: double, "
    "roce: double, debt_equity: double>>, "
    "fundamentals struct<pat_margin: double, ebitda_margin: double, roe: double, roce: double, "
    "debt_equity: double, post_ipo_pe: double>, "
    "_corrupt_record string"
)
