"""Golden statement pages, series, ratios and section logic on small fixtures."""

import pytest
from pyspark.sql import functions as F

from issuelens.functions import scalars as S
from issuelens.plans import analysis, entities, facts, risks, sections

TABLE = [
    ("Revenue from operations (I)", "7,30,500.00", "6,12,000.00", "4,90,000.00"),
    ("Other income", "4,000.00", "3,500.00", "3,000.00"),
    ("Finance costs", "11,200.00", "12,600.00", "13,000.00"),
    ("Depreciation and amortisation expense", "21,300.00", "20,100.00", "18,800.00"),
    ("Restated profit before tax", "95,000.00", "70,400.00", "51,200.00"),
    ("Profit for the year", "71,250.00", "52,800.00", "38,400.00"),
    ("(a) Trade receivables", "1,02,400.00", "83,150.00", "70,600.00"),
    ("Total current assets", "3,10,000.00", "2,60,500.00", "2,20,700.00"),
    ("Total current liabilities", "1,95,300.00", "1,81,400.00", "1,66,900.00"),
    ("Total assets", "8,12,600.00", "7,03,900.00", "6,05,100.00"),
    ("Net worth", "3,40,000.00", "2,72,500.00", "2,21,700.00"),
    ("Long-term borrowings", "48,000.00", "57,500.00", "66,000.00"),
    ("Short-term borrowings", "37,000.00", "41,250.00", "43,800.00"),
    ("Net cash flow generated from operating activities", "80,150.00", "61,700.00", "47,300.00"),
    ("Purchase of property, plant and equipment", "(33,900.00)", "(29,250.00)", "(24,600.00)"),
    ("Proceeds from long-term borrowings", "7.00", "8.00", "9.00"),
]


@pytest.fixture(scope="module")
def facts_df(spark):
    rows = [("Particulars", "Fiscal 2024", "Fiscal 2023", "Fiscal 2022"), *TABLE]
    cells = [("d", 2, 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    cells = spark.createDataFrame(cells, "doc_id string, page int, table_no int, row_no int, col_no int, text string")
    pages = spark.createDataFrame(
        [("d", 1, "cover"), ("d", 2, "Restated Consolidated Statement of Profit and Loss\n(All amounts in ₹ lakhs)")],
        "doc_id string, n int, text string")
    spans = spark.createDataFrame([], "doc_id string, key string, page_start int, page_end int")
    scan = facts.anchor_pages(pages, spans, ["financial_statements"])
    return facts.extract_facts(pages, cells, scan).cache()


def test_golden_table(facts_df):
    got = {(r.fiscal_label, r.metric): r.value for r in facts_df.collect()}
    assert got["FY24", "revenue"] == 7305.0
    assert got["FY24", "pat"] == 712.5
    assert got["FY24", "cfo"] == 801.5
    assert got["FY22", "capex"] == -246.0
    assert got["FY23", "receivables"] == 831.5


def test_series_ratios_and_growth(facts_df):
    row = analysis.ratios(facts.series(facts.wide_years(facts_df))).withColumn("ups", analysis.growth_steps("revenue")).first()
    latest = row.years[0]
    assert [y.fy for y in row.years] == [24, 23, 22]
    assert latest.total_debt == 850.0
    assert latest.ebitda == 1275.0
    assert row.ups == 2
    assert row.revenue_cagr == pytest.approx((7305.0 / 4900.0) ** 0.5 - 1)
    assert row.debt_equity == pytest.approx(850.0 / 3400.0)


def _rows(spark, text):
    page = spark.createDataFrame([("d", 1, text)], "doc_id string, n int, text string")
    out = facts.borderless_rows(facts.carry_headers(page)).collect()
    return {(r.metric, r.pos): list(r["values"]) for r in out}, {r.metric: list(r["values"]) for r in out}


def test_borderless_values_below_label(spark):
    text = "\n".join(["For the year ended", "March 31, 2026", "March 31, 2025", "Revenue from operations", "1,906.40",
                      "1,733.10", "Total assets", "Equity", "2,250.00", "2,118.00"])
    _, got = _rows(spark, text)
    assert got["revenue"] == [1906.4, 1733.1]
    assert got["total_assets"] == [2250.0, 2118.0]


def test_borderless_inline_and_dash(spark):
    _, got = _rows(spark, "Fiscal 2025\nFiscal 2024\nTotal borrowings - 150.00\nFinance costs 12.50 11.25")
    assert got["total_debt"] == [None, 150.0]
    assert got["finance_costs"] == [12.5, 11.25]


def test_borderless_note_column_and_junk(spark):
    _, got = _rows(spark, "FY 2025 FY 2024\nRevenue from operations\n25\n1,200.00\n1,100.00\nNet worth\nTotal A\n800.00\n700.00")
    assert got["revenue"] == [1200.0, 1100.0]
    assert got["net_worth"] == [800.0, 700.0]


def test_flow_rows_name_no_metric(spark):
    df = spark.createDataFrame([("(Increase)/ Decrease in trade receivables",), ("Proceeds from long-term borrowings",),
                                ("(a) Inventories",), ("Net cash flow generated from/(used in) operating activities",)], "t string")
    assert [r[0] for r in df.select(S.metric_of(F.col("t"))).collect()] == [None, None, "inventory", "cfo"]


def test_bare_borrowings_follow_their_heading(spark):
    text = "FY 2025 FY 2024\nNon-current liabilities\n(i) Borrowings\n50.00\n60.00\nCurrent liabilities\n(i) Borrowings\n20.00\n10.00"
    _, got = _rows(spark, text)
    assert got["borrowings_lt"] == [50.0, 60.0]
    assert got["borrowings_st"] == [20.0, 10.0]


def test_column_mismatch_is_dropped(spark):
    _, got = _rows(spark, "FY 2025 FY 2024 FY 2023\nTotal assets\n1,000.00\n2,000.00\n3,000.00\n4,000.00")
    assert got == {}


def test_stub_period_is_consumed_not_stored(spark):
    text = "December 31, 2025\nMarch 31, 2025\nMarch 31, 2024\nTotal assets\n9,000.00\n8,000.00\n7,000.00"
    page = spark.createDataFrame([("d", 1, text)], "doc_id string, n int, text string")
    head = facts.carry_headers(page)
    assert head.first().labels == ["STUB25", "FY25", "FY24"]
    got = {r.fiscal_label: r.value for r in facts.borderless_facts(head).collect()}
    assert got == {"FY25": 8000.0, "FY24": 7000.0}


def test_peers_and_valuation_call(spark):
    rows = [("Name of the company", "P/E", "EPS (Basic)", "RoNW (%)"), ("North Mills Ltd*", "28.4", "6.00", "11.0"),
            ("South Mills Ltd", "35.0", "4.50", "14.5"), ("East Mills Ltd", "22.0", "7.25", "9.5"), ("River Grain Limited", "-", "5.60", "16.0")]
    cells = spark.createDataFrame([("d", 9, 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)],
                                  "doc_id string, page int, table_no int, row_no int, col_no int, text string")
    names = spark.createDataFrame([("d", "River Grain Limited")], "doc_id string, company_name string")
    peers = entities.peers(cells, names)
    assert sorted(r.pe for r in peers.collect() if r.pe) == [22.0, 28.4, 35.0]
    assert [r.name for r in peers.collect() if r.is_issuer] == ["River Grain Limited"]
    med = analysis.peer_medians(peers).withColumns({
        "issuer_pe": F.lit(35.2), "price_high": F.lit(128.0), "issuer_eps": F.lit(None).cast("double"), "pat_cagr": F.lit(0.3)})
    row = analysis.valuation(med).first()
    assert (row.peer_pe_median, row.relative, row.call) == (28.4, 1.24, "fairly_valued_expensive")


def test_weighted_eps(spark):
    rows = [("Particulars", "Basic EPS (₹)", "Diluted EPS (₹)", "Weight"), ("Fiscal 2026", "12.40", "11.90", "3"),
            ("Fiscal 2025", "10.15", "9.95", "2"), ("Fiscal 2024", "7.60", "7.60", "1")]
    cells = spark.createDataFrame([("d", 9, 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)],
                                  "doc_id string, page int, table_no int, row_no int, col_no int, text string")
    assert entities.weighted_eps(cells).first().eps == round((12.40 * 3 + 10.15 * 2 + 7.60) / 6, 2)


def test_objects_pledge_and_dividend(spark):
    lines = spark.createDataFrame(
        [("d", 0, "Repayment of certain borrowings ₹ 140 crore"), ("d", 1, "Capital expenditure for a new unit ₹ 95 crore"),
         ("d", 2, "Working capital needs ₹ 60 crore"), ("d", 3, "General corporate purposes"), ("d", 4, "Contents")],
        "doc_id string, line_no int, line string")
    got = entities.objects(lines).orderBy("rank").collect()
    assert [r.category for r in got] == ["debt_repayment", "capex", "working_capital", "general_corporate"]
    assert got[0].amount_cr == 140.0
    pages = spark.createDataFrame(
        [("a", 3, "None of the Equity Shares held by our promoters are pledged."), ("b", 3, "Shares pledged by our promoters secure a loan.")],
        "doc_id string, n int, text string")
    ranges = spark.createDataFrame([("a", 1, 1, 9), ("b", 1, 1, 9)], "doc_id string, rank bigint, lo int, hi int")
    assert [r.doc_id for r in entities.pledging(pages, ranges).collect()] == ["b"]
    text = spark.createDataFrame([("We have not declared any dividend",), ("declared and paid dividends",), ("policy",)], "t string")
    assert [r[0] for r in text.select(entities.dividend(F.col("t"))).collect()] == [False, True, None]


def test_issue_details(spark):
    text = ("RIVER GRAIN LIMITED\nPrice Band: ₹ 120 to ₹ 128 per share. Face value of ₹ 10 each. Fresh issue of shares aggregating up to "
            "₹ 350 crores. Offer for sale of shares aggregating up to ₹ 420 crores. Bid lot of 110 equity shares. BSE and NSE\n"
            "Pre-offer promoters hold 61.7% of capital\nPost-offer promoters hold 48.9% of capital")
    pages = spark.createDataFrame([("d", 1, text)], "doc_id string, n int, text string")
    docs = spark.createDataFrame([("d",)], "doc_id string")
    spans = spark.createDataFrame([], "doc_id string, key string, page_start int, page_end int")
    r = entities.issue_details(pages, spans, docs).first()
    assert (r.price_band_low, r.price_band_high, r.fresh_issue_cr, r.ofs_cr, r.total_issue_cr) == (120.0, 128.0, 350.0, 420.0, 770.0)
    assert (r.lot_size, r.listing_at, r.pre_issue_promoter_pct, r.post_issue_promoter_pct) == (110, "BSE, NSE", 61.7, 48.9)
    assert sections.company_name(pages).first().company_name == "River Grain Limited"


def test_the_issuer_is_named_on_any_page(spark):
    rows = [("a", 1, "a scan"), ("a", 30, "front\nRIVER GRAIN LIMITED\n"), ("a", 31, "OTHER FOODS LIMITED"), ("b", 1, None), ("b", 2, ""),
            ("c", 2, "Oak Mills Limited"), ("c", 4, "OAK HOLDINGS LIMITED")]
    pages = spark.createDataFrame(rows, "doc_id string, n int, text string")
    got = {r.doc_id: (r.company_name, r.name_page) for r in sections.issuer_names(pages).collect()}
    assert got == {"a": ("River Grain Limited", 30), "c": ("Oak Mills Limited", 2)}


def test_sections_end_to_end(spark):
    pages = spark.createDataFrame([
        ("d", 1, "CONTENTS\nRISK FACTORS ........ 2\nOUR BUSINESS ........ 3"), ("d", 2, "front matter"),
        ("d", 3, "SECTION II - RISK FACTORS\ntop 10 customers contributed 57.8% of revenue"), ("d", 4, "more risks"),
        ("d", 5, "OUR BUSINESS\nwe make food"), ("d", 6, "DIVIDEND POLICY\nno dividend")], "doc_id string, n int, text string")
    toc = spark.createDataFrame([("d", 1, "Dividend Policy", 6)], "doc_id string, level int, title string, page int")
    out = {r.key: r for r in sections.locate_sections(pages, toc, spark).collect()}
    assert len(out) == 27
    assert (out["risk_factors"].page_start, out["risk_factors"].page_end, out["risk_factors"].method) == (3, 4, "printed_toc")
    assert (out["dividend_policy"].page_start, out["dividend_policy"].method) == (6, "toc")
    assert out["risk_factors"].text.startswith("SECTION II")
    assert not out["mdna"].found


def test_risk_findings_rank_and_score(spark, facts_df):
    years = facts.series(facts.wide_years(facts_df))
    profile = years.withColumns({
        "risk_text": F.lit("Our top 10 customers contributed 57.8% of revenue. The market is highly competitive."),
        "business_text": F.lit(""), "risk_page": F.lit(20), "source_pages": F.create_map(F.lit("cfo"), F.lit(9)), "criminal": F.lit(2), "total_cases": F.lit(25),
        "litigation_page": F.lit(30), "pledged": F.lit(False), "pledge_evidence": F.lit(None).cast("string"),
        "pledge_page": F.lit(None).cast("int")})
    found = risks.risk_findings(profile)
    got = {r.risk_type: r.severity for r in found.collect()}
    assert got["customer_concentration"] == "high"
    assert got["competition"] == "low"
    docs = spark.createDataFrame([("d",)], "doc_id string")
    sev = [r.severity for r in found.collect()]
    want = 100 - sum({"critical": 18, "high": 10, "medium": 4, "low": 1}[s] for s in sev)
    assert risks.penalty_score(found, docs).first().risk_score == want
    heat = {r.risk_type: (r.severity, r["count"]) for r in risks.heatmap(found, docs).collect()}
    assert len(heat) == 14 and heat["promoter_pledging"] == ("none", 0) and heat["litigation"][1] == 2


def test_evidence_begins_where_the_whole_pattern_matches(spark):
    """Context as by a search from the start of the text, by a pattern that never sees more than a few sentences."""
    from issuelens.functions import vocab
    from issuelens.functions.scalars import ci, snippet

    far, near = "ab " * 70, "x" * 30
    core = "the market is highly  competitive"
    texts = [core, f"{far}{core}{far}", f"One. Two\n{near} {core}. {far}", f"{far}.{near}{core} and highly competitive, {near}.", f"{far}\n{core}\n{far}. {core}",
             f"é😀{near}😀 {'😀' * 119}Intensely\tcompetitive{far}", f"highly competitive {near} highly competitive {far} highly competitive", f"{'.' * 200}highly competitive..",
             f"{near}. Highly competitive. {near}. Highly competitive. "]
    pattern = dict((k, p) for k, p, _, _ in vocab.RISK_PATTERNS)["competition"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    match = F.regexp_extract("t", ci(pattern), 0)
    want = snippet(F.col("t"), F.position(match, F.col("t")), F.length(match))
    got = risks._with_context(F.col("t"), pattern, lambda start, found: F.struct(found.alias("m"), snippet(F.col("t"), start, F.length(found)).alias("s")))
    for r in df.select("i", match.alias("m"), want.alias("s"), got.alias("got")).collect():
        assert (r.i, r.got.m, r.got.s) == (r.i, r.m, r.s) and r.m


def test_evidence_is_searched_at_its_core_only(spark):
    """A long text without stops: tried at each character, the context takes many seconds."""
    import time

    text = "abc de " * 1_000_000 + "a highly competitive trade. Negative working capital"
    profile = spark.createDataFrame([("d", text)], "doc_id string, risk_text string").select(
        "doc_id", F.expr("array(named_struct('fy', 24, 'total_debt', 1d, 'net_worth', null, 'current_assets', null, 'current_liabilities', null, 'cfo', 1d))").alias("years"),
        "risk_text", F.lit("").alias("business_text"), F.lit(20).alias("risk_page"), F.expr("cast(map() as map<string,int>)").alias("source_pages"),
        F.lit(0).alias("criminal"), F.lit(0).alias("total_cases"), F.lit(1).alias("litigation_page"), F.lit(False).alias("pledged"),
        F.lit(None).cast("string").alias("pledge_evidence"), F.lit(None).cast("int").alias("pledge_page"))
    found = risks.risk_findings(profile)
    found.filter("false").collect()
    began = time.time()
    got = {r.risk_type: r.evidence_text for r in found.collect()}
    assert set(got) == {"competition", "working_capital"} and got["working_capital"].strip() == "Negative working capital"
    assert "highly competitive trade" in got["competition"]
    assert time.time() - began < 25


def test_title_similarity():
    assert sections.token_set_ratio("risk factors", "internal risk factors") == 100.0
    assert sections.token_set_ratio("objects of the offer", "objects of the issue") > 82
    assert sections.token_set_ratio("glossary", "risk factors") < 50
    assert sections.token_set_ratio("", "risk factors") == 0.0


def test_seven_fiscal_years_are_kept(spark):
    heads = "\n".join(f"March 31, {y}" for y in range(2026, 2019, -1))
    text = f"{heads}\nTotal assets\n" + "\n".join(f"{v}00.00" for v in range(17, 10, -1))
    page = spark.createDataFrame([("d", 1, text)], "doc_id string, n int, text string")
    got = {r.fiscal_label: r.value for r in facts.borderless_facts(facts.carry_headers(page)).collect()}
    assert got == {f"FY{y}": v * 100.0 for y, v in zip(range(26, 19, -1), range(17, 10, -1), strict=True)}


def test_late_contents_headings_and_headers_count(spark):
    pages = [("d", n, f"page {n}") for n in range(1, 60)]
    pages[15] = ("d", 16, "RISK FACTORS ........ 2")
    pages[57] = ("d", 58, "\n".join(["x"] * 12 + ["RISK FACTORS", "text"]))
    df = spark.createDataFrame(pages, "doc_id string, n int, text string")
    assert [r.n for r in sections.toc_lines(df).collect()] == [16]
    heads = sections.heading_pages(df)
    assert [r.n for r in heads.collect()] == [58]
    claims = spark.createDataFrame([("d", "risk_factors", 2)], "doc_id string, key string, page_start int")
    assert sections.verify_pages(claims, heads).first().page_start == 58
    rows = [("note",)] * 5 + [("Particulars", "Fiscal 2024", "Fiscal 2023"), ("Total assets", "10.00", "9.00")]
    cells = spark.createDataFrame([("d", 1, 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)],
                                  "doc_id string, page int, table_no int, row_no int, col_no int, text string")
    assert sorted(r.value for r in facts.table_facts(cells).collect()) == [9.0, 10.0]


def test_findings_with_a_common_head_stay_apart(spark):
    head = "The company depends on a small number of large "
    df = spark.createDataFrame([("d", "k", head + "customers", "high", 1), ("d", "k", head + "suppliers", "low", 2), ("d", "k", head + "customers", "low", 3)],
                               "doc_id string, risk_type string, title string, severity string, ord int")
    assert sorted(r.ord for r in risks.dedupe_max(df, ["doc_id", "risk_type"], "title", "severity", "ord").collect()) == [1, 2]


def test_issue_details_beyond_the_cover(spark):
    pages = spark.createDataFrame([("d", 1, "cover"), ("d", 40, "Bid lot of 75 equity shares")], "doc_id string, n int, text string")
    docs = spark.createDataFrame([("d",)], "doc_id string")
    spans = spark.createDataFrame([], "doc_id string, key string, page_start int, page_end int")
    assert entities.issue_details(pages, spans, docs).first().lot_size == 75
