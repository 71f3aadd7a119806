"""Readers, sinks, the dataset builder and the path from pages to reports."""

import json

import pytest
from pyspark.sql import functions as F

from issuelens.functions import scalars as S
from issuelens.plans import dataset, forecast, prospectus
from issuelens.sources import landing, schemas, sinks


def test_csv_headers_are_cleaned_and_ids_stay_text(spark, tmp_path):
    (tmp_path / "g.csv").write_text("cg_ipo_id,company,~gmp<b>x</b>\n007,Acme Ltd.,12.5\n")
    df = landing.read_table(spark, str(tmp_path / "g.csv"), "cg_ipo_id string, company string, `~gmp<b>x</b>` double")
    assert df.columns == ["cg_ipo_id", "company", "gmp"]
    assert df.first().cg_ipo_id == "007"


def test_report_corpus_skips_broken_files(spark, tmp_path):
    good = {"scoring": {"overall": 61.5, "categories": {"growth": {"score": 30.0}, "cash_generation": {"score": 20.0}}},
            "snapshot": {"fresh_issue_cr": 100.0, "ofs_cr": 300.0}, "meta": {"coverage": 0.4}, "verdict": "v",
            "industry": {"excerpt": "x" * 600 + " software platform"}, "valuation": {"call": "overvalued", "issuer_pe": 30.0},
            "forensic": {"flags": [{"rule": "high_accruals", "detail": "d" * 200}]},
            "risk": {"score": 70.0, "findings": [{"title": f"t{i}", "severity": "low"} for i in range(7)]},
            "cases": {"bull": [{"text": str(i)} for i in range(5)], "bear": []}, "extra": {"ignored": 1}}
    (tmp_path / "116.json").write_text(json.dumps(good))
    (tmp_path / "9.json").write_text("{broken")
    reports = landing.read_reports(spark, str(tmp_path))
    assert [r.cg_ipo_id for r in reports.select("cg_ipo_id").collect()] == ["116"]
    slim = sinks.compact_report(reports).first()
    assert len(slim.risk.top) == 5 and len(slim.cases.bull) == 3 and len(slim.industry.excerpt) == 500
    assert slim.forensic.flags[0].name == "high_accruals" and len(slim.forensic.flags[0].detail) == 160
    assert slim.fundamentals.post_ipo_pe == 30.0
    f = forecast.rule_forecast(forecast.report_features(reports)).first()
    assert (f.ofs_share, f.issue_size_log, f.sector, f.loss_making) == (0.75, 2.6, "tech_platform", True)
    assert f.premium_pct == round(6 + 1.5 * 0.45 - 8 - 4, 1) and f.p_below_offer == 0.85


def test_chart_payload_to_local_days(spark):
    payload = {"chart": {"result": [{"timestamp": [1704080700, 1704102300, 1704167100, 1704253500],
                                     "indicators": {"quote": [{"close": [10.0, 11.0, None, 12.0]}]}}]}}
    df = spark.createDataFrame([("A", json.dumps(payload))], "symbol string, body string")
    got = {str(r.session_date): r.close for r in landing.chart_closes(df, "body", "symbol").collect()}
    assert got == {"2024-01-01": 11.0, "2024-01-03": 12.0}


def test_landed_rows_and_filings(spark):
    rows = spark.createDataFrame(
        [('<a href="https://x.in/ipo/acme/2624/">Acme <b>Ltd</b></a>', "1", "<i>5</i>"), ("Nameless", None, "x"), ("Late", "31.0", "y")],
        "Company string, id string, `~Price<br>` string")
    got = landing.clean_rows(rows, "Company", r"/ipo/[^/]+/(\d+)/", r'href="(https://x\.in/ipo/[^"]+)"', "id").collect()
    assert [(r.cg_ipo_id, r.company, r.Price) for r in got] == [("2624", "Acme Ltd", "5"), ("31", "Late", "y")]
    html = "".join(f"<td>Jan 0{i}, 2024</td> <td><a href='https://x.in/f/{u}' title=\"{t}\"></a>"
                   for i, u, t in ((1, "a", "Acme Ltd RHP"), (2, "b", "Acme corrigendum"), (3, "a", "Acme Ltd RHP")))
    page = spark.createDataFrame([(1, html)], "page int, html string")
    pat = r"""<td>([A-Z][a-z]{2} \d{2}, \d{4})</td>\s*<td><a href=['"](https://x\.in/f/[^'"]+)['"][^>]*title=["']([^"']+)["']"""
    f = landing.filings(page, "html", pat, ["page"]).collect()
    assert [(str(r.date), r.toks) for r in f] == [("2024-01-01", ["acme"])]


def test_page_blocks(spark):
    text = spark.createDataFrame([("QIB Shares Offered Not more than 50% Retail portion Not less than 35% NII Not less than 15%",)], "t string")
    r = text.select(*landing.reservation(F.col("t"))).first()
    assert (r.pct_qib, r.pct_retail, r.pct_nii, r.pct_anchor) == (50.0, 35.0, 15.0, 30.0)
    kpi = spark.createDataFrame([("Key Performance Indicator ROE 21.5% Debt / Equity 0.4 P/E (x) 18.2 25.1",)], "t string")
    k = kpi.select(*landing.kpi_block(F.col("t"))).first()
    assert (k.kpi_roe, k.kpi_debt_equity, k.kpi_post_ipo_pe, k.kpi_pb) == (21.5, 0.4, 25.1, None)


def test_scalars(spark):
    df = spark.createDataFrame([("₹ 1,23,456.78", "2624.0", "nan"), ("(45.5)", None, "12%"), ("–", "x1", "inf"), ("Rs. 7*", "7", "1,000")],
                               "a string, i string, n string")
    got = df.select(S.amount(F.col("a")), S.norm_id(F.col("i")), S.num(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(123456.78, "2624", None), (-45.5, "", 12.0), (None, "x1", None), (7.0, "7", 1000.0)]
    t = spark.createDataFrame([("see [p.3] and [p.12]",)], "t string").select(S.page_refs(F.col("t")), S.detect_unit(F.lit("(₹ in Lakhs)"))).first()
    assert (t[0], t[1]) == ([3, 12], "lakhs")


def test_tables_and_binary_documents(spark, tmp_path):
    df = spark.createDataFrame([(i, float("nan") if i % 2 else 1.239) for i in range(50)], "doc_id int, v double")
    sinks.write_tables({"t": sinks.site_payload(df)}, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "t"))
    assert back.count() == 50 and back.filter("v = 1.24").count() == 25 and back.filter("v IS NULL").count() == 25
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "Acme-DRHP.pdf").write_bytes(b"%PDF")
    r = landing.read_documents(spark, str(tmp_path / "docs")).first()
    assert (r.doc_type, r.file_size, len(r.sha256)) == ("DRHP", 4, 64)


def test_expanded_dataset(spark):
    issue = spark.createDataFrame([
        ("1", "Acme Ltd", None, "Book", "01-Jan-2024", "03-Jan-2024", "10-Jan-2024", "1,000", "500", "100", "400", "Bank"),
        ("2", "Beta Ltd", None, "Book", "01-Feb-2024", "03-Feb-2024", None, "50", "10", None, None, None)], schemas.ISSUE)
    subs = spark.createDataFrame([("1", 5.0, None, None, 3.0, 2.0, None, 4.0, 10)], schemas.SUBSCRIPTION)
    listing = spark.createDataFrame([("1", None, "Acme", "10-Jan-2024", "IN1", "ACME", None, "1000", "1,250", "25%")], schemas.LISTING)
    outc = spark.createDataFrame([("1", 12.5)], "cg_ipo_id string, current_ret double")
    sector = spark.createDataFrame([("1", "Energy")], "cg_ipo_id string, sector string")
    details = spark.createDataFrame([("1", "Tech", 50.0, None), ("2", "Tech", 40.0, 9.0)],
                                    "cg_ipo_id string, sector string, pct_qib double, kpi_roe double")
    for c in ("pct_retail", "pct_anchor", "kpi_roce", "kpi_debt_equity", "kpi_pat_margin", "kpi_ebitda_margin", "kpi_pb", "kpi_post_ipo_pe"):
        details = details.withColumn(c, F.lit(None).cast("double"))
    fund = "struct<pat_margin: double, ebitda_margin: double, roe: double, roce: double, debt_equity: double, post_ipo_pe: double>"
    reports = spark.createDataFrame([("1", (0.1, 0.2, 0.2345, 0.3, 0.4, 20.0))], f"cg_ipo_id string, fundamentals {fund}")
    gmp = spark.createDataFrame([("1", 9.0, 1062.0)], "cg_ipo_id string, gmp double, estimated_price double")
    hand = spark.createDataFrame([("BETA LIMITED", 77.0)], "Name string, ROCE double")
    out = {r.cg_ipo_id: r for r in dataset.expanded(issue, subs, listing, outc, sector, details, reports, gmp, hand).collect()}
    a, b = out["1"], out["2"]
    assert (a["Sector"], a["ROE"], a["GMP"], a["Listing Gain"], a["Day1 Close"], a["LTP Gain"]) == ("Energy", 23.45, 62.0, 25.0, 1250.0, 12.5)
    assert (b["Sector"], b["ROE"], b["ROCE"], b["QIB"]) == ("Tech", 9.0, 77.0, None)


@pytest.fixture(scope="module")
def corpus(spark):
    text = {
        1: "ACME FOODS LIMITED\nPrice Band: ₹ 315 to ₹ 332. Fresh issue of shares aggregating up to ₹ 600 crores. "
           "Offer for sale of shares aggregating up to ₹ 900 crores. Face value of ₹ 10",
        2: "RISK FACTORS\nOur top 10 customers contributed 62.4% of revenue. The industry is cyclical.",
        3: "OUR BUSINESS\nOne of the largest food makers in the region with many plants",
        4: "OBJECTS OF THE OFFER\nRepayment of borrowings ₹ 250 crore\nGeneral corporate purposes",
        5: "FINANCIAL STATEMENTS\nRestated Statement of Profit and Loss\n(₹ in lakhs)\nFiscal 2024\nFiscal 2023\nFiscal 2022\n"
           "Revenue from operations\n4,52,180.00\n3,61,420.00\n2,98,540.00\nProfit for the year\n49,870.00\n37,720.00\n29,430.00\n"
           "Net worth\n2,45,600.00\n1,96,400.00\n1,58,900.00\nTotal borrowings 96,600.00 1,12,100.00 1,17,500.00",
        6: "DIVIDEND POLICY\nOur Company has not declared any dividend in the past",
    }
    rows = [("acme", n, t) for n, t in text.items()] + [("blank", 1, "nothing to read here, only a cover page of a scan")]
    pages = spark.createDataFrame(rows, "doc_id string, n int, text string")
    toc = spark.createDataFrame([], "doc_id string, level int, title string, page int")
    cells = spark.createDataFrame([], "doc_id string, page int, table_no int, row_no int, col_no int, text string")
    return prospectus.analyse(spark, pages, toc, cells)


def test_pages_to_reports(corpus):
    reports = {r.doc_id: r for r in corpus["reports"].collect()}
    acme, blank = reports["acme"], reports["blank"]
    assert acme.company_name == "Acme Foods Limited"
    assert acme.revenue_cagr == pytest.approx((4521.8 / 2985.4) ** 0.5 - 1)
    assert 0 < acme.coverage < 1 and acme.overall > 0
    assert any(f.title.startswith("Top customer") and f.severity == "high" for f in acme.findings)
    asked = [q.question for q in acme.questions]
    assert asked[0].startswith("Why do existing holders")
    assert blank.confidence == "low" and all(not r.included or r.points is not None for r in blank.rules)


def test_included_means_points(corpus):
    rules = corpus["rules"]
    assert rules.filter("included != (points IS NOT NULL)").count() == 0
    growth = {r.rule: r.points for r in rules.filter("doc_id = 'acme' AND category = 'growth'").collect()}
    assert growth == {"revenue_cagr": 16.0, "pat_cagr": 20.0, "growth_consistency": 10.0}
