import json
import math

import pytest
from pyspark.sql import functions as F

from issuelens.plans.facts import borderless_facts, carry_headers
from issuelens.plans.signals import head_table, serve_signals
from issuelens.sources import landing

DIRECTION = {"intercept": 0.4, "gmp_prem": 0.05, "log_QIB": -0.3, "founded": 2.0}


@pytest.fixture(scope="module")
def issues(spark):
    rows = [(1, 20.0, 3.0), (2, None, 3.0), (3, None, None), (4, 0.0, 0.0), (5, float("1e6"), None)]
    return spark.createDataFrame(rows, "id long, prem double, qib double")


@pytest.fixture(scope="module")
def medians(spark):
    return spark.createDataFrame([("gmp_prem", 10.0), ("log_QIB", 1.5), ("unused", 3.0), ("founded", None)], "name string, m double")


def serve(df, coefs, medians, verdicts=None):
    inputs = {"gmp_prem": F.col("prem"), "log_QIB": F.col("qib")}
    return {r.id: r for r in serve_signals(df, "id", inputs, coefs, medians, verdicts).collect()}


def test_direction_with_medians_for_missing_signals(spark, issues, medians):
    got = serve(issues, head_table(DIRECTION, None, spark), medians)
    for i, prem, qib in [(1, 20, 3), (2, 10, 3), (3, 10, 1.5), (4, 0, 0)]:
        z = 0.4 + 0.05 * prem - 0.3 * qib
        assert got[i].p_lists_above_offer == round(1 / (1 + math.exp(-z)), 2)
    assert got[5].p_lists_above_offer == 1.0
    assert all(r.forecast_gain_pct is None for r in got.values())
    assert (got[1].inputs_used, got[2].inputs_used, got[3].inputs_used) == (["gmp_prem", "log_QIB"], ["log_QIB"], [])


def test_a_head_is_there_only_if_it_shipped(spark, issues, medians):
    verdicts = spark.createDataFrame([("direction", 90, 0.764, 0.712), ("magnitude", 90, 14.27, 16.04)], "head string, n long, cv double, baseline double")
    both = serve(issues, head_table(DIRECTION, {"intercept": 2.0, "gmp_prem": 0.9}, spark), medians, verdicts)
    assert both[1].forecast_gain_pct == 20.0 and both[2].forecast_gain_pct == 11.0
    assert (both[1].direction_cv, both[1].direction_baseline, both[1].magnitude_cv, both[1].magnitude_baseline) == (0.76, 0.71, 14.3, 16.0)
    size = serve(issues, head_table(None, {"intercept": 2.0}, spark), medians, verdicts)
    assert size[1].p_lists_above_offer is None and size[1].direction_cv is None and size[1].forecast_gain_pct == 2.0
    assert serve(issues, head_table(None, None, spark), medians) == {}
    assert serve(issues.filter("false"), head_table(DIRECTION, None, spark), medians) == {}


def test_reports_of_many_lines_are_read_whole(spark, tmp_path):
    good = {"scoring": {"overall": 61.5}, "meta": {"company_name": "Acme"}, "verdict": "v"}
    for name, body in {"116.json": json.dumps(good, indent=2), "9.json": json.dumps(good, indent=2)[:40], "7.txt": json.dumps(good), "8.json": ""}.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "id=33").mkdir()
    (tmp_path / "id=33" / "part-0.txt").write_text(json.dumps(good, indent=4) + "\n")
    assert [(r.cg_ipo_id, r.meta.company_name, r.scoring.overall) for r in landing.read_reports(spark, str(tmp_path)).collect()] == [("116", "Acme", 61.5)]
    assert [r.cg_ipo_id for r in landing.read_reports(spark, str(tmp_path), r"/id=([^/]+)/").collect()] == ["33"]


def test_the_last_liability_heading_names_bare_borrowings(spark):
    lines = ["year ended March 31, 2024", "year ended March 31, 2023", "Borrowings", "9.00", "8.00", "Non-Current Liabilities", "Borrowings", "1.00", "2.00",
             "Other line", "CURRENT LIABILITIES", "Provisions", "Borrowings", "3.00", "4.00"]
    pages = [(1, 1, "\n".join(lines)), (1, 2, "\n".join([*lines[:2], "Borrowings", "5.00", "6.00"])), (2, 1, None), (3, 1, "")]
    df = spark.createDataFrame(pages, "doc_id long, n int, text string")
    got = sorted((r.doc_id, r.page, r.fiscal_label, r.metric, r.value) for r in borderless_facts(carry_headers(df)).collect())
    assert got == [(1, 1, "FY23", "borrowings_lt", 2.0), (1, 1, "FY23", "borrowings_st", 4.0), (1, 1, "FY24", "borrowings_lt", 1.0), (1, 1, "FY24", "borrowings_st", 3.0)]


def test_dates_are_read_day_first(spark):
    from issuelens.functions.scalars import parse_day_first

    want = {"05/03/2024": "2024-03-05", "5-3-2024": "2024-03-05", "05.03.2024": "2024-03-05", "5-Mar-2024": "2024-03-05", " 05-MAR-2024 ": "2024-03-05",
            "5 march 2024": "2024-03-05", "2024-03-05": "2024-03-05", "25/12/2023": "2023-12-25", "12/25/2023": None, "tba": None, "": None, None: None, "31-02-2024": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.d and str(r.d) for r in df.select("t", parse_day_first(F.col("t")).alias("d")).collect()}
    assert got == want
def test_heads_are_validated_on_rows_made_once(spark):
    """Statistics of earlier rows only, as in a plain loop over the folds; the frame is evaluated once."""
    from datetime import date, timedelta

    import numpy as np

    from issuelens.plans import models

    luck = np.random.default_rng(5)
    n = 400
    a, b = luck.normal(3, 2, n), luck.normal(size=n)
    gain = 2 * a - b + luck.normal(size=n)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i, date(2020, 1, 1) + timedelta(i // 7), None if i % 5 == 0 else float(a[i]), None if i % 3 == 0 else float(b[i]), None, float(gain[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, day date, a double, b double, c double, raw double").withColumn("gain", counted("raw")).drop("raw")
    got = {r["head"]: r for r in models.fit_signals(df, ["a", "b", "c"], "gain", "day", "id").collect()}
    assert seen.value <= 2 * n  # once for the filter, once for the rows

    start, errors, sizes = int(n * 0.4), [], []
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    edges = [start + i * (n - start) // 5 for i in range(6)]
    for lo, hi in zip(edges, edges[1:]):
        mid = np.array([np.median(col[~np.isnan(col)]) if (~np.isnan(col)).any() else 0.0 for col in x[:lo].T])
        full = np.where(np.isnan(x), mid, x)
        sd = full[:lo].std(axis=0)
        z = np.c_[np.ones(n), (full - full[:lo].mean(axis=0)) / np.where(sd > 0, sd, 1)]
        w = np.linalg.pinv(z[:lo].T @ z[:lo] + np.diag([0, 1, 1, 1])) @ (z[:lo].T @ gain[:lo])
        errors.append(np.abs(z[lo:hi] @ w - gain[lo:hi]).mean())
        sizes.append(hi - lo)
    assert got["magnitude"].error == pytest.approx(np.average(errors, weights=sizes)) and got["magnitude"].folds == 5 and got["direction"].skill
