"""Findings of order lines: flags of null titles, and no sort of all lines."""

import io
import re
from contextlib import redirect_stdout

from issuelens.catalog.rules_q import _line_findings


def put(spark, path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    lines = [(1, 1, "A", 50.0), (2, 1, "A", 3.0), (1, 2, "R", 46.0), (3, None, "N", 50.0), (3, None, "A", 1.0), (3, 1, None, 2.0), (4, 1, "N", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{path}/lineitem.parquet")


def explained(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_line_findings_by_title(spark, tmp_path):
    put(spark, tmp_path)
    found = _line_findings(spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([
        (7, "A line 1", 75, "critical", "A"), (7, "R line 2", 102, "high", "R"), (8, None, None, "critical", "N"),
        (None, "N line 1", 88, "medium", "N")], key=str)
    plan = explained(found)
    assert len(re.findall(r"\bHashAggregate", plan)) >= 2  # the lines themselves are counted without a sort
