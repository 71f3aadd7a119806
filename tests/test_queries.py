"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    state, rows, why = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert state in ("ok", "rows"), why
    if state == "rows":
        assert rows > 0


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert {"symbol", "ret_6m", "bottom_so_far_pct", "peak_24m_pct"} <= set(out.columns)
    assert out.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
