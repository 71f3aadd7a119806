"""Side-by-side run of the registered queries and their SQL on one data folder.

python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if v != v:
            return "nan"
        r = float(f"{v:.10g}")
        return int(r) if r == int(r) and abs(r) < 1e15 else r
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    sc, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows", len(srows), None
    cur = con.execute(sql)
    dc, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return "SCHEMA", len(srows), f"{sc} != {dc}"
    if srows != drows:
        s, d = set(map(repr, srows)), set(map(repr, drows))
        return "VALUES", len(srows), (f"spark {len(srows)} duck {len(drows)}\n   only spark: {sorted(s - d)[:3]}"
                                      f"\n   only duck:  {sorted(d - s)[:3]} ({len(s - d)}/{len(d - s)})")
    return "ok", len(srows), None


def main(argv):
    from issuelens.session import get_session
    import __spark_entry__ as e

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    names = argv[1:] or list(qs)
    bad = 0
    for name in names:
        t = time.time()
        try:
            state, n, why = compare(spark, con, sf, name, qs[name], sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            state, n, why = "ERROR", 0, str(exc)[:1500]
        bad += state not in ("ok", "rows")
        print(f"{name:24} {state:7} {n:7} {time.time() - t:6.2f}s {why or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
