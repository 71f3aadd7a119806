"""Registry of the queries over the driver's tables, and the views they share.

The engine's own tables (issues, prices, facts, pages) are mapped onto the driver's:
a user's events are the price series of a symbol, an order is an issue, a customer and
year is a fiscal year, a document's lines make its pages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.facts import METRICS, series, wide_years
from ..session import spread
from ..sources.landing import daily_close

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@lru_cache(maxsize=256)
def _schema(app: str, path: str) -> StructType:
    """Schema of a table, read from the file footer once per application."""
    return SparkSession.builder.getOrCreate().read.parquet(path).schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.read.schema(_schema(spark.sparkContext.applicationId, path)).parquet(path)


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def R(expr: str, n: int) -> str:
    """SQL for half-up rounding on the decimal value, as Spark rounds doubles."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {n}) AS DOUBLE)"


# Sums of four- and six-decimal products can end on half a cent, where the order of
# summation decides; this offset is smaller than their last digit and avoids the edge.
NUDGE = 3.7e-7


# --- prices: symbol, session_date, close --------------------------------------
def prices(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("symbol"), F.to_date("ts").alias("session_date"),
        F.col("value").alias("close"), "ts", "event_id")
    return daily_close(ev, "symbol", "session_date", "close", ["ts", "event_id"])


PRICES = """prices AS (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS session_date, max_by(value, (ts, event_id)) AS close
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


# --- listings: one row per symbol ---------------------------------------------
def listings(spark: SparkSession, sf: str) -> DataFrame:
    """First session as the listing day, mean first-type value as the offer price."""
    ev = table(spark, sf, "events")
    return ev.groupBy(F.col("user_id").alias("symbol")).agg(
        F.min(F.to_date("ts")).alias("listing_date"),
        F.round(F.avg("value"), 2).alias("offer"),
        F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))) / 10 - 20, 2).alias("listing_gain"))


LISTINGS = """listings AS (
  SELECT user_id AS symbol, min(CAST(ts AS DATE)) AS listing_date, round(avg(value), 2) AS offer,
    round(avg(value) FILTER (event_type = 'view') / 10 - 20, 2) AS listing_gain
  FROM events GROUP BY 1)"""


# --- subscription: order x returnflag -----------------------------------------
def subscription(spark: SparkSession, sf: str) -> DataFrame:
    """Order as issue; quantity by return flag as class multiples, NULL without lines."""
    li = table(spark, sf, "lineitem")
    qty = li.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(n)
          for f, n in (("A", "qib"), ("N", "retail"), ("R", "nii"))],
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + NUDGE, 2).alias("net"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("opened"), "o_totalprice", "o_orderstatus", "o_custkey",
        "o_orderpriority").join(qty, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


SUBSCRIPTION = """qty AS (
  SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS qib,
    sum(l_quantity) FILTER (l_returnflag = 'N') AS retail, sum(l_quantity) FILTER (l_returnflag = 'R') AS nii,
    round(sum(l_extendedprice * (1 - l_discount)) + 3.7e-7, 2) AS net
  FROM lineitem GROUP BY 1),
subscription AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS opened, o_totalprice, o_orderstatus, o_custkey, o_orderpriority,
    qib, retail, nii, net
  FROM orders LEFT JOIN qty ON o_orderkey = l_orderkey)"""


# --- fiscal facts: customer x order year -----------------------------------------
def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Long facts (doc_id, fy, metric, value, page) per customer and order year."""
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, net))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"),
                                          F.year("o_orderdate").alias("fy"))
    sums = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("doc_id", "fy").agg(
        F.sum(net).alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("finance_costs"),
        F.sum(net * F.col("l_tax")).alias("depreciation"), (flag("A") - flag("R")).alias("pbt"),
        (0.75 * (flag("A") - flag("R"))).alias("pat"),
        F.sum(F.when(F.col("l_linestatus") == "O", net)).alias("receivables"),
        flag("N").alias("current_assets"), flag("R").alias("current_liabilities"),
        F.sum("l_extendedprice").alias("total_assets"),
        (F.sum("l_extendedprice") - 0.5 * flag("R")).alias("net_worth"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount") * 3).alias("borrowings_lt"),
        F.sum(F.when(F.col("l_linestatus") == "F", net * F.col("l_tax") * 4)).alias("borrowings_st"),
        (flag("N") - 0.5 * flag("A")).alias("cfo"), (-F.sum(net * F.col("l_tax"))).alias("capex"))
    names = [c for c in sums.columns if c not in ("doc_id", "fy")]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n) + NUDGE, 2).alias("value"),
                               F.lit(i + 1).alias("page")) for i, n in enumerate(names)])
    return sums.select("doc_id", "fy", F.explode(cells).alias("c")).select("doc_id", "fy", "c.*") \
        .filter(F.col("value").isNotNull())


FACT_METRICS = ["revenue", "finance_costs", "depreciation", "pbt", "pat", "receivables", "current_assets",
                "current_liabilities", "total_assets", "net_worth", "borrowings_lt", "borrowings_st", "cfo", "capex"]

WIDE = """raw AS (
  SELECT o_custkey AS doc_id, year(o_orderdate) AS fy, l_extendedprice * (1 - l_discount) AS net,
    l_extendedprice AS gross, l_discount AS d, l_tax AS t, l_returnflag AS f, l_linestatus AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sums AS (
  SELECT doc_id, fy, round(sum(net) + 3.7e-7, 2) AS revenue, round(sum(gross * d) + 3.7e-7, 2) AS finance_costs,
    round(sum(net * t) + 3.7e-7, 2) AS depreciation,
    round(sum(net) FILTER (f = 'A') - sum(net) FILTER (f = 'R') + 3.7e-7, 2) AS pbt,
    round(0.75 * (sum(net) FILTER (f = 'A') - sum(net) FILTER (f = 'R')) + 3.7e-7, 2) AS pat,
    round(sum(net) FILTER (s = 'O') + 3.7e-7, 2) AS receivables, round(sum(net) FILTER (f = 'N') + 3.7e-7, 2) AS current_assets,
    round(sum(net) FILTER (f = 'R') + 3.7e-7, 2) AS current_liabilities, round(sum(gross) + 3.7e-7, 2) AS total_assets,
    round(sum(gross) - 0.5 * sum(net) FILTER (f = 'R') + 3.7e-7, 2) AS net_worth,
    round(sum(gross * d * 3) + 3.7e-7, 2) AS borrowings_lt, round(sum(net * t * 4) FILTER (s = 'F') + 3.7e-7, 2) AS borrowings_st,
    round(sum(net) FILTER (f = 'N') - 0.5 * sum(net) FILTER (f = 'A') + 3.7e-7, 2) AS cfo, round(-sum(net * t) + 3.7e-7, 2) AS capex
  FROM raw GROUP BY 1, 2),
wide AS (
  SELECT *, CASE WHEN borrowings_lt IS NULL AND borrowings_st IS NULL THEN NULL
      ELSE round(coalesce(borrowings_lt, 0) + coalesce(borrowings_st, 0), 2) END AS total_debt,
    round(pbt + finance_costs + depreciation, 2) AS ebitda FROM sums),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fy DESC) - 1 AS rk,
    count(*) OVER (PARTITION BY doc_id) AS n_years FROM wide),
t0 AS (SELECT * FROM ranked WHERE rk = 0),
t1 AS (SELECT * FROM ranked WHERE rk = 1),
told AS (SELECT * FROM ranked WHERE rk = n_years - 1)"""


def fiscal_series(spark: SparkSession, sf: str) -> DataFrame:
    return series(wide_years(facts(spark, sf), METRICS))


# --- document pages: five lines each ------------------------------------------------
LINES_PER_PAGE = 5

PAGES = """lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents),
dpages AS (
  SELECT doc_id, CAST(line_no // 5 AS INT) + 1 AS n, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM lines GROUP BY 1, 2)"""


# Page numbers that skip one behind every short page, so that runs of pages have gaps.
GAPPED = """gapped AS (SELECT doc_id, n + count(*) FILTER (length(text) < 300)
  OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS n, text FROM dpages)"""


def gapped_pages(spark: SparkSession, sf: str) -> DataFrame:
    short = F.count(F.when(F.length("text") < 300, 1)).over(
        Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return doc_pages(spark, sf).select("doc_id", (F.col("n") + short).alias("n"), "text")


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.sections import pages_of_lines

    return pages_of_lines(texts(spark, sf).select("doc_id", "text"), LINES_PER_PAGE)


def texts(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return spread(table(spark, sf, name), key)
