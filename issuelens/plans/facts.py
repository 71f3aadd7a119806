"""Fiscal facts from statement pages: tables, borderless text, units and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import (amount, ci, clean_label, detect_unit, extract, fiscal_label,
                                 fiscal_labels, metric_of, unit_factor)
from ..operators.ordering import ffill, islands, nearest_mark

TABLE = ["doc_id", "page", "table_no"]
METRICS = [
    "revenue", "other_income", "total_income", "finance_costs", "depreciation", "pbt", "pat",
    "ebitda", "total_assets", "net_worth", "borrowings_lt", "borrowings_st", "total_debt",
    "receivables", "current_assets", "current_liabilities", "cfo", "capex",
]


def anchor_pages(pages: DataFrame, spans: DataFrame, keys: Sequence[str],
                 patterns: Sequence[str] = vocab.STATEMENT_ANCHORS, follow: int = 3) -> DataFrame:
    """Pages to scan: those that name a statement inside the given chapters, plus the next ones.

    A document without any of the chapters is scanned whole.
    """
    ranges = spans.filter(F.col("key").isin(*keys)).select("doc_id", "page_start", "page_end")
    counts = pages.groupBy("doc_id").agg(F.max("n").alias("pages"))
    any_anchor = ci("(?:" + "|".join(patterns) + ")")
    named = pages.filter(F.col("text").rlike(any_anchor)).select("doc_id", "n")
    inside = named.join(ranges, "doc_id") \
        .filter(F.col("n").between(F.col("page_start"), F.col("page_end"))).select("doc_id", "n")
    whole = named.join(ranges.select("doc_id").distinct(), "doc_id", "left_anti")
    return inside.unionByName(whole).distinct().join(counts, "doc_id") \
        .select("doc_id", F.explode(F.sequence(
            F.col("n"), F.least(F.col("n") + follow, F.col("pages")))).alias("n")).distinct()


def resolve_units(scan: DataFrame, text: str = "text") -> DataFrame:
    """Unit of each scanned page: its own caption or the nearest one in the same run of pages."""
    marked = scan.withColumn("own_unit", detect_unit(F.col(text)))
    return nearest_mark(marked, ["doc_id"], "n", "own_unit", "unit")


def carry_headers(scan: DataFrame, text: str = "text") -> DataFrame:
    """Fiscal column headers of each page, carried on over contiguous pages."""
    own = fiscal_labels(F.col(text))
    runs = islands(scan, ["doc_id"], "n", "__run") \
        .withColumn("__own", F.when(F.size(own) > 0, own))
    w = Window.partitionBy("doc_id", "__run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("labels", F.last("__own", ignorenulls=True).over(w)) \
        .drop("__run", "__own")


def table_facts(cells: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Facts of ruled tables: metric label x fiscal column -> value.

    The header is the first row with at least two fiscal cells.
    """
    marked = cells.withColumn("fy", fiscal_label(F.col("text")))
    heads = marked.filter(F.col("fy").isNotNull()) \
        .groupBy(*TABLE, "row_no").agg(F.collect_list(F.struct("col_no", "fy")).alias("cols")) \
        .filter(F.size("cols") >= 2)
    header = heads.groupBy(*TABLE).agg(F.min("row_no").alias("head"),
                                       F.min_by("cols", "row_no").alias("cols"))
    fiscal = header.select(*TABLE, "head", F.explode("cols").alias("c")) \
        .select(*TABLE, "head", F.col("c.col_no").alias("col_no"), F.col("c.fy").alias("fiscal_label"))
    labels = cells.filter(F.col("col_no") == 0).withColumn("metric", metric_of(F.col("text"))) \
        .filter(F.col("metric").isNotNull()).select(*TABLE, "row_no", "metric")
    values = cells.withColumn("value", amount(F.col("text"))).filter(F.col("value").isNotNull()) \
        .drop("text")
    return values.join(fiscal, [*TABLE, "col_no"]).filter(F.col("row_no") > F.col("head")) \
        .join(labels, [*TABLE, "row_no"]) \
        .select("doc_id", "page", "fiscal_label", "metric", "value",
                F.lit(0).alias("source_rank"),
                (F.col("table_no") * 10_000 + F.col("row_no")).cast("bigint").alias("ord"),
                F.lit(confidence).alias("confidence"))


_CELL = rf"(?:{vocab.STATEMENT_NUMBER}|[-–—])"
_TAIL = rf"(?:^|\s)((?:{_CELL}\s+)*{_CELL})\s*$"
_DASHES = ("-", "–", "—")


def _cell_value(token: Column) -> Column:
    return F.when(token.isin(*_DASHES), F.lit(None).cast("double")).otherwise(amount(token))


def _liability_side(lines: Column, pos: Column) -> Column:
    """'lt' or 'st' by the last liability heading at or above a line."""
    sides = F.transform(F.slice(lines, 1, pos + 1), lambda x, i: F.when(
        x.rlike(ci(vocab.NON_CURRENT_HEADING)), F.struct(i.alias("i"), F.lit("lt").alias("s")))
        .when(x.rlike(ci(vocab.CURRENT_HEADING)), F.struct(i.alias("i"), F.lit("st").alias("s"))))
    return F.array_max(F.array_compact(sides))["s"]


def borderless_rows(pages: DataFrame) -> DataFrame:
    """Statement rows of pages without ruled tables.

    pages: (doc_id, n, text, labels). A row is a metric label followed by one value
    line per column, or with the values at its end. A leading note reference is
    dropped, up to two short junk lines before the values are skipped, and any other
    count mismatch drops the row. Label lines never depend on each other, so each is
    folded over the few lines below it inside its own page row: no shuffle, no Python.
    """
    n = F.size("labels")
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    base = pages.filter(n > 0).withColumn("__lines", lines) \
        .select("doc_id", "n", "labels", "__lines", F.posexplode("__lines").alias("pos", "line"))
    label = clean_label(F.col("line"))
    bare = label.rlike(ci(vocab.BARE_BORROWINGS))
    metric = F.coalesce(metric_of(F.col("line")), F.when(
        bare, F.concat(F.lit("borrowings_"), _liability_side(F.col("__lines"), F.col("pos")))))
    labelled = base.withColumn("metric", metric).filter(F.col("metric").isNotNull())

    tail = F.split(F.trim(extract(F.col("line"), _TAIL)), r"\s+")
    inline = F.transform(tail, _cell_value)
    inline_ok = (F.size(tail) == n) | (F.size(tail) == n + 1)

    start = F.struct(
        F.array().cast("array<double>").alias("vals"), F.lit(None).cast("string").alias("first"),
        F.lit(2).alias("junk"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        core = F.lower(F.regexp_replace(line, r"^[().]+|[().]+$", ""))
        dash = core.isin("-", "–", "—", "nil", "na")
        value = amount(line)
        empty = F.size(acc["vals"]) == 0
        full = F.size(acc["vals"]) >= n + 2
        junk = empty & (acc["junk"] > 0) & (F.length(line) < 12) & ~line.rlike(r"\d") \
            & metric_of(line).isNull()
        stop = acc["done"] | full
        takes = dash | value.isNotNull()
        return F.struct(
            F.when(~stop & takes, F.concat(acc["vals"], F.array(F.when(~dash, value))))
            .otherwise(acc["vals"]).alias("vals"),
            F.when(~stop & empty & takes & ~dash, line).otherwise(acc["first"]).alias("first"),
            F.when(~stop & ~takes & junk, acc["junk"] - 1).otherwise(acc["junk"]).alias("junk"),
            (stop | (~takes & ~junk)).alias("done"))

    below = F.slice("__lines", F.col("pos") + 2, n + 4)
    folded = labelled.withColumn("__in", inline).withColumn("__ok", F.coalesce(inline_ok, F.lit(False))) \
        .withColumn("__acc", F.when(~F.col("__ok"), F.aggregate(below, start, step)))
    vals = F.col("__acc.vals")
    note = (F.size(vals) == n + 1) & F.col("__acc.first").rlike(r"^\d{1,3}$")
    stacked = F.when(note, F.slice(vals, F.lit(2), n)).otherwise(vals)
    rows = folded.withColumn("values", F.when(
        F.col("__ok"), F.slice("__in", F.size("__in") - n + 1, n)).otherwise(stacked))
    kept = rows.filter((F.size("values") == n) & (
        F.col("__ok") | F.exists("values", lambda v: v.isNotNull())))
    return kept.select("doc_id", F.col("n"), "pos", "metric", "labels", "values")


def borderless_facts(pages: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Facts of borderless rows; stub periods are read but never stored."""
    pairs = borderless_rows(pages).select(
        "doc_id", "n", "pos", "metric", F.explode(F.arrays_zip("labels", "values")).alias("p"))
    return pairs.filter(F.col("p.values").isNotNull() & ~F.col("p.labels").startswith("STUB")) \
        .select("doc_id", F.col("n").alias("page"), F.col("p.labels").alias("fiscal_label"), "metric",
                F.col("p.values").alias("value"), F.lit(1).alias("source_rank"),
                F.col("pos").cast("bigint").alias("ord"), F.lit(confidence).alias("confidence"))


def first_value_wins(facts: DataFrame) -> DataFrame:
    """One value per fiscal year and metric: earlier page first, tables before text on a page."""
    order = F.struct("page", "source_rank", "ord")
    return facts.groupBy("doc_id", "fiscal_label", "metric").agg(
        F.min_by(F.struct("value", "page", "confidence"), order).alias("b")) \
        .select("doc_id", "fiscal_label", "metric", F.col("b.value").alias("value"),
                F.col("b.page").alias("page"), F.col("b.confidence").alias("confidence"))


def extract_facts(pages: DataFrame, cells: DataFrame, scan: DataFrame) -> DataFrame:
    """Facts in crore of all scanned pages of all documents."""
    scanned = pages.join(scan, ["doc_id", "n"])
    carried = ffill(resolve_units(scanned), ["doc_id"], ["n"], "unit", "unit")
    units = carried.select("doc_id", F.col("n").alias("page"), F.coalesce(
        unit_factor(F.col("unit")), F.lit(1.0)).alias("factor"))
    tables = table_facts(cells.join(scan.withColumnRenamed("n", "page"), ["doc_id", "page"]))
    text = borderless_facts(carry_headers(scanned))
    scaled = tables.unionByName(text).join(units, ["doc_id", "page"]) \
        .withColumn("value", F.round(F.col("value") * F.col("factor"), 2)).drop("factor")
    return first_value_wins(scaled).withColumn(
        "fy", F.substring("fiscal_label", 3, 2).cast("int"))


def wide_years(facts: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per document and fiscal year, a column per metric, derived metrics filled."""
    wide = facts.groupBy("doc_id", "fy").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    return derive(wide)


def derive(wide: DataFrame) -> DataFrame:
    """Debt, EBITDA and revenue where the document does not print them."""
    lt, st = F.col("borrowings_lt"), F.col("borrowings_st")
    debt = F.when(lt.isNotNull() | st.isNotNull(),
                  F.round(F.coalesce(lt, F.lit(0.0)) + F.coalesce(st, F.lit(0.0)), 2))
    ebitda = F.round(F.col("pbt") + F.col("finance_costs") + F.col("depreciation"), 2)
    revenue = F.round(F.col("total_income") - F.coalesce("other_income", F.lit(0.0)), 2)
    return wide.withColumns({"total_debt": F.coalesce("total_debt", debt),
                             "ebitda": F.coalesce("ebitda", ebitda),
                             "revenue": F.coalesce("revenue", revenue)})


def series(wide: DataFrame) -> DataFrame:
    """One row per document: its fiscal years as an array, latest first."""
    fields = [c for c in wide.columns if c != "doc_id"]
    packed = F.struct("fy", *[c for c in fields if c != "fy"])
    return wide.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(packed))).alias("years"))


def source_pages(facts: DataFrame) -> DataFrame:
    """First page that gave each metric, as a map per document."""
    per = facts.groupBy("doc_id", "metric").agg(F.min("page").alias("page"))
    return per.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "page"))).alias("source_pages"))


def year(metric: str, rank: int = 0) -> Column:
    """Metric of the rank-th latest fiscal year of a ``series`` row."""
    return F.get("years", F.lit(rank))[metric]


def cagr(metric: str) -> Column:
    """Growth between the oldest and the latest year; needs two years and positive ends."""
    n = F.size("years")
    last, first = year(metric), F.get("years", n - 1)[metric]
    ok = (n >= 2) & (last > 0) & (first > 0)
    return F.when(ok, F.pow(last / first, 1 / F.nullif((n - 1).cast("double"), F.lit(0.0))) - 1)


def fiscal_rank(facts: DataFrame) -> DataFrame:
    """Facts with the rank of their fiscal year, latest 0 (years per document are few)."""
    years = facts.select("doc_id", "fy").distinct()
    w = Window.partitionBy("doc_id").orderBy(F.col("fy").desc())
    return facts.join(years.withColumn("fiscal_rank", F.row_number().over(w) - 1), ["doc_id", "fy"])


def metric_present(facts: DataFrame) -> DataFrame:
    """Metrics with at least one value in any year."""
    return facts.groupBy("doc_id", "metric").agg(F.count("value").alias("years")).filter("years > 0")
