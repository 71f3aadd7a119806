"""Dataset builder: the wide table of one row per issue and its work lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.vocab import (GAIN, BASE_NAMES, SUB_NAMES, LISTING_NAMES, OUTCOME_NAMES, NUMERIC,
                               DETAIL_COLS, REPORT_COLS, TARGETS)
from ..functions.scalars import ci, first_match, lookup, norm_name, num, parse_date
from ..operators.joins import left_first
from ..operators.merge import priority_fill
from ..operators.ordering import grouped_index, top_per_group

def _pick(df: DataFrame, names: Mapping[str, str], key: str = "cg_ipo_id") -> DataFrame:
    return df.select(key, *[F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns])


def expanded(issue: DataFrame, subs: DataFrame, listing: DataFrame, outcomes: DataFrame,
             sectors: DataFrame, details: DataFrame, reports: DataFrame, gmp: DataFrame,
             hand_sheet: DataFrame, order: str = "cg_ipo_id") -> DataFrame:
    """The wide dataset: base facts, subscription, listing day, outcomes and filled columns.

    Automated sources fill each target column in order; the hand sheet comes last by
    normalised name. The grey-market premium is repaired from the estimated price.
    """
    key = "cg_ipo_id"
    base = _pick(issue, BASE_NAMES)
    for right, names in ((subs, SUB_NAMES), (listing, LISTING_NAMES), (outcomes, OUTCOME_NAMES)):
        picked = _pick(right, names)
        ties = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in picked.columns]))]
        base = left_first(base, picked, key, [F.col(order), *ties])
    def first(df: DataFrame) -> DataFrame:
        """One row per key: of each column the first non-null value, rows ordered by all their values."""
        rest = [c for c in df.columns if c != key]
        order = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))
        return df.groupBy(key).agg(*[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in rest])

    col = lambda c: F.col(f"`{c}`")
    filled = priority_fill(base, key, [
        (first(sectors), {"Sector": F.col("sector")}),
        (first(details), {c: F.col(src) for c, src in DETAIL_COLS.items()}),
        (first(reports), {c: F.round(F.col(f"fundamentals.{src}") * scale, 2)
                          for c, (src, scale) in REPORT_COLS.items()}),
        (first(outcomes), {"LTP Gain": F.col("current_ret")}),
        (first(gmp), {"GMP": F.col("gmp"), "Estimated Price": F.col("estimated_price")}),
    ], [c for c in TARGETS])
    sheet = top_per_group(hand_sheet.withColumn("__k", norm_name(F.col("Name"))), ["__k"], [F.col("Name")])
    sheet_cols = [c for c in TARGETS if c in hand_sheet.columns]
    out = filled.withColumn("__k", norm_name(F.col("Name"))).join(
        sheet.select("__k", *[col(c).alias(f"__h_{c}") for c in sheet_cols]), "__k", "left")
    out = out.withColumns({c: F.coalesce(col(c), col(f"__h_{c}")) for c in sheet_cols}) \
        .drop("__k", *[f"__h_{c}" for c in sheet_cols])
    out = out.withColumns({c: num(col(c)) for c in NUMERIC})
    out = out.withColumn("GMP", repair_gmp(col("Estimated Price"), col("Offer Price"), col("GMP")))
    return out.orderBy(parse_date(col("List Date")).desc_nulls_last(), key)


def repair_gmp(estimate: Column, offer: Column, reported: Column) -> Column:
    """Premium as estimate less offer when both exist, the reported figure otherwise."""
    return F.coalesce(F.round(estimate - offer, 2), reported)


def data_dictionary(df: DataFrame, notes: Mapping[str, str]) -> list[tuple[str, str]]:
    return [(c, notes.get(c, "")) for c in df.columns]


# ------------------------------------------------------------------ sectors

def instrument(name: Column, industry: Column) -> Column:
    blob = F.concat_ws(" ", name, F.coalesce(industry, F.lit("")))
    return F.when(blob.rlike(ci(vocab.INVIT_NAME)), "invit") \
        .when(blob.rlike(ci(vocab.REIT_NAME)), "reit").otherwise("equity")


def canon_sector(c: Column) -> Column:
    """Profile sector in the dataset's vocabulary; an unknown label passes through."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(lookup(F.lower(text), vocab.PROFILE_SECTOR), text)


def sector_cascade(df: DataFrame, name: str = "company", profile: str = "yahoo_sector",
                   industry: str = "yahoo_industry", bucket: str = "report_sector",
                   name_rules: Sequence[tuple[str, str]] = vocab.NAME_SECTORS) -> DataFrame:
    """Sector with its source: market profile, prospectus bucket, company name, else Other."""
    by_profile = canon_sector(F.col(profile))
    by_report = lookup(F.col(bucket), vocab.BUCKET_SECTOR)
    by_name = first_match(F.col(name), name_rules)
    sector = F.coalesce(by_profile, by_report, by_name, F.lit("Other"))
    ind = F.nullif(F.col(industry), F.lit(""))
    fin = F.when(ind.isNotNull(), ind.rlike(ci(vocab.FINANCIAL_INDUSTRY))).otherwise(F.col("sector") == "Financials")
    re_ = F.when(ind.isNotNull(), ind.rlike(ci(vocab.REALTY_INDUSTRY))).otherwise(F.col("sector") == "Real Estate")
    return df.withColumn("sector", sector).withColumns({
        "source": F.when(by_profile.isNotNull(), "yahoo").when(by_report.isNotNull(), "rhp")
        .when(by_name.isNotNull(), "name").otherwise("unknown"),
        "instrument": instrument(F.col(name), F.col(industry)),
        "is_financial": fin.cast("int"), "is_realestate": re_.cast("int")})


# ------------------------------------------------------------------ refresh decisions and queues

def refresh_due(listed: Column, final: Column, known: Column, now: Column, days: int = 760) -> Column:
    """False for issues older than ``days`` whose final value or company is on record."""
    old = F.datediff(now, listed) > days
    settled = F.coalesce(final.isNotNull() | (known.isNotNull() & (known != "")), F.lit(False))
    return listed.isNotNull() & ~(old & settled)


def needs_fetch(values: Sequence[Column], sector: Column, fetched: Column, now: Column,
                retry_days: int = 7) -> Column:
    """True when details or sector are missing and the last try is a week old."""
    gap = F.coalesce(*[v.cast("string") for v in values]).isNull() | F.coalesce(sector, F.lit("")).eqNullSafe("")
    recent = F.coalesce(F.datediff(now, fetched) < retry_days, F.lit(False))
    return gap & ~recent


def work_budget(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def site_window(opened: Column, listed: Column, now: Column, days: int = 550, pending: int = 120) -> Column:
    """Issues the site shows: recently listed, opened lately without a listing, or still to open."""
    return F.coalesce(listed >= F.date_sub(now, days), F.lit(False)) \
        | (listed.isNull() & F.coalesce(opened >= F.date_sub(now, pending), F.lit(False))) \
        | F.coalesce(opened >= now, F.lit(False))


def maturity_weight(ret_6m: Column, ret_12m: Column, ret_24m: Column) -> Column:
    return F.when(ret_24m.isNotNull(), 3).when(ret_12m.isNotNull(), 2).when(ret_6m.isNotNull(), 1).otherwise(0)


def stratified_queue(df: DataFrame, day: str, weight: str, row_id: str, rows_per_cell: int = 1_000_000
                     ) -> DataFrame:
    """Round-robin work queue over years: rank in year by weight and date, newest first.

    ``row_id`` is a unique number and breaks ties.
    """
    staged = df.withColumn("year", F.year(day))
    return grouped_index(staged, ["year"], [(weight, True), (day, True)], row_id, "rank_in_year", rows_per_cell) \
        .orderBy("rank_in_year", F.col(weight).desc(), F.col("year").desc())
