"""Writers: landed tables, the site payload, compact reports and append-only history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import any_not_null, finite


def rounded(c: Column, dtype: T.DataType, decimals: int = 2) -> Column:
    """Nested value with every float rounded and NaN or infinity turned into NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.round(finite(c), decimals)
    if isinstance(dtype, T.StructType):
        fields = [rounded(c.getField(f.name), f.dataType, decimals).alias(f.name)
                  for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: rounded(x, dtype.elementType, decimals))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: rounded(v, dtype.valueType, decimals))
    return c


def site_payload(df: DataFrame, decimals: int = 2) -> DataFrame:
    return df.select(*[rounded(F.col(f.name), f.dataType, decimals).alias(f.name)
                       for f in df.schema.fields])


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet table per name, in as many files as the plan has tasks."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def append_history(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").parquet(path)


def signal_map(pairs: Mapping[str, Column]) -> Column:
    """Map of the non-missing signals under short names, NULL when none is left."""
    full = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), finite(v))])
    kept = F.map_filter(full, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def compact_report(df: DataFrame, excerpt: int = 500, detail: int = 160, top: int = 5,
                   cases: int = 3) -> DataFrame:
    """Reports cut to what the forecaster and the site read."""
    findings = F.transform(
        F.slice(F.coalesce("risk.findings", F.array()), 1, top),
        lambda f: F.struct(f["title"].alias("title"), f["severity"].alias("severity")))
    flags = F.transform("forensic.flags", lambda f: F.struct(
        F.coalesce(f["rule"], f["name"]).alias("name"),
        F.substring(f["detail"], 1, detail).alias("detail")))
    ratios = {
        "pat_margin": F.col("financials.ratios.net_margin"),
        "ebitda_margin": F.col("financials.ratios.operating_margin"),
        "roe": F.col("financials.ratios.roe"),
        "roce": F.col("financials.ratios.roce"),
        "debt_equity": F.col("financials.ratios.debt_equity"),
        "post_ipo_pe": F.col("valuation.issuer_pe"),
    }
    fundamentals = F.when(any_not_null(*ratios.values()),
                          F.struct(*[v.alias(k) for k, v in ratios.items()]))
    return df.select(
        "cg_ipo_id", "scoring", "snapshot", "valuation",
        F.struct(F.col("risk.score").alias("score"), F.col("risk.boilerplate").alias("boilerplate"),
                 findings.alias("top")).alias("risk"),
        F.struct(flags.alias("flags")).alias("forensic"), "verdict", "meta",
        F.struct(F.substring("industry.excerpt", 1, excerpt).alias("excerpt")).alias("industry"),
        F.struct(F.slice("cases.bull", 1, cases).alias("bull"),
                 F.slice("cases.bear", 1, cases).alias("bear")).alias("cases"),
        fundamentals.alias("fundamentals"))
