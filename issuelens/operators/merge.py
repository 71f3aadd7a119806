"""Keyed merges: latest row, upsert, per-column refresh and the write-once ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import top_per_group


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row that comes last in the given order, per key (pass descending columns)."""
    return top_per_group(df, keys, order, 1)


def upsert(old: DataFrame, fresh: DataFrame, keys: Sequence[str],
           order: Sequence[Column] | None = None) -> DataFrame:
    """Fresh rows replace old rows of the same key; columns may differ.

    With ``order`` (ascending) a key repeated in the batch keeps its last row.
    """
    if order is not None:
        fresh = latest(fresh, keys, order)
    kept = old.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True)


def coalesce_upsert(old: DataFrame, fresh: DataFrame, keys: Sequence[str],
                    keep_old: Sequence[str], overwrite: Sequence[str] = ()) -> DataFrame:
    """Per-column refresh of unique-key tables.

    ``keep_old`` columns keep the stored value when the fresh one is missing;
    ``overwrite`` columns take the fresh value, missing or not, of a refreshed key.
    """
    f = fresh.select(*keys, F.lit(True).alias("__new"),
                     *[F.col(c).alias(f"__{c}") for c in [*keep_old, *overwrite]])
    joined = old.join(f, list(keys), "full_outer")
    cols = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in keep_old]
    cols += [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
             for c in overwrite]
    rest = [c for c in old.columns if c not in {*keys, *keep_old, *overwrite}]
    return joined.select(*keys, *cols, *rest)


def ledger_merge(ledger: DataFrame, calls: DataFrame, key: str, call_cols: Sequence[str],
                 outcome_cols: Sequence[str]) -> DataFrame:
    """Write-once ledger: a recorded call never changes, outcomes only fill gaps."""
    new = calls.select(key, F.lit(True).alias("__new"),
                       *[F.col(c).alias(f"__{c}") for c in [*call_cols, *outcome_cols]])
    old = ledger.withColumn("__old", F.lit(True))
    joined = old.join(new, key, "full_outer")
    fixed = [F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
             for c in call_cols]
    filled = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in outcome_cols]
    return joined.select(key, *fixed, *filled)


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Row batches of several sources or years; schema drift becomes NULL columns."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def retrofit(reports: DataFrame, corpus: DataFrame, key: str, struct: str) -> DataFrame:
    """Fill a missing struct from another corpus by key; says what happened per row."""
    other = corpus.select(key, F.col(struct).alias("__other"), F.lit(True).alias("__hit"))
    joined = reports.join(other, key, "left")
    state = F.when(F.col(struct).isNotNull(), "had") \
        .when(F.col("__other").isNotNull(), "patched").otherwise("unmatched")
    return joined.withColumn("state", state) \
        .withColumn(struct, F.coalesce(struct, "__other")).drop("__other", "__hit")


def priority_fill(base: DataFrame, key: str,
                  sources: Sequence[tuple[DataFrame, Mapping[str, Column]]],
                  columns: Sequence[str]) -> DataFrame:
    """First non-missing value per column over an ordered list of keyed sources.

    Every source is (table with unique keys, {target column: expression}); a value
    of '' counts as missing. Null keys of the base match nothing and stay.
    """
    out = base
    for i, (table, mapping) in enumerate(sources):
        picked = table.select(
            key, *[F.when(expr.cast("string") != "", expr).alias(f"__{i}_{c}")
                   for c, expr in mapping.items()])
        out = out.join(picked, key, "left")
    filled = []
    for c in columns:
        options = [F.col(c)] if c in base.columns else []
        options += [F.col(f"__{i}_{c}") for i, (_, m) in enumerate(sources) if c in m]
        filled.append(F.coalesce(*options).alias(c))
    return out.select(*[c for c in base.columns if c not in columns], *filled)


def first_valid(candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], valid: Column
                ) -> DataFrame:
    """First candidate in the order of trial whose result is valid."""
    return top_per_group(candidates.filter(valid), keys, order, 1)
