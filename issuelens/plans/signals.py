"""Serving the pre-listing heads: which way an issue lists, and how far only if that head shipped.

The artifact is three small tables: coefficients (head, feature, coef), the intercept
being the feature ``intercept``; training medians (name, m); and what validation said
of each head (head, n, cv, baseline). A head without coefficients did not ship.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid

DIRECTION, MAGNITUDE = "direction", "magnitude"
INTERCEPT = "intercept"


def head_table(direction: Mapping[str, float] | None, magnitude: Mapping[str, float] | None, spark) -> DataFrame:
    """Coefficients as a table; a head that is None has no rows."""
    rows = [(head, name, float(w)) for head, coef in ((DIRECTION, direction), (MAGNITUDE, magnitude)) for name, w in (coef or {}).items()]
    return spark.createDataFrame(rows, "head string, feature string, coef double")


def serve_signals(df: DataFrame, row_id: str, inputs: Mapping[str, Column], coefs: DataFrame, medians: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(row_id, inputs_used, p_lists_above_offer, forecast_gain_pct, and the verdict columns).

    ``inputs`` are the live signals on the model's scale by feature name, NULL where a
    signal is missing: then the training median stands in, else zero. A feature that is
    no input counts with its median. ``inputs_used`` names the signals that were there.
    The size is withheld, as NULL, unless its head shipped; without any head there are
    no rows.

    The tables hold one row per feature and head and become one map each, so rows are
    scored where they are, without a shuffle.
    """
    per_head = coefs.groupBy("head").agg(F.map_from_entries(F.collect_list(F.struct("feature", "coef"))).alias("w"))
    model = per_head.agg(F.map_from_entries(F.collect_list(F.struct("head", "w")))).scalar()
    middle = medians.filter(F.col("m").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("name", "m")))).scalar()
    live = F.map_filter(F.create_map(*[x for name, c in inputs.items() for x in (F.lit(name), c.cast("double"))]), lambda _, v: v.isNotNull())
    seen = df.select(F.col(row_id), live.alias("__live")).withColumns({"__model": model, "__middle": middle})

    def scored(head: str) -> Column:
        weights = F.try_element_at("__model", F.lit(head))
        terms = F.transform(F.map_entries(weights), lambda e: F.when(e["key"] == INTERCEPT, e["value"]).otherwise(
            e["value"] * F.coalesce(F.try_element_at("__live", e["key"]), F.try_element_at("__middle", e["key"]), F.lit(0.0))))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    out = seen.filter(F.size("__model") > 0).select(
        row_id, F.array_sort(F.map_keys("__live")).alias("inputs_used"),
        F.round(sigmoid(scored(DIRECTION)), 2).alias("p_lists_above_offer"), F.round(scored(MAGNITUDE), 1).alias("forecast_gain_pct"))
    if verdicts is None:
        return out
    told = verdicts.agg(F.map_from_entries(F.collect_list(F.struct("head", F.struct("n", "cv", "baseline"))))).scalar()
    known = out.withColumn("__v", told)
    columns = {}
    for head, scale in ((DIRECTION, 2), (MAGNITUDE, 1)):
        shipped = F.col("p_lists_above_offer" if head == DIRECTION else "forecast_gain_pct").isNotNull()
        for name in ("cv", "baseline"):
            columns[f"{head}_{name}"] = F.when(shipped, F.round(F.try_element_at("__v", F.lit(head))[name], scale))
    return known.withColumns(columns).drop("__v")
