"""Scoring on read: features of a report, the rule forecast and the linear heads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import clip, first_match, log1p_pos, lookup

# --- fixed values: regimes of the rule forecast (by score, not overvalued) ----
REGIMES = [
    # min score, probability, break window, depth, bottom window, bottom depth, recover offer, recover listing
    (72.0, 0.25, (1, 10), -5, (0, 12), (-8, 5), (1, 20), (5, 60)),
    (60.0, 0.60, (5, 45), -15, (40, 90), (-25, -5), (70, 160), (90, 250)),
    (None, 0.85, (0, 25), -30, (60, 130), (-55, -15), (150, 400), (None, None)),
]
EXPENSIVE = ("overvalued", "fairly_valued_expensive")


def features(reports: DataFrame) -> DataFrame:
    """Identity-free feature row of each compact report.

    Needs columns overall, growth_score, cash_score, health_score, risk_score,
    flag_count, relative, call, fresh_cr, ofs_cr, total_cr, excerpt.
    """
    fresh, ofs = F.coalesce("fresh_cr", F.lit(0.0)), F.coalesce("ofs_cr", F.lit(0.0))
    both = F.nullif(fresh + ofs, F.lit(0.0))
    total = F.coalesce(F.nullif("total_cr", F.lit(0.0)), both)
    sector = first_match(F.lower(F.coalesce("excerpt", F.lit(""))), vocab.SECTOR_BUCKETS, "other", ignore_case=False)
    return reports.withColumns({
        "ofs_share": F.when(both > 0, F.round(ofs / both, 2)),
        "issue_size_log": F.when(total > 0, F.round(F.log10(total), 2)),
        "sector": sector,
        "loss_making": (F.coalesce("growth_score", F.lit(50.0)) < 40)
        & (F.coalesce("cash_score", F.lit(50.0)) < 40)})


def report_features(reports: DataFrame) -> DataFrame:
    """Feature columns straight from nested reports."""
    cat = lambda k: F.round(F.try_element_at("scoring.categories", F.lit(k))["score"], 1)
    flat = reports.select(
        "cg_ipo_id", F.col("scoring.overall").alias("overall"), cat("growth").alias("growth_score"),
        cat("cash_generation").alias("cash_score"), cat("financial_health").alias("health_score"),
        cat("governance").alias("governance_score"), cat("promoter_quality").alias("promoter_score"),
        F.col("risk.score").alias("risk_score"),
        F.coalesce(F.size("forensic.flags"), F.lit(0)).alias("flag_count"),
        F.col("valuation.relative").alias("relative"), F.col("valuation.call").alias("call"),
        F.col("snapshot.fresh_issue_cr").alias("fresh_cr"), F.col("snapshot.ofs_cr").alias("ofs_cr"),
        F.col("snapshot.total_issue_cr").alias("total_cr"), F.col("industry.excerpt").alias("excerpt"),
        F.col("meta.coverage").alias("coverage"))
    return features(flat)


def sector_flags(bucket: Column) -> dict[str, Column]:
    sector = F.coalesce(lookup(bucket, vocab.BUCKET_SECTOR), F.lit("Other"))
    return {"sector_name": sector, "is_financial": (sector == "Financials").cast("double"),
            "is_realestate": (sector == "Real Estate").cast("double")}


def rule_forecast(df: DataFrame) -> DataFrame:
    """Listing premium and the break, bottom and recovery windows of the score's regime."""
    score = F.coalesce("overall", F.lit(50.0))
    over = F.coalesce(F.col("call").isin(*EXPENSIVE), F.lit(False)) | (F.coalesce("relative", F.lit(0.0)) > 1.3)
    big = F.coalesce("ofs_share", F.lit(0.0)) >= 0.7
    mega = F.coalesce("issue_size_log", F.lit(0.0)) >= 3.7
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    prem = clip(6.0 + (score - 60) * 0.45 - one(over, 8.0) - one(big, 4.0) - one(mega, 3.0), -8.0, 35.0)

    def pick(get) -> Column:
        top, mid, low = (F.lit(get(r)) for r in REGIMES)
        return F.when((score >= REGIMES[0][0]) & ~over, top).when((score >= REGIMES[1][0]) & ~over, mid).otherwise(low)

    return df.withColumns({
        "premium_pct": F.round(prem, 1), "premium_low": F.round(prem - 8, 1), "premium_high": F.round(prem + 10, 1),
        "p_below_offer": pick(lambda r: r[1]), "below_from": pick(lambda r: r[2][0]), "below_to": pick(lambda r: r[2][1]),
        "expected_depth_pct": pick(lambda r: r[3]), "bottom_from": pick(lambda r: r[4][0]),
        "bottom_to": pick(lambda r: r[4][1]), "bottom_low_pct": pick(lambda r: r[5][0]),
        "bottom_high_pct": pick(lambda r: r[5][1]), "recover_from": pick(lambda r: r[6][0]),
        "recover_to": pick(lambda r: r[6][1]), "recover_listing_from": pick(lambda r: r[7][0]),
        "recover_listing_to": pick(lambda r: r[7][1])})


def listing_vector(df: DataFrame) -> DataFrame:
    """Scaled inputs of the small listing-premium model."""
    return df.withColumns({
        "x_bias": F.lit(1.0), "x_overall": F.coalesce("overall", F.lit(50.0)) / 100,
        "x_risk": F.coalesce("risk_score", F.lit(50.0)) / 100, "x_ofs": F.coalesce("ofs_share", F.lit(0.5)),
        "x_size": F.coalesce("issue_size_log", F.lit(3.0)) / 4,
        "x_over": F.coalesce(F.col("call").isin(*EXPENSIVE), F.lit(False)).cast("double"),
        "x_flags": F.least(F.col("flag_count"), F.lit(4)) / 4})


def signal_inputs(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Live signals on the model's scale, training medians where a signal is missing.

    Needs gmp, price_high, sub_qib, sub_nii, sub_bnii, sub_snii, sub_rii. A feature is
    served from the input it was trained on; a premium of zero is a value.
    """
    inputs = {
        "gmp_prem": clip(F.col("gmp") / F.nullif("price_high", F.lit(0.0)) * 100, -30.0, 150.0),
        "log_QIB": log1p_pos(F.col("sub_qib")), "log_bNII": log1p_pos(F.col("sub_bnii")),
        "log_sNII": log1p_pos(F.col("sub_snii")), "log_Retail": log1p_pos(F.col("sub_rii")),
        "log_NII": log1p_pos(F.coalesce("sub_nii", (F.col("sub_bnii") + F.col("sub_snii")) / 2))}
    return df.withColumns({k: F.coalesce(v, F.lit(float(medians.get(k, 0.0)))) for k, v in inputs.items()})


def score_linear(df: DataFrame, coef: Mapping[str, float], intercept: float,
                 medians: Mapping[str, float] | None = None) -> Column:
    """Linear score with training medians (else zero) for missing inputs."""
    out = F.lit(float(intercept))
    for name, weight in coef.items():
        fallback = float((medians or {}).get(name, 0.0))
        value = F.coalesce(F.col(f"`{name}`"), F.lit(fallback)) if name in df.columns else F.lit(fallback)
        out = out + value * float(weight)
    return out


def exit_call(r6: Column, r12: Column, r24: Column) -> list[Column]:
    """Best predicted horizon, 'avoid' when none is profitable, NULL when none is known."""
    best = F.greatest(r6, r12, r24)
    label = F.when(r6 == best, "6m").when(r12 == best, "12m").otherwise("24m")
    call = F.when(best <= 0, "avoid").when(best.isNotNull(), F.concat(F.lit("hold to ~"), label))
    return [call.alias("exit_call"), F.when(best > 0, F.round(best, 1)).alias("expected_ret_pct")]


def entry_call(bottom: Column, session: Column) -> list[Column]:
    at = F.greatest(F.round(session), F.lit(0.0)).cast("int")
    read = F.when(at <= 10, "dips are bought fast").when(at.isNotNull(), "patience pays") \
        .when(bottom.isNotNull(), "depth is predictable, timing is not")
    return [F.round(bottom, 1).alias("expected_bottom_pct"), at.alias("expected_bottom_session"),
            read.alias("entry_read")]
