"""Split-proof return outcomes per issue from daily closes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, rebase

HORIZONS = {"ret_6m": 182, "ret_12m": 365, "ret_24m": 730}


def sessions(prices: DataFrame, symbol: str = "symbol", day: str = "session_date") -> DataFrame:
    """Session number since the first close (a symbol has at most one row per day)."""
    w = Window.partitionBy(symbol).orderBy(day)
    return prices.withColumn("session", F.row_number().over(w) - 1)


def over(px: Column, by: Column) -> Column:
    """``px / by`` as doubles divide: zero over zero is NaN, anything else over zero infinite."""
    return F.when(by == 0, px * F.lit(float("inf"))).otherwise(px / by)


def outcomes(prices: DataFrame, listings: DataFrame, now: Column,
             horizons: Mapping[str, int] = HORIZONS, tolerance: int = 21, lead: int = 5,
             min_closes: int = 5, max_gap: int = 20, bottom_days: int = 365,
             bottom_min: int = 10, bottom_final: int = 300, peak_days: int = 730,
             delisted_gap: int = 30, window_days: int = 800, decimals: int = 1) -> DataFrame:
    """Returns at horizons, deepest point and later peak of every listed symbol.

    prices (symbol, session_date, close), one row per day; listings (symbol,
    listing_date, offer, listing_gain), one row per symbol. Returns chain from the
    day-1 base factor, so a later split in the series cannot distort them; on a first
    close of zero they are infinite or NaN, as in the SQL. The first
    pass aggregates each symbol once; the peak depends on the bottom, so a second
    pass joins the bottom back to the same partitioning.
    """
    p = prices.join(listings, "symbol").filter(F.col("session_date") >= F.date_sub("listing_date", lead))
    num = sessions(p)
    day, close, sess = F.col("session_date"), F.col("close"), F.col("session")
    in12 = day <= F.date_add("listing_date", bottom_days)
    aggs = [
        F.count("*").alias("n"),
        F.min_by("close", "session_date").alias("day1"),
        F.min("session_date").alias("first_day"),
        F.max_by("close", "session_date").alias("last_close"),
        F.max("session_date").alias("last_day"),
        F.count(F.when(in12, 1)).alias("n12"),
        F.max(F.when(in12, day)).alias("last12"),
        F.min(F.when(in12, F.struct(close.alias("c"), sess.alias("s"), day.alias("d")))).alias("bot"),
    ]
    for name, days in horizons.items():
        aggs.append(F.max(F.when(day <= F.date_add("listing_date", days),
                                 F.struct(day.alias("d"), close.alias("c")))).alias(f"at_{name}"))
    keys = ["symbol", "listing_date", "offer", "listing_gain"]
    first = num.groupBy(*keys).agg(*aggs).filter(
        (F.col("n") >= min_closes) & (F.col("offer") > 0)
        & (F.datediff("first_day", "listing_date") <= max_gap))
    gain = finite(F.col("listing_gain"))
    base = F.coalesce(1 + gain / 100, F.col("day1") / F.col("offer"))
    limit = F.least(F.date_add("listing_date", window_days), now)
    first = first.withColumn("base", base) \
        .withColumn("delisted", F.col("last_day") < F.date_sub(limit, delisted_gap)) \
        .withColumn("has_bottom", F.col("n12") >= bottom_min) \
        .withColumn("final_bottom", F.col("has_bottom") & (
            F.col("delisted") | (F.col("last12") >= F.date_add("listing_date", bottom_final))))

    floor = first.filter("final_bottom").select(
        "symbol", F.col("bot.d").alias("bot_day"), F.col("bot.s").alias("bot_s"))
    after = num.join(floor, "symbol").filter(
        (day >= F.col("bot_day")) & (day <= F.date_add("listing_date", peak_days)))
    peaks = after.groupBy("symbol").agg(
        F.max(F.struct(close.alias("c"), (-sess).alias("s"))).alias("peak"))

    def pct(px: Column) -> Column:
        return F.round((F.col("base") * over(px, F.col("day1")) - 1) * 100, decimals)

    rets = []
    for name, days in horizons.items():
        at = F.col(f"at_{name}")
        ok = (at["d"] >= F.date_add("listing_date", days - tolerance)) | F.col("delisted")
        rets.append(F.when(ok, pct(at["c"])).alias(name))
    low = pct(F.col("bot.c"))
    return first.join(peaks, "symbol", "left").select(
        "symbol", "listing_date", F.col("offer").alias("issue_price"),
        pct(F.col("day1")).alias("ret_1d"), *rets, pct(F.col("last_close")).alias("current_ret"),
        "delisted", F.col("last_day").alias("last_date"),
        F.when(F.col("has_bottom"), low).alias("bottom_so_far_pct"),
        F.when(F.col("has_bottom"), F.col("bot.s")).alias("bottom_so_far_session"),
        F.when(F.col("final_bottom"), low).alias("bottom_12m_pct"),
        F.when(F.col("final_bottom"), F.col("bot.s")).alias("sessions_to_bottom"),
        pct(F.col("peak.c")).alias("peak_24m_pct"),
        (-F.col("peak.s")).alias("sessions_to_peak"))


def from_listing(df: DataFrame, returns: list[str], day1: str = "day1_gain",
                 suffix: str = "_from_listing") -> DataFrame:
    """Adds each return measured from the listing price."""
    return df.select("*", *[F.round(rebase(F.col(r), F.col(day1)), 1).alias(r + suffix)
                            for r in returns])
