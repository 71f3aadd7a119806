"""Joins the built-in operators do not name: containment, overlap, interval, as-of, nearest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import day_sequence, top_per_group


def dim_lookup(facts: DataFrame, dim: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Left join to a dimension of which only the last duplicate counts."""
    return facts.join(top_per_group(dim, [key], order, 1), key, "left")


def left_first(base: DataFrame, right: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Left equi join after keeping the first right row per key."""
    return base.join(top_per_group(right, [key], order, 1), key, "left")


def _token_counts(df: DataFrame, toks: str) -> DataFrame:
    return df.select(F.explode(toks).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


def _salted_candidates(probes: DataFrame, targets: DataFrame, counts: DataFrame,
                       target_id: str, rows_per_salt: int) -> DataFrame:
    """Equi join on token in which a token carried by many targets is split by salt.

    probes: (…, tok); targets: (target_id, …, tok); counts: (tok, df of the targets).
    The few tokens that probes use prune the target side first.
    """
    salts = F.ceil(F.col("df") / rows_per_salt).cast("int").alias("salts")
    used = probes.select("tok").distinct().join(counts, "tok").select("tok", salts)
    left = probes.join(used, "tok").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = targets.join(used, "tok") \
        .withColumn("salt", F.pmod(F.xxhash64(target_id), F.col("salts")).cast("int"))
    return left.drop("salts").join(right.drop("salts"), ["tok", "salt"]).drop("tok", "salt")


def token_subset_join(names: DataFrame, titles: DataFrame, name_id: str, name_toks: str,
                      title_id: str, title_toks: str, rows_per_salt: int = 100_000) -> DataFrame:
    """Pairs whose name tokens all occur in the title (an empty name matches nothing).

    A name is looked up by its rarest token only, so every pair is met once and a
    common word never builds a candidate list unless a name has nothing rarer; what
    remains hot is salted. Equal token sets are joined once and expanded to ids last.
    Result: (name_id, title_id).
    """
    named, titled = _token_keys(names, name_id, name_toks, "__n"), _token_keys(titles, title_id, title_toks, "__t")
    return _subset_hits(named, titled, rows_per_salt).join(named, "__nk").join(titled, "__tk").select(name_id, title_id)


def _token_keys(df: DataFrame, row_id: str, toks: str, name: str, *more: str) -> DataFrame:
    """(row_id, tokens sorted, their text as key, more columns)."""
    return df.select(row_id, F.array_sort(toks).alias(name), *more).withColumn(f"{name}k", F.to_json(name))


def _subset_hits(named: DataFrame, titled: DataFrame, rows_per_salt: int) -> DataFrame:
    """(__nk, __tk): token sets of names that lie whole in token sets of titles."""
    n = named.filter(F.size("__n") > 0).select("__nk", "__n").dropDuplicates(["__nk"])
    t = titled.select("__tk", "__t").dropDuplicates(["__tk"])
    counts = _token_counts(t, "__t")
    weighed = n.withColumn("tok", F.explode("__n")).join(counts, "tok", "left") \
        .withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = top_per_group(weighed, ["__nk"], [F.col("df"), F.col("tok")], 1) \
        .filter(F.col("df") > 0).drop("df")
    pairs = _salted_candidates(rarest, t.withColumn("tok", F.explode("__t")), counts,
                               "__tk", rows_per_salt)
    return pairs.filter(F.size(F.array_except("__n", "__t")) == 0).select("__nk", "__tk")


def token_overlap_join(left: DataFrame, table: DataFrame, left_id: str, left_toks: str,
                       table_id: str, table_toks: str, order: str,
                       rows_per_salt: int = 100_000) -> DataFrame:
    """First table row (by ``order``) that fuzzily matches each left row.

    Match: one token set contains the other, or they share at least
    max(2, |table tokens| - 1) tokens. Prefix filter: a table row that misses at most
    one token still shares one of its two rarest, and a left row inside a table row
    shares its rarest, so only those tokens are joined. Equal token sets are joined
    once, the table's with their first row, and expanded to ids last.
    """
    named = left.select(left_id, F.array_sort(left_toks).alias("__l")).filter(F.size("__l") > 0) \
        .withColumn("__lk", F.to_json("__l"))
    l = named.select("__lk", "__l").dropDuplicates(["__lk"])
    r = table.select(F.array_sort(table_toks).alias("__r"), F.struct(F.col(order).alias("o"), F.col(table_id).alias("i")).alias("__o")) \
        .filter(F.size("__r") > 0).withColumn("__rk", F.to_json("__r")) \
        .groupBy("__rk").agg(F.first("__r").alias("__r"), F.min("__o").alias("__o"))
    lc, rc = _token_counts(l, "__l"), _token_counts(r, "__r")

    def rare(df: DataFrame, key: str, toks: str, counts: DataFrame, k: int) -> DataFrame:
        w = df.withColumn("tok", F.explode(toks)).join(counts, "tok", "left") \
            .withColumn("df", F.coalesce("df", F.lit(0)))
        return top_per_group(w, [key], [F.col("df"), F.col("tok")], k).drop("df")

    by_table = _salted_candidates(rare(r, "__rk", "__r", lc, 2),
                                  l.withColumn("tok", F.explode("__l")), lc, "__lk", rows_per_salt)
    by_left = _salted_candidates(rare(l, "__lk", "__l", rc, 1),
                                 r.withColumn("tok", F.explode("__r")), rc, "__rk", rows_per_salt)
    cols = ["__lk", "__l", "__r", "__o"]
    pairs = by_table.select(*cols).unionByName(by_left.select(*cols))
    shared = F.size(F.array_intersect("__l", "__r"))
    hit = (shared == F.size("__r")) | (shared == F.size("__l")) \
        | (shared >= F.greatest(F.lit(2), F.size("__r") - 1))
    best = pairs.filter(hit).groupBy("__lk").agg(F.min("__o").alias("__o"))
    return named.join(best, "__lk").select(left_id, F.col("__o.i").alias(table_id))


def nearest_in_interval(names: DataFrame, titles: DataFrame, name_id: str, name_toks: str, name_day: str,
                        title_id: str, title_toks: str, title_day: str, before: int, after: int,
                        rows_per_salt: int = 100_000) -> DataFrame:
    """Of the titles that hold all tokens of a name, the one nearest in time within the interval.

    A title's day counts from ``before`` days before the name's day to ``after`` days after it;
    ties go to the smaller id. Names without such a title, or without a day, have no row.
    Result: (name_id, title_id, gap_days).

    Token sets are matched once. Names and titles then meet on days: equal token sets of a
    day are one row, and the key of the join holds a bucket of days as wide as the
    interval, so a name reads two buckets of a title's days and no pair outside the
    interval is formed.
    """
    width = before + after + 1
    bucket = lambda d: F.floor(F.unix_date(d) / width)
    named = _token_keys(names, name_id, name_toks, "__n", F.col(name_day).cast("date").alias("__d"))
    titled = _token_keys(titles, title_id, title_toks, "__t", F.col(title_day).cast("date").alias("__e"))
    filed = titled.filter("__e IS NOT NULL").groupBy("__tk", "__e").agg(F.min(title_id).alias(title_id)) \
        .withColumn("__b", bucket(F.col("__e")))
    asked = named.filter("__d IS NOT NULL").select("__nk", "__d").distinct() \
        .withColumn("__b", F.explode(F.sequence(bucket(F.date_sub("__d", before)), bucket(F.date_add("__d", after)))))
    gap = F.datediff("__e", "__d")
    met = asked.join(_subset_hits(named, titled, rows_per_salt), "__nk").alias("a").join(
        filed.alias("f"), (F.col("a.__tk") == F.col("f.__tk")) & (F.col("a.__b") == F.col("f.__b")) & gap.between(-before, after))
    best = met.groupBy("__nk", "__d").agg(F.min(F.struct(F.abs(gap).alias("gap_days"), F.col(title_id))).alias("__m"))
    return named.join(best, ["__nk", "__d"]).select(name_id, F.col(f"__m.{title_id}").alias(title_id), "__m.gap_days")


def asof_horizons(prices: DataFrame, anchors: DataFrame, key: str, day: str, close: str,
                  anchor: str, horizons: Mapping[str, int], tolerance: int,
                  keep: str | None = None) -> DataFrame:
    """Last close at or before anchor + n days for several horizons in one pass.

    Kept only if it is at most ``tolerance`` days older than the horizon, or the
    boolean anchor column ``keep`` (delisted) is true. Map-side partial aggregates
    carry the work, so a symbol with very many rows is no hot spot.
    """
    flags = [keep] if keep else []
    joined = prices.join(anchors.select(key, anchor, *flags), key)
    aggs, outs = [], []
    for name, days in horizons.items():
        end = F.date_add(anchor, days)
        seen = F.col(day) <= end
        aggs.append(F.max(F.when(seen, F.struct(F.col(day).alias("d"), F.col(close).alias("c"))))
                    .alias(f"__{name}"))
        ok = F.col(f"__{name}.d") >= F.date_add(anchor, days - tolerance)
        if keep:
            ok = ok | F.col(keep)
        outs.append(F.when(ok, F.col(f"__{name}.c")).alias(name))
    return joined.groupBy(key, anchor, *flags).agg(*aggs).select(key, *outs)


def index_change(index: DataFrame, day: str, close: str, lookback: int,
                 name: str = "index_chg") -> DataFrame:
    """Change over ``lookback`` sessions for every calendar day of the index's life.

    A day without a session carries the last one forward, so a date can be joined by
    equality. The index is one series of one row per session. Sessions are numbered
    from the day set, and the older close is met by number, not by a global window.
    """
    numbered = index.select(day, close).join(day_sequence(index, day, "__seq"), day)
    older = numbered.select((F.col("__seq") + lookback).alias("__seq"), F.col(close).alias("__old"))
    change = numbered.join(older, "__seq", "left") \
        .withColumn(name, (F.col(close) / F.col("__old") - 1) * 100)
    nxt = numbered.select((F.col("__seq") - 1).alias("__seq"), F.col(day).alias("__next"))
    spans = change.join(nxt, "__seq", "left")
    last = F.coalesce(F.date_sub("__next", 1), F.col(day))
    return spans.select(F.explode(F.sequence(F.col(day), last)).alias(day), name)


def asof_index(anchors: DataFrame, index: DataFrame, anchor: str, day: str, close: str,
               lookback: int, name: str = "index_chg") -> DataFrame:
    """Index change up to each anchor date (equality join on the densified calendar).

    Dates after the last session take its value.
    """
    dense = index_change(index, day, close, lookback, name)
    end = index.agg(F.max(day)).scalar()
    return anchors.withColumn("__j", F.least(F.col(anchor), end)) \
        .join(dense.withColumnRenamed(day, "__j"), "__j", "left").drop("__j")


#: Rows that pivots and first thresholds of ``similar`` are taken from, and pivots.
PIVOT_SAMPLE, PIVOTS = 2_048, 16


def _profile_rows(profiles: Sequence[Mapping | None], names: Sequence[str]) -> np.ndarray:
    return np.array([[(p or {}).get(c, np.nan) for c in names] for p in profiles], float).reshape(len(profiles), len(names))


def _choose_pivots(sample: Sequence[Mapping], names: Sequence[str], count: int = PIVOTS) -> np.ndarray:
    """Rows of the sample that know exactly ``names``, each farthest from those before it."""
    rows = _profile_rows([p for p in sample if p and len(p) == len(names) and all(p.get(c) is not None for c in names)], names)
    if not len(rows):
        return rows
    chosen, far = [0], np.sqrt(((rows - rows[0]) ** 2).mean(axis=1))
    while len(chosen) < min(count, len(rows)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, np.sqrt(((rows - rows[chosen[-1]]) ** 2).mean(axis=1)))
    return rows[chosen]


def _rms(have: np.ndarray, goal: np.ndarray, min_common: int) -> np.ndarray:
    """RMS distance over common categories; infinite where too few are common."""
    gap = (have - goal) ** 2
    common = (~np.isnan(gap)).sum(axis=1)
    far = np.sqrt(np.nansum(gap, axis=1) / np.maximum(common, 1))
    far[common < max(min_common, 1)] = np.inf
    return far


def _near_targets(block: list, sample: list, row_id: str, profile: str, k: int, min_common: int, slack: float):
    """Per batch of rows, the ``k`` nearest of each target and all others within ``slack`` of them.

    Among profiles with the same categories the distance is a metric, so a row's and a
    target's distances to a pivot differ by no more than the distance between the two.
    A row is scored only if no pivot shows it to be beyond the target's threshold: the
    k-th distance among sampled rows, and later the best met so far. Profiles with
    other categories are always scored. A row without ids counts the scored pairs.
    """
    names = sorted({c for t in block for c in t[profile] or {}} | {c for t in sample for c in t[profile] or {}})
    sets = Counter(frozenset(t[profile] or {}) for t in sample)
    whole = sorted(max(sets, key=lambda c: (sets[c], sorted(c)), default=frozenset()))
    pivots = _choose_pivots([t[profile] for t in sample], whole) if len(whole) >= max(min_common, 1) else np.zeros((0, 0))
    places = [names.index(c) for c in whole]
    goal, ids = _profile_rows([t[profile] for t in block], names), [t[row_id] for t in block]
    some, keys_of = _profile_rows([t[profile] for t in sample], names), np.array([t[row_id] for t in sample])

    def complete(rows: np.ndarray) -> np.ndarray:
        known = ~np.isnan(rows)
        return known[:, places].all(axis=1) & (known.sum(axis=1) == len(places))

    def to_pivots(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((rows[:, places] - p) ** 2).mean(axis=1)) for p in pivots], axis=1)

    bounded = complete(goal) if len(pivots) else np.zeros(len(goal), bool)
    marks = to_pivots(goal) if len(pivots) else np.zeros((len(goal), 0))
    first = np.full(len(goal), np.inf)
    for i in np.flatnonzero(bounded):
        far = np.sort(_rms(some, goal[i], min_common)[keys_of != ids[i]])
        first[i] = far[k - 1] if len(far) >= k else np.inf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = first.copy()
        for batch in batches:
            have, keys, out_t, out_r, scored = _profile_rows(batch[profile].tolist(), names), batch[row_id].to_numpy(), [], [], 0
            # A category that no target and no sampled row knows parts a profile from the pivots' set.
            own = complete(have) & np.array([len(p or {}) == len(places) for p in batch[profile]], bool) if len(pivots) else np.zeros(len(have), bool)
            mine = to_pivots(have) if len(pivots) else None
            for i, t in enumerate(ids):
                open_ = keys != t
                if bounded[i]:
                    open_ &= ~own | (np.abs(mine - marks[i]).max(axis=1) <= limit[i] + slack + 1e-9)
                at = np.flatnonzero(open_)
                scored += len(at)
                if not len(at):
                    continue
                far = _rms(have[at], goal[i], min_common)
                if len(far) >= k:
                    limit[i] = min(limit[i], np.partition(far, k - 1)[k - 1])
                near = at[(far <= limit[i] + slack) & np.isfinite(far)]
                out_t += [t] * len(near)
                out_r += keys[near].tolist()
            yield pd.DataFrame({"target_id": pd.array([*out_t, None], "object"), row_id: pd.array([*out_r, None], "object"), "scored": [*[0] * len(out_t), scored]})
    return run


def _near_pairs(vectors: DataFrame, targets: DataFrame, row_id: str, profile: str, k: int, min_common: int, decimals: int, block: int) -> DataFrame:
    """(target_id, row_id, scored): the pairs that can be among the nearest, and rows without ids that count scored pairs."""
    blocks = max(1, math.ceil(targets.count() / block))
    kind = dict(vectors.dtypes)[row_id]
    sample = vectors.select(row_id, profile).orderBy(F.xxhash64(row_id), row_id).limit(PIVOT_SAMPLE).collect()
    pairs = None
    for b in range(blocks):
        part = targets.filter(F.pmod(F.xxhash64(row_id), F.lit(blocks)) == b).select(row_id, profile).collect()
        near = vectors.select(row_id, profile).mapInPandas(
            _near_targets(part, sample, row_id, profile, k, min_common, 2 * 10.0 ** -decimals), f"target_id {kind}, {row_id} {kind}, scored long")
        pairs = near if pairs is None else pairs.unionByName(near)
    return pairs


def similar(vectors: DataFrame, targets: DataFrame, row_id: str, profile: str, k: int = 5,
            min_common: int = 5, decimals: int = 1, block: int = 1024) -> DataFrame:
    """The ``k`` rows nearest to each target by RMS distance over common categories.

    ``profile`` is a map category -> score. Any number of targets is allowed: blocks of
    about ``block`` targets meet the rows in one pass each; rows that distances to
    pivots rule out are not scored, and only the few rows of a batch that can be
    among a target's ``k`` leave it. These pairs are scored exactly and ranked; ties
    break on ``row_id``.
    """
    pairs = _near_pairs(vectors, targets, row_id, profile, k, min_common, decimals, block).filter("target_id IS NOT NULL").drop("scored")
    goals = targets.select(F.col(row_id).alias("target_id"), F.col(profile).alias("__p"))
    rows = pairs.join(goals, "target_id").join(vectors.select(row_id, profile), row_id)
    common = F.array_intersect(F.map_keys(profile), F.map_keys("__p"))
    squares = F.aggregate("__common", F.lit(0.0), lambda a, c: a + F.pow(
        F.element_at(F.col(profile), c) - F.element_at(F.col("__p"), c), 2))
    scored = rows.withColumn("__common", common) \
        .withColumn("distance", F.round(F.sqrt(squares / F.size("__common")), decimals)) \
        .select("target_id", row_id, "distance")
    return top_per_group(scored, ["target_id"], [F.col("distance"), F.col(row_id)], k, "rank")


def similar_work(vectors: DataFrame, targets: DataFrame, row_id: str, profile: str, k: int = 5,
                 min_common: int = 5, decimals: int = 1, block: int = 1024) -> DataFrame:
    """(n_targets, n_rows, n_scored, share): how many of all pairs ``similar`` scores."""
    done = _near_pairs(vectors, targets, row_id, profile, k, min_common, decimals, block).agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("n_scored"))
    counts = done.withColumn("n_targets", targets.agg(F.count("*").alias("n")).scalar()).withColumn("n_rows", vectors.agg(F.count("*").alias("n")).scalar())
    return counts.select("n_targets", "n_rows", "n_scored", (F.col("n_scored") / F.nullif(F.col("n_targets") * F.col("n_rows"), F.lit(0))).alias("share"))


def has_report(issues: DataFrame, reports: DataFrame, key: str, present: bool) -> DataFrame:
    """Issues that have (or lack) a report."""
    return issues.join(reports.select(key).distinct(), key, "left_semi" if present else "left_anti")
