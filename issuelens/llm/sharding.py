"""Sharding by sampled splitters.

Rows are ordered by a hash of their text and, within equal texts, by a hash of their
key, so copies lie together. A size-weighted sample of these places gives splitters
for many fine ranges of about equal bytes; the ranges are then measured over all rows,
overfull ones are divided again by a denser sample of their own rows, and whole fine
ranges are dealt to shards at the measured quantiles.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.staging import staged

SHARDS = 24
#: Fine ranges for each shard, and the bytes a fine range may hold in a large corpus.
RANGES = 128
RANGE_BYTES = 256 << 20
#: Sampled places for each fine range.
DRAWN = 4
_LEAST = -(1 << 63)


def _constant(values: list[int]) -> Column:
    """An array literal that the optimiser folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of splitters at or before a row's place (h, g), by binary search."""
    if not bounds:
        return F.lit(0).cast("long")
    hs, gs = _constant([h for h, _ in bounds]), _constant([g for _, g in bounds])
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]

    def halve(low: Column, step: Column) -> Column:
        at = low + step
        h, g = F.try_element_at(hs, at.cast("int")), F.try_element_at(gs, at.cast("int"))
        return F.when((at <= len(bounds)) & ((h < F.col("h")) | ((h == F.col("h")) & (g <= F.col("g")))), at).otherwise(low)

    return F.aggregate(_constant(steps), F.lit(0).cast("long"), halve)


def _measured(base: DataFrame, bounds: list[tuple[int, int]]) -> list:
    """Bytes, rows and divisibility of every fine range that has rows."""
    return (
        base.groupBy(_range_of(bounds).alias("r"))
        .agg(
            F.sum("size").alias("bytes"),
            F.count(F.lit(1)).alias("rows"),
            (F.min(F.struct("h", "g")) != F.max(F.struct("h", "g"))).alias("divisible"),
        )
        .orderBy("r")
        .collect()
    )


def _sampled(base: DataFrame, per_byte: float, bounds: list[tuple[int, int]], only: list[int] | None) -> list:
    """Places drawn with probability size x ``per_byte``, at most 1, by a hash."""
    if only is not None:
        wanted = [int(i in set(only)) for i in range(len(bounds) + 1)]
        base = base.where(F.element_at(_constant(wanted), (_range_of(bounds) + 1).cast("int")) == 1)
    luck = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "h", "g"), 11) / F.lit(float(1 << 53))
    drawn = base.where(luck < F.col("size") * F.lit(per_byte))
    return sorted((r.h, r.g, r.size) for r in drawn.select("h", "g", "size").collect())


def _cut(places: list, bounds: list[tuple[int, int]], step: float, unit: float) -> list[tuple[int, int]]:
    """Splitters about every ``step`` of sampled weight, between copies only if one must.

    A splitter goes before the place that would take its range well over ``step``, so
    of two places that weigh more than that together, the second starts a range.
    """
    out = set(bounds)
    held, before = 0.0, None
    for h, g, size in places:
        weight = max(size, unit)
        if held >= step or (held and held + weight > 1.5 * step):
            out.add((h, g) if h == before or (h, _LEAST) in out else (h, _LEAST))
            held = 0.0
        held += weight
        before = h
    return sorted(out)


def splitters(base: DataFrame, total: int, step: float) -> tuple[list[tuple[int, int]], list]:
    """Splitters of ``base(h, g, size)`` and the measures of their ranges.

    A range over twice ``step`` that has more than one place is divided by a sample
    of its own rows, four times as dense each round; at the latest, when every row
    is drawn, each place can be a splitter. The driver holds about ``DRAWN`` x
    total / step places at once.
    """
    rate = DRAWN / step
    bounds = _cut(_sampled(base, rate, [], None), [], step, 1 / rate)
    while True:
        measured = _measured(base, bounds)
        over = [m.r for m in measured if m.bytes > 2 * step and m.divisible]
        if not over:
            return bounds, measured
        places = _sampled(base, rate, bounds, over)
        by_range: dict[int, list] = {}
        for p in places:
            by_range.setdefault(bisect_right(bounds, (p[0], p[1])), []).append(p)
        grown = bounds
        for own in by_range.values():
            grown = _cut(own, grown, step, 1 / rate)
        bounds, rate = grown, rate * 4


def _dealt(measured: list, shards: int) -> list[int]:
    """Shard of each measured range: the quantile in which its middle byte lies."""
    total, before, out = sum(m.bytes for m in measured), 0, []
    for m in measured:
        out.append(min(shards - 1, int(shards * (before + m.bytes / 2) / total)))
        before += m.bytes
    return out


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Law ``bytes``: the summed ``size`` (UTF-8 bytes of the text plus 8) of the shards
    is equal up to about one fine range, 1/128 of a shard, or one document that is
    larger. ``slot`` numbers the rows of a shard from 0 without a gap.
    ``grown_shard`` is null: under this law every shard changes with their number.

    Copies of a text share a shard unless a splitter has to divide their group
    because it outweighs two fine ranges. Defined cases: a null text has no bytes
    and checksum 0 and keeps the nulls together; null and repeated keys are allowed,
    rows equal in text and key stay in one range. An empty table gives no rows.
    Other columns are not carried.

    Scale: only (key, size, checksum, hashes) leave the first scan. The number of fine
    ranges grows with the bytes, and row numbers are taken inside fine ranges, so no
    task sorts a whole shard.
    """
    base = staged(
        docs.select(
            F.col(key),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.col(key), F.lit("place")).alias("g"),
        )
    )
    total = base.agg(F.sum("size")).first()[0] or 0
    step = max(1.0, total / max(shards * RANGES, -(-total // RANGE_BYTES)))
    bounds, measured = splitters(base, total, step) if total else ([], [])
    dealt = _dealt(measured, shards)
    shard_of, first_slot, used = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1), [0] * shards
    for m, s in zip(measured, dealt, strict=True):
        shard_of[m.r], first_slot[m.r] = s, used[s]
        used[s] += m.rows
    at = (F.col("r") + 1).cast("int")
    place = F.row_number().over(Window.partitionBy("r").orderBy("h", "g", key))
    return base.withColumn("r", _range_of(bounds)).select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(_constant(shard_of), at).cast("int").alias("shard"),
        (F.element_at(_constant(first_slot), at) + place - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
