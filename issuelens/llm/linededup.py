"""Line dedup over overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.staging import apart

WINDOW = 3
ADDED = ("n_lines", "n_removed", "removed")


def _windows(lines: Column, size: int) -> Column:
    """One (h1, h2, pos, blank) entry per run of ``size`` consecutive lines."""

    def entry(i: Column) -> Column:
        run = [F.element_at(lines, (i + k + 1).cast("int")) for k in range(size)]
        return F.struct(
            F.xxhash64(*run).alias("h1"),
            F.xxhash64(F.lit("second"), *run).alias("h2"),
            i.cast("int").alias("pos"),
            (F.trim(F.concat(*run)) == "").alias("blank"),
        )

    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(F.transform(starts, entry), lambda w: ~w["blank"])


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` without the later occurrences of repeated runs of ``size`` lines.

    Every run of ``size`` consecutive lines is a window, known by a 128-bit hash.
    The first occurrence of a window, by (key, position), stays; the lines of all
    later ones are removed, overlapping windows removing the union of their lines.
    Added columns: ``n_lines``, ``n_removed`` and ``removed``, the sorted starts of
    the removed windows.

    Defined cases: a null text stays null with no lines; an empty text is one empty
    line; windows of blanks (U+0020) only never match, others do, tabs too; texts under ``size`` lines have no
    window. Repeated rows (same key and text) count as one document and keep the
    same text. Rows with one key and different texts are told apart by the text's
    hash. A null key sorts first. Other columns pass through unchanged, except that
    the added columns replace input columns of the same name.

    Scale: windows travel as hashes; counting them combines on the map side, so a
    line run shared by a third of all documents sends one row per task. The join
    back has unique windows on one side, so AQE may split its hot keys.
    """
    columns = apart(docs, ADDED)
    lines = F.split(F.col(text), "\n", -1)
    ident = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("t"))
    seen = (
        docs.where(F.col(text).isNotNull())
        .select(ident.alias("id"), lines.alias("lines"))
        .select("id", F.explode(_windows(F.col("lines"), size)).alias("w"))
        .select("w.h1", "w.h2", "id", "w.pos")
    )
    first = (
        seen.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = (
        seen.join(first, ["h1", "h2"])
        .where(F.struct("id", "pos") != F.col("first"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_set("pos")).alias("__cuts"))
        .select(F.col("id.k").alias("__k"), F.col("id.t").alias("__t"), "__cuts")
    )
    n = F.size("__lines")
    edges = F.concat(F.array(F.lit(-size)), F.col("__cuts"), F.array(n))

    def between(i: Column) -> Column:
        low, high = F.element_at("__edges", (i + 1).cast("int")), F.element_at("__edges", (i + 2).cast("int"))
        return F.slice("__lines", low + size + 1, F.greatest(high - low - size, F.lit(0)))

    cut = F.col("__cuts").isNotNull() & F.col(text).isNotNull()
    kept = F.when(cut, F.flatten(F.transform(F.sequence(F.lit(0), F.size("__cuts")), between))).otherwise(F.col("__lines"))
    return (
        docs.select(*columns, F.xxhash64(text).alias("__h"))
        .join(later, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__t")), "left")
        .withColumn("__lines", F.split(F.col(text), "\n", -1))
        .withColumn("__edges", F.when(cut, edges))
        .withColumn("__kept", kept)
        .select(
            *[F.when(cut, F.array_join("__kept", "\n")).otherwise(F.col(text)).alias(text) if c == text else c for c in columns],
            F.coalesce(F.when(F.col(text).isNotNull(), n), F.lit(0)).cast("long").alias("n_lines"),
            F.when(cut, n - F.size("__kept")).otherwise(0).cast("long").alias("n_removed"),
            F.coalesce("__cuts", F.array().cast("array<int>")).alias("removed"),
        )
    )
