"""Order-dependent operators that never put an unbounded group into one task.

Windows here run over groups with a known bound (calendar days of a symbol, pages
of one document, cells of a counted grid); anything larger is first counted,
bracketed or cut into cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import array_median


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; keeps the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                  rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group.

    The rank filter lets Spark keep only k rows per group and partition before the
    shuffle (WindowGroupLimit), so a hot key never reaches one task whole.
    """
    col = rank or "__rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= k)
    return out if rank else out.drop(col)


def islands(df: DataFrame, keys: Sequence[str], n: str, name: str = "run") -> DataFrame:
    """Id of the contiguous run of integers a row belongs to (pages of one document)."""
    w = Window.partitionBy(*keys).orderBy(n)
    return df.withColumn(name, F.col(n) - F.row_number().over(w))


def ffill(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str,
          name: str, block: int | None = None) -> DataFrame:
    """Last non-null value at or before the row.

    Without ``block`` a group is one document (its lines or pages). For groups without
    a bound pass ``block``, a width of the first order column (a number): values are
    then filled inside blocks, and only one value per block is carried across them.
    """
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(source, ignorenulls=True).over(w))
    cut = df.withColumn("__b", F.floor(F.col(order[0]) / block))
    seen = F.when(F.col(source).isNotNull(), F.struct(*order))
    ends = cut.groupBy(*keys, "__b").agg(F.max_by(source, seen).alias("__end"))
    past = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(past)).drop("__end")
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(cut, carry, [*keys, "__b"]) \
        .withColumn(name, F.coalesce(F.last(source, ignorenulls=True).over(inside), F.col("__carry"))) \
        .drop("__b", "__carry")


def nearest_mark(df: DataFrame, keys: Sequence[str], n: str, mark: str,
                 name: str = "resolved") -> DataFrame:
    """Value of the nearest marked row inside a contiguous run; a tie takes the lower row."""
    runs = islands(df, keys, n, "__run")
    back = Window.partitionBy(*keys, "__run").orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "__run").orderBy(n).rowsBetween(0, Window.unboundedFollowing)
    marked = F.when(F.col(mark).isNotNull(), F.struct(F.col(n).alias("n"), F.col(mark).alias("v")))
    before = F.last(marked, ignorenulls=True).over(back)
    after = F.first(marked, ignorenulls=True).over(ahead)
    out = runs.withColumn("__b", before).withColumn("__a", after)
    take_before = F.col("__a").isNull() | (
        F.col("__b").isNotNull() & (F.col(n) - F.col("__b.n") <= F.col("__a.n") - F.col(n)))
    return out.withColumn(name, F.when(take_before, F.col("__b.v")).otherwise(F.col("__a.v"))) \
        .drop("__run", "__a", "__b")


def day_sequence(df: DataFrame, day: str, name: str = "seq") -> DataFrame:
    """Dense number of every distinct day; the day set is bounded by the calendar."""
    days = df.agg(F.array_sort(F.collect_set(day)).alias("__d"))
    return days.select(F.posexplode("__d").alias(name, day))


def running_days(days: DataFrame, day: str, n: str, name: str = "before") -> DataFrame:
    """Rows on earlier days, for a table of one row per day.

    Running totals inside a year plus the total of earlier years, so no window
    spans the table.
    """
    d = days.withColumn("__y", F.year(day))
    years = d.groupBy("__y").agg(F.sum(n).alias("__t")) \
        .agg(F.collect_list(F.struct("__y", "__t")).alias("a")).scalar()
    w = Window.partitionBy("__y").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(n).over(w), F.lit(0))
    earlier = F.aggregate(F.filter("__ys", lambda x: x["__y"] < F.col("__y")),
                          F.lit(0).cast("bigint"), lambda a, x: a + x["__t"])
    return d.withColumn("__ys", years).withColumn(name, inside + earlier).drop("__y", "__ys")


#: Quantiles that hot cells are cut at, at most; and the sketch's accuracy.
CUTS, CUT_ACCURACY = 1_000, 20_000


def split_cells(df: DataFrame, cols: Sequence[str], row_id: str, rows_per_cell: int) -> DataFrame:
    """``df`` with ``__cell``: 0 in small cells; a rising number over the ids of hot ones.

    Cut points come from a mergeable sketch over the rows of the hot cells alone. There
    are about as many of them as the table has times ``rows_per_cell`` rows.
    """
    hot = df.groupBy(*cols).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows_per_cell)
    grid = [i / CUTS for i in range(1, CUTS)]
    sketched = null_safe_join(df.select(*cols, row_id), hot, cols).groupBy(*cols, "__n").agg(
        F.percentile_approx(row_id, grid, CUT_ACCURACY).alias("__q"))
    parts = F.least(F.ceil(F.col("__n") / rows_per_cell), F.lit(CUTS)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda j: F.element_at("__q", F.round(j * CUTS / parts).cast("int")))
    known = sketched.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)], F.array_distinct(cuts).alias("__cuts"))
    same = F.lit(True)
    for i, c in enumerate(cols):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    below = F.size(F.filter("__cuts", lambda c: c < F.col(row_id)))
    return df.join(known, same, "left").withColumn("__cell", F.coalesce(F.when(F.col("__cuts").isNotNull(), below), F.lit(0))) \
        .drop("__cuts", *[f"__k{i}" for i in range(len(cols))])


def grouped_index(df: DataFrame, keys: Sequence[str], coarse: Sequence[tuple[str, bool]],
                  row_id: str, name: str = "idx", rows_per_cell: int = 1_000_000) -> DataFrame:
    """Exact 0-based position inside each group, ordered by ``coarse`` then ``row_id``.

    ``coarse`` holds (column, descending) pairs of bounded cardinality such as days or
    weights; ``row_id`` is a unique number. A cell (group x coarse values) with more
    than ``rows_per_cell`` rows is split at quantiles of its ids, so even one hot day is
    ranked in many even tasks wherever its ids lie; only the counts of the cells are
    accumulated per group.
    """
    cols = [*keys, *[c for c, _ in coarse]]
    cells = split_cells(df, cols, row_id, rows_per_cell)
    order = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in coarse]
    counts = cells.groupBy(*cols, "__cell").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(*order, "__cell") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0))).drop("__c")
    inner = Window.partitionBy(*cols, "__cell").orderBy(row_id)
    return null_safe_join(cells, offsets, [*cols, "__cell"]) \
        .withColumn(name, F.col("__off") + F.row_number().over(inner) - 1) \
        .drop("__cell", "__off")


def global_index(df: DataFrame, day: str, row_id: str, name: str = "idx",
                 rows_per_cell: int = 1_000_000) -> DataFrame:
    """Exact 0-based position of every dated row over the whole table."""
    dated = df.filter(F.col(day).isNotNull()).withColumn("__y", F.year(day))
    years = dated.groupBy("__y").agg(F.count("*").alias("__t")) \
        .agg(F.collect_list(F.struct("__y", "__t")).alias("a")).scalar()
    earlier = F.aggregate(F.filter("__ys", lambda x: x["__y"] < F.col("__y")),
                          F.lit(0).cast("bigint"), lambda a, x: a + x["__t"])
    return grouped_index(dated, ["__y"], [(day, False)], row_id, name, rows_per_cell) \
        .withColumn("__ys", years).withColumn(name, F.col(name) + earlier).drop("__y", "__ys")


CELLS = 1_000


#: Tasks' worth of salts that the rows of large groups are dealt to.
SALTS = 1_009


def _marked(rows: DataFrame, stats: DataFrame, keys: Sequence[str], small: int) -> DataFrame:
    """``rows`` with the bracket of their group, no large group in one task.

    There are fewer large groups than rows by a factor of ``small``, so their brackets
    are broadcast; only rows of small groups meet theirs by key.
    """
    names = ["__n", "__lo", "__hi"]
    large = stats.filter(F.col("__n") > small).select(*keys, *[F.col(c).alias(f"{c}l") for c in names])
    few = stats.filter(F.col("__n") <= small).select(*keys, F.lit(0).cast("bigint").alias("__salt"), *[F.col(c).alias(f"{c}s") for c in names])
    salt = F.when(F.col("__nl").isNotNull(), F.pmod(F.xxhash64("__v", F.spark_partition_id()), F.lit(SALTS)) + 1).otherwise(0)
    dealt = null_safe_join(rows, F.broadcast(large), keys, "left").withColumn("__salt", salt)
    both = null_safe_join(dealt, few, [*keys, "__salt"], "left")
    return both.select(*keys, "__v", *[F.coalesce(f"{c}l", f"{c}s").alias(c) for c in names])


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5,
                   name: str = "median", small: int = 5_000) -> DataFrame:
    """Exact interpolated quantile per group, safe for groups of any size.

    A mergeable sketch brackets the wanted rank, counts per value are kept inside the
    bracket only, about 0.2 % of a large group, and the bracket is cut into ``CELLS``
    cells. Ranks accumulate over the cells of a group, then over the values of the one
    or two cells that hold the wanted ranks, so no window spans a group. The sketch
    is too coarse for groups under ``small`` rows; their bracket is the whole range.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")) \
        .filter(F.col("__v").isNotNull())
    eps = 1e-3
    sketch = F.percentile_approx(
        "__v", F.array(F.lit(max(q - eps, 0.0)), F.lit(min(q + eps, 1.0))), 10_000)
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__b"))
    whole = F.col("__n") <= small
    stats = stats.select(*keys, "__n", F.when(whole, F.col("__min")).otherwise(F.get("__b", F.lit(0))).alias("__lo"),
                         F.when(whole, F.col("__max")).otherwise(F.get("__b", F.lit(1))).alias("__hi"))
    if keys:
        marked = _marked(rows, stats, keys, small)
    else:
        marked = rows.withColumn("__s", stats.select(F.struct("__n", "__lo", "__hi")).scalar()) \
            .select("__v", "__s.*")
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    cell = F.when(F.col("__v") < F.col("__lo"), -1).otherwise(
        F.coalesce(F.floor((F.col("__v") - F.col("__lo")) / width * CELLS), F.lit(0)))
    group = [*keys, "__n", "__cell"]
    counts = marked.filter(F.col("__v") <= F.col("__hi")).withColumn("__cell", cell) \
        .withColumn("__v", F.when(F.col("__cell") >= 0, F.col("__v"))) \
        .groupBy(*group, "__v").agg(F.count("*").alias("__c"))
    pos = F.lit(q) * (F.col("__n") - 1)
    over = Window.partitionBy(*keys, "__n").orderBy("__cell")
    cells = counts.groupBy(*group).agg(F.sum("__c").alias("__c")) \
        .withColumn("__before", F.sum("__c").over(over) - F.col("__c")) \
        .filter((F.col("__before") <= F.ceil(pos)) & (F.col("__before") + F.col("__c") > F.floor(pos))) \
        .drop("__c")
    inside = Window.partitionBy(*group).orderBy("__v")
    ranked = null_safe_join(counts, cells, group) \
        .withColumn("__cum", F.col("__before") + F.sum("__c").over(inside)).withColumn("__pos", pos)
    out = ranked.groupBy(*keys, "__n", "__pos").agg(
        F.min(F.when(F.col("__cum") > F.floor("__pos"), F.col("__v"))).alias("__l"),
        F.min(F.when(F.col("__cum") > F.ceil("__pos"), F.col("__v"))).alias("__h"))
    part = F.col("__pos") - F.floor("__pos")
    return out.select(*keys, (F.col("__l") + (F.col("__h") - F.col("__l")) * part).alias(name))


def with_global_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """Adds the exact quantile of a whole column as a scalar."""
    return df.withColumn(name, exact_quantile(df, [], value, q, "__q").scalar())


def trailing_bars(df: DataFrame, day: str, row_id: str, values: Sequence[str], n: int = 60,
                  min_n: int = 20, suffix: str = "_bar") -> DataFrame:
    """Median of the last ``n`` rows with a strictly earlier day, one row per day.

    All rows of a day share the bar, and a day can contribute only its last ``n``
    rows to any later bar. So each day keeps at most ``n`` rows (cut before the
    shuffle), and the rest works on days: day blocks of width ``n`` are replicated
    once, so the frame never crosses a partition. Nulls are dropped after taking
    the ``n`` rows; fewer than ``min_n`` values give NULL.
    """
    dated = df.filter(F.col(day).isNotNull())
    recent = top_per_group(dated.select(day, row_id, *values), [day], [F.col(row_id).desc()], n)
    per_day = recent.groupBy(day).agg(
        F.array_sort(F.collect_list(F.struct(row_id, *values))).alias("__rows"))
    numbered = per_day.join(day_sequence(dated, day, "__seq"), day)
    block = F.floor(F.col("__seq") / n)
    spread = numbered.withColumn("__block", F.explode(F.array(block, block + 1)))
    w = Window.partitionBy("__block").orderBy("__seq").rowsBetween(-n, -1)
    past = spread.withColumn("__past", F.flatten(F.collect_list("__rows").over(w))) \
        .filter(F.col("__block") == block)
    last = F.slice("__past", F.greatest(F.size("__past") - n + 1, F.lit(1)), F.lit(n))
    out = past.withColumn("__last", last)

    def bar(v: str) -> Column:
        vals = F.filter(F.transform("__last", lambda r: r[v]), lambda x: x.isNotNull())
        return F.when(F.size(vals) >= min_n, array_median(vals)).alias(v + suffix)

    return out.select(day, *[bar(v) for v in values])


def time_folds(df: DataFrame, day: str, row_id: str, frac: float = 0.4, min_rows: int = 60,
               splits: int = 5, name: str = "fold") -> DataFrame:
    """Forward-chaining fold of every dated row: 0 trains only, 1..splits are scored.

    Fold k trains on every row before its block. The five block edges are found first
    (a small aggregate over day counts). Only the days that hold a block
    edge are ranked row by row; all other rows are placed by comparing their
    (day, id) with the five edges, so the table itself is never shuffled.
    """
    dated = df.filter(F.col(day).isNotNull())
    days = dated.groupBy(day).agg(F.count("*").alias("__n"))
    total = days.agg(F.sum("__n")).scalar()
    start = F.greatest(F.floor(F.col("__total") * frac), F.lit(min_rows))
    edge_list = F.transform(
        F.sequence(F.lit(0), F.lit(splits - 1)),
        lambda i: F.floor(F.col("__start") + i * (F.col("__total") - F.col("__start")) / splits))
    edges = running_days(days, day, "__n", "__before") \
        .withColumn("__total", total).withColumn("__start", start) \
        .filter(F.col("__total") - F.col("__start") >= splits * 5) \
        .withColumn("__edge", F.explode(edge_list)) \
        .filter((F.col("__edge") >= F.col("__before"))
                & (F.col("__edge") < F.col("__before") + F.col("__n"))) \
        .select(day, (F.col("__edge") - F.col("__before")).alias("__pos"))
    on_edge_days = dated.select(day, row_id).join(F.broadcast(edges.select(day).distinct()), day)
    picked = grouped_index(on_edge_days, [day], [], row_id, "__pos").join(edges, [day, "__pos"])
    bounds = picked.agg(F.collect_list(
        F.struct(F.col(day).alias("d"), F.col(row_id).alias("i"))).alias("a")).scalar()
    here = F.struct(F.col(day).alias("d"), F.col(row_id).alias("i"))
    return dated.withColumn("__edges", bounds) \
        .withColumn(name, F.when(F.size("__edges") > 0,
                                 F.size(F.filter("__edges", lambda e: e <= here)))) \
        .drop("__edges")
