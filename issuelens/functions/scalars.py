"""Scalar functions: Column in, Column out, all JVM-side built-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def ci(pattern: str) -> str:
    """Case-insensitive form of a pattern."""
    return "(?i)" + pattern


def finite(c: Column) -> Column:
    """NaN and infinities become NULL; the engine stores missing values as NULL only."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def num(c: Column) -> Column:
    """Number from text with thousands commas or a percent sign, NULL when unparsable."""
    return finite(F.trim(F.translate(c.cast("string"), ",%", "")).try_cast("double"))


def amount(c: Column) -> Column:
    """Printed amount: currency marks, Indian grouping, (x) as negative, dashes as NULL."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"₹|Rs\.|\*", ""))
    negative = bare.startswith("(") & bare.endswith(")")
    digits = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[()]+|[()]+$", ""), ",", ""))
    value = F.when(digits.rlike(r"^-?\d+(\.\d+)?$"), digits.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def norm_id(c: Column) -> Column:
    """Stable string id: '2624.0' and 2624 become '2624', NULL becomes ''."""
    text = F.trim(c.cast("string"))
    whole = finite(text.try_cast("double")).try_cast("bigint").cast("string")
    return F.coalesce(whole, text, F.lit(""))


def tokens(c: Column, stop: Iterable[str] = vocab.TITLE_STOP) -> Column:
    """Distinct lower-case name tokens without stop words, in order of appearance."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), " ")
    dropped = F.array(*[F.lit(w) for w in ("", *stop)])
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(dropped, w)))


def norm_name(c: Column, stop: Iterable[str] = vocab.NAME_STOP) -> Column:
    """Join key of a company name: lower-case words without stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), " ")
    dropped = F.array(*[F.lit(w) for w in ("", *stop)])
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(dropped, w)), " ")


def strip_html(c: Column, sep: str = "") -> Column:
    """Markup removed (``sep=' '`` keeps adjacent cells apart), white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", sep), r"\s+", " "))


def parse_date(c: Column, fmt: str = "dd-MMM-yyyy") -> Column:
    return F.try_to_date(c, fmt)


#: Spellings of a date that put the day before the month, and the ISO form.
DAY_FIRST = ("d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-MM-dd")


def parse_day_first(c: Column) -> Column:
    """Date of a text in any of ``DAY_FIRST``; NULL for everything else, month-first dates too."""
    text = F.initcap(F.trim(c))
    return F.coalesce(*[F.try_to_date(text, f) for f in DAY_FIRST])


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Winsorise; NULL stays NULL (``least``/``greatest`` would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def log1p_pos(c: Column) -> Column:
    return F.log1p(clip(c, 0.0, None))


def log10_floor1(c: Column) -> Column:
    return F.log10(clip(c, 1.0, None))


def safe_div(a: Column, b: Column) -> Column:
    """NULL when either side is NULL or the divisor is zero."""
    return a / F.nullif(b, F.lit(0.0))


def band(c: Column, table: Sequence[tuple[float, float]], lower_is_better: bool = False) -> Column:
    """Points of the first band hit; the last band catches the rest, NULL stays NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("double"))
    for threshold, points in table:
        edge = F.lit(float(threshold))
        out = out.when(c > edge if lower_is_better else c >= edge, F.lit(float(points)))
    return out.otherwise(F.lit(float(table[-1][1])))


def pct_severity(c: Column, bands: Sequence[float]) -> Column:
    lo, mid, hi = bands
    return (
        F.when(c >= hi, "critical").when(c >= mid, "high").when(c >= lo, "medium")
        .when(c.isNotNull(), "low")
    )


def rebase(ret_pct: Column, day1_pct: Column) -> Column:
    """Return measured from the listing price instead of the offer price."""
    r = ((1 + ret_pct / 100) / (1 + day1_pct / 100) - 1) * 100
    return F.when(day1_pct > -95, r)


def stable_round(c: Column, decimals: int) -> Column:
    """Half-up rounding that ignores the last-digit noise of distributed sums."""
    return F.round(F.round(c, 6), decimals)


def sigmoid(c: Column, clamp: float = 30.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(c, -clamp, clamp)))


def literal_map(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Value of a fixed table, NULL for a missing key."""
    return F.try_element_at(literal_map(table), c)


def unit_factor(c: Column) -> Column:
    """Factor to crore, NULL for an unknown unit."""
    return lookup(F.lower(c), vocab.UNIT_FACTORS)


def to_crore(number: Column, unit: Column) -> Column:
    """Amount in crore; a missing unit counts as crore."""
    factor = F.coalesce(unit_factor(F.nullif(unit, F.lit(""))), F.lit(1.0))
    return F.round(amount(number) * factor, 2)


def rescale(value: Column, unit: Column) -> Column:
    """Amount in crore, refusing to guess an unknown unit."""
    return F.round(value * unit_factor(unit), 2)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL (not '') when the pattern or group is absent."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_match(c: Column, table: Sequence[tuple[str, str]], default: str | None = None,
                ignore_case: bool = True) -> Column:
    """Label of the first pattern of an ordered table that occurs in the text."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for label, pattern in table:
        out = out.when(c.rlike(ci(pattern) if ignore_case else pattern), F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def detect_unit(c: Column) -> Column:
    """Unit word of an amounts caption, lower case."""
    caption, bracket = extract(c, ci(vocab.UNIT_CAPTION)), extract(c, ci(vocab.UNIT_BRACKET))
    return F.lower(F.coalesce(caption, bracket))


def fiscal_label(c: Column) -> Column:
    """'FYnn' of one header cell."""
    year = extract(c, ci(vocab.FISCAL_HEADER))
    return F.when(year.isNotNull(), F.concat(F.lit("FY"), F.right(year, F.lit(2))))


def fiscal_labels(c: Column) -> Column:
    """Column headers in order of appearance; quarter-end dates become STUBnn.

    Empty unless at least two fiscal years are named.
    """
    heads = F.regexp_extract_all(
        c, F.lit(ci(f"({vocab.STUB_HEADER}|{vocab.FISCAL_HEADER})")), 1)
    stub = ci("^" + vocab.STUB_HEADER)
    labels = F.transform(heads, lambda h: F.concat(
        F.when(h.rlike(stub), "STUB").otherwise("FY"), F.right(h, F.lit(2))))
    kept = F.array_distinct(labels)
    years = F.size(F.filter(kept, lambda x: x.startswith("FY")))
    return F.when(years >= 2, kept).otherwise(F.array().cast("array<string>"))


def clean_label(c: Column) -> Column:
    """Row label without list numbering and trailing roman row references."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(squeezed, ci(vocab.ENUM_PREFIX), ""),
                            vocab.ROMAN_TAIL, "")


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value computed once, for long rule tables over a costly input."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def metric_of(c: Column) -> Column:
    """Metric named by a statement row label; cash-movement rows name none."""
    return let(clean_label(c), lambda label: F.when(
        ~label.rlike(ci(vocab.FLOW_LABEL)), first_match(label, vocab.ROW_LABELS)))


def snippet(text: Column, start: Column, length: Column, width: int = 220) -> Column:
    """Context around a match (1-based ``start``), white space squeezed."""
    begin = F.greatest(start - width // 2, F.lit(1))
    return F.trim(F.regexp_replace(F.substring(text, begin, length + width), r"\s+", " "))


def count_substring(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a plain substring."""
    cut = F.replace(text, needle, F.lit(""))
    return ((F.length(text) - F.length(cut)) / F.length(needle)).cast("bigint")


def first_of(items: Column, limit: int | None) -> Column:
    """The first ``limit`` entries of an array, all of them without a limit."""
    return items if limit is None else F.slice(items, 1, limit)


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, the whole text without a number."""
    return text if chars is None else F.substring(text, 1, chars)


def page_refs(c: Column, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\[p\.(\d+)\]"), 1)
    return first_of(F.transform(found, lambda x: x.cast("int")), limit)


def tier(c: Column, table: Sequence[tuple[float, str]], floor: str) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for threshold, label in table:
        out = out.when(c >= float(threshold), F.lit(label))
    return out.otherwise(F.lit(floor))


def fmt_cr(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(c, 0), F.lit(" cr")), F.lit("n/a"))


def severity_rank(c: Column) -> Column:
    return lookup(c, {s: i for i, s in enumerate(vocab.SEVERITIES)})


def array_median(arr: Column) -> Column:
    """Median of the non-null numbers of an array, NULL when there are none."""
    ordered = F.array_sort(F.filter(arr, lambda x: x.isNotNull()))
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def array_pstdev(arr: Column) -> Column:
    """Population standard deviation of the non-null numbers of an array."""
    kept = F.filter(arr, lambda x: x.isNotNull())
    n = F.size(kept).cast("double")
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0.0))
    return F.sqrt(F.aggregate(kept, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
                  / F.nullif(n, F.lit(0.0)))


def all_not_null(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def any_not_null(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])
