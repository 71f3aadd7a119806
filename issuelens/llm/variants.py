"""Spelling variants: words at edit distance one, found by pivotal bigrams.

Every word is cut into its bigrams, ordered from the rarest to the most frequent over
the whole vocabulary. Its prefix holds the first ``GRAM * EDITS + 1`` of them; among
these, dynamic programming picks the ``EDITS + 1`` disjoint ones of least total
frequency, its pivots. One edit spoils at most one of two disjoint pivots, so of two
near words the one whose prefix ends earlier in the order has a pivot in the prefix of
the other. The edit lies behind that pivot, so the pivot keeps its place and all before
it is equal, or before it, so it shifts by the difference in length and all behind it is
equal. Prefix bigrams are therefore indexed twice, by the word up to the bigram and by
the word from the bigram on, and pivots look both up; each pair met is verified by its
letters and then by its edit distance.

The prefix takes all occurrences of its last bigram, so the argument also holds where
a word repeats a bigram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.staging import staged

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 2
EDITS = 1
#: A form is at least this many times as frequent as its variant.
RATIO = 10


def misspelt(run: Column, key: Column, every: int = 31) -> Column:
    """``run`` without one code point where ``every`` divides the crc32 of ``<key>:<run>``."""
    luck = F.crc32(F.concat(key.cast("string"), F.lit(":"), run).cast("binary"))
    place = (luck % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(luck % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, times: int = 2) -> DataFrame:
    """(word, n): words of ``length`` code points or more that occur ``times`` or more.

    Runs shorter than ``length`` cannot become longer, so the pattern skips them.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    words = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select(misspelt(F.col("run"), F.col("key")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def pivots(places: Sequence[int], weights: Sequence[int], many: int = EDITS + 1, size: int = GRAM) -> list[int]:
    """Indices of the ``many`` disjoint grams of least total weight; ``places`` ascend.

    best[m] after gram i is the least weight of m disjoint grams among the first i;
    each either leaves gram i out or ends with it behind the last gram that it does
    not overlap.
    """
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())] + [(float("inf"), ())] * many]
    for i, place in enumerate(places):
        free = i
        while free > 0 and places[free - 1] > place - size:
            free -= 1
        row = [best[0][0]]
        for m in range(1, many + 1):
            weight, chosen = best[free][m - 1]
            row.append(min(best[i][m], (weight + weights[i], (*chosen, i))))
        best.append(row)
    return list(best[-1][many][1])


def _cut(order: dict[str, tuple[int, int]]):
    def one(word: str) -> tuple[int, int, list, list]:
        grams = sorted((*order[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
        last = grams[GRAM * EDITS][0]
        prefix = sorted((g for g in grams if g[0] <= last), key=lambda g: g[2])
        head = sorted(grams[: GRAM * EDITS + 1], key=lambda g: g[2])
        chosen = [head[i] for i in pivots([g[2] for g in head], [g[1] for g in head])]
        letters = 0
        for c in set(word):
            letters |= 1 << ord(c) % 63
        return last, letters, [g[2] for g in chosen], [g[2] for g in prefix]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.iloc[low : low + 4096]
                last, letters, chosen, prefix = zip(*map(one, part["word"]), strict=True) if len(part) else ((), (), (), ())
                yield pd.DataFrame({"word": part["word"], "n": part["n"], "last": list(last), "letters": list(letters), "pivots": list(chosen), "prefix": list(prefix)})

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a < b: the pairs of ``words(word, n)`` one edit apart.

    The bigram order holds at most 90 squared rows, as many as pairs of letters
    exist, whatever the vocabulary. Skewed index keys are split by Spark's skew join.
    """
    grams = words.select(F.explode(F.expr(f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")).alias("gram"))
    counted = sorted((r["count"], r.gram) for r in grams.groupBy("gram").count().collect())
    order = {gram: (rank, n) for rank, (n, gram) in enumerate(counted)}
    cut = staged(words.mapInPandas(_cut(order), "word string, n long, last int, letters long, pivots array<int>, prefix array<int>"))

    def sides(places: str) -> DataFrame:
        """One row for the part of the word up to each of these bigrams, and one for the part from it on."""
        up, on = F.substring(F.col("word"), F.lit(1), F.col("p") + GRAM), F.substring(F.col("word"), F.col("p") + 1, F.length("word"))
        at = F.explode(F.array(F.xxhash64(F.lit(0), up), F.xxhash64(F.lit(1), on))).alias("at")
        rows = cut.select("word", "n", "last", "letters", F.explode(places).alias("p"))
        return rows.select(at, "word", "n", "last", "letters", F.length("word").alias("len"))

    other_letters = F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters")))
    met = sides("pivots").alias("x").join(
        sides("prefix").alias("y"),
        (F.col("x.at") == F.col("y.at"))
        & (F.col("x.last") <= F.col("y.last"))
        & (F.abs(F.col("x.len") - F.col("y.len")) <= EDITS)
        & (other_letters <= 2 * EDITS)
        & (F.levenshtein(F.col("x.word"), F.col("y.word"), EDITS) == EDITS),
    )
    low, high = F.struct("x.word", "x.n"), F.struct("y.word", "y.n")
    return (
        met.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
        .select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))
        .distinct()
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the end of each word's chain of forms.

    Chains double their step in every round. A form is ``RATIO`` times as frequent as
    its word, so a chain of counts below 2**63 has 19 steps at most and five rounds
    always reach its end; the first round that moves nothing ends the loop.
    """
    now = staged(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = staged(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("at").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return now


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, times: int = 2, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary of ``docs``.

    Words are maximal runs of letters of whole texts, A-Z lowered, some misspelt by
    ``misspelt``. Words are near at edit distance exactly one in code points. The form
    of a word is its most frequent near word (ties: the smallest in code-point order)
    if that is ``ratio`` times as frequent, else null; ``root`` follows forms to the
    last, or is the word itself. ``n_near`` counts near words.

    Defined cases: null and empty texts have no words; a null key misspells nothing.
    Every row counts, repeated ones too. Texts and words may be of any length; a word
    costs index rows by its repeated bigrams at most. An empty table gives no rows.
    Other columns are not read. ``length`` must be at least 4, so that a prefix exists.

    Scale: runs are counted on the map side first, so a frequent word is one row a
    task; all later steps work on the vocabulary.
    """
    if length < GRAM * EDITS + GRAM:
        raise ValueError(f"length must be at least {GRAM * EDITS + GRAM}")
    words = staged(word_counts(docs, key, text, length, times))
    pairs = staged(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("o"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "o")).alias("best"))
    named = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    told = staged(
        words.join(best, "word", "left")
        .withColumn("best", named)
        .select("word", F.col("best.o").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.m")).alias("form_n"))
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
