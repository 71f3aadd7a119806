"""Language identification: TF-IDF character n-grams and a sparse logistic model.

Texts become counts of hashed character n-grams (n = 1 to 3, lower case, every run of
other characters one blank), weighted by inverse document frequency over all training
documents and scaled to unit length. A multinomial logistic regression is trained
with follow-the-regularised-leader (per-coordinate, elastic net), then one
temperature is fitted on training documents it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.staging import apart, thinned

BUCKETS = 1 << 16
SAMPLE = 3200
UNKNOWN = "und"
ADDED = ("held_out", "lang_pred", "score")
_SCALES = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Table of the code points that are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of one whole text; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes] if len(codes) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep]
    m = len(codes) + 2
    padded = np.full(m, 32, np.uint32)
    padded[1:-1] = codes
    one = padded * _SCALES[0]
    two = one[:-1] + padded[1:] * _SCALES[1]
    three = two[:-1] + padded[2:] * _SCALES[2]
    mixed = np.concatenate([one, two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed >>= np.uint32(16)
    total = np.bincount(mixed, minlength=BUCKETS)
    buckets = np.flatnonzero(total).astype(np.int32)
    return buckets, total[buckets].astype(np.float32)


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return (x / max(float(np.sqrt((x * x).sum())), 1e-12)).astype(np.float32)

    def logits(self, buckets: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[buckets] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(buckets, self.vector(buckets, counts)) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the multinomial model over sparse rows (buckets, x, class).

    FTRL-proximal per coordinate: the weights follow in closed form from the summed
    gradients ``z`` and squared gradients ``n``; ``l1`` keeps weak features at exactly
    zero, ``l2`` bounds the rest. The bias is not penalised.
    """
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bias = np.zeros(classes)
    order = np.random.default_rng(7)

    def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            w = solved(z[at], n[at])
            slope = softmax(x @ w + bias)
            slope[label] -= 1
            bias -= 0.05 * slope
            g = x[:, None] * slope[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return solved(z, n).astype(np.float32), bias.astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its log."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: str) -> Column:
    """True for rows that may not be learnt from: crc32 of the key as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(bucket, df, docs) over all rows of ``texts(text)``; bucket -1 counts the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                df[gram_counts(text)[0]] += 1
            rows += len(batch)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], rows)})

    return texts.select("text").mapInPandas(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LangModel:
    """Model of the languages in ``docs``, learnt from its rows outside the held-out fifth.

    Document frequencies cover every training row. The classifier is fitted on at
    most ``sample`` of them, the same number for each language, chosen by a hash of
    the key, so what reaches the driver is bounded by that parameter and ``BUCKETS``.
    """
    usable = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id")
    )
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    langs = sorted(sizes)
    if not langs:
        return LangModel([], np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    counted = document_frequencies(usable).toPandas()
    total = int(counted.loc[counted["bucket"] == -1, "df"].sum())
    df = np.zeros(BUCKETS)
    seen = counted[counted["bucket"] >= 0]
    df[seen["bucket"]] = seen["df"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    model = LangModel(langs, idf, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32), 1.0)
    each = max(1, sample // len(langs))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, 2 * each / n).otherwise(share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")))
    drawn = usable.where(thinned(F.col("id"), share)).withColumn("rank", rank).where(F.col("rank") <= each).select("rank", "lang", "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [gram_counts(t) for t in batch["text"]]
            yield pd.DataFrame({"rank": batch["rank"], "lang": batch["lang"], "at": [a.tobytes() for a, _ in pairs], "n": [c.tobytes() for _, c in pairs]})

    got = drawn.mapInPandas(featured, "rank int, lang string, at binary, n binary").toPandas().sort_values(["rank", "lang"])
    rows, checks = [], []
    for r in got.itertuples():
        at, n = np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float32)
        if len(at):
            (checks if r.rank % 5 == 0 else rows).append((at, model.vector(at, n), langs.index(r.lang)))
    model.weights, model.bias = train_ftrl(rows or checks, len(langs))
    if checks:
        model.temperature = fit_temperature(np.stack([model.logits(a, x) for a, x, _ in checks]), np.array([c for _, _, c in checks]))
    return model


def identify(docs: DataFrame, model: LangModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, the calibrated probability.

    Whole texts are read. Null texts and texts without a letter get ``und`` and score
    0, as do all texts where nothing could be learnt. Only the text decides. A null
    key counts as held out. Ties go to the language first in order. Added columns
    replace input columns of the same name; the others pass through.
    """
    others = apart(docs, ADDED)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("__p", predicted(F.col(text))).select(
        *others, held_out(key).alias("held_out"), F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score")
    )
