"""Text quality from supervised subword embeddings, trained in numpy.

A token is a run of characters other than white space, case and marks kept. Its hashed
word vector and the hashed vectors of its byte n-grams, with marks at both ends, are
averaged; a token that repeats the one before it brings the vector of repetition as
well. A document is the average over its tokens. A softmax layer classifies it;
vectors and layer are learned together by stochastic gradient descent.

As the layer is linear, scoring needs one number a bucket and class: vectors are
multiplied with the layer once, and documents average these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.langid import held_out, softmax
from issuelens.llm.sampling import labelled_sample
from issuelens.llm.staging import apart
from issuelens.llm.wordhash import BLOCK_BYTES, WHITE, mix

WORDS = 1 << 15
GRAMS = 1 << 15
SIZES = (1, 2, 3, 4)
DIM = 12
#: Labelled documents of each class that training may use.
SAMPLE = 3000
EPOCHS = 12
RATE = 0.5
ADDED = ("held_out", "score", "predicted")
#: Bucket of repetition, behind those of words and n-grams.
REPEAT = WORDS + GRAMS
BUCKETS = REPEAT + 1
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _tokens(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, token starts, ends, tokens up to the end of each text)."""
    data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    space = WHITE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    return data, starts, ends, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in block]))


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, one place of it, distinct token of each token)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    scale = np.full(len(data) + 1, _SALT, np.uint64)
    scale[0] = 1
    power = np.multiply.accumulate(scale)
    inverse = np.full(len(data), np.uint64(pow(int(_SALT), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(inverse), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * power[starts])
    return np.unique(hashes, return_index=True, return_inverse=True)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets, how many of them) for each of some tokens, padded with a mark at both ends."""
    length = ends - starts + 2
    low = np.cumsum(length) - length
    flat = np.full(int(length.sum()) + max(SIZES), 256, np.uint64)
    at = np.repeat(starts - low, length) + np.arange(int(length.sum()))
    inner = np.ones(int(length.sum()), bool)
    inner[low] = inner[low + length - 1] = False
    flat[: len(inner)][inner] = data[(at - 1)[inner]]
    token = np.repeat(np.arange(len(starts)), length)
    left = np.repeat(low + length, length) - np.arange(len(token))
    code, buckets, owners = np.zeros(len(token), np.uint64), [], []
    for n in range(1, max(SIZES) + 1):
        code = code * np.uint64(0x100000001B3) + flat[n - 1 : n - 1 + len(token)] + np.uint64(1)
        if n in SIZES:
            ok = (left >= n) & (inner if n == 1 else True)
            buckets.append(mix(code[ok] * _SALT + np.uint64(n)) % np.uint64(GRAMS))
            owners.append(token[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64) + WORDS, np.bincount(owner, minlength=len(starts))


def _blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Consecutive texts of about an eighth of ``BLOCK_BYTES`` together."""
    block: list[bytes] = []
    held = 0
    for text in texts:
        block.append((text or "").encode("utf-8", "replace"))
        held += len(block[-1])
        if held >= BLOCK_BYTES // 8:
            yield block
            block, held = [], 0
    if block:
        yield block


@dataclass
class Cut:
    """Tokens of some texts: their distinct tokens, the buckets of these, and where texts end."""

    words: np.ndarray
    grams: np.ndarray
    many: np.ndarray
    token: np.ndarray
    again: np.ndarray
    cuts: np.ndarray


def cut(block: list[bytes]) -> Cut:
    data, starts, ends, cuts = _tokens(block)
    hashes, first, token = _distinct(data, starts, ends)
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    head = np.concatenate([[0], cuts[:-1]])
    again[head[head < len(again)]] = False
    grams, many = _grams(data, starts[first], ends[first])
    return Cut((hashes % np.uint64(WORDS)).astype(np.int64), grams, many, token, again, cuts)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each whole text: the average over its tokens; empty without tokens."""
    for block in _blocks(texts):
        c = cut(block)
        low, ends = 0, np.cumsum(c.many)
        for high in c.cuts:
            mine, count = np.unique(c.token[low:high], return_counts=True)
            parts = c.many[mine]
            at = np.repeat(ends[mine] - parts - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
            share = count / np.maximum(1, high - low) / (1 + parts)
            buckets = np.concatenate([c.words[mine], c.grams[at], [REPEAT]])
            weights = np.concatenate([share, np.repeat(share, parts), [c.again[low:high].mean() if high > low else 0.0]])
            used, inverse = np.unique(buckets, return_inverse=True)
            yield used.astype(np.int32), np.bincount(inverse, weights, len(used)).astype(np.float32)
            low = high


@dataclass
class QualityModel:
    """Numbers a bucket and class, and the bias of each class."""

    table: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the second class for each whole text."""
        side = (self.table[:, 1] - self.table[:, 0]).astype(np.float64)
        base = float(self.bias[1] - self.bias[0])
        out = []
        for block in _blocks(texts):
            c = cut(block)
            if len(c.many):
                grams = np.add.reduceat(side[c.grams], np.cumsum(c.many) - c.many)
                own = (side[c.words] + grams) / (1 + c.many)
            else:
                own = np.zeros(0)
            total = np.concatenate([[0.0], np.cumsum(own[c.token] + side[REPEAT] * c.again)])
            low = np.concatenate([[0], c.cuts[:-1]])
            mean = (total[c.cuts] - total[low]) / np.maximum(1, c.cuts - low)
            out.append(1 / (1 + np.exp(-np.clip(mean + base, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: tuple[float, float] = (1.0, 1.0), seed: int = 1, epochs: int = EPOCHS, rate: float = RATE) -> QualityModel:
    """Model of rows (buckets, weights, class), a falling rate; the same for the same rows.

    ``weights`` are those of the classes in the loss, so that a balanced sample still
    gives the probabilities of the whole.
    """
    classes = {y for *_, y in rows}
    if len(classes) < 2:
        sure = 4.0 if classes == {1} else -4.0 if classes == {0} else 0.0
        return QualityModel(np.zeros((BUCKETS, 2), np.float32), np.array([0.0, sure], np.float32))
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    turns, turn = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, x, y = rows[i]
            h = x @ vectors[at]
            slope = softmax(h @ layer + bias) * weights[y]
            slope[y] -= weights[y]
            step = np.float32(rate * (1 - turn / turns))
            back = layer @ slope
            layer -= step * np.outer(h, slope).astype(np.float32)
            bias -= np.float32(0.1) * step * slope.astype(np.float32)
            vectors[at] -= (step * x[:, None] * back[None, :]).astype(np.float32)
            turn += 1
    return QualityModel((vectors @ layer).astype(np.float32), bias)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Model learnt from at most ``sample`` labelled documents of each class.

    Texts are cut to features where they are, so the driver receives at most one number a
    bucket for each document. Null labels and null texts teach nothing.
    """
    drawn, sizes = labelled_sample(docs, labels, key, text, label, sample)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(features(batch["text"].tolist()))
            yield pd.DataFrame({"y": batch["y"], "rank": batch["rank"], "at": [a.tobytes() for a, _ in pairs], "w": [w.tobytes() for _, w in pairs]})

    got = drawn.select("y", "rank", "text").mapInPandas(featured, "y int, rank int, at binary, w binary").toPandas().sort_values(["rank", "y"])
    rows = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.w, np.float32), int(r.y)) for r in got.itertuples()]
    share = [sizes.get(y, 0) / max(1, min(sizes.get(y, 0), sample)) for y in (0, 1)]
    top = max(*share, 1e-9)
    return train(rows, (share[0] / top, share[1] / top))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on).

    Every token of the whole text counts. Null and empty texts, and texts of white
    space, have no tokens and get the score of the bias. Only the text decides, so
    equal texts score alike. A null key counts as held out. Rows that repeat a key are
    scored one by one. Added columns replace input columns of the same name; the
    others pass through. Without labels of both classes the score is constant.
    """
    others = apart(docs, ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x 2 floats

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    told = docs.withColumn("__s", scored(F.col(text)))
    return told.select(*others, held_out(key).alias("held_out"), F.col("__s").alias("score"), (F.col("__s") >= least).cast("int").alias("predicted"))
