"""Toxicity: a bidirectional GRU with attention pooling, written and trained in numpy.

A word enters as the sum of two views: a hashed embedding of the word, and the mean
of hashed embeddings of its byte n-grams, which carries over to words never seen.
Windows of ``WINDOW`` words start at every word, so all overlapping windows of the whole
text are scored; a GRU reads each in both directions, attention pools its states, and a
logistic unit scores it. The score of a document is that of its most toxic window.
As neighbouring windows read the same words, a step of all of them reads one slice of
the text's gate inputs.

Labels are known for documents only. Training therefore works on each document's top
windows: at first those with the word whose documents are most often toxic, then those
that the network itself scores highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.langid import held_out
from issuelens.llm.staging import apart, thinned
from issuelens.llm.wordhash import BLOCK_BYTES, NOT_ALNUM, cut_words, mix

WINDOW = 8
WORDS = 1 << 16
GRAMS = 1 << 16
SIZES = (3, 5)
DIM = 12
HIDDEN = 8
#: Labelled documents that training may use: toxic ones, and this times as many others.
SAMPLE = 1500
OTHERS = 2
EPOCHS = 10
RATE = 0.01
WARM = 2
NEGATIVES = 3
ADDED = ("held_out", "score", "predicted")


@dataclass
class Words:
    """Distinct words of some texts, and every window as indices into them.

    ``grams`` lists the n-gram buckets of all distinct words, those of word i from
    ``gram_at[i]`` on. ``seq`` holds the words of all texts in order, each text filled
    up to ``WINDOW`` words with index ``len(buckets)``; ``starts`` are the windows in it.
    """

    buckets: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray
    seq: np.ndarray
    starts: np.ndarray
    text_of: np.ndarray
    #: (first word, n-gram, place and window) of each block the texts were cut in.
    blocks: tuple[tuple[int, int, int, int], ...] = ((0, 0, 0, 0),)

    def of_block(self, k: int) -> Words:
        """The words and windows of one block alone, as views."""
        end = (len(self.buckets), len(self.grams), len(self.seq), len(self.starts))
        (w, g, s, n), (w2, g2, s2, n2) = self.blocks[k], [*self.blocks, end][k + 1]
        seq = np.where(self.seq[s:s2] == len(self.buckets), w2, self.seq[s:s2]) - w
        return Words(self.buckets[w:w2], self.grams[g:g2], self.gram_at[w:w2] - g, seq, self.starts[n:n2] - s, self.text_of[n:n2])

    @property
    def windows(self) -> np.ndarray:
        return self.seq[self.starts[:, None] + np.arange(WINDOW)[None, :]]


def _ranges(low: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())


def cut_windows(texts: list[str | None]) -> Words:
    """The words and windows of whole texts; a text without words has one empty window."""
    block = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data, starts, ends, hashes, cuts = cut_words(block, NOT_ALNUM)
    _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    grams, gram_at = _grams(np.where(NOT_ALNUM[data], np.uint8(0), data), starts[first], ends[first])
    n = np.diff(np.concatenate([[0], cuts]))
    wide = np.maximum(n, WINDOW)
    seq = np.full(int(wide.sum()), len(first), np.int32)
    base = np.cumsum(wide) - wide
    seq[_ranges(base, n)] = index
    count = wide - WINDOW + 1
    buckets = (hashes[first] % np.uint64(WORDS)).astype(np.int64)
    return Words(buckets, grams, gram_at, seq, _ranges(base, count), np.repeat(np.arange(len(texts)), count))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets of some words in order, where each word's begin); a word has a mark at both ends."""
    length = ends - starts + 2
    owner = np.repeat(np.arange(len(starts)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(owner))
    flat = np.concatenate([[0], data, np.zeros(max(SIZES) + 1, np.uint8)])[_ranges(starts, length)].astype(np.uint64)
    flat = np.append(flat, np.zeros(max(SIZES), np.uint64))
    code, buckets, owners = np.zeros(len(owner), np.uint64), [], []
    for n in range(1, max(SIZES) + 1):
        code = code << np.uint64(8) | flat[n - 1 : n - 1 + len(owner)]
        if n in SIZES:
            whole = left >= n
            buckets.append(mix((code[whole] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(GRAMS))
            owners.append(owner[whole])
    order = np.argsort(np.concatenate(owners), kind="stable")
    many = np.bincount(np.concatenate(owners), minlength=len(starts))
    return np.concatenate(buckets)[order].astype(np.int64), np.cumsum(many) - many


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about a quarter of ``BLOCK_BYTES`` together."""
    block: list[str | None] = []
    held = 0
    for text in texts:
        block.append(text)
        held += len(text or "")
        if held >= BLOCK_BYTES // 4:
            yield block
            block, held = [], 0
    if block:
        yield block


def all_windows(texts: list[str | None]) -> Words:
    """``cut_windows`` of many texts, cut block by block to bound memory."""
    parts, blocks, words, grams, at, windows, before = [], [], 0, 0, 0, 0, 0
    for block in _blocks(texts):
        w = cut_windows(block)
        seq = np.where(w.seq == len(w.buckets), -1, w.seq + words).astype(np.int32)
        parts.append((w.buckets.astype(np.int32), w.grams.astype(np.int32), w.gram_at + grams, seq, (w.starts + at).astype(np.int32), (w.text_of + before).astype(np.int32)))
        blocks.append((words, grams, at, windows))
        words, grams, at, windows, before = words + len(w.buckets), grams + len(w.grams), at + len(seq), windows + len(w.starts), before + len(block)
    buckets, gram_list, gram_at, seq, starts, text_of = (np.concatenate(x) for x in zip(*parts, strict=True))
    seq[seq < 0] = words
    return Words(buckets, gram_list, gram_at, seq, starts, text_of, tuple(blocks))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


def new_parameters(seed: int = 3) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)

    def scaled(*shape: int) -> np.ndarray:
        return (draw.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)

    return {
        "word": (draw.standard_normal((WORDS, DIM)) * 0.1).astype(np.float32),
        "gram": (draw.standard_normal((GRAMS, DIM)) * 0.3).astype(np.float32),
        "inp": scaled(DIM, 6 * HIDDEN),
        "inp_bias": np.zeros(6 * HIDDEN, np.float32),
        "rec": scaled(2, HIDDEN, 3 * HIDDEN),
        "att": scaled(2 * HIDDEN, HIDDEN),
        "att_bias": np.zeros(HIDDEN, np.float32),
        "att_out": scaled(HIDDEN),
        "out": scaled(2 * HIDDEN),
        "out_bias": np.zeros(1, np.float32),
    }


def word_vectors(p: dict, w: Words, step: int = 1 << 14) -> np.ndarray:
    """Both views of every distinct word added up, some thousand words at a time."""
    out = p["word"][w.buckets]
    ends = np.append(w.gram_at, len(w.grams))
    for low in range(0, len(w.gram_at), step):
        at = ends[low : low + step + 1]
        sums = np.add.reduceat(p["gram"][w.grams[at[0] : at[-1]]], at[:-1] - at[0], axis=0)
        out[low : low + step] += sums / np.maximum(np.diff(at)[:, None], 1).astype(np.float32)
    return out


def _inputs(p: dict, vectors: np.ndarray) -> np.ndarray:
    """(2, words + 1, 3 x HIDDEN): gate inputs of each direction; the last row is padding."""
    rows = np.concatenate([vectors @ p["inp"] + p["inp_bias"], np.zeros((1, 6 * HIDDEN), np.float32)])
    return np.ascontiguousarray(rows.reshape(len(rows), 2, 3 * HIDDEN).transpose(1, 0, 2))


def forward(p: dict, inputs: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logits of the windows; with ``keep`` also what the gradient needs."""
    n, h = len(windows), HIDDEN
    states = np.zeros((WINDOW, n, 2 * h), np.float32)
    now = np.zeros((2, n, h), np.float32)
    steps = []
    for t in range(WINDOW):
        gx = np.stack([inputs[0][windows[:, t]], inputs[1][windows[:, WINDOW - 1 - t]]])
        gh = now @ p["rec"]
        gates = _sigmoid(gx[..., : 2 * h] + gh[..., : 2 * h])
        z, r = gates[..., :h], gates[..., h:]
        new = np.tanh(gx[..., 2 * h :] + r * gh[..., 2 * h :])
        if keep:
            steps.append((now, z, r, new, gh[..., 2 * h :]))
        now = new + z * (now - new)
        states[t, :, :h] = now[0]
        states[WINDOW - 1 - t, :, h:] = now[1]
    u = np.tanh(states @ p["att"] + p["att_bias"])
    seen = (windows != inputs.shape[1] - 1).T
    seen[0] |= ~seen.any(axis=0)
    s = np.where(seen, u @ p["att_out"], np.float32(-1e9))
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[..., None] * states).sum(axis=0)
    logits = pooled @ p["out"] + p["out_bias"]
    return (logits, steps, states, u, a, pooled) if keep else logits


def gradient(p: dict, w: Words, vectors: np.ndarray, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss of some windows over the words of ``w``."""
    h = HIDDEN
    inputs = _inputs(p, vectors)
    logits, steps, states, u, a, pooled = forward(p, inputs, windows, keep=True)
    d = ((_sigmoid(logits) - labels) * weights / weights.sum()).astype(np.float32)
    g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()], np.float32)}
    dc = d[:, None] * p["out"]
    da = (states * dc).sum(axis=-1)
    ds = a * (da - (a * da).sum(axis=0))
    du = ds[..., None] * p["att_out"] * (1 - u * u)
    g["att_out"] = (u * ds[..., None]).sum(axis=(0, 1))
    g["att"] = np.einsum("tni,tnj->ij", states, du)
    g["att_bias"] = du.sum(axis=(0, 1))
    dstates = a[..., None] * dc + du @ p["att"].T
    g["rec"] = np.zeros_like(p["rec"])
    dinputs = np.zeros_like(inputs)
    back = np.zeros((2, len(windows), h), np.float32)
    for t in reversed(range(WINDOW)):
        before, z, r, new, ghn = steps[t]
        dh = back + np.stack([dstates[t, :, :h], dstates[WINDOW - 1 - t, :, h:]])
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z)
        dr = dnew * ghn * r * (1 - r)
        dgh = np.concatenate([dz, dr, dnew * r], axis=-1)
        dgx = np.concatenate([dz, dr, dnew], axis=-1)
        g["rec"] += before.transpose(0, 2, 1) @ dgh
        back = dh * z + dgh @ p["rec"].transpose(0, 2, 1)
        np.add.at(dinputs[0], windows[:, t], dgx[0])
        np.add.at(dinputs[1], windows[:, WINDOW - 1 - t], dgx[1])
    rows = dinputs[:, :-1].transpose(1, 0, 2).reshape(-1, 6 * h)
    g["inp"], g["inp_bias"] = vectors.T @ rows, rows.sum(axis=0)
    dvec = rows @ p["inp"].T
    g["word"], g["gram"] = (np.zeros(p[k].shape, p[k].dtype) for k in ("word", "gram"))
    np.add.at(g["word"], w.buckets, dvec)
    length = np.diff(np.append(w.gram_at, len(w.grams)))
    np.add.at(g["gram"], w.grams, np.repeat(dvec / np.maximum(length, 1)[:, None], length, axis=0))
    return g


def _part(w: Words, rows: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some windows alone, and these windows over them."""
    used, index = np.unique(w.seq[w.starts[rows][:, None] + np.arange(WINDOW)[None, :]], return_inverse=True)
    index = index.reshape(-1, WINDOW)
    words = used[used < len(w.buckets)]
    length = np.diff(np.append(w.gram_at, len(w.grams)))[words]
    grams = w.grams[_ranges(w.gram_at[words], length)]
    return Words(w.buckets[words], grams, np.cumsum(length) - length, index.ravel(), np.zeros(0, int), np.zeros(0, int)), index


def _slices(p: dict, inputs: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Logits of the windows at every place of ``seq``, as ``forward`` has them."""
    n, h = len(seq) - WINDOW + 1, HIDDEN
    gates_in = inputs[:, seq]
    now = np.zeros((2, n, h), np.float32)
    states = np.empty((WINDOW, n, 2 * h), np.float32)
    for t in range(WINDOW):
        back = WINDOW - 1 - t
        for d, at in ((0, t), (1, back)):
            gx, gh = gates_in[d, at : at + n], now[d] @ p["rec"][d]
            gates = _sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
            new = np.tanh(gx[:, 2 * h :] + gates[:, h:] * gh[:, 2 * h :])
            now[d] = new + gates[:, :h] * (now[d] - new)
            states[at, :, d * h : (d + 1) * h] = now[d]
    s = np.tanh(states @ p["att"] + p["att_bias"]) @ p["att_out"]
    seen = seq != inputs.shape[1] - 1
    empty = np.ones(n, bool)
    for t in range(WINDOW):
        s[t, ~seen[t : t + n]] = np.float32(-1e9)
        empty &= ~seen[t : t + n]
    s[0, empty] = 0
    a = np.exp(s - s.max(axis=0))
    return ((states @ p["out"]) * a).sum(axis=0) / a.sum(axis=0) + p["out_bias"]


def window_logits(p: dict, w: Words, block: int = 2048) -> np.ndarray:
    """Logits of all windows, block by block of the texts and some thousand places at a time."""
    out = []
    for k in range(len(w.blocks)):
        one = w.of_block(k) if len(w.blocks) > 1 else w
        inputs, last = _inputs(p, word_vectors(p, one)), len(one.seq) - WINDOW + 1
        parts = [_slices(p, inputs, one.seq[i : min(i + block, last) + WINDOW - 1]) for i in range(0, last, block)]
        if parts:
            out.append(np.concatenate(parts)[one.starts])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def first_scores(w: Words, label: np.ndarray) -> np.ndarray:
    """For every window its word with the greatest log odds of standing in a toxic document."""
    texts = np.zeros(len(w.seq), np.int64)
    texts[w.starts] = w.text_of
    np.maximum.accumulate(texts, out=texts)
    word = np.append(w.buckets, WORDS)[w.seq]
    texts *= WORDS + 1
    texts += word
    once = np.unique(texts)
    y = label[once // (WORDS + 1)] == 1
    found = [np.bincount((once % (WORDS + 1))[y == side], minlength=WORDS + 1) for side in (True, False)]
    share = [(n + 0.5) / ((label == side).sum() + 1) for n, side in zip(found, (1, 0), strict=True)]
    odds = np.log(share[0] / share[1])
    odds[WORDS] = -99.0
    own = odds[word]
    best = own[w.starts]
    for t in range(1, WINDOW):
        np.maximum(best, own[w.starts + t], out=best)
    return best


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Parameters learnt from labelled texts with Adam; the same for the same rows.

    The result is the average over the later half of the epochs, which depends less on
    the order of rows than the last step does.
    """
    p = new_parameters(seed)
    if not texts or len(set(labels)) < 2:
        p["out"][:] = 0
        p["out_bias"][:] = 4.0 if labels and labels[0] else -4.0
        return p
    w = all_windows(texts)
    label = np.array(labels, np.float32)
    first = first_scores(w, label)
    draw = np.random.default_rng(seed)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    turn = 0
    mean = {k: np.zeros_like(x) for k, x in p.items()}
    for epoch in range(epochs):
        logits = window_logits(p, w) if epoch >= WARM else first
        order = np.lexsort((-logits, w.text_of))
        rank = np.arange(len(order)) - np.searchsorted(w.text_of[order], w.text_of[order])
        most = np.where(label[w.text_of[order]] == 1, 1, NEGATIVES)
        rows = order[rank < most]
        rows = rows[draw.permutation(len(rows))]
        for low in range(0, len(rows), 128):
            some = rows[low : low + 128]
            part, windows = _part(w, some)
            g = gradient(p, part, word_vectors(p, part), windows, label[w.text_of[some]], np.where(label[w.text_of[some]] == 1, 1.5, 1.0))
            turn += 1
            touched = {"word": np.unique(part.buckets), "gram": np.unique(part.grams)}
            for k in p:  # of the tables only the rows in use move
                at = touched.get(k, slice(None))
                m[k][at] += 0.1 * (g[k][at] - m[k][at])
                v[k][at] += 0.01 * (g[k][at] * g[k][at] - v[k][at])
                step = (m[k][at] / (1 - 0.9**turn)) / (np.sqrt(v[k][at] / (1 - 0.99**turn)) + 1e-8)
                p[k][at] -= (RATE * step).astype(np.float32)
        if epoch >= epochs // 2:
            for k in p:
                mean[k] += p[k]
    return {k: (x / (epochs - epochs // 2)).astype(np.float32) for k, x in mean.items()}


def score_texts(p: dict, texts: list[str | None]) -> np.ndarray:
    """Score of each whole text: the probability of its most toxic window."""
    out = []
    for block in _blocks(texts):
        w = cut_windows(block)
        top = np.full(len(block), -np.inf)
        np.maximum.at(top, w.text_of, window_logits(p, w))
        out.append(1 / (1 + np.exp(-np.clip(top, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Parameters from at most ``sample`` toxic and ``OTHERS`` x ``sample`` other labelled documents, by hash of the key.

    Only rows outside the held-out fifth are used; of contradicting labels the larger
    counts. The sample is the only thing the driver receives; its keys, (1 + ``OTHERS``) x ``sample`` at
    most, are broadcast, so the documents are not shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y")).where(~held_out("id"))
    share = F.lit(1.0)
    for r in known.groupBy("y").count().collect():  # two rows at most
        share = F.when(F.col("y") == r.y, 2 * sample * F.when(F.col("y") == 0, OTHERS).otherwise(1) / r["count"]).otherwise(share)
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    drawn = known.where(thinned(F.col("id"), share)).withColumn("rank", rank).where(F.col("rank") <= sample * F.when(F.col("y") == 0, OTHERS).otherwise(1)).select("id", "y", "rank")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(drawn), "id").dropDuplicates(["id"]).orderBy("y", "rank").collect()
    return train([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, parameters: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every window of the whole text is scored. Null and empty texts, and texts without
    a word, have one empty window. Only the text decides, so equal texts score alike.
    A null key counts as held out. Added columns replace input columns of the same
    name; the others pass through.
    """
    others = apart(docs, ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(parameters)  # about 1 MB, fixed

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, texts.tolist()))

    scored_docs = docs.withColumn("__s", scored(F.col(text)))
    return scored_docs.select(*others, held_out(key).alias("held_out"), F.col("__s").alias("score"), (F.col("__s") >= 0.5).cast("int").alias("predicted"))
