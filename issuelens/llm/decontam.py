"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts are sequences of words (letters, digits and non-ASCII bytes; A-Z lowered). An
item of n words leaks into a document when some stretch of it is within
``EDITS`` x n word edits (insert, delete, replace) of the item.

The CGK embedding (Chakraborty, Goldenberg, Koucky, STOC 2016) walks along a sequence
and at step j emits the current word, moving on when a random bit of (j, word) says so.
Two walks with the same bits fall into step again after an edit, so sequences at a small
edit distance have embeddings at a small Hamming distance. Bit sampling over the
embedding is then an LSH: some sampled places make a key, independent walks give one key
each, and equal keys make a candidate. Candidates are decided by the exact edit distance
of the whole item.

Walks fall out of step for good when edits add up, so items of 2 x ``PART`` words and
more are embedded in parts of ``PART`` words and some more. By pigeonhole a leak has a
part of m out of n words with at most m / n of the allowed edits, so what must be found
never grows with the item. ``walks_for`` takes as many walks, and places for a key, as
planted edits need for the recall ``RECALL`` at a part's length and edit bound.

Windows are as long as the part. A window is embedded only where the q-gram lemma
leaves a leak possible: n words within e edits of another sequence share a run of
floor(n / (e + 1)) words with it (``GRAM`` at most here), so windows start around
shared runs, with every shift that e edits allow. This loses nothing and spares the
walk over windows that cannot match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm.wordhash import NOT_ALNUM, mix, odd_numbers, word_hashes

EDITS = 0.2
GRAM = 4
PART = 16
#: Least share of leaks that the walks of a part find, for each kind of edit.
RECALL = 0.999
#: Walks that ``walks_for`` draws at most.
MOST_WALKS = 128
#: Bytes of item texts that one pass over the documents takes along.
BLOCK_BYTES = 16 << 20
ADDED = ("item_id", "edits", "item_words", "start_word")


def words_of(texts) -> list[np.ndarray]:
    return list(word_hashes(texts, NOT_ALNUM))


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of q words."""
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    scale = odd_numbers(7000 + q, q)
    total = np.zeros(n, np.uint64)
    for k in range(q):
        total += words[k : k + n] * scale[k]
    return mix(total)


def embed_keys(windows: np.ndarray, n: int, sampled: int, walks: int) -> np.ndarray:
    """(walks, rows) LSH keys of sequences of n words, one per row of ``windows``."""
    rows, steps = len(windows), 2 * n
    padded = np.concatenate([windows[:, :n], np.zeros((rows, 1), np.uint64)], axis=1)
    turn = odd_numbers(31, walks * steps).reshape(walks, steps, 1)
    pick = np.random.default_rng(57 + n)
    places = np.zeros((walks, steps), np.int64)
    for t in range(walks):
        places[t, pick.choice(steps, min(sampled, steps), replace=False)] = 1
    scale = odd_numbers(83, walks * steps).reshape(walks, steps, 1)
    at = np.zeros((walks, rows), np.int64)
    line = np.arange(rows)[None, :]
    keys = np.zeros((walks, rows), np.uint64)
    for j in range(steps):
        here = padded[line, at]
        chosen = np.flatnonzero(places[:, j])
        if len(chosen):
            keys[chosen] += mix(here[chosen] * scale[chosen, j] + scale[chosen, j])
        at += ((here * turn[:, j]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return keys


def planted(rng: np.random.Generator, n: int, e: int, kind: str, even: bool) -> tuple[np.ndarray, np.ndarray]:
    """A sequence of n words and a stretch that holds it with e edits of one kind at its start."""
    fresh = iter(rng.integers(1, 1 << 64, 2 * n + 2 * e, dtype=np.uint64))
    item = np.array([next(fresh) for _ in range(n)])
    at = (np.arange(1, e + 1) * (n + 1) // (e + 1) - 1) if even else np.sort(rng.choice(n, e, replace=False))
    out = []
    for k, word in enumerate(item):
        how = kind if kind != "mixed" else ("replace", "delete", "insert")[rng.integers(3)]
        if k not in at:
            out.append(word)
        elif how != "delete":
            out += [next(fresh)] if how == "replace" else [next(fresh), word]
    return item, np.array([*out, *fresh][: n + e])


@lru_cache(maxsize=None)
def walks_for(n: int, e: int) -> tuple[int, int]:
    """(sampled places, walks) that find e edits in n words with a chance of ``RECALL`` at least.

    No walks at all where ``MOST_WALKS`` do not reach it: then every window is decided
    exactly. Most places and fewest walks first. The chance comes from planted edits of each
    kind: p is the share of walks on which a pair agrees, (1 - p) ** walks its miss.
    """
    if e == 0:
        return 3, 1
    rng = np.random.default_rng(1000 * n + e)
    kinds = [(kind, even) for kind in ("replace", "delete", "insert", "mixed") for even in (True, False)]
    pairs = [planted(rng, n, e, *kind) for kind in kinds for _ in range(100)]
    left, right = (np.stack([x[:n] for x in side]) for side in zip(*pairs, strict=True))
    for sampled, most in ((3, MOST_WALKS // 2), (2, MOST_WALKS // 2), (1, MOST_WALKS)):
        agree = embed_keys(left, n, sampled, MOST_WALKS) == embed_keys(right, n, sampled, MOST_WALKS)
        for walks in range(8, most + 1, 8):
            miss = (1 - agree.mean(axis=0)) ** walks
            if miss.reshape(len(kinds), -1).mean(axis=1).max() <= 1 - RECALL:
                return sampled, walks
    return 0, 0


def edits_by_start(item: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """(rows, places) least edit distance between the item and what begins at each place.

    ``stretches`` is padded with zeros on the right. The table is filled from the ends:
    the last row says for each start what the best end costs.
    """
    back = np.ascontiguousarray(stretches[:, ::-1])
    rows, width = back.shape
    place = np.arange(width + 1)
    row = np.zeros((rows, width + 1), np.int64)
    for i, word in enumerate(item[::-1], 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (back != word))
        row = np.minimum.accumulate(new - place, axis=1) + place
    return row[:, :0:-1]


class Items:
    """The items of one block, in parts, indexed by the runs of words their leaks must share."""

    def __init__(self, ids: list[int], texts: list[str | None], edits: float):
        kept = [(i, w) for i, w in zip(ids, words_of(texts), strict=True) if len(w)]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        self.allowed = [int(edits * len(w)) for w in self.words]
        self.parts: list[np.ndarray] = []
        whole, before, spread = [], [], []
        for k, w in enumerate(self.words):
            count = max(1, len(w) // PART)
            cuts = [j * len(w) // count for j in range(count + 1)]
            for low, high in zip(cuts, cuts[1:]):
                self.parts.append(w[low:high])
                whole.append(k)
                before.append(low)
                spread.append(self.allowed[k] * (high - low) // len(w))
        #: Of each part: its item, the item's words before it, the edits it may have.
        self.whole, self.before, self.spread = (np.array(x, np.int64) for x in (whole, before, spread))
        sizes = np.array([len(w) for w in self.parts], np.int64)
        self.kinds, self.kind = np.unique(np.stack([sizes, self.spread], axis=1), axis=0, return_inverse=True)
        self.walks = [walks_for(int(n), int(e)) for n, e in self.kinds]
        posts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(self.parts):
            q = min(GRAM, len(w) // (int(self.spread[k]) + 1))
            g = grams(w, q)
            posts.setdefault(q, []).append((g, np.full(len(g), k), np.arange(len(g))))
        self.index = {}
        for q, found in posts.items():
            g, part, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(g, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[g >> np.uint64(44)] = True
            self.index[q] = (g[order], part[order], offset[order], sieve)

    def windows(self, words: np.ndarray) -> np.ndarray:
        """Distinct (part, start) rows of the windows that could be a leak."""
        found = []
        for q, (g, part, offset, sieve) in self.index.items():
            mine = grams(words, q)
            at = np.flatnonzero(sieve[mine >> np.uint64(44)])
            low, high = np.searchsorted(g, mine[at], "left"), np.searchsorted(g, mine[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            if len(at):
                post = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                found.append(np.stack([part[post], np.repeat(at, count) - offset[post]], axis=1))
        if not found:
            return np.zeros((0, 2), np.int64)
        lines = np.unique(np.concatenate(found), axis=0)
        spread = self.spread[lines[:, 0]]
        reach = np.arange(-spread.max(), spread.max() + 1)
        starts = lines[:, 1][:, None] + reach[None, :]
        part = np.broadcast_to(lines[:, 0][:, None], starts.shape)
        near = (np.abs(reach)[None, :] <= spread[:, None]) & (starts < len(words))
        return np.unique(np.stack([part[near], np.maximum(starts[near], 0)], axis=1), axis=0)

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, start) of every leak, the least edits and start each."""
        found = [np.zeros((0, 3), np.int64)]
        for d, words in enumerate(docs):
            rows = self.windows(words)
            found.append(np.concatenate([np.full((len(rows), 1), d), rows], axis=1))
        todo = np.concatenate(found)
        kind = self.kind.ravel()[todo[:, 1]]
        near = [np.zeros((0, 3), np.int64)]
        for which in np.unique(kind):
            rows = todo[kind == which]
            for low in range(0, len(rows), 4096):
                near.append(self._alike(int(self.kinds[which, 0]), *self.walks[which], rows[low : low + 4096], docs))
        return self._decided(np.unique(np.concatenate(near), axis=0), docs)

    def _alike(self, n: int, sampled: int, walks: int, rows: np.ndarray, docs) -> np.ndarray:
        """(item, document, block) where a window agrees with its part on some walk.

        Blocks divide the starts of an item in a document; the edits that an item may
        have before the part lead to two of them at most.
        """
        places, which = np.unique(rows[:, ::2], axis=0, return_inverse=True)
        windows = np.zeros((len(places), n), np.uint64)
        for i, (d, start) in enumerate(places):
            piece = docs[d][start : start + n]
            windows[i, : len(piece)] = piece
        parts, mine = np.unique(rows[:, 1], return_inverse=True)
        have = embed_keys(np.stack([self.parts[k] for k in parts]), n, sampled, walks)
        keys = embed_keys(windows, n, sampled, walks)
        agree = np.full(len(rows), walks == 0)
        for t in range(walks):
            agree |= keys[t, which.ravel()] == have[t, mine.ravel()]
        d, k, start = rows[agree].T
        item = self.whole[k]
        allowed = np.array(self.allowed, np.int64)[item]
        first = start - self.before[k]
        ends = [np.maximum(first + reach, 0) // (2 * allowed + 1) for reach in (-allowed, allowed)]
        return np.unique(np.concatenate([np.stack([item, d, block], axis=1) for block in ends]), axis=0)

    def _decided(self, near: np.ndarray, docs) -> list[tuple[int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.unique(near[:, 0]):
            mine = near[near[:, 0] == k]
            n, allowed = len(self.words[k]), self.allowed[k]
            block = 2 * allowed + 1
            size = max(1, (1 << 20) // (block + n + allowed))
            for low in range(0, len(mine), size):
                rows = mine[low : low + size]
                stretches = np.zeros((len(rows), block + n + allowed), np.uint64)
                for i, (_, d, b) in enumerate(rows):
                    piece = docs[d][b * block : (b + 1) * block + n + allowed]
                    stretches[i, : len(piece)] = piece
                costs = edits_by_start(self.words[k], stretches)[:, :block]
                for i in np.flatnonzero(costs.min(axis=1) <= allowed):
                    d, at = int(rows[i, 1]), int(costs[i].argmin())
                    found = int(costs[i, at]), int(rows[i, 2]) * block + at
                    best[d, int(k)] = min(best.get((d, int(k)), found), found)
        return [(d, k, e, s) for (d, k), (e, s) in best.items()]


def _item_blocks(spark: SparkSession, benchmark: DataFrame, item: str, item_text: str, edits: float) -> Iterator[Broadcast]:
    """The benchmark as broadcast indexes of at most about ``BLOCK_BYTES`` of text each."""
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield spark.sparkContext.broadcast(Items([r.id for r in rows], [r.text for r in rows], edits))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """One row per (document, item) leak: key, item_id, edits, item_words, start_word.

    ``start_word`` counts words before the best stretch, ``edits`` is its exact word
    edit distance. The document side streams through without a shuffle; the items
    come along in blocks of at most about ``BLOCK_BYTES`` of text, one pass over the
    documents for each block, so what is broadcast is bounded however large the
    benchmark is.

    Defined cases: null or wordless items leak nowhere, null or wordless documents
    hold no leak. Repeated documents are reported once per row, repeated items once
    per item row. A null key is reported as null. Other columns are not carried.
    """
    kind = dict(docs.dtypes)[key]
    out = None
    for shared in _item_blocks(docs.sparkSession, benchmark, item, item_text, edits):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    part = batch.slice(low, 2000)
                    found = index.leaks(words_of(part.column(1).to_pylist()))
                    values = [
                        [index.ids[k] for _, k, *_ in found],
                        [e for _, _, e, _ in found],
                        [len(index.words[k]) for _, k, *_ in found],
                        [s for *_, s in found],
                    ]
                    keys = part.column(0).take(pa.array([d for d, *_ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, pa.int64()) for v in values)], names=[key, *ADDED])

        part = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").mapInArrow(
            run, f"{key} {kind}, item_id long, edits long, item_words long, start_word long"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _leak_test(shared: Broadcast):
    """A function of a text column: whether the text holds an item of one block."""

    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            bad = np.zeros(len(texts), bool)
            for low in range(0, len(texts), 2000):
                for d, *_ in shared.value.leaks(words_of(texts.iloc[low : low + 2000].tolist())):
                    bad[low + d] = True
            yield pd.Series(bad)

    return leaky


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """``docs`` without the rows whose text has a leak, as ``find_leaks`` finds them.

    Rows are judged where they are, block of items by block, without a shuffle. Null
    texts stay; all columns pass through.
    """
    for shared in _item_blocks(docs.sparkSession, benchmark, item, item_text, edits):
        docs = docs.where(~_leak_test(shared)(F.col(text)))
    return docs
