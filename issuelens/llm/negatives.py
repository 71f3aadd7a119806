"""Hard negatives by an inverted multi-index, searched exactly.

Vectors are cut in two halves with a codebook each; a pair of centroids is a cell. A
half's score in a cell is at most the inner product with its centroid plus the half's
length times the cell's radius, so the two half bounds add up to a bound on every
score of the cell. A heap visits cells in falling order of that sum (the
multi-sequence algorithm) and stops when no later cell can enter the result: the
windows are certified and the search is exact, whatever the codebooks.

Cells lie on shelves of bounded size, one task's worth of rows; a hot cell fills
several. Anchors travel to shelves: first to the best one, which gives a threshold,
then to those whose bound reaches it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.staging import staged, thinned

#: Most rows and bytes of the sample that codebooks are fitted on.
SAMPLE, SAMPLE_BYTES = 8192, 1 << 25
#: Most centroids of a half; cells are their pairs.
CENTROIDS = 64
CELL_ROWS = 128
#: Bytes of vectors on a shelf, and of anchors in one group sent to it.
SHELF_BYTES = 1 << 24
#: Shelves there are at least, where rows suffice.
SHELVES = 48
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Index:
    """Rows on shelves, and what bounds their scores: at most ``CENTROIDS`` squared cells."""

    rows: DataFrame  # shelf, cell, id, label, v
    kind: str
    dim: int
    first: np.ndarray
    second: np.ndarray
    cells: np.ndarray
    shelf: np.ndarray
    parts: np.ndarray
    radii: np.ndarray
    chunk: int

    def halves(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        v = np.frombuffer(b"".join(packed), self.kind).reshape(len(packed), self.dim).astype(np.float64)
        return v[:, :cut], v[:, cut:]


def quantised(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, components floor(scale * x), one row an id."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = kept.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the rows of ``points``, the same for the same rows."""
    if not len(points) or not points.shape[1]:
        return np.zeros((1, points.shape[1]))
    draw = np.random.default_rng(5)
    centres = points[draw.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)


def _packed(kind: str, dim: int):
    def run(vectors: pd.Series) -> list[bytes]:
        out = []
        for v in vectors:
            row = np.zeros(dim, kind)
            row[: len(v)] = v
            out.append(row.tobytes())
        return out

    return run


def build(rows: DataFrame) -> Index | None:
    """Index over all of ``rows(id, label, v)``; None if there are none.

    Three numbers, a bounded sample and at most ``CENTROIDS`` squared cell counts
    reach the driver.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
    if not size.n:
        return None
    dim, top = max(1, size.dim), size.top or 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    pack = _packed(kind, dim)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    drawn = rows.where(thinned(F.col("id"), F.lit(2 * most / size.n))).orderBy(F.xxhash64("id"), "id").limit(most).select("v").toPandas()
    v = np.frombuffer(b"".join(pack(drawn["v"])), kind).reshape(len(drawn), dim).astype(np.float64)
    k = int(np.clip(round((size.n / CELL_ROWS) ** 0.5), 2, CENTROIDS))
    half = -(-dim // 2)
    first, second = codebook(v[:, :half], k), codebook(v[:, half:], k)
    shared = rows.sparkSession.sparkContext.broadcast((first, second))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = shared.value
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.iloc[low : low + 4096]
                packed = pack(part["v"])
                x = np.frombuffer(b"".join(packed), kind).reshape(len(part), dim).astype(np.float64)
                i, j = nearest(x[:, :half], one), nearest(x[:, half:], two)
                r1, r2 = np.linalg.norm(x[:, :half] - one[i], axis=1), np.linalg.norm(x[:, half:] - two[j], axis=1)
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "v": packed, "cell": i * len(two) + j, "r1": r1, "r2": r2})

    cut = staged(rows.mapInPandas(placed, "id long, label long, v binary, cell long, r1 double, r2 double"))
    cells = cut.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toPandas().sort_values("cell")
    room = max(1, min(SHELF_BYTES // (dim * np.dtype(kind).itemsize), -(-size.n // SHELVES)))
    shelf, parts, at, held = [], [], 0, 0
    for n in cells["n"]:
        if held and held + n > room:
            at, held = at + 1, 0
        many = -(-n // room)
        shelf.append(at)
        parts.append(many)
        at, held = (at + many, 0) if many > 1 else (at, held + n)
    places = rows.sparkSession.createDataFrame(list(zip(cells["cell"].tolist(), shelf, [int(p) for p in parts], strict=True)), "cell long, first long, parts long")
    on = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shelf")
    shelved = cut.join(F.broadcast(places), "cell").select(on, "cell", "id", "label", "v")
    chunk = max(1, SHELF_BYTES // (dim * np.dtype(kind).itemsize))
    return Index(
        shelved, kind, dim, first, second, cells["cell"].to_numpy(), np.array(shelf), np.array(parts, np.int64), cells[["r1", "r2"]].to_numpy(), chunk
    )


def _slack(bound: np.ndarray) -> np.ndarray:
    """The bound a little raised, beyond the noise of floating point."""
    return bound + 1e-9 * np.abs(bound) + 1e-3


def _half_bounds(one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return one @ first.T, two @ second.T, np.linalg.norm(one, axis=1), np.linalg.norm(two, axis=1)


def _routes(shared: Broadcast, probe: bool):
    """Shelves of each anchor: the one of the best bound, or all others that can hold a row it wants."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        i, j = index.cells // len(index.second), index.cells % len(index.second)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256].reset_index(drop=True)
                s1, s2, n1, n2 = _half_bounds(*index.halves(list(part["v"])), index.first, index.second)
                middle = s1[:, i] + s2[:, j]
                spread = n1[:, None] * index.radii[:, 0] + n2[:, None] * index.radii[:, 1]
                high, deep = _slack(middle + spread), -_slack(-(middle - spread))
                rows, shelves = [], []
                for a, wants in enumerate(part["wants"]):
                    if probe:
                        best = int(np.argmax(high[a]))
                        rows.append(a)
                        shelves.append(int(index.shelf[best] + part["id"][a] % index.parts[best]))
                        continue
                    need = np.zeros(len(i), bool)
                    for w in wants:
                        need |= (high[a] >= w["lo"]) & (deep[a] <= w["hi"])
                    found = np.unique(np.concatenate([np.arange(s, s + p) for s, p in zip(index.shelf[need], index.parts[need], strict=True)] or [np.zeros(0, int)]))
                    found = found[found != part["probed"][a]]
                    rows += [a] * len(found)
                    shelves += found.tolist()
                out = part.iloc[rows].reset_index(drop=True)
                out["shelf"] = np.array(shelves, np.int64)
                out["probed"] = out["shelf"] if probe else out["probed"]
                yield out[["shelf", "id", "label", "v", "wants", "probed"]]

    return run


class _Shelf:
    """Rows of one shelf by cell, and the falling order of cells for a query."""

    def __init__(self, index: Index, rows: pd.DataFrame):
        rows = rows.sort_values(["cell", "id"], ignore_index=True)
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.one, self.two = index.halves(list(rows["v"]))
        self.exact = np.frombuffer(b"".join(rows["v"]), index.kind).reshape(len(rows), index.dim)
        #: Sums of products stay below 2**53, so doubles are exact.
        self.small = index.kind == "<i2" and index.dim < 1 << 23
        self.exact = self.exact.astype(np.float64 if self.small else np.int64)
        cell = rows["cell"].to_numpy()
        cells, low = np.unique(cell, return_index=True)
        self.slices = {(int(c) // len(index.second), int(c) % len(index.second)): (a, b) for c, a, b in zip(cells, low, np.append(low[1:], len(cell)), strict=True)}
        at1, at2 = cell // len(index.second), cell % len(index.second)
        self.used1, inv1 = np.unique(at1, return_inverse=True)
        self.used2, inv2 = np.unique(at2, return_inverse=True)
        self.first, self.second = index.first[self.used1], index.second[self.used2]
        self.r1, self.r2 = np.zeros(len(self.used1)), np.zeros(len(self.used2))
        np.maximum.at(self.r1, inv1, np.linalg.norm(self.one - self.first[inv1], axis=1))
        np.maximum.at(self.r2, inv2, np.linalg.norm(self.two - self.second[inv2], axis=1))

    def visit(self, half1: np.ndarray, half2: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, low, high) of the cells' rows in falling order of summed half bounds."""
        o1, o2 = np.argsort(-half1, kind="stable"), np.argsort(-half2, kind="stable")
        heap = [(-(half1[o1[0]] + half2[o2[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            found = self.slices.get((int(self.used1[o1[i]]), int(self.used2[o2[j]])))
            if found:
                yield -bound, *found
            else:
                yield -bound, 0, 0
            if j + 1 < len(o2):
                heapq.heappush(heap, (-(half1[o1[i]] + half2[o2[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (-(half1[o1[i + 1]] + half2[o2[0]]), i + 1, 0))


def _searched(shared: Broadcast, same: bool, k: int):
    """The best ``k`` rows of a shelf in every window of every anchor sent there."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index: Index = shared.value
        out: list[tuple[int, int, int, int]] = []
        if len(rows) and len(asked):
            shelf = _Shelf(index, rows)
            one, two = index.halves(list(asked["v"]))
            exact = np.frombuffer(b"".join(asked["v"]), index.kind).reshape(len(asked), index.dim).astype(shelf.exact.dtype)
            s1, s2, n1, n2 = _half_bounds(one, two, shelf.first, shelf.second)
            for a, (anchor, label, wants) in enumerate(zip(asked["id"], asked["label"], asked["wants"], strict=True)):
                best = {w["w"]: [] for w in wants}
                floor = {w["w"]: w["lo"] for w in wants}
                for bound, low, high in shelf.visit(_slack(s1[a] + n1[a] * shelf.r1), _slack(s2[a] + n2[a] * shelf.r2)):
                    if all(bound < x for x in floor.values()):
                        break
                    if low == high:
                        continue
                    scores = shelf.exact[low:high] @ exact[a]
                    fits = (shelf.labels[low:high] == label) == same
                    fits &= shelf.ids[low:high] != anchor
                    for w in wants:
                        at = np.flatnonzero(fits & (scores >= floor[w["w"]]) & (scores <= w["hi"]))
                        if len(at):
                            if len(at) > k:
                                at = at[np.lexsort((shelf.ids[low:high][at], -scores[at]))[:k]]
                            met = best[w["w"]] + [(-int(scores[x]), int(shelf.ids[low + x])) for x in at]
                            met.sort()
                            best[w["w"]] = met[:k]
                            if len(met) >= k:
                                floor[w["w"]] = max(floor[w["w"]], -met[k - 1][0])
                out += [(anchor, w, i, -s) for w, met in best.items() for s, i in met]
        return pd.DataFrame(out, columns=["anchor", "w", "id", "score"])

    return run


_ASKED = "shelf long, id long, label long, v binary, wants array<struct<w:int,lo:long,hi:long>>, probed long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, w, id, score, rank): the best ``k`` rows in each window of ``asked(id, label, v, wants)``.

    Only rows with the anchor's label count, or only others. Higher scores come
    first, ties by smaller id. Each group of the search holds one shelf and at most
    about ``chunk`` anchors.
    """
    spark = asked.sparkSession
    slim = Index(**{**index.__dict__, "rows": None})
    shared = spark.sparkContext.broadcast(slim)
    groups = -(-asked.count() // index.chunk) or 1
    rows = index.rows.withColumn("group", F.explode(F.array(*map(F.lit, range(groups))))) if groups > 1 else index.rows.withColumn("group", F.lit(0))

    def through(sent: DataFrame) -> DataFrame:
        sent = sent.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        return rows.groupBy("shelf", "group").cogroup(sent.groupBy("shelf", "group")).applyInPandas(_searched(shared, same, k), "anchor long, w int, id long, score long")

    probes = staged(asked.withColumn("shelf", F.lit(0)).withColumn("probed", F.lit(-1)).mapInPandas(_routes(shared, True), _ASKED))
    near = staged(_best(through(probes), k).drop("rank"))
    floors = near.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    known = floors.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("known"))
    raised = F.transform("wants", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], F.coalesce(F.col("known")[w["w"]], w["lo"])).alias("lo"), w["hi"].alias("hi")))
    sure = probes.join(known, F.col("id") == F.col("anchor"), "left").withColumn("wants", raised).select("shelf", "id", "label", "v", "wants", "probed")
    rest = through(sure.mapInPandas(_routes(shared, False), _ASKED))
    return staged(_best(near.union(rest), k))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the components floor(``scale`` * x). An anchor's
    positives are its best ``positives`` other rows of its label; for each, the best
    ``negatives`` rows of other labels with a score from ``low`` to ``high`` percent of
    the positive's are returned. Ties go to the smaller key. ``is_anchor`` is a
    condition on ``id``, the key.

    Defined cases: rows with a null key, label or vector, or a null or non-finite
    component, take no part. Of rows with the same key the one with the least label,
    then the least vector, counts. Vectors of different lengths are filled up with
    zeros, so an empty vector scores 0 everywhere. A positive below 0 has an empty
    window, one of 0 takes scores of 0. Scores are exact while they fit in a long.
    An anchor without positives or an empty table gives no rows. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(staged(quantised(vectors, key, vector, label, scale)))
    if index is None:
        return spark.createDataFrame([], names)
    index.rows = staged(index.rows)
    anchors = staged(index.rows.where(is_anchor).select("id", "label", "v"))
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    friends = search(index, anchors.withColumn("wants", whole), True, positives)
    window = F.struct(F.col("rank").alias("w"), F.expr(f"(score * {low} + 99) div 100").alias("lo"), F.expr(f"(score * {high}) div 100").alias("hi"))
    windows = friends.where("score >= 0").withColumn("window", window).groupBy("anchor").agg(F.sort_array(F.collect_list("window")).alias("wants"))
    asked = anchors.join(windows, F.col("id") == F.col("anchor")).select("id", "label", "v", "wants")
    foes = search(index, asked, False, negatives)
    told = friends.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("rank").alias("w"), F.col("score").alias("positive_score"))
    return told.join(foes.withColumnRenamed("anchor", "anchor_id"), ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
