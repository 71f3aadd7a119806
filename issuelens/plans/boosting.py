"""Boosted trees fitted whole in one task, tree for tree those that Spark's GBT fits in two jobs a round.

Spark's trees see an input only through its bin, at most 32 of them. All rows of a cell (one
bin of each input) so share their prediction in every round, and a round needs of each cell
only how many of its rows are sampled and what their labels sum up to. The thresholds of the
bins, the rows that a round samples (one generator a round and partition, by position) and
the choice of splits are Spark's, so the models are the same to the noise of sums.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings that the fit knows; any other one is left to Spark's own trees.
KNOWN = frozenset(("maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "seed"))
#: Bins of an input, and the rows that Spark takes its thresholds from.
MAX_BINS, SPLIT_ROWS = 32, 10_000
#: Positions of a generator that one lane draws in turn; draws held at once.
LANE, HELD = 4_096, 1 << 26
#: Cells that are numbered by a table of all possible ones; rows summed up at once.
DENSE, CHUNK = 1 << 24, 1 << 20
#: Share of the squares within a node under which its labels count as equal.
PURE = 1e-12
_EPSILON = 2.0 ** -52
_ARRAY_SEED = 0x3C074A61
_U = np.uint64


# ------------------------------------------------------------------ Spark's generator

def _murmur(words: Sequence[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """MurmurHash3 of four-byte words, many at once."""
    rotl = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = seed.astype(np.uint32)
    for w in words:
        h = h ^ rotl(w * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4 * len(words))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def start_states(seeds: np.ndarray) -> np.ndarray:
    """First states of Spark's XORShift generators with these seeds."""
    words = np.ascontiguousarray(seeds, dtype=">i8").reshape(-1).view("<u4").reshape(-1, 2).T.astype(np.uint32)
    low = _murmur(words, np.full(words.shape[1], _ARRAY_SEED, np.uint32))
    return ((_murmur(words, low).astype(_U) << _U(32)) | low.astype(_U)).reshape(np.shape(seeds))


def _step(s: np.ndarray, spare: np.ndarray) -> None:
    for shift, by in ((np.left_shift, 21), (np.right_shift, 35), (np.left_shift, 4)):
        shift(s, _U(by), out=spare)
        np.bitwise_xor(s, spare, out=s)


@lru_cache(maxsize=16)
def _leap(steps: int) -> np.ndarray:
    """What ``steps`` steps make of each bit of a state; steps are linear in the bits."""
    s = _U(1) << np.arange(64, dtype=_U)
    spare = np.empty_like(s)
    for _ in range(steps):
        _step(s, spare)
    return s


def _leapt(s: np.ndarray, leap: np.ndarray) -> np.ndarray:
    out = np.zeros_like(s)
    for i in range(64):
        out ^= ((s >> _U(i)) & _U(1)) * leap[i]
    return out


class Draws:
    """Which rows each round samples: row j of a partition by the j-th number of its generator.

    ``sizes`` holds the rows of each partition, ``parts`` their numbers. A generator is cut
    into lanes that draw side by side, so rows are laid out by lane, with empty places at
    the end of a partition: ``laid`` brings a column into that layout of ``width`` places.
    """

    def __init__(self, parts: np.ndarray, sizes: np.ndarray, seed: int, rate: float):
        self.parts, self.sizes, self.seed = parts.astype(np.int64), sizes, seed
        self.limit = _U(int(np.ceil(rate * 2.0 ** 53)))
        self.lane = int(min(LANE, sizes.max()))
        self.blocks = -(-sizes // self.lane)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.lanes = int(self.blocks.sum())
        self.width = self.lane * self.lanes

    def laid(self, values: np.ndarray, empty) -> np.ndarray:
        out, lo = np.empty((self.lane, self.lanes), values.dtype), 0
        for n, b, at in zip(self.sizes, self.blocks, self.first, strict=True):
            full = np.full(b * self.lane, empty, values.dtype)
            full[:n] = values[lo:lo + n]
            out[:, at:at + b] = full.reshape(b, self.lane).T
            lo += n
        return out.reshape(-1)

    def rounds(self, n: int) -> Iterator[np.ndarray]:
        """Of every round, whether each place is sampled."""
        some = max(1, HELD // self.width)
        for lo in range(0, n, some):
            yield from self._drawn(np.arange(lo, min(lo + some, n)))

    def _drawn(self, rounds: np.ndarray) -> np.ndarray:
        now = start_states(self.seed + rounds[:, None] + self.parts[None, :] + 1)
        starts = np.empty((len(rounds), self.lanes), _U)
        leap = _leap(2 * self.lane)
        for b in range(int(self.blocks.max())):
            more = self.blocks > b
            starts[:, self.first[more] + b] = now[:, more]
            now = _leapt(now, leap)
        s, spare, high = starts, np.empty_like(starts), np.empty_like(starts)
        out = np.empty((len(rounds), self.lane, self.lanes), bool)
        for j in range(self.lane):
            _step(s, spare)
            np.bitwise_and(s, _U((1 << 26) - 1), out=high)
            np.left_shift(high, _U(27), out=high)
            _step(s, spare)
            np.bitwise_and(s, _U((1 << 27) - 1), out=spare)
            np.bitwise_or(high, spare, out=high)
            np.less(high, self.limit, out=out[:, j, :])
        return out.reshape(len(rounds), self.width)


# ------------------------------------------------------------------ bins

def thresholds(values: np.ndarray, n: int) -> np.ndarray:
    """Thresholds of an input from its sampled values, as Spark finds them; ``n`` rows were sampled from."""
    met, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(met):
        return np.zeros(0)
    counts = counts.astype(float)
    rows = float(n) * (SPLIT_ROWS / n if SPLIT_ROWS < n else 1.0)
    zeros = rows - counts.sum()
    if zeros > _EPSILON * counts.sum() * 100:
        at = np.searchsorted(met, 0.0)
        met, counts = np.insert(met, at, 0.0), np.insert(counts, at, zeros)
    between, bins = (met[:-1] + met[1:]) / 2.0, min(MAX_BINS, n)
    if len(between) <= bins - 1:
        return between
    stride, out, cum = rows / bins, [], np.cumsum(counts)
    target = stride
    for i in range(1, len(met)):
        if abs(cum[i - 1] - target) < abs(cum[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def cells_of(bins: list[np.ndarray], sizes: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """(bin of every input in each cell that occurs, cell of every row)."""
    code, room = np.zeros(len(bins[0]), np.int32), 1
    for b, size in zip(bins, sizes, strict=True):
        if room * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            room = len(code)
        if room * size >= 1 << 31 and code.dtype == np.int32:
            code = code.astype(np.int64)
        code *= size
        code += b
        room *= size
    if room <= DENSE:
        known = np.zeros(room, bool)
        known[code] = True
        met = np.flatnonzero(known)
        cell = (np.cumsum(known, dtype=np.int32) - np.int32(1))[code]
    else:
        met, cell = np.unique(code, return_inverse=True)
        cell = cell.astype(np.int32)
    first = np.empty(len(met), np.int64)
    first[cell] = np.arange(len(cell))
    return [b[first].astype(np.intp) for b in bins], cell


# ------------------------------------------------------------------ trees

def _best(hist: Sequence[np.ndarray], least: int) -> tuple[float, int, int] | None:
    """(gain, input, bin) of the best split of a node; None where nothing is gained."""
    best = None
    for f, h in enumerate(hist):
        if h.shape[1] < 2:
            continue
        left = np.cumsum(h, axis=1)
        whole = left[:, -1:]
        left = left[:, :-1]
        right = whole - left
        ok = (left[0] >= least) & (right[0] >= least)
        if not ok.any():
            continue
        left, right = left[:, ok], right[:, ok]
        n = whole[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            var = lambda x: np.where(x[0] > 0, (x[2] - x[1] * x[1] / x[0]) / x[0], 0.0)
            gain = var(whole) - left[0] / n * var(left) - right[0] / n * var(right)
        at = int(np.argmax(gain))
        if gain[at] > 0 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), f, int(np.flatnonzero(ok)[at]))
    return best


def grow(cols: Sequence[np.ndarray], sizes: Sequence[int], sums: np.ndarray, depth: int, least: int) -> tuple[list[list[float]], np.ndarray]:
    """(nodes, prediction of every cell) of one tree; ``sums`` holds count, sum and sum of squares of each cell.

    A node is [input or -1, last bin to its left, left, right, gain, prediction, count, sum,
    sum of squares].
    """
    nodes: list[list[float]] = []
    told = np.zeros(sums.shape[1])
    open_ = [(None, 0, np.arange(sums.shape[1]))]
    while open_:
        (parent, level, at), *open_ = open_
        mine = sums if level == 0 else sums[:, at]
        n, s, q = mine.sum(axis=1)
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        node = [-1, -1, -1, -1, 0.0, float(s / n) if n else 0.0, float(n), float(s), float(q)]
        nodes.append(node)
        best = None
        if level < depth and q - s * s / n > PURE * q:  # else the labels differ by the noise of sums alone
            binned = [c if level == 0 else c[at] for c in cols]
            best = _best([np.stack([np.bincount(b, weights=x, minlength=k) for x in mine]) for b, k in zip(binned, sizes, strict=True)], least)
        if best is None:
            told[at] = node[5]
            continue
        node[4], node[0], node[1] = best
        goes = cols[best[1]][at] <= best[2]
        open_ += [((len(nodes) - 1, 2), level + 1, at[goes]), ((len(nodes) - 1, 3), level + 1, at[~goes])]
    return nodes, told


def boost(cols: Sequence[np.ndarray], sizes: Sequence[int], cell: np.ndarray, labels: Mapping[str, np.ndarray],
          draws: Draws, settings: Mapping[str, float]) -> dict[str, tuple[list, np.ndarray]]:
    """Of each kind (trees, score of every cell).

    ``labels`` holds the value of ``size`` and the class of ``direction``; they and the
    cells stand in the layout of ``draws``, empty places in a cell after the last one.
    """
    m = len(cols[0])
    score = {kind: np.zeros(m) for kind in labels}
    trees: dict[str, list] = {kind: [] for kind in labels}
    for turn, taken in enumerate(draws.rounds(settings["maxIter"])):
        n, sums = np.zeros(m + 1), {kind: np.zeros((2 if kind == "size" else 1, m + 1)) for kind in labels}
        for lo in range(0, draws.width, CHUNK):
            some = taken[lo:lo + CHUNK]
            met = cell[lo:lo + CHUNK][some].astype(np.intp)
            n += np.bincount(met, minlength=m + 1)
            for kind, y in labels.items():
                v = y[lo:lo + CHUNK][some].astype(float)
                for power, into in enumerate(sums[kind]):
                    into += np.bincount(met, weights=v * v if power else v, minlength=m + 1)
        for kind in labels:
            now, k, s = score[kind], n[:m], sums[kind][0, :m]
            if kind == "size":
                q = sums[kind][1, :m]
                rest = (2 * (s - k * now), 4 * (q - 2 * now * s + k * now * now)) if turn else (s, q)
            else:
                up, down = (4 / (1 + np.exp(2 * now)), 4 / (1 + np.exp(-2 * now))) if turn else (1.0, 1.0)
                rest = (s * up - (k - s) * down, s * up * up + (k - s) * down * down)
            nodes, told = grow(cols, sizes, np.stack([k, *rest]), settings["maxDepth"], settings["minInstancesPerNode"])
            trees[kind].append(nodes)
            score[kind] = now + (settings["stepSize"] if turn else 1.0) * told
    return {kind: (trees[kind], score[kind]) for kind in labels}


# ------------------------------------------------------------------ one task a fit

_OUT = "kind string, n long, e double, trees string"


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _gathered(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray] | None) -> dict[str, np.ndarray]:
    """Columns of all batches; inputs as bins, or as they are where thresholds are still to be found."""
    got: dict[str, list[np.ndarray]] = {c: [] for c in ("part", "past", "fix", "up", "x")}
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        got["x"].append(x if cuts is None else _binned(x, cuts))
        for c, kind in (("part", np.int32), ("past", bool), ("fix", float), ("up", np.int8)):
            got[c].append(b.column(c).to_numpy(zero_copy_only=False).astype(kind))
    return {c: np.concatenate(got.pop(c)) for c in list(got)}


def _fitted(kinds: Sequence[str], cuts: list[np.ndarray] | None, settings: Mapping[str, float], whole: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered((b for b in batches if b.num_rows), cuts)
        past, x, found = got["past"], got.pop("x"), cuts
        if found is None:
            found = [thresholds(x[past, f], int(past.sum())) for f in range(x.shape[1])]
            x = _binned(x, found)
        sizes = [len(c) + 1 for c in found]
        cols, cell = cells_of(list(x.T), sizes)
        del x
        # a partition's rows arrive one after the other, in their order
        part = got.pop("part")[past]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        draws = Draws(part[starts], np.diff(starts, append=len(part)), settings["seed"], settings["subsamplingRate"])
        del part
        values = {"size": got.pop("fix"), "direction": got.pop("up")}
        known = {k: values[k][~past] for k in kinds}
        labels = {k: draws.laid(values.pop(k)[past], 0) for k in kinds}
        asked, place = cell[~past], draws.laid(cell[past], len(cols[0]))
        del values, cell, past, got
        out = []
        for kind, (trees, score) in boost(cols, sizes, place, labels, draws, settings).items():
            told, want = score[asked], known[kind]
            e = np.abs(told - want) if kind == "size" else (told > 0) == (want > 0)
            for n in (n for t in trees for n in t if n[0] >= 0):
                n[1] = float(found[n[0]][n[1]])
            out.append((kind, len(asked), float(e.mean()) if len(e) else None, json.dumps(trees) if whole else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.string()), strict=True)],
                                         names=["kind", "n", "e", "trees"])

    return run


def _cuts(past: DataFrame, n: int, seed: int) -> list[np.ndarray] | None:
    """Thresholds of the inputs; None where Spark takes them from all rows, which the task then does."""
    if n <= SPLIT_ROWS:
        return None
    spark, x = past.sparkSession, past.select(vector_to_array("features").alias("x"))
    s = start_states(np.array([seed]))
    _step(s, np.empty_like(s))
    drawn = int(s[0] & _U(0xFFFFFFFF))
    rows = x._jdf.rdd().sample(False, SPLIT_ROWS / n, drawn - (1 << 32) if drawn >= 1 << 31 else drawn)
    some = DataFrame(spark._jsparkSession.createDataFrame(rows, x._jdf.schema()), spark).toArrow().column("x").combine_chunks()
    values = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
    return [thresholds(values[:, f], n) for f in range(values.shape[1])]


def fit_in_task(rows: DataFrame, kinds: Sequence[str], fold: int | None, n: int, settings: Mapping[str, float]) -> list:
    """(kind, n, e, trees): fitted on the ``n`` rows before the fold, with its rows and their mean error or accuracy.

    Without a fold all rows are fitted on and the trees are returned as text.
    """
    past = F.lit(True) if fold is None else F.col("fold") < fold
    cuts = _cuts(rows if fold is None else rows.filter(past), n, settings["seed"])
    read = rows if fold is None else rows.filter(F.col("fold") <= fold)
    sent = read.select(F.spark_partition_id().alias("part"), past.alias("past"), "fix", "up", vector_to_array("features").alias("x"))
    return sent.coalesce(1).mapInArrow(_fitted(kinds, cuts, settings, fold is None), _OUT).collect()  # a row a kind


def spark_model(estimator: GBTRegressor | GBTClassifier, trees: str, inputs: int) -> GBTRegressionModel | GBTClassificationModel:
    """Spark's model of the trees, as ``estimator`` would have fitted it."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    ml, calc = sc._jvm.org.apache.spark.ml, sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    kind = "GBTClassificationModel" if isinstance(estimator, GBTClassifier) else "GBTRegressionModel"

    def doubles(values: Sequence[float]):
        out = sc._gateway.new_array(sc._gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def built(nodes: Sequence[Sequence[float]], i: int):
        f, cut, left, right, gain, told, n, s, q = nodes[i]
        stats, var = calc(doubles([n, s, q]), int(n)), (q - s * s / n) / n if n else 0.0
        if f < 0:
            return ml.tree.LeafNode(told, var, stats)
        return ml.tree.InternalNode(told, var, gain, built(nodes, int(left)), built(nodes, int(right)), ml.tree.ContinuousSplit(int(f), cut), stats)

    found = json.loads(trees)
    array = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(found))
    for i, nodes in enumerate(found):
        array[i] = ml.regression.DecisionTreeRegressionModel(f"dtr_{i}", built(nodes, 0), inputs)
    weights = doubles([1.0, *[estimator.getStepSize()] * (len(found) - 1)])
    made = (ml.classification.GBTClassificationModel(estimator.uid, array, weights, inputs, 2) if kind == "GBTClassificationModel"
            else ml.regression.GBTRegressionModel(estimator.uid, array, weights, inputs))
    estimator._transfer_params_to_java()
    made = estimator._java_obj.copyValues(made, ml.param.ParamMap.empty())
    return estimator._copyValues(estimator._create_model(made))
