"""Horizon heads: boosted models per variant and target, validated forward in time, gated, saved and served.

A head is (variant, target, kind). The ``pre`` variant knows nothing of the first
trading day; ``post`` knows the day-1 gain as an input, and its return heads learn the
correction to that gain. ``size`` heads predict the value, ``direction`` heads of the
return targets the chance to end above the offer. Every head is fitted once a fold on
the rows before the fold's block; only a head that beats its baseline is fitted on all
rows and saved. A fit is one task that runs all its rounds over the binned rows (see
``boosting``); one with more rows than a task may hold runs Spark's own trees, two jobs a
round. The fits are independent Spark jobs, a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import time_folds
from ..session import materialise
from .boosting import KNOWN, fit_in_task, spark_model
from .models import TREES, column_medians, cv_metrics, fold_baselines, majority_baseline, skill_gate

VARIANTS = ("pre", "post")
#: Rows, those to be scored among them, that are fitted in one task: about 50 bytes each.
TASK_ROWS = 10_000_000
_KEYS = ["variant", "target", "kind"]
_FOLDS = "variant string, target string, kind string, fold int, n long, mae double"


@dataclass(frozen=True)
class Horizons:
    """Columns of the modelling frame that the heads read."""

    inputs: tuple[str, ...]
    returns: tuple[str, ...]
    others: tuple[str, ...]
    carry: str
    day: str
    row_id: str

    def names(self, variant: str) -> list[str]:
        return [*self.inputs, *([self.carry] if variant == "post" else [])]

    def base(self, variant: str, target: str) -> Column:
        """What a size head corrects."""
        return F.col(self.carry) if variant == "post" and target in self.returns else F.lit(0.0)

    def heads(self) -> list[tuple[str, str, str]]:
        kinds = lambda t: ("size", "direction") if t in self.returns else ("size",)
        return [(v, t, k) for v in VARIANTS for t in (*self.returns, *self.others) for k in kinds(t)]


def _filled(df: DataFrame, medians: Column, names: Sequence[str]) -> DataFrame:
    """Missing inputs take their median, then zero; the map travels as a column."""
    full = df.withColumn("__m", medians)
    return full.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at("__m", F.lit(c)), F.lit(0.0)) for c in names}).drop("__m")


def median_map(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return column_medians(df, names).agg(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("m"))


def variant_medians(frame: DataFrame, spec: Horizons) -> DataFrame:
    """(variant, m): medians of the inputs of each variant, found in one pass; ``pre`` knows some of those of ``post``."""
    mine = lambda v: F.map_filter("m", lambda c, _: c.isin(*spec.names(v)))
    parts = F.array(*[F.struct(F.lit(v).alias("variant"), mine(v).alias("m")) for v in VARIANTS])
    return median_map(frame, spec.names("post")).select(F.explode(parts).alias("r")).select("r.*")


def folded_rows(frame: DataFrame, spec: Horizons, target: str, splits: int) -> DataFrame:
    """Rows that bear the target with their fold, written once for both variants."""
    names = spec.names("post")
    rows = frame.filter(F.col(target).isNotNull()).select(spec.day, spec.row_id, F.col(target).alias("y"), *[c for c in names if c != target])
    return materialise(time_folds(materialise(rows), spec.day, spec.row_id, splits=splits))


def past_medians(folded: DataFrame, spec: Horizons) -> DataFrame:
    """One row with the medians of the rows that every fold trains on, the block before the first scored one.

    So no fold sees a statistic of rows it predicts. Both variants read them.
    """
    return materialise(median_map(folded.filter("fold = 0"), spec.names("post")))


def head_rows(folded: DataFrame, medians: DataFrame, spec: Horizons, variant: str, target: str) -> DataFrame:
    """(fold, features, y, base, fix, up) of the folded rows of the target, written once."""
    names = spec.names(variant)
    ready = _filled(folded, medians.scalar(), names).withColumn("base", spec.base(variant, target).cast("double"))
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
    up = (F.col("y") > 0).cast("int")
    return materialise(packed.select("fold", "features", F.col("y").cast("double"), "base", (F.col("y") - F.col("base")).alias("fix"), up.alias("up")))


def _trees(kind: str, settings: Mapping[str, object]):
    made, label = (GBTClassifier, "up") if kind == "direction" else (GBTRegressor, "fix")
    return made(featuresCol="features", labelCol=label, **{**TREES, **settings})


def _fold_score(rows: DataFrame, kind: str, fold: int, settings: Mapping[str, object]) -> tuple[int, int, float] | None:
    """(fold, rows, error or accuracy) of one fold; None where its past has one class only or its block no row."""
    past = rows.filter(F.col("fold") < fold)
    if kind == "direction" and past.select("up").distinct().count() < 2:
        return None
    told = _trees(kind, settings).fit(past).transform(rows.filter(F.col("fold") == fold))
    right = (F.col("prediction") == F.col("up")).cast("double")
    wrong = F.abs(F.col("prediction") + F.col("base") - F.col("y"))
    out = told.agg(F.count("*").alias("n"), F.avg(right if kind == "direction" else wrong).alias("e")).first()
    return (fold, out.n, out.e) if out.n else None


def _fold_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and gains by fold; rows without one, where there are too few for folds, are under -1."""
    found = rows.groupBy(F.coalesce("fold", F.lit(-1)).alias("fold")).agg(F.count("*").alias("n"), F.sum("up").alias("ups"))
    return {r.fold: (r.n, r.ups) for r in found.collect()}  # a row a fold


def _fold_scores(rows: DataFrame, kinds: Sequence[str], fold: int, sizes: Mapping[int, tuple[int, int]], settings: Mapping[str, object]) -> list:
    """(kind, fold, rows, error or accuracy) of the heads of one variant and target; ``sizes`` holds rows and gains by fold."""
    n, ups = (sum(v[i] for f, v in sizes.items() if 0 <= f < fold) for i in (0, 1))
    if not n or n + sizes.get(fold, (0, 0))[0] > TASK_ROWS or set(settings) - KNOWN:
        scores = [(k, _fold_score(rows, k, fold, settings)) for k in kinds]
        return [(k, *score) for k, score in scores if score]
    kinds = [k for k in kinds if k == "size" or 0 < ups < n]
    found = fit_in_task(rows, kinds, fold, n, {**TREES, **settings}) if kinds else []
    return [(r.kind, fold, r.n, r.e) for r in found if r.n]


def _whole_fit(rows: DataFrame, kinds: Sequence[str], inputs: int, sizes: Mapping[int, tuple[int, int]], settings: Mapping[str, object]) -> dict:
    """Of each kind the model fitted on all rows."""
    n = sum(v[0] for v in sizes.values())
    if not 0 < n <= TASK_ROWS or set(settings) - KNOWN:
        return {k: _trees(k, settings).fit(rows) for k in kinds}
    return {r.kind: spark_model(_trees(r.kind, settings), r.trees, inputs) for r in fit_in_task(rows, kinds, None, n, {**TREES, **settings})}


def _together(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Results of some Spark jobs in order, a few running at a time."""
    with ThreadPool(max(1, min(parallelism, len(jobs) or 1))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)


def baselines(frame_rows: Mapping[tuple[str, str], DataFrame], spec: Horizons) -> DataFrame:
    """(variant, target, kind, fold, n, base_mae): what each head has to beat in each fold.

    The mean of all earlier rows for sizes; the earlier majority, and never less than a
    coin flip, for directions.
    """
    parts = []
    for variant, target, kind in spec.heads():
        rows = frame_rows[variant, target].drop("base")
        if kind == "size":
            known = fold_baselines(rows, "fold", "y")
            per = rows.filter("fold > 0").join(F.broadcast(known), "fold").groupBy("fold").agg(
                F.count("*").alias("n"), F.avg(F.abs(F.col("base") - F.col("y"))).alias("base_mae"))
        else:
            per = majority_baseline(rows, "fold", "up").select("fold", "n", F.col("baseline_acc").alias("base_mae"))
        parts.append(per.select(F.lit(variant).alias("variant"), F.lit(target).alias("target"), F.lit(kind).alias("kind"), "fold", "n", "base_mae"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Trained:
    """Metrics of every head and, for those with skill, the models fitted on all rows."""

    metrics: DataFrame
    models: dict[tuple[str, str, str], GBTRegressionModel | GBTClassificationModel]
    medians: DataFrame  # variant, m
    spec: Horizons

    def importances(self, spark: SparkSession, top: int | None = 12) -> DataFrame:
        """(variant, target, kind, rank, input, importance) of the shipped heads, largest first."""
        rows = []
        for (variant, target, kind), model in sorted(self.models.items()):
            ranked = sorted(zip(self.spec.names(variant), model.featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], p[0]))
            rows += [(variant, target, kind, i + 1, name, float(w)) for i, (name, w) in enumerate(ranked[:top])]
        return spark.createDataFrame(rows, "variant string, target string, kind string, rank int, input string, importance double")

    def save(self, path: str) -> None:
        """One folder a head, the medians and the metrics beside them."""
        self.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
        self.medians.write.mode("overwrite").parquet(f"{path}/medians")
        for head, model in self.models.items():
            model.write().overwrite().save("/".join([path, "heads", *head]))


def train_horizons(frame: DataFrame, spec: Horizons, splits: int = 5, min_rows: int = 60, parallelism: int = 8, **settings) -> Trained:
    """Forward-chained validation of every head, then the final fit of those with skill.

    ``frame`` holds the day, the id, the inputs, the carry and the targets; rows without
    a target don't count for its heads, and a target with under ``min_rows`` rows has no
    head. Only one error a fold and head reaches the driver. ``settings`` override those
    of the trees.
    """
    spark = frame.sparkSession
    counts = frame.filter(F.col(spec.day).isNotNull()).agg(*[F.count(t).alias(t) for t in (*spec.returns, *spec.others)]).first()
    enough = lambda names: tuple(t for t in names if counts[t] >= min_rows)
    spec = Horizons(spec.inputs, enough(spec.returns), enough(spec.others), spec.carry, spec.day, spec.row_id)
    targets = (*spec.returns, *spec.others)
    first = [lambda: materialise(variant_medians(frame, spec)), *[lambda t=t: folded_rows(frame, spec, t, splits) for t in targets]]
    medians, *ready = _together(spark, first, parallelism)
    folded = dict(zip(targets, ready, strict=True))
    packs = [(v, t) for v in VARIANTS for t in targets]
    past = dict(zip(targets, _together(spark, [lambda t=t: past_medians(folded[t], spec) for t in targets], parallelism), strict=True))
    rows = dict(zip(packs, _together(spark, [lambda v=v, t=t: head_rows(folded[t], past[t], spec, v, t) for v, t in packs], parallelism), strict=True))
    kinds = {p: [k for v, t, k in spec.heads() if (v, t) == p] for p in packs}
    held = _together(spark, [lambda p=p: _fold_sizes(rows[p]) for p in packs], parallelism)
    sizes = dict(zip(packs, held, strict=True))
    turns = [(p, fold) for fold in range(splits, 0, -1) for p in packs]  # the longest first
    found = _together(spark, [lambda p=p, k=k: _fold_scores(rows[p], kinds[p], k, sizes[p], settings) for p, k in turns], parallelism)
    scored = [(*p, *score) for (p, _), scores in zip(turns, found, strict=True) for score in scores]
    bars = baselines(rows, spec) if rows else spark.createDataFrame([], "variant string, target string, kind string, fold int, n long, base_mae double")
    folds = materialise(spark.createDataFrame(scored, _FOLDS).join(bars.drop("n"), [*_KEYS, "fold"]))
    size = skill_gate(cv_metrics(folds.filter("kind = 'size'"), keys=_KEYS))
    direction = skill_gate(cv_metrics(folds.filter("kind = 'direction'"), higher_is_better=True, keys=_KEYS))
    n_scored = folds.groupBy(*_KEYS).agg(F.sum("n").alias("n_scored"))
    n = spark.createDataFrame([(t, counts[t]) for t in (*spec.returns, *spec.others)], "target string, n long")
    metrics = materialise(size.unionByName(direction).join(n_scored, _KEYS).join(F.broadcast(n), "target"))
    shipped = [tuple(r) for r in metrics.filter("skill").select(*_KEYS).collect()]  # one row a head
    wanted = [(p, [k for k in kinds[p] if (*p, k) in shipped]) for p in packs]
    fitted = _together(spark, [lambda p=p, some=some: _whole_fit(rows[p], some, len(spec.names(p[0])), sizes[p], settings) for p, some in wanted if some], parallelism)
    models = {(*p, k): model for (p, _), made in zip([w for w in wanted if w[1]], fitted, strict=True) for k, model in made.items()}
    return Trained(metrics, models, medians, spec)


def load_heads(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(models by head, medians) as ``Trained.save`` wrote them; a head that did not ship is absent."""
    shipped = spark.read.parquet(f"{path}/metrics").filter("skill").select(*_KEYS).collect()
    kinds = {"size": GBTRegressionModel, "direction": GBTClassificationModel}
    return {tuple(r): kinds[r.kind].load("/".join([path, "heads", *r])) for r in shipped}, spark.read.parquet(f"{path}/medians")


def horizon_reads(frame: DataFrame, models: Mapping, medians: DataFrame, spec: Horizons) -> DataFrame:
    """``frame`` with ``variant``, each target's forecast and ``p_<target>``, the chance of a gain.

    Rows with a known carry take the ``post`` heads, others the ``pre`` ones. A head
    without skill is not there, so its column is NULL: the number is withheld. Post
    return heads add the carry back.
    """
    parts = []
    for variant in VARIANTS:
        names, known = spec.names(variant), F.col(spec.carry).isNotNull()
        part = frame.filter(known if variant == "post" else ~known).withColumn("variant", F.lit(variant))
        held = {c: F.col(c) for c in part.columns}
        median = medians.filter(F.col("variant") == variant).select("m").scalar()
        filled = part.withColumn("__m", median).withColumns(
            {f"__{c}": F.coalesce(F.col(c).cast("double"), F.try_element_at("__m", F.lit(c)), F.lit(0.0)) for c in names})
        out = VectorAssembler(inputCols=[f"__{c}" for c in names], outputCol="features").transform(filled)
        told = {}
        for t in (*spec.returns, *spec.others):
            size, direction = models.get((variant, t, "size")), models.get((variant, t, "direction"))
            told[t], told[f"p_{t}"] = F.lit(None).cast("double"), F.lit(None).cast("double")
            if size is not None:
                out = size.transform(out).withColumnRenamed("prediction", f"__size_{t}")
                told[t] = F.col(f"__size_{t}") + spec.base(variant, t)
            if direction is not None:
                out = direction.transform(out).drop("rawPrediction", "prediction").withColumnRenamed("probability", f"__up_{t}")
                told[f"p_{t}"] = F.round(vector_to_array(f"__up_{t}")[1], 2)
        mine = [c for c in held if c not in told]
        parts.append(out.select(*mine, *[v.alias(k) for k, v in told.items() if not k.startswith("p_") or k[2:] in spec.returns]))
    return parts[0].unionByName(parts[1])
