"""Modelling operators: frame, folds, linear and tree heads, validation and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import clip, log10_floor1, log1p_pos, lookup, num
from ..operators.ordering import exact_quantile, time_folds
from ..session import written

# --- fixed values: model settings -------------------------------------------
MIN_COVERAGE = 0.5
MIN_ROWS = 60
MIN_EDGE = 0.03
RIDGE_LAMBDA = 1.0
LOO_LAMBDA = 0.5
SEED = 42
TREES = dict(maxIter=120, maxDepth=2, stepSize=0.03, subsamplingRate=0.7, minInstancesPerNode=20, seed=SEED)


def coverage_gate(reports: DataFrame, coverage: str = "coverage", minimum: float = MIN_COVERAGE) -> DataFrame:
    """Drops reports read too poorly; an unknown coverage passes."""
    return reports.filter(F.col(coverage).isNull() | (F.col(coverage) >= minimum))


def model_frame(wide: DataFrame, reports: DataFrame, sectors: DataFrame) -> DataFrame:
    """Modelling columns of the wide dataset; undated rows and trusts are left out.

    wide: cg_ipo_id, list_dt, QIB, bNII, sNII, NII, Retail, Total Sub, Offer Price, GMP,
    Listing Gain, Issue Size (cr), Fresh (cr), OFS (cr), index_chg and the targets.
    """
    col = lambda c: num(F.col(f"`{c}`"))
    fresh, ofs = F.coalesce(col("Fresh (cr)"), F.lit(0.0)), F.coalesce(col("OFS (cr)"), F.lit(0.0))
    size = col("Issue Size (cr)")
    joined = wide.join(coverage_gate(reports).drop("coverage"), "cg_ipo_id", "left") \
        .join(sectors.select("cg_ipo_id", "sector", "is_financial", "is_realestate", "instrument"), "cg_ipo_id", "left") \
        .filter((F.coalesce("instrument", F.lit("equity")) == "equity") & F.col("list_dt").isNotNull())
    logs = {f"log_{n}": log1p_pos(col(c)) for n, c in (
        ("QIB", "QIB"), ("bNII", "bNII"), ("sNII", "sNII"), ("NII", "NII"), ("Retail", "Retail"), ("Total", "Total Sub"))}
    prem = clip(col("GMP") / F.nullif(col("Offer Price"), F.lit(0.0)) * 100, -30.0, 150.0)
    targets = {t: clip(F.col(t).cast("double"), -95.0, 400.0)
               for t in ("ret_6m", "ret_12m", "ret_24m", "bottom_12m_pct", "peak_24m_pct") if t in wide.columns}
    return joined.withColumns({
        **logs, "gmp_prem": prem, "has_gmp": prem.isNotNull().cast("double"),
        "listing_gain_day1": clip(col("Listing Gain"), -80.0, 400.0),
        "issue_size_log": log10_floor1(size), "smallcap": F.coalesce((size < 1000).cast("double"), F.lit(0.0)),
        "ofs_share": clip(ofs / F.nullif(fresh + ofs, F.lit(0.0)), 0.0, 1.0),
        "has_rhp": F.col("rhp_overall").isNotNull().cast("double"),
        "sector": F.coalesce("sector", F.lit("Other")),
        "is_financial": F.coalesce(F.col("is_financial").cast("double"), F.lit(0.0)),
        "is_realestate": F.coalesce(F.col("is_realestate").cast("double"), F.lit(0.0)), **targets})


# ------------------------------------------------------------------ preparation

def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, m): the exact medians of many columns in one pass; a column of nulls has no row."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    return exact_quantile(long.select("x.*"), ["name"], "v", 0.5, "m")


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact column medians as a one-row summary, for artifacts."""
    found = {r.name: float(r.m) for r in column_medians(df, cols).collect()}
    return {c: found.get(c, 0.0) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str], train: Column | None = None) -> DataFrame:
    """Missing inputs take the column's exact median (of the training rows), then zero."""
    base = df.filter(train) if train is not None else df
    found = column_medians(base, cols).agg(F.map_from_entries(F.collect_list(F.struct("name", "m")))).scalar()
    filled = df.withColumn("__m", found)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at("__m", F.lit(c)), F.lit(0.0)) for c in cols}).drop("__m")


def one_hot(df: DataFrame, col: str, vocabulary: Sequence[str], prefix: str = "sec_") -> DataFrame:
    """Indicator columns of a fixed vocabulary; 'Other' has none."""
    return df.withColumns({f"{prefix}{v}": (F.col(col) == v).cast("double") for v in vocabulary if v != "Other"})


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.col(col) != "Other")).select(col).distinct().orderBy(col)


def standardise(df: DataFrame, cols: Sequence[str], train: Column | None = None) -> DataFrame:
    """z-scores with the population deviation of the training rows; a constant column divides by 1."""
    base = df.filter(train) if train is not None else df
    stats = base.agg(F.struct(*[F.struct(
        F.avg(c).alias("m"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s")).alias(c)
        for c in cols]).alias("st")).scalar()
    out = df.withColumn("__st", stats)
    return out.withColumns({c: (F.col(c) - F.col(f"__st.{c}.m")) / F.col(f"__st.{c}.s") for c in cols}).drop("__st")


# ------------------------------------------------------------------ linear heads

def gram(df: DataFrame, cols: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """XᵀX (upper triangle, with the intercept) and Xᵀy as one aggregate row, or one for each group of ``by``."""
    names = ["one", *cols]
    val = lambda c: F.lit(1.0) if c == "one" else F.col(c)
    sums = [F.sum(val(a) * val(b)).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums,
                  *[F.sum(val(c) * F.col(y)).alias(f"{c}__y") for c in names])


def solve_ridge(row: Mapping[str, float], cols: Sequence[str], lam: float = RIDGE_LAMBDA
                ) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (intercept first, unpenalised) and the inverse of the k×k normal matrix."""
    names = ["one", *cols]
    k = len(names)
    a = np.zeros((k, k))
    for i, p in enumerate(names):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"{p}__{names[j]}"]
    a += lam * np.diag([0.0] + [1.0] * (k - 1))
    b = np.array([row[f"{c}__y"] for c in names])
    inverse = np.linalg.pinv(a)
    return inverse @ b, inverse


def predict_linear(cols: Sequence[str], w: Sequence[float]) -> Column:
    out = F.lit(float(w[0]))
    for c, v in zip(cols, w[1:]):
        out = out + F.col(c) * float(v)
    return out


def unstandardise(w: Sequence[float], mean: Sequence[float], sd: Sequence[float]) -> tuple[list[float], float]:
    """Coefficients and intercept on the original scale, so serving needs no scaler."""
    coef = [float(c / s) for c, s in zip(w[1:], sd)]
    return coef, float(w[0] - sum(c * m for c, m in zip(coef, mean)))


def ridge_loo(df: DataFrame, cols: Sequence[str], y: str, lam: float = LOO_LAMBDA) -> DataFrame:
    """Leave-one-out predictions of a ridge from one Gram matrix (hat-matrix shortcut)."""
    w, inverse = solve_ridge(gram(df, cols, y).first().asDict(), cols, lam)
    x = [F.lit(1.0), *[F.col(c) for c in cols]]
    h = F.lit(0.0)
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            h = h + a * b * float(inverse[i, j])
    fit = predict_linear(cols, w)
    return df.withColumn("loo_pred", F.col(y) - (F.col(y) - fit) / (1 - h))


def fit_direction(df: DataFrame, cols: Sequence[str], label: str, c: float = 1.0):
    """Logistic head with penalty 1/(C·n) on standardised columns."""
    packed = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    n = packed.count()
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(n, 1)),
                              elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-6).fit(packed)


def fit_trees(df: DataFrame, cols: Sequence[str], y: str, classify: bool = False, **settings):
    """Small gradient-boosted head of the horizon models."""
    packed = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    kind = GBTClassifier if classify else GBTRegressor
    return kind(featuresCol="features", labelCol=y, **{**TREES, **settings}).fit(packed)


def importances(model, cols: Sequence[str], k: int = 12) -> list[tuple[str, float]]:
    return sorted(zip(cols, model.featureImportances.toArray().tolist()), key=lambda p: -p[1])[:k]


# ------------------------------------------------------------------ validation

def forward_chain(df: DataFrame, fold: str, fit_predict, splits: int = 5) -> DataFrame:
    """Predictions of every scored row, each fold trained on the rows before its block.

    Five distributed fits; ``fit_predict(train, test)`` returns the test with ``pred``.
    """
    parts = [fit_predict(df.filter(F.col(fold) < k), df.filter(F.col(fold) == k)) for k in range(1, splits + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


Learned = Mapping[int, Mapping[str, float]]


def prepared(df: DataFrame, cols: Sequence[str], k: Column, medians: Learned, means: Learned, sds: Learned) -> DataFrame:
    """Imputed and standardised inputs, by the numbers that split ``k`` learned of each column."""
    per = lambda learned, c: lookup(k, {i: of[c] for i, of in learned.items()})
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), per(medians, c)) for c in cols})
    return filled.withColumns({c: (F.col(c) - per(means, c)) / per(sds, c) for c in cols})


def learn_splits(past: DataFrame, cols: Sequence[str]) -> tuple[Learned, Learned, Learned]:
    """Exact medians, means and population deviations of the rows of each split of ``past(k, ...)``.

    A column without values has the median 0, a constant one the deviation 1. All splits are
    learned in the same passes; a few numbers a split reach the driver.
    """
    splits = [r.k for r in past.select("k").distinct().collect()]
    medians = {k: dict.fromkeys(cols, 0.0) for k in splits}
    long = past.select("k", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    for r in exact_quantile(long.select("k", "x.*"), ["k", "name"], "v", 0.5, "m").collect():
        medians[r.k][r["name"]] = float(r.m)
    whole = past.withColumns({c: F.coalesce(F.col(c).cast("double"), lookup(F.col("k"), {i: of[c] for i, of in medians.items()})) for c in cols})
    found = whole.groupBy("k").agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).collect()
    return medians, {r.k: {c: r[c].m for c in cols} for r in found}, {r.k: {c: r[c].s or 1.0 for c in cols} for r in found}


def fit_signals(df: DataFrame, cols: Sequence[str], y: str, day: str, row_id: str,
                lam: float = RIDGE_LAMBDA, splits: int = 5) -> DataFrame:
    """Validates the two pre-listing heads forward in time and says which may ship.

    Magnitude is a ridge, direction a logistic head; each fold learns its medians,
    scaling and weights from earlier rows only. One row per head with error (or
    accuracy), baseline, edge and the skill verdict.

    The rows are written once, then once more in a folder a fold. The statistics and
    normal matrices of all splits are aggregated together; only the logistic heads are
    fitted one by one.
    """
    rows = written(df.filter(F.col(y).isNotNull() & F.col(day).isNotNull()).select(*dict.fromkeys([day, row_id, *cols, y])))
    dated = time_folds(rows, day, row_id, splits=splits)
    folded = written(dated.select("fold", *cols, y, (F.col(y) > 0).cast("int").alias("up")), "fold")
    past = folded.filter(F.col("fold") < splits).withColumn("k", F.explode(F.sequence(F.col("fold") + 1, F.lit(splits))))
    learned = learn_splits(past, cols)
    grams = {r.k: r.asDict() for r in gram(prepared(past, cols, F.col("k"), *learned), cols, y, ["k"]).collect()}
    sizes, calls = [], []
    for k in range(1, splits + 1):
        train, test = (prepared(folded.filter(part), cols, F.lit(k), *learned) for part in (F.col("fold") < k, F.col("fold") == k))
        w, _ = solve_ridge(grams[k], cols, lam)
        sizes.append(test.select("fold", y, predict_linear(cols, w).alias("pred")))
        head = fit_direction(train, cols, "up")
        packed = VectorAssembler(inputCols=list(cols), outputCol="features").transform(test)
        calls.append(head.transform(packed).select("fold", "up", F.col("prediction").alias("pred")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    magnitude = cv_metrics(fold_errors(union(sizes), fold_baselines(folded, "fold", y), "fold", y, "pred"))
    right = union(calls).groupBy("fold").agg(F.avg((F.col("pred") == F.col("up")).cast("double")).alias("mae"))
    bars = majority_baseline(folded, "fold", "up").withColumnRenamed("baseline_acc", "base_mae")
    direction = cv_metrics(right.join(bars, "fold"), higher_is_better=True)
    heads = magnitude.withColumn("head", F.lit("magnitude")).unionByName(direction.withColumn("head", F.lit("direction")))
    return skill_gate(heads)


def hash_fold(row_id: Column, k: int = 5) -> Column:
    """Deterministic shuffled fold of the older trainer."""
    return F.pmod(F.xxhash64(row_id), F.lit(k)).cast("int")


def fold_baselines(df: DataFrame, fold: str, y: str, splits: int = 5) -> DataFrame:
    """Mean of all rows before each scored block, from per-fold sums only."""
    per = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    packed = per.agg(F.collect_list(F.struct(F.col(fold).alias("f"), "s", "n")).alias("a")).scalar()
    grid = per.filter(F.col(fold) > 0).select(fold).withColumn("a", packed)
    before = F.filter("a", lambda r: r["f"] < F.col(fold))
    s = F.aggregate(before, F.lit(0.0), lambda acc, r: acc + r["s"])
    n = F.aggregate(before, F.lit(0).cast("bigint"), lambda acc, r: acc + r["n"])
    return grid.select(fold, (s / F.nullif(n.cast("double"), F.lit(0.0))).alias("base"), n.alias("n_train"))


def fold_errors(pred: DataFrame, baselines: DataFrame, fold: str, y: str, p: str) -> DataFrame:
    """Error of the model and of the training mean per scored fold."""
    return pred.filter(F.col(fold) > 0).join(F.broadcast(baselines), fold).groupBy(fold).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"),
        F.avg(F.abs(F.col("base") - F.col(y))).alias("base_mae"))


def cv_metrics(folds: DataFrame, n: str = "n", err: str = "mae", base: str = "base_mae",
               higher_is_better: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled error, baseline, edge with its standard error and folds won, per head."""
    edge = F.col(err) - F.col(base) if higher_is_better else F.col(base) - F.col(err)
    k = F.count("*").cast("double")
    return folds.withColumn("__d", edge).groupBy(*keys).agg(
        (F.sum(F.col(err) * F.col(n)) / F.sum(n)).alias("error"), F.avg(base).alias("baseline"),
        (F.stddev_samp(err) / F.sqrt(k)).alias("se"), F.avg("__d").alias("edge"),
        (F.stddev_samp("__d") / F.sqrt(k)).alias("edge_se"),
        F.count(F.when(F.col("__d") > 0, 1)).alias("folds_won"), F.count("*").alias("folds"))


def skill_gate(metrics: DataFrame, min_edge: float = MIN_EDGE) -> DataFrame:
    """A head ships if its edge beats its noise, most folds and 3 % of the baseline."""
    ok = (F.col("edge") > F.col("edge_se")) & (F.col("folds_won") * 2 > F.col("folds")) \
        & (F.col("edge") > min_edge * F.col("baseline"))
    return metrics.withColumn("skill", F.coalesce(ok, F.lit(False)))


def majority_baseline(df: DataFrame, fold: str, label: str) -> DataFrame:
    """Accuracy of the training majority per scored block, never below a coin flip."""
    rates = fold_baselines(df.withColumn("__y", F.col(label).cast("double")), fold, "__y")
    joined = df.filter(F.col(fold) > 0).join(F.broadcast(rates), fold)
    right = F.avg((F.col(label).cast("int") == (F.col("base") > 0.5).cast("int")).cast("double"))
    return joined.groupBy(fold).agg(F.count("*").alias("n"), F.greatest(right, F.lit(0.5)).alias("baseline_acc"))


def direction_accuracy(pred: Column, actual: Column) -> Column:
    return F.avg(((pred > 0) == (actual > 0)).cast("double"))


def promote(candidate: DataFrame, history: DataFrame, schema_version: int) -> DataFrame:
    """Promotion gate: more skilful heads win, then the larger edge; other schemas do not count.

    candidate (heads, edge); history (at, schema, heads, edge), of which the last comparable
    entry is the incumbent.
    """
    last = history.filter(F.col("schema") == schema_version).agg(
        F.max(F.struct("at", "heads", "edge")).alias("inc")).select("inc").scalar()
    c = candidate.withColumn("inc", last)
    better = F.col("inc").isNull() | (F.col("heads") > F.col("inc.heads")) \
        | ((F.col("heads") == F.col("inc.heads")) & (F.col("edge") > F.col("inc.edge")))
    return c.select("heads", "edge", F.col("inc.heads").alias("incumbent_heads"),
                    F.col("inc.edge").alias("incumbent_edge"), better.alias("promoted"))


def scoreboard(calls: DataFrame, horizons: Sequence[str], says: str = "rule_says",
               yes: str = "BUY-CANDIDATE", no: str = "no", min_hits: int = 5) -> DataFrame:
    """Rule against the rest per horizon: counts, exact medians, edge and win rates."""
    long = calls.select(says, F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(h).cast("double").alias("ret")) for h in horizons])).alias("x")) \
        .select(F.when(F.col(says) == yes, "rule").when(F.col(says) == no, "rest").alias("side"), "x.*") \
        .filter(F.col("ret").isNotNull() & F.col("side").isNotNull())
    mids = exact_quantile(long, ["horizon", "side"], "ret", 0.5, "med")
    stats = long.groupBy("horizon", "side").agg(
        F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win")).join(mids, ["horizon", "side"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    out = stats.groupBy("horizon").agg(
        F.coalesce(side("rule", "n"), F.lit(0)).alias("n_rule"), F.coalesce(side("rest", "n"), F.lit(0)).alias("n_rest"),
        side("rule", "med").alias("rule_median"), side("rest", "med").alias("rest_median"),
        side("rule", "win").alias("rule_win_rate"), side("rest", "win").alias("rest_win_rate"))
    return out.filter(F.col("n_rule") >= min_hits).withColumn("edge_pp", F.col("rule_median") - F.col("rest_median"))


SECTORS = tuple(sorted({s for s, _ in vocab.NAME_SECTORS}))
