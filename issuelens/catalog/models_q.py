"""Modelling operators and the micro-batch jobs over the driver's tables."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import log1p_pos
from ..operators.ordering import time_folds
from ..plans import forecast, models
from ..plans.horizon import Horizons, horizon_reads, load_heads, train_horizons
from ..session import materialise, shared_dir
from ..plans.signals import serve_signals
from ..streaming.streams import ledger_stream, read_version, signal_upsert
from .aggs_q import _CV, _cv
from .base import SUBSCRIPTION, day, query, subscription, table

_INPUTS = ["qib", "retail", "nii"]


def _frame(spark, sf):
    """One modelling row per order: subscription inputs and the listing gain."""
    s = subscription(spark, sf)
    gain = (F.col("net") / F.nullif("o_totalprice", F.lit(0.0)) - 1) * 100
    return s.withColumn("gain", gain).withColumn("up", (F.col("gain") > 0).cast("int"))


_FRAME = f"""{SUBSCRIPTION}, frame AS (SELECT *, (net / o_totalprice - 1) * 100 AS gain FROM subscription)"""


@query("model_frame", f"""
WITH {SUBSCRIPTION} SELECT CAST(o_orderkey AS VARCHAR) AS cg_ipo_id, round(ln(1 + qib), 8) AS log_qib, round(ln(1 + retail), 8) AS log_retail,
  round(CASE WHEN nii IS NOT NULL THEN least(nii / o_totalprice * 100000, 150) END, 6) AS gmp_prem, CASE WHEN nii IS NULL THEN 0.0 ELSE 1.0 END AS has_gmp,
  round(CASE WHEN net IS NOT NULL THEN least(greatest((net / o_totalprice - 1) * 100, -80), 400) END, 6) AS gain, round(log10(greatest(o_totalprice / 100, 1)), 8) AS issue_size_log,
  CASE WHEN o_totalprice / 100 < 1000 THEN 1.0 ELSE 0.0 END AS smallcap, round(coalesce(nii, 0) / nullif(coalesce(qib, 0) + coalesce(nii, 0), 0), 8) AS ofs_share,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS is_realestate, CASE WHEN net / o_totalprice IS NULL OR net / o_totalprice >= 0.5 THEN 1.0 ELSE 0.0 END AS has_rhp
FROM subscription JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'AUTOMOBILE'""")
def model_frame(spark, sf):
    s = subscription(spark, sf).withColumn("cg_ipo_id", F.col("o_orderkey").cast("string"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    wide = s.select(
        "cg_ipo_id", F.col("opened").alias("list_dt"), F.col("qib").alias("QIB"), F.lit(None).cast("double").alias("bNII"),
        F.lit(None).cast("double").alias("sNII"), F.col("nii").alias("NII"), F.col("retail").alias("Retail"),
        F.lit(None).cast("double").alias("Total Sub"), F.col("o_totalprice").alias("Offer Price"), (F.col("nii") * 1000).alias("GMP"),
        ((F.col("net") / F.nullif("o_totalprice", F.lit(0.0)) - 1) * 100).alias("Listing Gain"), (F.col("o_totalprice") / 100).alias("Issue Size (cr)"),
        F.col("qib").alias("Fresh (cr)"), F.col("nii").alias("OFS (cr)"))
    reports = s.select("cg_ipo_id", (F.col("net") / F.nullif("o_totalprice", F.lit(0.0))).alias("coverage"), F.lit(60.0).alias("rhp_overall"))
    seg = F.col("c_mktsegment")
    sectors = s.join(c, "o_custkey").select(
        "cg_ipo_id", seg.alias("sector"), F.lit(0).alias("is_financial"), (seg == "BUILDING").cast("int").alias("is_realestate"),
        F.when(seg == "AUTOMOBILE", "reit").otherwise("equity").alias("instrument"))
    m = models.model_frame(wide, reports, sectors)
    return m.select("cg_ipo_id", F.round("log_QIB", 8).alias("log_qib"), F.round("log_Retail", 8).alias("log_retail"), F.round("gmp_prem", 6).alias("gmp_prem"),
                    "has_gmp", F.round("listing_gain_day1", 6).alias("gain"), F.round("issue_size_log", 8).alias("issue_size_log"), "smallcap",
                    F.round("ofs_share", 8).alias("ofs_share"), "is_realestate", "has_rhp")


@query("impute_median", f"""
WITH {SUBSCRIPTION}, m AS (SELECT median(qib) AS q, median(retail) AS r FROM subscription)
SELECT o_orderkey, coalesce(qib, q, 0) AS qib, coalesce(retail, r, 0) AS retail FROM subscription, m""")
def impute_median(spark, sf):
    return models.impute_median(subscription(spark, sf), ["qib", "retail"]).select("o_orderkey", "qib", "retail")


@query("one_hot", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0.0 END AS sec_PROMO, CASE WHEN p_type = 'SMALL' THEN 1.0 ELSE 0.0 END AS sec_SMALL FROM part""")
def one_hot(spark, sf):
    return models.one_hot(table(spark, sf, "part"), "p_type", ["PROMO", "SMALL", "Other"]).select("p_partkey", "sec_PROMO", "sec_SMALL")


@query("standardise", """
WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_tax) AS b, stddev_pop(l_tax) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / s, 6) AS l_quantity, round((l_tax - b) / t, 6) AS l_tax FROM lineitem, m""")
def standardise(spark, sf):
    z = models.standardise(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    return z.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


@query("ridge_fit", f"""
WITH {_FRAME}, d AS (SELECT qib AS x, gain AS y FROM frame WHERE qib IS NOT NULL AND gain IS NOT NULL),
g AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) + 1 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM d)
SELECT round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) AS slope, round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 4) AS intercept FROM g""")
def ridge_fit(spark, sf):
    d = _frame(spark, sf).filter("qib IS NOT NULL AND gain IS NOT NULL")
    w, _ = models.solve_ridge(models.gram(d, ["qib"], "gain").first().asDict(), ["qib"])
    return d.agg(F.count("*").alias("n")).select(
        F.round(F.lit(float(w[1])), 6).alias("slope"), F.round(F.lit(float(w[0])), 4).alias("intercept"))


@query("ridge_loo", f"""
WITH {_FRAME}, d AS (SELECT o_orderkey, qib AS x, gain AS y FROM frame WHERE qib IS NOT NULL AND gain IS NOT NULL),
g AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) + 0.5 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM d),
l AS (SELECT o_orderkey, (sy - y) / (n - 1) AS my, (n - 1) AS m, sx - x AS ax, sxx - x * x AS axx, sy - y AS ay, sxy - x * y AS axy, x, y FROM d, g)
SELECT o_orderkey, round((ay - (m * axy - ax * ay) / (m * axx - ax * ax) * ax) / m + (m * axy - ax * ay) / (m * axx - ax * ax) * x, 3) AS loo_pred FROM l""")
def ridge_loo(spark, sf):
    d = _frame(spark, sf).filter("qib IS NOT NULL AND gain IS NOT NULL")
    return models.ridge_loo(d, ["qib"], "gain").select("o_orderkey", F.round("loo_pred", 3).alias("loo_pred"))


def _ready(spark, sf):
    """Complete, standardised inputs with labels."""
    f = _frame(spark, sf).filter(F.col("gain").isNotNull()).select("o_orderkey", "opened", *_INPUTS, "gain", "up")
    filled = models.impute_median(f, _INPUTS)
    scaled = models.standardise(filled.withColumns({c: log1p_pos(F.col(c)) for c in _INPUTS}), _INPUTS)
    return materialise(scaled)


def _packed(df):
    return VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(df)


@query("logit_fit")
def logit_fit(spark, sf):
    """Direction head fitted on all rows; accuracy against the majority."""
    ready = _ready(spark, sf)
    model = models.fit_direction(ready, _INPUTS, "up")
    scored = model.transform(_packed(ready))
    return scored.agg(F.round(F.avg((F.col("prediction") == F.col("up")).cast("double")), 3).alias("accuracy"),
                      F.round(F.greatest(F.avg("up"), 1 - F.avg("up")), 3).alias("majority"), F.count("*").alias("n"))


@query("logit_cv")
def logit_cv(spark, sf):
    """Forward-chained accuracy of the direction head per fold with its baseline."""
    folded = materialise(time_folds(_ready(spark, sf), "opened", "o_orderkey").select("o_orderkey", "fold", *_INPUTS, "up"))

    def fit(train, test):
        model = models.fit_direction(train, _INPUTS, "up")
        return model.transform(_packed(test)).select("fold", "up", F.col("prediction").alias("pred"))

    pred = models.forward_chain(folded, "fold", fit)
    acc = pred.groupBy("fold").agg(F.round(F.avg((F.col("pred") == F.col("up")).cast("double")), 3).alias("accuracy"))
    return acc.join(models.majority_baseline(folded, "fold", "up"), "fold").select(
        "fold", "accuracy", F.round("baseline_acc", 3).alias("baseline"), "n")


@query("signals_cv")
def signals_cv(spark, sf):
    """Both pre-listing heads, validated forward in time with training-only statistics."""
    f = _frame(spark, sf).withColumns({c: log1p_pos(F.col(c)) for c in _INPUTS})
    out = models.fit_signals(f, _INPUTS, "gain", "opened", "o_orderkey")
    return out.select("head", *[F.round(c, 3).alias(c) for c in ("error", "baseline", "edge")], "folds_won", "folds", "skill")


HORIZONS = Horizons(("qib", "retail", "nii"), ("ret_12m",), ("bottom_12m_pct",), "listing_gain_day1", "opened", "o_orderkey")


def _horizon_frame(spark, sf):
    """The gain as return, the gain of a neighbouring month as a bottom, half the gain as day-1 gain of even keys."""
    f = _frame(spark, sf)
    return f.select(
        "o_orderkey", "opened", *_INPUTS, F.col("gain").alias("ret_12m"),
        F.when(F.col("o_orderkey") % 3 != 0, -F.col("qib") * 2 - F.col("nii")).alias("bottom_12m_pct"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("gain") / 2).alias("listing_gain_day1"))


@lru_cache(maxsize=8)
def _trained_once(app, sf):
    spark = SparkSession.builder.getOrCreate()
    folder = f"{shared_dir(spark)}/horizons-{uuid.uuid4().hex}"
    trained = train_horizons(_horizon_frame(spark, sf), HORIZONS)
    trained.save(folder)
    return trained, folder


def _trained(spark, sf):
    """Heads of all 120 rounds, trained once a session and folder and saved in the shared folder."""
    return _trained_once(spark.sparkContext.applicationId, sf)


_HORIZON_FOLDS = f"""{_FRAME}, h AS (SELECT o_orderkey, opened, qib, retail, nii, gain AS ret_12m,
    CASE WHEN o_orderkey % 3 <> 0 THEN -qib * 2 - nii END AS bottom_12m_pct FROM frame),
long AS (SELECT 'ret_12m' AS target, opened, o_orderkey, ret_12m AS y FROM h WHERE ret_12m IS NOT NULL
  UNION ALL SELECT 'bottom_12m_pct', opened, o_orderkey, bottom_12m_pct FROM h WHERE bottom_12m_pct IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY opened, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY target) AS total FROM long),
st AS (SELECT *, greatest(floor(total * 0.4), 60) AS start FROM ix),
fo AS (SELECT target, total, y, (SELECT count(*) FROM range(5) r(k) WHERE i >= floor(start + k * (total - start) / 5)) AS fold FROM st),
me AS (SELECT f.target, f.fold, avg(p.y) AS m, avg((p.y > 0)::INT) AS u FROM (SELECT DISTINCT target, fold FROM fo WHERE fold > 0) f
  JOIN fo p ON p.target = f.target AND p.fold < f.fold GROUP BY 1, 2),
pf AS (SELECT target, fold, any_value(total) AS n, count(*) AS k, avg(abs(y - m)) AS size, greatest(avg((((y > 0)::INT = (u > 0.5)::INT))::INT), 0.5) AS direction
  FROM fo JOIN me USING (target, fold) GROUP BY 1, 2)"""


@query("horizon_training", f"""
WITH {_HORIZON_FOLDS}, heads AS (
  SELECT target, 'size' AS kind, any_value(n) AS n, sum(k)::BIGINT AS n_scored, count(*) AS folds, round(avg(size), 4) AS baseline FROM pf GROUP BY 1
  UNION ALL SELECT target, 'direction', any_value(n), sum(k)::BIGINT, count(*), round(avg(direction), 4) FROM pf WHERE target = 'ret_12m' GROUP BY 1)
SELECT variant, target, kind, n, n_scored, folds, baseline FROM heads, (SELECT unnest(['pre', 'post']) AS variant)""")
def horizon_training(spark, sf):
    """Every boosted head through forward chaining: rows, folds and the baseline it has to beat."""
    trained, _ = _trained(spark, sf)
    return trained.metrics.select("variant", "target", "kind", "n", "n_scored", "folds", F.round("baseline", 4).alias("baseline"))


@query("horizon_heads")
def horizon_heads(spark, sf):
    """Error, edge and verdict of every boosted head; tested against plain arithmetic on its folds."""
    trained, _ = _trained(spark, sf)
    return trained.metrics.select(
        "variant", "target", "kind", *[F.round(c, 4).alias(c) for c in ("error", "baseline", "edge", "edge_se")], "folds_won", "folds", "skill")


@query("horizon_importances")
def horizon_importances(spark, sf):
    """Up to twelve inputs of each shipped head with their weight, largest first."""
    trained, _ = _trained(spark, sf)
    return trained.importances(spark).withColumn("importance", F.round("importance", 4))


@query("gbt_fit")
def gbt_fit(spark, sf):
    """Small boosted regressor of the gain; error against the mean, top inputs."""
    ready = _ready(spark, sf)
    model = models.fit_trees(ready, _INPUTS, "gain")
    top = models.importances(model, _INPUTS, 12)
    mean = ready.agg(F.avg("gain")).scalar()
    err = model.transform(_packed(ready)).withColumn("mean", mean).agg(
        F.round(F.avg(F.abs(F.col("prediction") - F.col("gain"))), 2).alias("mae"),
        F.round(F.avg(F.abs(F.col("mean") - F.col("gain"))), 2).alias("baseline_mae"))
    return err.select("mae", "baseline_mae", F.lit(top[0][0]).alias("top_input"))


@query("gbt_classify")
def gbt_classify(spark, sf):
    """Small boosted direction head."""
    ready = _ready(spark, sf)
    model = models.fit_trees(ready, _INPUTS, "up", classify=True)
    return model.transform(_packed(ready)).groupBy("up").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("called_up"))


@query("shuffled_cv")
def shuffled_cv(spark, sf):
    """Hash-fold error of the linear head (the older trainer's validation)."""
    ready = _ready(spark, sf).withColumn("k", models.hash_fold(F.col("o_orderkey")))
    parts = []
    for k in range(5):
        row = models.gram(ready.filter(F.col("k") != k), _INPUTS, "gain").first().asDict()
        w, _ = models.solve_ridge(row, _INPUTS)
        parts.append(ready.filter(F.col("k") == k).select("k", F.abs(models.predict_linear(_INPUTS, w) - F.col("gain")).alias("e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("e"), 2).alias("mae"))


@query("skill_gate", f"""
WITH {_CV}, m AS (SELECT avg(base_mae) AS b, avg(base_mae - mae) AS e, stddev_samp(base_mae - mae) / sqrt(count(*)) AS s,
  count(*) FILTER (base_mae > mae) AS w, count(*) AS k FROM fe)
SELECT round(e, 6) AS edge, w AS folds_won, coalesce(e > s AND w * 2 > k AND e > 0.03 * b, false) AS skill FROM m""")
def skill_gate(spark, sf):
    m = models.skill_gate(models.cv_metrics(_cv(spark, sf)))
    return m.select(F.round("edge", 6).alias("edge"), "folds_won", "skill")


@query("majority_baseline", f"""
WITH {SUBSCRIPTION}, e AS (SELECT (o_orderkey * 7 % 6)::INT AS fold, (net > o_totalprice)::INT AS up FROM subscription WHERE net IS NOT NULL),
b AS (SELECT k.fold, (SELECT avg(up) FROM e WHERE e.fold < k.fold) AS base FROM (SELECT DISTINCT fold FROM e WHERE fold > 0) k)
SELECT e.fold, count(*) AS n, round(greatest(avg((up = (base > 0.5)::INT)::INT), 0.5), 6) AS baseline_acc FROM e JOIN b USING (fold) GROUP BY 1""")
def majority_baseline(spark, sf):
    s = subscription(spark, sf).filter(F.col("net").isNotNull())
    e = s.select((F.col("o_orderkey") * 7 % 6).cast("int").alias("fold"), (F.col("net") > F.col("o_totalprice")).cast("int").alias("up"))
    return models.majority_baseline(e, "fold", "up").withColumn("baseline_acc", F.round("baseline_acc", 6))


@query("promotion", """
WITH h AS (SELECT CAST(o_orderdate AS DATE) AS made, 1 + count(*) % 3 AS heads, round(avg(o_totalprice), 2) AS edge, year(o_orderdate) % 2 AS schema FROM orders GROUP BY o_orderdate),
inc AS (SELECT max((made, heads, edge)) AS i FROM h WHERE schema = 1), c AS (SELECT 2 AS heads, round(max(o_totalprice), 2) AS edge FROM orders)
SELECT c.heads, c.edge, i[2] AS incumbent_heads, i[3] AS incumbent_edge, i IS NULL OR c.heads > i[2] OR (c.heads = i[2] AND c.edge > i[3]) AS promoted FROM c, inc""")
def promotion(spark, sf):
    o = table(spark, sf, "orders")
    hist = o.groupBy(F.to_date("o_orderdate").alias("at")).agg(
        (1 + F.count("*") % 3).alias("heads"), F.round(F.avg("o_totalprice"), 2).alias("edge")) \
        .withColumn("schema", F.year("at") % 2)
    cand = o.agg(F.lit(2).alias("heads"), F.round(F.max("o_totalprice"), 2).alias("edge"))
    return models.promote(cand, hist, 1)


_COEF = {"qib": 0.02, "retail": -0.01, "nii": 0.005}
_MED = {"qib": 30.0, "retail": 25.0, "nii": 28.0}


@query("linear_score", f"""
WITH {SUBSCRIPTION}, s AS (SELECT o_orderkey, -0.3 + 0.02 * coalesce(qib, 30) - 0.01 * coalesce(retail, 25) + 0.005 * coalesce(nii, 28) AS z FROM subscription)
SELECT o_orderkey, round(z, 6) AS score, round(1 / (1 + exp(-least(greatest(z, -30), 30))), 6) AS p FROM s""")
def linear_score(spark, sf):
    s = subscription(spark, sf)
    from ..functions.scalars import sigmoid

    z = forecast.score_linear(s, _COEF, -0.3, _MED)
    return s.select("o_orderkey", F.round(z, 6).alias("score"), F.round(sigmoid(z), 6).alias("p"))


@query("signal_serving", f"""
WITH {_FRAME}, x AS (SELECT o_orderkey, ln(1 + qib) AS q, ln(1 + retail) AS r, ln(1 + nii) AS n, gain, (gain > 0)::INT::DOUBLE AS up FROM frame),
f AS (SELECT corr(q, up) AS cq, corr(r, up) AS cr, median(q) AS mq, median(r) AS mr, median(n) AS mn, avg(up) AS u, count(gain) AS rows FROM x)
SELECT o_orderkey, list_filter(['log_NII', 'log_QIB', 'log_Retail'], lambda k: CASE k WHEN 'log_NII' THEN n IS NOT NULL WHEN 'log_QIB' THEN q IS NOT NULL ELSE r IS NOT NULL END) AS inputs_used,
  round(1 / (1 + exp(-least(greatest(u + cq * coalesce(q, mq) + cr * coalesce(r, mr) - 0.05 * coalesce(n, mn), -30), 30))), 2) AS p_lists_above_offer,
  CAST(NULL AS DOUBLE) AS forecast_gain_pct, round(u, 2) AS direction_cv, round(greatest(u, 1 - u), 2) AS direction_baseline,
  CAST(NULL AS DOUBLE) AS magnitude_cv, CAST(NULL AS DOUBLE) AS magnitude_baseline FROM x, f""")
def signal_serving(spark, sf):
    """Direction served from coefficients learnt as correlations; the magnitude head did not ship, so no number."""
    f = _frame(spark, sf)
    inputs = {"log_QIB": log1p_pos(F.col("qib")), "log_Retail": log1p_pos(F.col("retail")), "log_NII": log1p_pos(F.col("nii"))}
    x = f.select("o_orderkey", *[c.alias(k) for k, c in inputs.items()], F.col("up").cast("double").alias("up"))
    learnt = x.agg(F.corr("log_QIB", "up").alias("log_QIB"), F.corr("log_Retail", "up").alias("log_Retail"),
                   F.lit(-0.05).alias("log_NII"), F.avg("up").alias("intercept"), F.count("up").alias("n"))
    names = ["log_QIB", "log_Retail", "log_NII", "intercept"]
    coefs = learnt.select(F.lit("direction").alias("head"), F.explode(F.create_map(*[v for k in names for v in (F.lit(k), F.col(k))])).alias("feature", "coef"))
    verdicts = learnt.select(F.lit("direction").alias("head"), "n", F.col("intercept").alias("cv"),
                             F.greatest("intercept", 1 - F.col("intercept")).alias("baseline"))
    return serve_signals(x, "o_orderkey", {k: F.col(k) for k in inputs}, coefs, models.column_medians(x, list(inputs)), verdicts)


@query("horizon_score")
def horizon_score(spark, sf):
    """Saved heads read back: post-listing rows know the day-1 gain, heads without skill stay silent."""
    _, folder = _trained(spark, sf)
    heads, medians = load_heads(spark, folder)
    told = horizon_reads(_horizon_frame(spark, sf).drop("ret_12m", "bottom_12m_pct"), heads, medians, HORIZONS)
    return told.select("o_orderkey", "variant", *[F.round(c, 4).alias(c) for c in ("ret_12m", "p_ret_12m", "bottom_12m_pct")])


@query("exit_call", f"""
WITH {SUBSCRIPTION}, r AS (SELECT o_orderkey, qib - 20 AS a, retail - 30 AS b, nii - 40 AS c FROM subscription),
g AS (SELECT *, greatest(a, b, c) AS m FROM r)
SELECT o_orderkey, CASE WHEN m <= 0 THEN 'avoid' WHEN m IS NOT NULL THEN 'hold to ~' || CASE WHEN a = m THEN '6m' WHEN b = m THEN '12m' ELSE '24m' END END AS exit_call,
  CASE WHEN m > 0 THEN m END AS expected_ret_pct FROM g""")
def exit_call(spark, sf):
    s = subscription(spark, sf)
    return s.select("o_orderkey", *forecast.exit_call(F.col("qib") - 20, F.col("retail") - 30, F.col("nii") - 40))


@query("carry_baseline", f"""
WITH {SUBSCRIPTION}, c AS (SELECT o_orderpriority, coalesce((qib - 25) * 2, 0) AS carry, (net / o_totalprice - 1) * 100 AS y FROM subscription WHERE net IS NOT NULL)
SELECT o_orderpriority, count(*) AS n, round(avg(abs(carry - y)), 6) AS carry_mae, round(avg(((carry > 0) = (y > 0))::INT), 6) AS carry_direction FROM c GROUP BY 1""")
def carry_baseline(spark, sf):
    s = subscription(spark, sf).filter(F.col("net").isNotNull())
    carry, y = F.coalesce((F.col("qib") - 25) * 2, F.lit(0.0)), (F.col("net") / F.nullif("o_totalprice", F.lit(0.0)) - 1) * 100
    c = s.select("o_orderpriority", carry.alias("carry"), y.alias("y"))
    return c.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("carry") - F.col("y"))), 6).alias("carry_mae"),
        F.round(models.direction_accuracy(F.col("carry"), F.col("y")), 6).alias("carry_direction"))


# ------------------------------------------------------------------ micro-batches

BATCHES = 3


def _replay(spark, sf, name, order, start):
    """Feeds a table to a stream in BATCHES runs, by ``order``; ``start`` begins one run."""
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    rows = table(spark, sf, name)
    place = F.unix_micros(F.col(order).cast("timestamp")) if name == "orders" else F.col(order)
    edges = rows.select(F.percentile_approx(place, [i / BATCHES for i in range(1, BATCHES)], 10_000)).first()[0]
    batch = sum(((place > e).cast("int") for e in edges), F.lit(0))
    for i in range(BATCHES):
        rows.filter(F.coalesce(batch, F.lit(0)) == i).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def _folders(spark):
    base = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


@query("signal_stream", """
SELECT user_id AS analysis_id, arg_max(value, (ts, event_id)) AS gmp FROM events GROUP BY 1""")
def signal_stream(spark, sf):
    """Events replayed in three batches as a stream of live signals; the newest per user remains."""
    target, checkpoint = _folders(spark)
    columns = [F.col("user_id").alias("analysis_id"), F.col("value").alias("gmp"), "ts", "event_id"]
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    _replay(spark, sf, "events", "event_id", lambda s: signal_upsert(s.select(*columns), target, checkpoint, ["analysis_id"], newest))
    return read_version(spark, target).select("analysis_id", "gmp")


@query("ledger_stream", """
WITH e AS (SELECT quantile_disc(o_orderdate, [1/3, 2/3]) AS q FROM orders),
b AS (SELECT o.*, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS ret, (o_orderdate > q[1])::INT + (o_orderdate > q[2])::INT AS batch FROM orders o, e),
m AS (SELECT o_custkey, batch, max(ret) AS ret FROM b GROUP BY 1, 2)
SELECT o_custkey AS id, strftime(min(o_orderdate), '%Y-%m-%d') AS opened, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS rule_says,
  (SELECT arg_min(ret, batch) FROM m WHERE m.o_custkey = b.o_custkey AND ret IS NOT NULL) AS ret FROM b GROUP BY 1""")
def ledger_stream_q(spark, sf):
    """Orders replayed in three batches, oldest first, as closing issues; the first call per customer is kept."""
    target, checkpoint = _folders(spark)
    columns = [F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("opened"), "o_orderkey", F.col("o_orderpriority").alias("rule_says"),
               F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("ret")]
    oldest = [F.col("opened"), F.col("o_orderkey")]
    _replay(spark, sf, "orders", "o_orderdate", lambda s: ledger_stream(
        s.select(*columns), target, checkpoint, "id", ["opened", "o_orderkey", "rule_says"], ["ret"], oldest))
    return read_version(spark, target).select("id", day("opened").alias("opened"), "rule_says", "ret")
