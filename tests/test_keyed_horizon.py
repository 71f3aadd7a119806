import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from issuelens.plans import boosting, horizon
from issuelens.plans.horizon import Horizons, horizon_reads, load_heads, train_horizons
from issuelens.session import materialise
from issuelens.sources.keyed import KeyedTable, newest


def files(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("part-*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def store(tmp_path):
    return KeyedTable(str(tmp_path / "t"), ("id",), 16)


def frame(spark, *values):
    return spark.createDataFrame(list(values), "id long, at int, v string")


def test_a_batch_rewrites_its_buckets_only(spark, store):
    latest = newest([F.col("at").desc()], ["id"])
    assert store.read(spark) is None
    store.merge(frame(spark, *[(i, 0, f"a{i}") for i in range(200)]), 0, latest)
    first = files(store.path)
    touched = store.merge(frame(spark, (3, 1, "b"), (3, 2, "c"), (500, 1, "new"), (7, -1, "late")), 1, latest)
    now = files(store.path)
    assert 1 <= len(touched) <= 3
    assert all(now[f] == first[f] for f in first)
    fresh = set(now) - set(first)
    assert {int(Path(f).parent.name.split("=")[1]) for f in fresh} == touched
    want = {i: (i, 0, f"a{i}") for i in range(200)} | {3: (3, 2, "c"), 500: (500, 1, "new")}
    assert rows(store.read(spark)) == sorted(want.values())
    assert rows(store.read(spark, 0)) == sorted((i, 0, f"a{i}") for i in range(200))


def test_replays_change_nothing_and_old_versions_go(spark, store):
    latest = newest([F.col("at").desc()], ["id"])
    for batch in range(5):
        store.merge(frame(spark, (1, batch, f"v{batch}"), (2 + batch, 0, "x")), batch, latest)
    before, state = files(store.path), rows(store.read(spark))
    assert store.merge(frame(spark, (1, 99, "again")), 4, latest) == set() == store.merge(frame(spark, (1, 99, "again")), 0, latest)
    assert files(store.path) == before and rows(store.read(spark)) == state
    assert store.batches(spark) == [3, 4]
    wrote = {m: store.manifest(spark, m)["buckets"] for m in (3, 4)}
    live = {(b, w) for m in wrote.values() for b, w in m.items()}
    assert {(Path(f).parent.name.split("=")[1], int(Path(f).parent.parent.name)) for f in before} == live


def test_a_batch_without_a_manifest_is_not_there(spark, store):
    latest = newest([F.col("at").desc()], ["id"])
    store.merge(frame(spark, (1, 0, "a")), 0, latest)

    def broken(old, fresh):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.merge(frame(spark, (1, 1, "b")), 1, broken)
    os.makedirs(f"{store.path}/data/{1:012d}/__bucket=0")
    assert rows(store.read(spark)) == [(1, 0, "a")]
    store.merge(frame(spark, (1, 1, "b")), 1, latest)
    assert rows(store.read(spark)) == [(1, 1, "b")]


def test_null_keys_empty_batches_and_removed_rows(spark, store):
    latest = newest([F.col("at").desc()], ["id"])
    store.merge(frame(spark, (None, 0, "n"), (None, 1, "m"), (4, 0, "a")), 0, latest)
    assert sorted(store.read(spark).collect(), key=str) == sorted([(4, 0, "a"), (None, 1, "m")], key=str)
    assert store.merge(spark.createDataFrame([], "id long, at int, v string"), 1, latest) == set()
    store.merge(frame(spark, (4, 1, "gone")), 2, lambda old, fresh: old.join(fresh, "id", "left_anti"))
    assert [r.id for r in store.read(spark).collect()] == [None]


SPEC = Horizons(("a", "b"), ("ret_6m",), ("bottom_12m_pct",), "day1", "opened", "id")


@pytest.fixture(scope="module")
def issues(spark):
    draw = np.random.default_rng(8)
    a, noise, gain = draw.standard_normal(400), draw.standard_normal(400), draw.standard_normal(400) * 20
    data = [(i, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}", float(a[i]) if i % 9 else None, float(draw.standard_normal()),
             float(gain[i]) if i % 4 else None, float(30 * a[i] + noise[i]), float(noise[i])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, opened string, a double, b double, day1 double, ret_6m double, bottom_12m_pct double")
    return df.withColumn("opened", F.to_date("opened"))


@pytest.fixture(scope="module")
def trained(issues):
    return train_horizons(issues, SPEC, maxIter=12)


def test_heads_with_signal_ship_and_noise_does_not(spark, trained):
    verdict = {(r.variant, r.target, r.kind): r for r in trained.metrics.collect()}
    assert set(verdict) == set(SPEC.heads())
    assert all(r.n == 400 and r.n_scored == 240 and r.folds == 5 for r in verdict.values())
    assert verdict["pre", "ret_6m", "size"].skill and verdict["pre", "ret_6m", "direction"].skill
    assert not verdict["pre", "bottom_12m_pct", "size"].skill
    assert set(trained.models) == {h for h, r in verdict.items() if r.skill}
    top = {(r.variant, r.target, r.kind): r.input for r in trained.importances(spark).filter("rank = 1").collect()}
    assert top["pre", "ret_6m", "size"] == "a"
    total = trained.importances(spark).groupBy("variant", "target", "kind").agg(F.sum("importance").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in total)


def test_pooled_error_is_that_of_the_folds(issues, trained):
    ordered = issues.orderBy("opened", "id").collect()
    y = np.array([r.ret_6m for r in ordered])
    edges = [int(160 + k * 240 / 5) for k in range(6)]
    means = [np.abs(y[lo:hi] - y[:lo].mean()).mean() for lo, hi in zip(edges, edges[1:], strict=False)]
    got = {(r.variant, r.target, r.kind): r.baseline for r in trained.metrics.collect()}
    assert abs(got["pre", "ret_6m", "size"] - np.mean(means)) < 1e-9


def test_saved_heads_serve_what_they_know(spark, issues, trained, tmp_path):
    trained.save(str(tmp_path / "heads"))
    heads, medians = load_heads(spark, str(tmp_path / "heads"))
    assert set(heads) == set(trained.models)
    told = horizon_reads(issues.drop("ret_6m", "bottom_12m_pct"), heads, medians, SPEC)
    got = {r.id: r for r in told.collect()}
    assert len(got) == 400 and all((r.variant == "post") == (r.day1 is not None) for r in got.values())
    assert all(r.bottom_12m_pct is None for r in got.values() if (r.variant, "bottom_12m_pct", "size") not in heads)
    known = {r.id: r.ret_6m for r in issues.collect()}
    pre = [abs(r.ret_6m - known[i]) for i, r in got.items() if r.variant == "pre"]
    assert np.mean(pre) < 20 and all(0 <= r.p_ret_6m <= 1 for r in got.values() if r.variant == "pre")
    size = heads.get(("post", "ret_6m", "size"))
    if size is not None:
        from pyspark.ml.linalg import Vectors

        row = next(r for r in got.values() if r.variant == "post" and r.a is not None)
        assert abs(size.predict(Vectors.dense([row.a, row.b, row.day1])) + row.day1 - row.ret_6m) < 1e-9
    assert [r.a for r in sorted(told.collect(), key=lambda r: r.id)[:1]] == [None]


def test_targets_without_enough_rows_have_no_head(issues):
    few = issues.withColumn("bottom_12m_pct", F.when(F.col("id") < 30, F.col("bottom_12m_pct")))
    out = train_horizons(few, SPEC, maxIter=2)
    assert {r.target for r in out.metrics.collect()} == {"ret_6m"}


def test_folds_of_a_target_are_found_once_for_both_variants(issues, monkeypatch):
    found, plain = [], horizon.time_folds
    monkeypatch.setattr(horizon, "time_folds", lambda df, *a, **k: found.append(1) or plain(df, *a, **k))
    train_horizons(issues, SPEC, maxIter=1)
    assert len(found) == 2


@pytest.mark.parametrize("n, depth, rate", [(900, 2, 0.7), (14_000, 2, 0.7), (900, 3, 1.0)])
def test_a_fit_in_one_task_makes_the_trees_of_spark(spark, n, depth, rate):
    some = spark.range(0, n, 1, 3).select(
        F.lit(0).alias("fold"), F.round(F.randn(3), 2).alias("a"), F.round(F.randn(4) * 9).alias("b"), F.lit(2.0).alias("c"))
    some = some.withColumn("y", F.col("a") * 4 + F.col("a") * F.col("b") / 5).withColumn("base", F.lit(0.0)).withColumn("fix", F.col("y"))
    rows = materialise(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(some.withColumn("up", (F.col("y") > 0).cast("int"))))
    settings = dict(maxIter=7, maxDepth=depth, subsamplingRate=rate)
    made = horizon._whole_fit(rows, ["size", "direction"], 3, {0: (n, 1)}, settings)
    for kind, mine in made.items():
        theirs = horizon._trees(kind, settings).fit(rows)
        far = theirs.transform(rows).select("a", "b", "y", F.col("prediction").alias("p")).distinct().join(
            mine.transform(rows).select("a", "b", "y", F.col("prediction").alias("q")).distinct(), ["a", "b", "y"])
        assert far.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
        assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray())
        cuts = lambda m: [line.split("(feature")[1].split(")")[0] for line in m.toDebugString.split("\n") if "If (feature" in line]
        assert cuts(mine) == cuts(theirs) and len(mine.trees) == 7


def test_rounds_are_not_spark_jobs(issues, monkeypatch):
    def refused(*_):
        raise AssertionError("a fit that runs jobs for every round")

    monkeypatch.setattr(horizon.GBTRegressor, "fit", refused)
    monkeypatch.setattr(horizon.GBTClassifier, "fit", refused)
    out = train_horizons(issues, SPEC, maxIter=4)
    assert all(r.folds == 5 and r.n_scored == 240 for r in out.metrics.collect()) and out.models


def test_fits_too_large_for_a_task_are_spark_s_own(issues, monkeypatch):
    told = lambda t: {(r.variant, r.target, r.kind): (round(r.error, 8), r.folds, r.skill) for r in t.metrics.collect()}
    small = SPEC.__class__(("a", "b"), ("ret_6m",), (), "day1", "opened", "id")
    mine = train_horizons(issues, small, maxIter=3)
    monkeypatch.setattr(horizon, "TASK_ROWS", 10)
    theirs = train_horizons(issues, small, maxIter=3)
    assert told(mine) == told(theirs) and set(mine.models) == set(theirs.models)


def test_generators_are_those_of_spark(spark):
    made = spark._jvm.org.apache.spark.util.random.XORShiftRandom
    sizes = np.array([9_000, 3, 5_000])
    draws = boosting.Draws(np.array([4, 0, 7]), sizes, 42, 0.7)
    rows = draws.laid(np.arange(sizes.sum()), -1)
    for turn, taken in enumerate(draws.rounds(3)):
        want = []
        for part, size in ((4, 9_000), (0, 3), (7, 5_000)):
            rng = made(42 + turn + part + 1)
            want += [rng.nextDouble() < 0.7 for _ in range(min(size, 300))] + [None] * (size - 300)
        got = dict(zip(rows[rows >= 0].tolist(), taken[rows >= 0].tolist(), strict=True))
        assert all(got[i] == w for i, w in enumerate(want) if w is not None)
