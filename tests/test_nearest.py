import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from issuelens.operators import joins
from issuelens.operators.ordering import grouped_index, split_cells, time_folds


def rms(p, q):
    common = set(p) & set(q)
    return math.sqrt(sum((p[c] - q[c]) ** 2 for c in common) / len(common)) if len(common) >= 3 else None


@pytest.fixture(scope="module")
def profiles():
    rng = random.Random(5)
    centres = [[rng.uniform(0, 100) for _ in range(8)] for _ in range(12)]
    rows = {}
    for i in range(900):
        c = centres[i % 12]
        rows[i] = {f"c{k}": round(c[k] + rng.gauss(0, 1.5), 3) for k in range(8)}
        if i % 17 == 0:
            rows[i].pop(f"c{i % 8}")
        if i % 41 == 0:
            rows[i]["extra"] = 5.0
        if i % 101 == 0:
            rows[i] = {"c0": 1.0, "c1": 2.0}
    rows |= {900 + i: dict(rows[7]) for i in range(40)}
    return rows


def test_pruned_search_is_exact(spark, profiles):
    data = [*profiles.items(), (5000, None), (5001, {})]
    df = spark.createDataFrame(data, "id long, p map<string,double>").repartition(5)
    targets = df.filter("id % 50 = 0 OR id = 907")
    got = {}
    for r in joins.similar(df, targets, "id", "p", k=4, min_common=3, decimals=3, block=9).collect():
        got.setdefault(r.target_id, []).append((r.rank, r.distance, r.id))
    want = {}
    for t in [i for i in profiles if i % 50 == 0 or i == 907]:
        near = sorted((round(d, 3), i) for i, q in profiles.items() if i != t and (d := rms(profiles[t], q)) is not None)[:4]
        if near:
            want[t] = [(k + 1, d, i) for k, (d, i) in enumerate(near)]
    assert set(got) == set(want)
    for t, rows in want.items():
        assert [(k, i) for k, _, i in sorted(got[t])] == [(k, i) for k, _, i in rows]
        assert all(abs(a[1] - b[1]) < 2e-3 for a, b in zip(sorted(got[t]), rows, strict=True))


def test_pivots_spare_most_pairs_of_clustered_profiles(spark, profiles):
    df = spark.createDataFrame(list(profiles.items()), "id long, p map<string,double>").repartition(3)
    work = joins.similar_work(df, df.filter("id % 50 = 0"), "id", "p", k=4, min_common=3).first()
    assert work.n_targets == 19 and work.n_rows == 940
    assert 0 < work.share < 0.5 and work.n_scored == round(work.share * 19 * 940)
    assert joins.similar(df, df.filter("false"), "id", "p").count() == 0


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(3)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    words = [f"w{i}" for i in range(14)]
    names = [(i, rng.sample(words, rng.choice([0, 1, 2, 2])), day(rng.randrange(700)) if i % 13 else None) for i in range(120)]
    names += [(500 + i, ["w0"], day(300)) for i in range(50)]  # equal names of one day
    titles = [(i, rng.sample(words, 5), day(rng.randrange(900)) if i % 11 else None) for i in range(300)]
    titles += [(1000 + i, ["w0", "w1"], day(290)) for i in range(200)]  # a hot day of equal titles
    n = spark.createDataFrame(names, "name_id long, toks array<string>, opened date")
    t = spark.createDataFrame(titles, "title_id long, toks array<string>, filed date")
    got = {r.name_id: (r.title_id, r.gap_days) for r in joins.nearest_in_interval(
        n, t, "name_id", "toks", "opened", "title_id", "toks", "filed", 40, 9, rows_per_salt=20).collect()}
    want = {}
    for i, toks, opened in names:
        fits = [(abs((filed - opened).days), j) for j, have, filed in titles
                if toks and opened and filed and set(toks) <= set(have) and -40 <= (filed - opened).days <= 9]
        if fits:
            want[i] = (min(fits)[1], min(fits)[0])
    assert got == want and len(want) > 60


def test_no_pair_beyond_the_interval_leaves_the_join(spark):
    day = dt.date(2021, 1, 1)
    n = spark.createDataFrame([(1, ["a"], day)], "name_id long, toks array<string>, opened date")
    t = spark.createDataFrame([(i, ["a"], day + dt.timedelta(days=60 + i)) for i in range(500)], "title_id long, toks array<string>, filed date")
    assert joins.nearest_in_interval(n, t, "name_id", "toks", "opened", "title_id", "toks", "filed", 30, 5).count() == 0


def test_one_outlying_id_leaves_cells_even(spark):
    rows = [(1, i) for i in range(4_000)] + [(1, 10**15), (2, 5), (None, 7)]
    df = spark.createDataFrame(rows, "day int, id long").repartition(4)
    sizes = {(r.day, r["__cell"]): r["count"] for r in split_cells(df, ["day"], "id", 500).groupBy("day", "__cell").count().collect()}
    hot = [n for (d, _), n in sizes.items() if d == 1]
    assert len(hot) == 9 and max(hot) < 600 and sum(hot) == 4_001
    assert sizes[2, 0] == sizes[None, 0] == 1
    placed = {(r.day, r.id): r.idx for r in grouped_index(df, ["day"], [], "id", rows_per_cell=500).collect()}
    assert all(placed[1, i] == i for i in range(4_000)) and placed[1, 10**15] == 4_000


def test_folds_are_planned_without_a_job(spark):
    rows = [(i, dt.date(2022, 1, 1) + dt.timedelta(days=i // 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, day date")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "planning")
    out = time_folds(df, "day", "id")
    assert not tracker.getJobIdsForGroup("folds")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    start = 160
    want = {i: sum(i >= start + k * 240 // 5 for k in range(5)) for i in range(400)}
    assert {r.id: r.fold for r in out.select("id", F.col("fold")).collect()} == want
