import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import negatives as N
from issuelens.llm import quality as Q
from issuelens.llm import variants as V

WORDS = "thoroughness wonderful élégantes übermäßig aaaaaaaaaa abababababab interesting questions mountains".split()


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def changed(rng, word):
    at, how = rng.randrange(len(word)), rng.random()
    letter = rng.choice("abcdeéß")
    return word[:at] + ("" if how < 0.34 else letter) + word[at + (how < 0.67) :]


def grouped(rows):
    """Brute force over (doc_id, text)."""
    count = Counter()
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        letters = "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in low)
        for run in letters.split():
            h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        near = [(-m, o) for o, m in words.items() if one_edit(w, o)]
        form = min(near)[1] if near and -min(near)[0] >= 10 * n else None
        out[w] = (form, n, len(near), words.get(form))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_pivots_are_the_lightest_disjoint_grams():
    rng = random.Random(4)
    for _ in range(300):
        places = sorted(rng.sample(range(9), 5))
        weights = [rng.randrange(1, 30) for _ in places]
        found = V.pivots(places, weights)
        apart = lambda c: all(places[b] - places[a] >= 2 for a, b in zip(c, c[1:], strict=False))
        best = min(sum(weights[i] for i in c) for c in itertools.combinations(range(5), 2) if apart(c))
        assert apart(found) and sum(weights[i] for i in found) == best


def test_variants_match_brute_force(spark, rng):
    family = WORDS + [changed(rng, w) for w in WORDS for _ in range(25)]
    family += [changed(rng, w) for w in family[9:]]
    rows = []
    for key in range(120):
        rows.append((key, " ".join(rng.choice(family) if rng.random() < 0.5 else rng.choice(WORDS).title() for _ in range(40)) + ", x1y."))
    rows += [(None, "Thoroughness thoroughnes"), (7, None), (7, ""), (3, "zz " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = grouped(rows)
    assert told(V.group_variants(df)) == want
    assert any(v[0] for v in want.values()) and any(v[1] != v[0] for v in want.values() if v[0])


def test_form_chains_reach_their_root(spark):
    chain = [f"abcdefg{'h' * k}" for k in range(20)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    assert {(r.word, r.root) for r in V.roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_variants_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    assert told(V.group_variants(odd_docs, length=4)) != {}
    assert V.group_variants(no_docs).collect() == []
    long = "q" * 30_000
    df = spark.createDataFrame([(1, f"{long} {long} {long}b {long}b")], "doc_id long, text string")
    assert {(r.n, r.n_near, r.form_n) for r in V.group_variants(df).collect()} == {(2, 1, None)}
    with pytest.raises(ValueError):
        V.group_variants(odd_docs, length=3)


def mined(rows, anchor, positives=5, negatives=3):
    """Brute force over (id, label, vector)."""
    ok = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            mine = (label, [math.floor(256 * x) for x in v])
            ok[i] = min(ok.get(i, mine), mine)
    out = []
    for a, (label, v) in ok.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m == label) for i, (m, w) in ok.items() if i != a)
        for s, p, _ in [t for t in scored if t[2]][:positives]:
            fits = [(n, t) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fits)]
    return sorted(out)


def test_negatives_match_brute_force(spark):
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((12, 9))
    rows = [(i, int(draw.integers(0, 4)), (centres[i % 12] + 0.5 * draw.standard_normal(9)).round(2).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(400)]  # a hot group of equal vectors, tied scores
    rows += [(2000, None, [1.0] * 9), (2050, 1, None), (2100, 1, [float("nan")] + [1.0] * 8), (2150, 2, [None] * 9), (2200, 1, [float("inf")] * 9),
             (2250, 1, []), (2300, 2, [3.0]), (None, 1, [1.0] * 9), (50, 3, [0.0] * 9), (2350, 1, [-5e6] * 9), (2400, 1, [7e6] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = sorted(tuple(r) for r in N.hard_negatives(df, F.col("id") % 50 == 0).collect())
    assert got == mined(rows, lambda i: i % 50 == 0) and len(got) > 60
    few = sorted(tuple(r) for r in N.hard_negatives(df, F.col("id") == 5, positives=2, negatives=40).collect())
    assert few == mined(rows, lambda i: i == 5, 2, 40)


def test_shelves_and_groups_change_nothing(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, i % 5, draw.standard_normal(7).tolist()) for i in range(300)] + [(300 + i, 1, [0.5] * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(N, "SHELF_BYTES", 7 * 2 * 20)
    monkeypatch.setattr(N, "CELL_ROWS", 10)
    assert sorted(tuple(r) for r in N.hard_negatives(df, F.col("id") % 9 == 0).collect()) == mined(rows, lambda i: i % 9 == 0)


def test_cells_come_in_falling_order():
    draw = np.random.default_rng(6)
    shelf = object.__new__(N._Shelf)
    shelf.used1, shelf.used2 = np.arange(5), np.arange(7)
    shelf.slices = {(i, j): (i, j + 10) for i in range(5) for j in range(7) if (i + j) % 3}
    one, two = draw.standard_normal(5), draw.standard_normal(7)
    seen = list(shelf.visit(one, two))
    assert [b for b, *_ in seen] == sorted((b for b, *_ in seen), reverse=True) and len(seen) == 35
    assert {(low, high - 10) for _, low, high in seen if high} == set(shelf.slices)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert N.hard_negatives(empty, F.col("id") % 50 == 0).collect() == []
    alone = spark.createDataFrame([(50, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    assert N.hard_negatives(alone, F.col("id") % 50 == 0).collect() == []


def slow_features(text):
    """Weight of every token part, by its bytes."""
    tokens = (text or "").encode().split()
    total = Counter()
    for t in tokens:
        marked = [256, *t, 256]
        parts = [tuple(marked[i : i + n]) for n in Q.SIZES for i in range(len(marked) - n + 1) if n > 1 or marked[i] != 256]
        for part in [t, *parts]:
            total[part] += 1 / len(tokens) / (1 + len(parts))
    return total, sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / max(1, len(tokens))


def test_features_match_plain_python():
    texts = ["The The fox | ! fox", None, "", "ünï  a\ta\na a", "one"]
    for text, (at, w) in zip(texts, Q.features(texts), strict=True):
        want, repeated = slow_features(text)
        assert abs(w.sum() - sum(want.values()) - repeated) < 1e-5
        assert abs(w[at == Q.REPEAT].sum() - repeated) < 1e-6
        assert len(at) <= len(want) + 1 and len(at) >= 0.98 * len(want)


def test_fast_score_is_that_of_the_features():
    draw = np.random.default_rng(1)
    model = Q.QualityModel(draw.standard_normal((Q.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    texts = ["The The fox | ! fox", None, "", "a a a b", "long text " * 500]
    for s, (at, w) in zip(model.scores(texts), Q.features(texts), strict=True):
        z = float(w @ (model.table[at, 1] - model.table[at, 0])) - 0.3
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-5


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score(docs, Q.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.predicted for r in rows])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert (s[y == 1] == 1).mean() >= 0.99 and (s[y == 0] == 0).mean() >= 0.95


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)] + [(4, None), (None, 1), (5, 0)], "doc_id long, quality int")
    model = Q.learn(odd_docs, labels)
    out = Q.score(odd_docs, model)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert Q.score(no_docs, model).count() == 0
    assert set(Q.learn(no_docs, labels).scores(["a", None])) == {0.5}
    again = Q.learn(odd_docs, labels)
    assert np.array_equal(model.table, again.table)
