import zlib

import numpy as np
import pytest

from issuelens.llm import toxicity as T
from issuelens.llm.langid import BUCKETS, fit_temperature, gram_counts, identify, softmax, train, train_ftrl

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def lang_model(tables):
    return train(tables[0])


def test_grams_ignore_case_and_punctuation():
    a, b = gram_counts("Der Hund, 12!"), gram_counts("der hund")
    assert np.array_equal(a[0][: len(b[0])], b[0]) or len(a[0]) >= len(b[0])
    assert gram_counts(None)[0].size == gram_counts("12 ,.")[0].size == 0


def test_ftrl_is_sparse_and_separates(rng):
    rows = [(np.array([k, 9, 50 + rng.randrange(40)]), np.array([0.7, 0.5, 0.5], np.float32), k) for k in (0, 1, 2) for _ in range(60)]
    weights, bias = train_ftrl(rows, 3)
    assert all(int(np.argmax(x @ weights[a] + bias)) == k for a, x, k in rows)
    assert (weights[200:] == 0).all() and weights.shape == (BUCKETS, 3)


def test_temperature_lowers_the_log_loss():
    draw = np.random.default_rng(1)
    labels = draw.integers(0, 3, 400)
    logits = draw.standard_normal((400, 3)) * 4
    logits[np.arange(400), labels] += 2
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(400), labels]).mean()
    assert loss(fit_temperature(logits, labels)) <= min(loss(1.0), loss(0.5), loss(8.0)) + 1e-6


def test_held_out_language_accuracy(tables, lang_model):
    rows = identify(tables[0], lang_model).collect()
    test = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert (lang_model.weights == 0).mean() > 0.5


def test_language_of_odd_rows(odd_docs, no_docs, lang_model):
    out = identify(odd_docs, lang_model)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if not r.text or r.doc_id in (3, 11)} == {"und"}
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert identify(no_docs, lang_model).count() == 0
    empty = train(no_docs)
    assert empty.langs == [] and identify(odd_docs, empty).where("lang_pred <> 'und'").count() == 0


def test_gradient_is_exact():
    p = {k: v.astype(np.float64) for k, v in T.new_parameters(1).items()}
    w = T.cut_windows(["you utter fool of the house and more words to go on with it now and then some", "a b c", ""])
    labels = np.arange(len(w.windows)) % 2 * 1.0

    def loss(q):
        z = T.forward(q, T._inputs(q, T.word_vectors(q, w)), w.windows)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    g = T.gradient(p, w, T.word_vectors(p, w), w.windows, labels, np.ones(len(labels)))
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in "ud")
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs(g[k][at] - (loss(up) - loss(down)) / 2e-3) < 1e-5, k


def test_windows_cover_every_word():
    for n in (0, 1, 15, 16, 17, 24, 25, 100):
        w = T.cut_windows([" ".join(f"v{i}" for i in range(n))])
        assert set(w.windows[w.windows < len(w.buckets)].tolist()) == set(range(n))
        assert len(w.windows) >= 1


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    p = T.learn(docs, labels)
    rows = T.score(docs, p).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    # Some toxic documents hold no word that marks toxicity; every known insult must be found.
    insults = "trash pathetic idiot worthless disgusting stupid clown loser scum moron".split()
    plain = np.array([any(w in (r.text or "").lower() for w in insults) for r in rows])
    print("held-out recall", s[y == 1].mean(), "of insults", s[plain & (y == 1)].mean(), "false positives", s[y == 0].mean())
    assert plain.sum() > 40 and s[plain & (y == 1)].mean() >= 0.95
    assert s[y == 1].mean() >= 0.8 and s[y == 0].mean() <= 0.02


def test_slices_score_every_window():
    p = T.new_parameters(5)
    texts = [" ".join(f"w{i % 37}" for i in range(n)) for n in (0, 1, 5, 8, 9, 40, 300)] + [None]
    w = T.all_windows(texts)
    assert np.bincount(w.text_of).tolist() == [max(1, n - T.WINDOW + 1) for n in (0, 1, 5, 8, 9, 40, 300, 0)]
    slow = T.forward(p, T._inputs(p, T.word_vectors(p, w)), w.windows)
    for block in (3, 50, 2048):
        assert np.allclose(T.window_logits(p, w, block), slow, atol=1e-5)


def test_training_is_repeatable():
    texts = [f"a fine day {i} in the park" for i in range(30)] + [f"you awful fool {i} get lost" for i in range(30)]
    one, two = (T.train(texts, [0] * 30 + [1] * 30, epochs=3) for _ in range(2))
    assert all(np.array_equal(one[k], two[k]) for k in one)
    assert T.score_texts(one, ["what an awful fool"])[0] > T.score_texts(one, ["a fine park"])[0]


def test_toxicity_of_odd_rows(odd_docs, no_docs, tables):
    p = T.new_parameters()
    out = T.score(odd_docs, p)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert T.score(no_docs, p).count() == 0
    nothing = T.learn(no_docs, tables[1])
    assert all(0 <= s <= 1 for s in T.score_texts(nothing, ["a", None]))
