import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from issuelens.llm import components as components_module, neardup
from issuelens.llm.components import components, contracted, labels
from issuelens.llm.linededup import dedupe_lines
from issuelens.llm.neardup import RADIUS, distance, keys_of, near_duplicates, signatures
from issuelens.llm.wordhash import NOT_ALNUM, WHITE, shingles, word_hashes

from .conftest import edited, prose


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def gram_set(text, size=4):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size=4, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).update(gram_set(t, size))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def test_word_hashes_cut_like_the_pattern():
    texts = ["A b\tC\x0bd e", "", None, "  x  ", "é É \x1c1", "a-b, c!"]
    got = [len(h) for h in word_hashes(texts)]
    assert got == [len(words_of(t)) for t in texts]
    a, b = word_hashes(["Ab cd", "aB CD"])
    assert np.array_equal(a, b)
    assert len(next(iter(word_hashes(["a-b, c!"], NOT_ALNUM)))) == 3 and WHITE[10] and NOT_ALNUM[10]
    assert len(shingles(next(iter(word_hashes(["a b"]))), 4)) == 1


def test_near_duplicates_match_brute_force(spark, rng):
    rows = []
    for f in range(12):
        base = prose(rng, rng.randrange(30, 120))
        rows += [(100 * f + k, edited(rng, base, rng.randrange(0, 8))) for k in range(12)]
    rows += [(5000 + k, prose(rng, rng.randrange(1, 8))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert {i: c for i, (_, c, _) in got.items()} == want
    assert all(n == len(gram_set(t)) for i, t in rows for n in [got[i][0]])
    assert all(kept == (c == i) for i, (_, c, kept) in got.items())


def test_signatures_within_the_radius_share_a_key(spark, rng):
    base = prose(rng, 90)
    docs = spark.createDataFrame([(k, edited(rng, base, k)) for k in range(20)], "doc_id long, text string")
    signed = signatures(docs).cache()
    keys = {}
    for r in keys_of(signed).collect():
        keys.setdefault(r.id, set()).add(r["at"])
    pairs = signed.alias("x").join(signed.alias("y"), F.expr("x.id < y.id")).select("x.id", "y.id", distance("x", "y")).collect()
    near = [(a, b) for a, b, d in pairs if a < b and d <= RADIUS]
    assert len(near) > 5
    assert all(keys[a] & keys[b] for a, b in near)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = near_duplicates(odd_docs)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == odd_docs.count()
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].kept and by[3].component_id == 3
    assert by[4].n_shingles == 1 and by[6].component_id == by[7].component_id == 6 and not by[7].kept
    assert by[5].component_id == 5
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(30)) and got[300] == 299


def test_components_end_once_links_are_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components_module, "staged", lambda df, write=components_module.staged: written.append(1) or write(df))
    links = [(100, 200 + i) for i in range(30)] + [(9, 1), (9, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {100: 100, 9: 1, 1: 1} | {200 + i: 100 for i in range(30)}
    assert len(written) == 3
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_few_rounds_keep_what_is_connected(spark, rng):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + rng.randrange(60)) for i in range(60)]
    table = spark.createDataFrame(links, "a long, b long")
    whole = {r.node: r.component for r in components(table).collect()}
    few = contracted(table, 2)
    part = {r.node: r.component for r in labels(few).collect()}
    assert part.keys() == whole.keys() and len(set(part.values())) > len(set(whole.values()))
    assert all(whole[c] == whole[n] for n, c in part.items())
    assert {r.node: r.component for r in components(few).collect()} == whole


def test_rows_for_each_rare_shingle_are_narrow(spark, rng, monkeypatch):
    """Signatures are written once for a document or index key, not once for each rare shingle."""
    rows = []
    for f in range(8):
        base = prose(rng, 700)
        rows += [(100 * f + k, edited(rng, base, 35)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = []

    def watched(df, write=neardup.staged):
        out = write(df)
        if "s0" in out.columns:
            wide.append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", watched)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert sum(wide) < 100 * len(rows)


def brute_lines(rows, size=3):
    seen, cut = {}, {}
    docs = sorted({(i, t) for i, t in rows if t is not None})
    for i, t in docs:
        lines = t.split("\n")
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if "".join(w).strip(" ") == "":
                continue
            if w in seen:
                cut.setdefault((i, t), set()).update(range(p, p + size))
            else:
                seen[w] = (i, t, p)
    return {(i, t): "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut.get((i, t), ())) for i, t in docs}


def test_line_dedup_matches_brute_force(spark, rng):
    pool = [prose(rng, 4) for _ in range(6)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id): (r.text, r.n_lines, r.n_removed) for r in dedupe_lines(docs).collect()}
    want = brute_lines(rows)
    for i, t in rows:
        assert got[i][0] == want[i, t]
        assert got[i][1] == len(t.split("\n"))


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    out = dedupe_lines(odd_docs)
    assert len(set(out.columns)) == len(out.columns) and {"shard", "h", "id"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert sum(r.text is None for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert by[1].n_lines == 0 and by[2].n_lines == 1 and by[9].n_removed == 0 and by[9].text == "l1\nl2\nl3\n\n\n\nl4"
    assert dedupe_lines(no_docs).count() == 0


def test_line_dedup_self_overlap(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "x\na\na\na\ny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedupe_lines(docs).collect()} == {1: "a", 2: "x\ny"}


def test_staged_leaves_no_shuffle_files(spark):
    import time

    from issuelens.llm.staging import staged

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    rows = spark.range(20_000).withColumn("k", F.expr("id % 5000"))
    kept = rows.groupBy("k").count()
    before = shuffles()
    out = staged(rows.join(kept, "k").where("count > 1").repartition(3, "id"))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert out.count() == 20_000 and out.where("count != 4").count() == 0
