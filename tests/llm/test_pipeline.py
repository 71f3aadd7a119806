"""Every stage of the pipeline on its own input, against brute force where one exists."""

import pytest

import corpus_pipeline as P
from issuelens.llm.staging import staged

from .conftest import prose
from .test_dedup import brute_components, brute_lines
from .test_layout import checked, reference_ids  # noqa: F401
from .test_privacy_leaks import brute_leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(staged(stage(spark, out[-1], SF)))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_in_order_with_the_columns_of_documents(steps):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for df in steps[:-1]:
        assert df.columns == P.COLUMNS


def test_language_stage_keeps_clean_documents(steps):
    before, after = dict(rows_of(steps[0])), dict(rows_of(steps[1]))
    gone = set(before) - set(after)
    assert len(gone) <= 0.02 * len(before) and all(after[i] == before[i] for i in after)


def test_line_stage_is_exact(steps):
    rows = rows_of(steps[1])
    want = {i: t for (i, _), t in brute_lines(rows).items()}
    got = dict(rows_of(steps[2]))
    was = dict(rows)
    assert got == {i: t for i, t in want.items() if t == was[i] or t.strip(" ")}


def test_near_stage_keeps_one_of_each_group(steps):
    rows = rows_of(steps[2])
    assert {i for i, _ in rows_of(steps[3])} == set(brute_components(rows, size=5).values())


def test_leak_stage(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = rows_of(steps[3])
    kept = {i for i, _ in rows_of(steps[4])}
    short = [(i, t) for i, t in rows if len(t) < 2500]
    bad = {d for d, _ in brute_leaks(short, items)}
    assert {i for i, _ in short} - bad == {i for i, _ in short} & kept


def test_leak_stage_reads_long_texts_to_their_end(spark, rng):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    docs = []
    for k, item in enumerate(items):
        words = item.split()
        del words[2 :: 6]
        ends = [item, " ".join(words), prose(rng, len(words))]
        docs += [(3 * k + j, f"{prose(rng, 3000)} {end} {prose(rng, 5)}", "en", "s", 0) for j, end in enumerate(ends)]
    texts = [(i, t) for i, t, *_ in docs]
    assert min(len(t) for _, t in texts) > 2500
    kept = {i for i, _ in rows_of(P.decontamination(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF))}
    assert kept == {i for i, _ in texts if i % 3 == 2}


def test_packing_stage(steps, reference_ids):  # noqa: F811
    checked(steps[5].collect(), dict(rows_of(steps[4])), reference_ids)


def test_run_and_empty_input(spark, steps, tmp_path, no_docs):
    assert P.run(spark, SF).count() == steps[5].count()
    empty = steps[0].where("false")
    for k, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, empty, SF).count() == 0, k


def test_null_texts_pass_to_their_defined_ends(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "der hund und die katze", "de", "s", 1)] + [(10 + i, "the cat and the dog " * 3 + str(i), "en", "s", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.language_id(spark, docs, SF)
    assert kept.where("doc_id in (1, 2)").count() == 0
    assert P.line_dedup(spark, docs, SF).count() == docs.count()
    assert P.near_dedup(spark, docs, SF).where("doc_id in (1, 2) or doc_id is null").count() == 3
    assert P.decontamination(spark, docs, SF).count() == docs.count()
