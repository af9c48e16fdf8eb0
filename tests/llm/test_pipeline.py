"""Each stage against what it must do, on the stage's own input."""

import os

import pytest
from edges import documents
from test_decontaminate import plain
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from tideview.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not found")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    scratch = corpus_pipeline.Scratch(spark, "stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.saved(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_keeps_good_and_drops_bad(spark, stages):
    kept = set(rows(stages[1]))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    there = set(rows(stages[0]))
    good = [r.doc_id in kept for r in labels if r.quality == 1 and r.doc_id in there]
    bad = [r.doc_id in kept for r in labels if r.quality == 0 and r.doc_id in there]
    assert sum(good) / len(good) > 0.97 and sum(bad) < len(bad) / 2


def test_line_dedup_only_cuts(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert set(before) == set(after)
    for i, r in after.items():
        assert len(r.text) == r.n_chars <= len(before[i].text)
        if len(r.text) == len(before[i].text):
            assert r.text == before[i].text


def test_near_dedup_by_brute_force(stages):
    before = rows(stages[2])
    ids = sorted(before)
    roots = plain_components(ids, [plain_fingerprint(before[i].text) for i in ids])
    assert set(rows(stages[3])) == set(roots)


def test_decontamination_by_brute_force(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in stages[3].collect()]
    clean = {int(r[0]) for r in plain(before, items) if not r[-1]}
    assert set(rows(stages[4])) == clean


def test_mixture_covers_all_and_run_is_the_stages(spark, stages):
    last = rows(stages[5])
    assert set(last) == set(rows(stages[4])) and all(r.rate >= 0 for r in last.values())
    again = {r.doc_id: r.rate for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert again == {i: r.rate for i, r in last.items()}


def test_stages_with_edges(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents(spark), FOLDER)
        assert out.columns == documents(spark).columns and 0 < out.count() <= 11
        assert stage(spark, documents(spark, []), FOLDER).count() == 0


def test_every_query_runs(spark):
    found = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in found} == set(range(1, 14))
    for name, query in found.items():
        assert query(spark, FOLDER).count() > 0, name
