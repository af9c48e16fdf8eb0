import numpy as np
from edges import documents, nothing

from tideview.llm import nbsvm


def toy(spark, n=120):
    rows = []
    for i in range(n):
        good = i % 4 > 0
        text = f"the river {i % 7} went on and it was good {i}" if good else f"BUY!! NOW!! {i % 5} ### ### cheap {i}"
        rows.append((i, text, "en", "s", len(text)))
    labels = [(i, int(i % 4 > 0)) for i in range(n)] + [(None, 1), (3, None), (10_000, 0), (7, 5)]
    return documents(spark, rows, clashes=False), spark.createDataFrame(labels, "doc_id long, label int")


def test_held_out_accuracy(spark):
    docs, labels = toy(spark)
    model = nbsvm.train(docs, labels.where("doc_id % 3 > 0"), log_features=14)
    got = nbsvm.classify(docs, model).where("doc_id % 3 = 0").collect()
    assert all(r.predicted == int(r.doc_id % 4 > 0) and 0 <= r.score <= 1 for r in got) and len(got) == 40


def test_bound_of_the_sample(spark):
    docs, labels = toy(spark)
    assert nbsvm.sample(docs, labels, 30).count() <= 30


def test_edges_keep_every_row(spark):
    docs, labels = toy(spark)
    model = nbsvm.train(docs, labels, log_features=14)
    edges = documents(spark)
    got = nbsvm.classify(edges, model).collect()
    assert len(got) == 11
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[2] == by_id[3] == by_id[6]  # null, empty and blank texts: the bias alone
    kept = nbsvm.keep(edges, model)
    assert kept.columns == edges.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_no_class_one_class_and_no_documents(spark):
    docs, labels = toy(spark)
    none = nbsvm.train(nothing(spark), labels, log_features=10)
    assert {r.score for r in nbsvm.classify(docs, none).collect()} == {0.5}
    ones = nbsvm.train(docs, labels.where("label = 1"), log_features=10)
    assert {round(r.score, 3) for r in nbsvm.classify(docs, ones).collect()} == {1.0}
    assert nbsvm.classify(nothing(spark), ones).collect() == []


def test_shapes():
    assert nbsvm.shapes(b"The THE x12,, a!!!!! \xc3\xa9t\xc3\xa9") == [b"Aa", b"AA", b"a0,,", b"a!!!", b"a"]


def test_dual_descent_meets_the_optimality_conditions():
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 30, 6)) for _ in range(60)]
    y = np.where(draw.random(60) < 0.5, 1.0, -1.0)
    scale, cost = draw.normal(size=30), np.full(60, 0.7)
    w = nbsvm.dual_descent(rows, scale, y, cost, 4000)

    def loss(v):
        x = np.array([scale[f] @ v[f] / np.sqrt(len(f)) + v[-1] for f in rows])
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * x)).sum()

    best = loss(w)
    for _ in range(300):
        assert loss(w + draw.normal(size=31) * 10 ** draw.uniform(-4, 0)) >= best - 1e-2


def test_log_count_ratios():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    r = nbsvm.log_count_ratios(rows, np.array([1.0, 1.0, -1.0]), 3)
    p, q = np.array([2, 3, 1]) / 6, np.array([1, 1, 2]) / 4
    assert np.allclose(r, np.log(p / q))
