import numpy as np
import pytest
from edges import documents, nothing

from tideview.llm import mixing


def test_rates_reach_the_targets(spark):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.3, 0.3, 0.3], 400)
    n = draw.integers(1, 100, 400)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    weights = [0.6, 0.3, 0.1]
    steps, reached = mixing.solve(table, weights, budget=1.5, rounds=90, tolerance=1e-6)
    rates = mixing._rates(p, steps, 1e-3)
    got = (rates * n) @ p / n.sum()
    assert (rates >= 0).all() and np.abs(got - 1.5 * np.array(weights)).max() < 5e-3 and np.abs(reached - got).max() < 2e-3
    # Against plain projected gradient descent run to the end.
    plain, share = np.ones(400), n / n.sum()
    for _ in range(20_000):
        plain = np.maximum(0, plain - 0.9 * (p @ ((plain * share) @ p - 1.5 * np.array(weights)) + 1e-3 * (plain - 1)))
    assert np.abs(plain - rates).max() < 0.05


def toy(spark):
    rows = [(i, ("good prose of the river " if i % 3 else "VILE! word! ") * (i % 7 + 1), "en", "s", 1) for i in range(90)]
    labels = [(i, "good" if i % 3 else "toxic") for i in range(60)] + [(None, "good"), (1, None), (2, "unheard of")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")


def test_mix(spark):
    docs, labels = toy(spark)
    got = mixing.mix(docs, labels, {"good": 0.9, "toxic": 0.1}).toPandas()
    assert list(got.columns) == ["doc_id", "n_tokens", "p_good", "p_toxic", "rate", "copies"] and len(got) == 90
    share = (got.rate * got.n_tokens * got.p_toxic).sum() / got.n_tokens.sum()
    assert abs(share - 0.1) < 0.01
    assert np.allclose(got.p_good + got.p_toxic, 1, atol=1e-6) and ((got.copies - got.rate).abs() < 1).all()


def test_edges(spark):
    docs, labels = toy(spark)
    got = mixing.mix(documents(spark), labels, {"good": 0.9, "toxic": 0.1}).toPandas()
    assert len(got) == 11 and (got.rate >= 0).all() and (got[got.n_tokens == 0].rate == 1).all()


@pytest.mark.parametrize("targets", [{"good": 1.0, "absent": 0.0}, {"good": 0.5, "absent": 0.5}])
def test_a_domain_without_labels(spark, targets):
    docs, labels = toy(spark)
    got = mixing.mix(docs, labels, targets).toPandas()
    assert (got.p_absent == 0).all() and np.isfinite(got.rate).all()


def test_nothing(spark):
    docs, labels = toy(spark)
    assert mixing.mix(nothing(spark), labels, {"good": 1.0}).collect() == []
    got = mixing.mix(docs, labels.limit(0), {"good": 0.5, "toxic": 0.5}).toPandas()
    assert (got.p_good == 0.5).all() and np.allclose(got.rate, 1)
