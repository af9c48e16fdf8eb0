"""Soft-membership mixing: document rates that give target token weights to domains.

A document belongs to every domain to a degree. One classifier for each domain (naive
Bayes support vectors) is trained on the labelled table; their probabilities, made to sum to one, are the posteriors
p. With n tokens in a document and S in all, nonnegative rates r are sought that minimise

    1/2 sum_k (sum_d r_d n_d p_dk / S - budget w_k)^2 + ridge/2 sum_d n_d / S (r_d - 1)^2

so that the expected tokens of domain k come to ``budget * S * w_k``, at rates as close to
1 as that allows. The method is projected gradient descent with momentum in the metric n_d / S. A
document's step is its posterior times a vector with one number per domain, so a rate
follows from the history of those vectors: each round is one pass over the written posteriors that
replays the history and sums what the rates give. The driver sees one row of sums per round.

``copies`` is the whole number of times to take the document: the rate rounded up or down by a
number that depends on the id alone, so its expectation is the rate. Training takes a bounded sample
(``max_train`` rows a domain model); everything else covers all rows.

Defined results: a document without words (null or empty text) has n_tokens 0, rate 1 and plays no part. Documents
with equal posteriors get equal rates. Repeated rows each count. A table without tokens is left at
rate 1. A domain without labelled rows has posterior 0 unless no domain has any (then all are equal).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm import nbsvm
from tideview.llm.common import Scratch, uniform


def domain_models(
    docs: DataFrame, labelled: DataFrame, domains: list[str], max_train: int = 6000, log_features: int = 18, **names
) -> list[nbsvm.Model | None]:
    """One model for each domain of ``labelled`` (doc_id, domain); None for a domain without rows."""
    place = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(domains)])
    known = labelled.select("doc_id", place.alias("label")).where("label is not null")
    rows, labels = nbsvm.vectors(nbsvm.sample(docs, known, max_train, **names), log_features, max_train)
    return [
        nbsvm.fit(rows, (labels == k).astype(int), log_features) if (labels == k).any() else None
        for k in range(len(domains))
    ]


def posteriors(docs: DataFrame, models: list[nbsvm.Model | None], **names) -> DataFrame:
    """doc_id, n_tokens, p (an array, one number for each domain, summing to one)."""
    present = [k for k, m in enumerate(models) if m is not None]
    scored = nbsvm.probabilities(docs, [models[k] for k in present] or [nbsvm.fit([], np.array([]), 1)], **names)
    total = F.aggregate("scores", F.lit(1e-12), lambda a, x: a + x)
    shares = [(F.col("scores")[present.index(k)] + 1e-12 / len(present)) / total if k in present else F.lit(0.0) for k in range(len(models))]
    if not present:
        shares = [F.lit(1.0 / len(models))] * len(models)
    return scored.select("doc_id", F.col("n_words").alias("n_tokens"), F.array(*[F.round(s, 9) for s in shares]).alias("p"))


def _rates(p: np.ndarray, steps: list[np.ndarray], ridge: float) -> np.ndarray:
    """The rates after the rounds whose vectors are given: momentum, step, then projection onto r >= 0."""
    now = before = np.ones(len(p))
    speed = 1.0 / (1.0 + ridge)  # the Hessian is at most this: posteriors and n_d / S sum to one
    for t, g in enumerate(steps):
        ahead = now + (t / (t + 3.0)) * (now - before)
        before, now = now, np.maximum(0.0, ahead - speed * (p @ g + ridge * (ahead - 1.0)))
    return now


def _ahead(p: np.ndarray, steps: list[np.ndarray], ridge: float) -> np.ndarray:
    """Where the next gradient is taken."""
    t = len(steps)
    now = _rates(p, steps, ridge)
    return now + (t / (t + 3.0)) * (now - _rates(p, steps[:-1], ridge)) if t else now


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy(zero_copy_only=False).astype(float)
    p = batch.column(batch.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False)
    return n, p.reshape(-1, k)


def solve(
    table: DataFrame, weights: list[float], budget: float = 1.0, ridge: float = 1e-3, rounds: int = 60, tolerance: float = 1e-4
) -> tuple[list[np.ndarray], np.ndarray]:
    """The history of step vectors, and the reached share of tokens for each domain.

    ``table`` (n_tokens, p) should be written, as every round reads it.
    """
    k = len(weights)
    target = budget * np.array(weights, float) / max(1e-12, sum(weights))

    def sums(of) -> np.ndarray:
        def work(batches):
            total = np.zeros(k + 1)
            for batch in batches:
                n, p = _columns(batch, k)
                total += np.append((of(p) * n) @ p, n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        # Summed as decimals, so that the order in which tasks end changes nothing.
        each = [F.sum(F.col("s")[i].cast("decimal(38,12)")).cast("double") for i in range(k + 1)]
        found = np.array(table.select("n_tokens", "p").mapInArrow(work, "s array<double>").agg(*each).first(), float)
        return found[:k] / found[k] if found[k] > 0 else target.copy()

    steps: list[np.ndarray] = []
    reached = sums(lambda p: np.ones(len(p)))
    for _ in range(rounds):
        so_far = list(steps)
        gradient = sums(lambda p: _ahead(p, so_far, ridge)) - target if steps else reached - target
        steps.append(np.round(gradient, 12))
        if np.abs(gradient).max() < tolerance:
            break
    return steps, target + steps[-1] if steps else reached


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    budget: float = 1.0,
    ridge: float = 1e-3,
    max_train: int = 6000,
) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain of ``targets``, rate, copies, for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    domains = list(targets)
    models = domain_models(docs, labelled, domains, max_train, doc_id=doc_id, text=text)
    table = scratch.saved(posteriors(docs, models, doc_id=doc_id, text=text), "posteriors")
    steps, _ = solve(table, [targets[d] for d in domains], budget, ridge)
    k = len(domains)

    def work(batches):
        for batch in batches:
            n, p = _columns(batch, k)
            rate = np.where(n > 0, _rates(p, steps, ridge), 1.0)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "p", "rate"])

    rated = table.select("doc_id", "n_tokens", "p").mapInArrow(work, "doc_id long, n_tokens long, p array<double>, rate double")
    rate = F.round("rate", 6)
    return rated.select(
        "doc_id",
        "n_tokens",
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
        rate.alias("rate"),
        F.floor(rate + uniform(F.col("doc_id"), 9)).cast("long").alias("copies"),
    )
