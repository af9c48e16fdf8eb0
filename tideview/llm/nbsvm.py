"""Quality classifier: naive Bayes support vectors.

Every text is a set of n-gram indicators. Each indicator is scaled by the class
log-count ratio r = log((p / |p|) / (q / |q|)), p and q being smoothed counts of the
documents of class 1 and 0 that have it. A linear hinge-loss model is fitted to the
scaled vectors by dual coordinate descent. A logistic curve, fitted to the margins
of training documents held back from that, turns the margin into a score.

Indicators (hashed into ``2 ** log_features`` places): lower-cased words, single
word shapes and bigrams of them, and n-grams of one word repeated. A shape keeps what junk is made of
(case, digits, punctuation, repetition) and drops the letters. Whole texts are read; labels, language,
source and id are never inputs of a score.

Training takes at most ``max_train`` labelled rows, those with the smallest hash of
their id; everything else is done for every row in tasks.

Defined results: a null text counts as empty; an empty text has no indicators and is
scored by the bias alone. Labels other than 0 and 1, null ids and rows without a document are ignored in training.
With one class only, or none, the score is the share of class 1 (0.5 if there is none). Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import astuple, dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import by_batch, split_words, texts

def _signs() -> bytes:
    table = bytearray(range(256))
    table[ord("a") : ord("z") + 1] = b"a" * 26
    table[ord("A") : ord("Z") + 1] = b"A" * 26
    table[ord("0") : ord("9") + 1] = b"0" * 10
    table[0x80:] = b"a" * 128
    return bytes(table)


_SIGNS = _signs()
#: Lengths of the n-grams of equal words.
EQUAL = (3, 4, 5, 6, 8, 10)
#: Shape bigrams remembered by a task before it starts afresh.
_REMEMBERED = 300_000
#: How many of a run of equal signs a shape keeps.
_KEPT = np.full(256, 3)
_KEPT[[ord("a"), ord("0")]], _KEPT[ord("A")] = 1, 2


def shapes(text: bytes) -> list[bytes]:
    """The words of a text with letters and digits replaced by one sign each kind and runs of a sign cut short."""
    signs = np.frombuffer(text.translate(_SIGNS), np.uint8)
    first = np.concatenate([[True], signs[1:] != signs[:-1]])
    begins = np.flatnonzero(first)
    place = np.arange(len(signs)) - np.repeat(begins, np.diff(np.append(begins, len(signs))))
    return [w[:24] for w in signs[place < _KEPT[signs]].tobytes().split()]


class Indicators:
    """Hashed places of a text's distinct n-grams; one object for each task."""

    def __init__(self, log_features: int):
        self.mask = (1 << log_features) - 1
        self.runs = {k: zlib.crc32(b"r%d" % k) for k in EQUAL}
        self.pairs: dict[tuple[bytes, bytes], int] = {}

    def _pair(self, pair: tuple[bytes, bytes]) -> int:
        if len(self.pairs) >= _REMEMBERED:
            self.pairs.clear()
        return self.pairs.setdefault(pair, zlib.crc32(b"s" + pair[0] + b" " + pair[1]))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = split_words(text.lower() if text else text)
        if not words:
            return np.zeros(0, np.int64)
        word, kind, digest = zlib.crc32(b"w"), zlib.crc32(b"s"), zlib.crc32
        kinds = shapes(text)
        found = [digest(w, word) for w in set(words)]
        found += [digest(k, kind) for k in set(kinds)]
        found += [self.pairs.get(p) or self._pair(p) for p in set(zip(kinds, kinds[1:]))]
        same = bytes(map(eq, words, words[1:]))
        found += [place for k, place in self.runs.items() if b"\1" * (k - 1) in same]
        return np.unique(np.array(found, np.int64) & self.mask)


@dataclass
class Model:
    log_features: int
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() / math.sqrt(max(1, len(f))) + self.bias for f in rows])

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        z = self.slope * self.margins(rows) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    p, q = np.ones(size), np.ones(size)
    for f, one in zip(rows, y):
        (p if one > 0 else q)[f] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(
    rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int, seed: int = 7
) -> np.ndarray:
    """Weights (the last one is the bias) of min |w|^2 / 2 + sum cost * max(0, 1 - y w.x).

    x is scale[f] / sqrt(len(f)) at the places f of a row, and 1 at the bias. One dual
    variable is moved at a time, to its optimum within [0, cost].
    """
    xs = [scale[f] / math.sqrt(max(1, len(f))) for f in rows]
    norms = np.array([x @ x + 1.0 for x in xs])
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, x = rows[i], xs[i]
            gradient = y[i] * (w[f] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's curve by Newton's method; targets are smoothed by class size."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -35, 35)))
        gradient = x @ (p - target) + 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), gradient)
        theta = theta - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, log_features: int, cost: float = 1.0, passes: int = 40) -> Model:
    size, y = 1 << log_features, np.where(labels > 0, 1.0, -1.0)
    ones = int((y > 0).sum())
    if ones in (0, len(y)):
        share = ones / len(y) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(log_features, np.zeros(size, np.float32), 0.0, 1.0, math.log(share / (1 - share)))

    def train(of: np.ndarray) -> tuple[np.ndarray, float]:
        part, py = [rows[i] for i in of], y[of]
        r = log_count_ratios(part, py, size)
        each = np.where(py > 0, len(py) / (2.0 * max(1, (py > 0).sum())), len(py) / (2.0 * max(1, (py < 0).sum())))
        found = dual_descent(part, r, py, cost * each, passes)
        return found[:-1] * r, float(found[-1])

    # Margins for the curve come from models that haven't seen the row.
    parts = np.arange(len(y)) % 3
    unseen = np.zeros(len(y))
    for k in range(3):
        if len(set(y[parts != k])) < 2:
            continue
        w, b = train(np.flatnonzero(parts != k))
        held = [rows[i] for i in np.flatnonzero(parts == k)]
        unseen[parts == k] = Model(log_features, w, b, 1.0, 0.0).margins(held)
    w, b = train(np.arange(len(y)))
    slope, shift = logistic_curve(unseen, y)
    return Model(log_features, w.astype(np.float32), b, slope, shift)


def sample(docs: DataFrame, labelled: DataFrame, max_train: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text and label of at most ``max_train`` rows of ``labelled`` (doc_id, label), chosen by a hash of the id."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), "label"
    )
    chosen = known.distinct().orderBy(F.xxhash64("_id", F.lit(11)), "_id", "label").limit(max_train)
    plain = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    return plain.join(F.broadcast(chosen), "_id").select("_id", "text", "label")


def vectors(chosen: DataFrame, log_features: int, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sample's indicators, made in tasks; these, of at most ``most`` ids, then come to the driver.

    Of rows that repeat an id one is taken, the same in every run.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        indicators = Indicators(log_features)
        rows = [indicators(t).astype(np.int32).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2).cast(pa.int32()), pa.array(rows, pa.binary())], ["_id", "label", "places"]
        )

    made = chosen.mapInArrow(by_batch(work), "_id long, label int, places binary")
    got = made.groupBy("_id", "label").agg(F.min("places")).take(most)
    got = sorted(got, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1], bytes(r[2])))
    return [np.frombuffer(r[2], np.int32).astype(np.int64) for r in got], np.array([r[1] for r in got])


def train(docs: DataFrame, labelled: DataFrame, max_train: int = 8000, log_features: int = 20, **names) -> Model:
    known = labelled.where(F.col("label").isin(0, 1))
    return fit(*vectors(sample(docs, known, max_train, **names), log_features, max_train), log_features)


def probabilities(docs: DataFrame, models: list[Model], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, scores (one for each model, all of one feature size) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast([astuple(m) for m in models])  # of a size set by log_features

    def work(batches):
        models = [Model(*m) for m in sent.value]
        indicators = Indicators(models[0].log_features)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = texts(batch)
            rows = [indicators(t) for t in values]
            scores = np.stack([m.probabilities(rows) for m in models], axis=1) if rows else np.zeros((0, 1))
            columns = [batch.column(0), pa.array([len(split_words(t)) for t in values], pa.int64())]
            columns.append(pa.array(scores.tolist(), pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "scores"])

        return by_batch(one)(batches)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(work, "doc_id long, n_words long, scores array<double>")


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, **names) -> DataFrame:
    """doc_id, score, predicted for every row."""
    scored = probabilities(docs, [model], **names)
    score = F.round(F.col("scores")[0], 9)
    return scored.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def work(batches):
        model = Model(*sent.value)
        indicators = Indicators(model.log_features)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [indicators(t) for t in texts(batch, text)]
            score = np.round(model.probabilities(rows), 9) if rows else np.zeros(0)
            return batch.filter(pa.array(score >= threshold))

        return by_batch(one)(batches)

    return docs.mapInArrow(work, docs.schema)
