import collections
import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edges import documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from tideview.llm import queries, trie
from tideview.llm.eliasfano import Sequence, map_arrays, write_arrays


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(0, 63))
def test_sequences(values, asked, shift):
    values = np.sort(np.array([v >> shift for v in values], np.uint64))
    universe = (2**64 - 1 >> shift) + 1
    s = Sequence(Sequence.build(values, universe, "x"), "x")
    if len(values):
        assert (s.access(np.arange(len(values))) == values).all()
    asked = np.array([v >> shift for v in asked] + [0, universe - 1], np.uint64)
    assert (s.successor(asked) == np.searchsorted(values, asked)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=2, max_size=200), st.integers(0, 39), st.integers(1, 900))
def test_pairs_and_places_of_numbers(values, shift, times):
    values = np.sort(np.repeat(np.array([v >> shift for v in values], np.uint64), times))
    s = Sequence(Sequence.build(values, (2**40 >> shift) + 1, "x"), "x")
    for got, want in zip(s.access_pairs(np.arange(len(values) - 1)), (values[:-1], values[1:])):
        assert (got == want).all()
    asked = np.unique(np.concatenate([values, values // 2]))
    assert (s.find(asked) == np.where(np.isin(asked, values), np.searchsorted(values, asked), -1)).all()


def test_sequences_with_long_runs():
    values = np.sort(np.concatenate([np.arange(100_000), np.full(5_000, 7), 10**9 + np.arange(1000) * 10**6])).astype(np.uint64)
    s = Sequence(Sequence.build(values, 10**12, "x"), "x")
    asked = np.sort(np.random.default_rng(0).integers(0, 10**10, 5000).astype(np.uint64))
    assert (s.successor(asked) == np.searchsorted(values, asked)).all()


def test_files(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint8), "b": np.zeros(0), "c": np.array([1.5, 2])}
    write_arrays(f"file://{tmp_path}/f/x.bin", arrays)
    write_arrays(f"file://{tmp_path}/f/x.bin", arrays)  # a task that runs again
    got = map_arrays(f"file://{tmp_path}/f/x.bin")
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("aAbÄ \t\n\r\x0b\x0c\x1c\x85\xa0\x00", max_size=12), min_size=1, max_size=6))
def test_tokens(rows):
    hashes, flat, begins = trie.tokens(pa.array(["cut off", *rows], pa.string())[1:])
    assert (np.diff(hashes.astype(object)) > 0).all()
    for i, t in enumerate(rows):
        words = [b"", *(t or "").encode().lower().split(), b""]
        assert hashes[flat[begins[i] : begins[i + 1]]].tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def test_a_look_up_selects_once(spark, monkeypatch):
    """An n-gram asked for is one select, a context two, whether found or not."""
    draw = np.random.default_rng(0)
    texts = [" ".join(f"w{w}" for w in draw.integers(0, 300, 200)) for _ in range(100)]
    df = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    model = trie.Trie(trie.build(df.where("doc_id % 5 > 0"), order=3))
    hashes, flat, begins = trie.tokens(pa.array(texts))
    wanted = len(hashes) + sum(len({tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)}) for k in (2, 3))
    contexts = len(hashes) + len(set(zip(flat[:-1], flat[1:])))
    selected = []
    plain = Sequence._select
    monkeypatch.setattr(Sequence, "_select", lambda self, k, bit: selected.append(len(k)) or plain(self, k, bit))
    model.score(model.words(hashes), flat, begins)
    assert 0 < sum(selected) < wanted + 2 * contexts


def plain_model(train, order, discount=0.75):
    counts = [collections.Counter() for _ in range(order)]
    for q in train:
        for k in range(order):
            for i in range(1 if k == 0 else 0, len(q) - k):
                counts[k][tuple(q[i : i + k + 1])] += 1
    total = [collections.Counter() for _ in range(order)]
    kinds = [collections.Counter() for _ in range(order)]
    for k in range(1, order):
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
    size, distinct = sum(counts[0].values()), len(counts[0])

    def p(g):
        k = len(g) - 1
        if k == 0:
            return (counts[0][g] + 0.5) / (size + 0.5 * (distinct + 1))
        h = g[:-1]
        if not total[k][h]:
            return p(g[1:])
        return max(counts[k][g] - discount, 0) / total[k][h] + discount * kinds[k][h] / total[k][h] * p(g[1:])

    return counts, size, p


def sequence(text):
    return [b"", *(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_by_brute_force(spark, order):
    draw = np.random.default_rng(order)
    texts = [" ".join(f"W{w}" for w in draw.zipf(1.6, 40) if w < 60) for _ in range(60)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = documents(spark, rows)
    shape = trie.build(df.where("doc_id % 3 > 0"), order=order, shard_bytes=1, bins=65_536)
    counts, size, p = plain_model([sequence(t) for i, t in enumerate(texts) if i % 3], order)
    assert [int(o[-1]) for o in shape.offsets] == [len(c) for c in counts] and shape.tokens == size and shape.shards > 1
    for r in trie.score(df, shape).collect():
        q = sequence(texts[r.doc_id])
        exact = sum(math.log10(p(tuple(q[max(0, i - order + 1) : i + 1]))) for i in range(1, len(q)))
        assert abs(r.score - exact) < 1e-6
        assert abs(r.base_score - sum(math.log10(p((w,))) for w in q[1:])) < 1e-9
        assert (r.n_tokens, r.n_known) == (len(q) - 1, sum(counts[0][(w,)] > 0 for w in q[1:]))
        assert r.train_tokens == size
    coarse = trie.score(df, trie.build(df.where("doc_id % 3 > 0"), order=order, bins=16)).collect()
    fine = {r.doc_id: r.score for r in trie.score(df, shape).collect()}
    assert all(abs(r.score - fine[r.doc_id]) < 0.25 * r.n_tokens for r in coarse)


def test_edges(spark):
    df = documents(spark)
    got = trie.score(df, trie.build(df.where("doc_id is not null"))).collect()
    assert len(got) == 11 and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}


def test_nothing_to_learn_from_or_to_score(spark):
    got = trie.score(documents(spark), trie.build(nothing(spark))).collect()
    assert len(got) == 11 and all(r.score == r.base_score == 0 and r.n_known == r.train_tokens == 0 for r in got)
    assert trie.score(nothing(spark), trie.build(documents(spark))).collect() == []


def test_quantised():
    values = np.random.default_rng(1).normal(size=1000)
    codes, book = trie.quantised(values, 256)
    assert np.abs(book[codes] - values).mean() < 0.02 and codes.dtype == np.uint8
    codes, book = trie.quantised(np.array([1.0, 2.0, 1.0]), 256)
    assert (book[codes] == [1, 2, 1]).all()


def test_the_query_counts_contexts_of_two_words(spark, tmp_path):
    texts = ["a b c", "d b e"] * 30
    documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], clashes=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_trie(spark, str(tmp_path)).collect()
    _, _, p = plain_model([sequence(texts[r.doc_id]) for r in got if not r.held_out], 3)
    for r in got:
        q = sequence(texts[r.doc_id])
        exact = sum(math.log10(p(tuple(q[max(0, i - 2) : i + 1]))) for i in range(1, len(q)))
        assert abs(r.score - exact) < 1e-6
