import random

import pytest
import xxhash
from edges import ROWS, documents, nothing

from tideview.llm import simhash
from tideview.llm.common import Scratch


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, radius=3):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def check(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    expected = sorted(zip((str(i) for i, _ in rows), (f"{f:016x}" for f in fps), map(str, plain_components([i for i, _ in rows], fps))))
    got = simhash.near_duplicates(df, **options).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


@pytest.mark.parametrize("bucket", [2000, 1])
def test_edges_and_both_ways_through_a_bucket(spark, bucket):
    check(documents(spark), bucket=bucket)


@pytest.mark.parametrize("bucket", [2000, 2])
def test_near_copies_by_brute_force(spark, bucket):
    draw = random.Random(5)
    base = [f"w{draw.randrange(400)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base) if i % 3 else [f"v{draw.randrange(400)}" for _ in range(50)]
        for _ in range(i % 5):
            words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
        rows.append((100 - i, " ".join(words), "en", "s", 1))
    check(documents(spark, rows, clashes=False), bucket=bucket)


def test_links_are_all_found(spark):
    draw = random.Random(1)
    fps = {draw.getrandbits(64) for _ in range(40)}
    fps |= {f ^ sum(1 << b for b in draw.sample(range(64), k)) for f in list(fps) for k in (1, 2, 3, 4)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), Scratch(spark, "t")).collect()
    close = {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {(r.u, r.v) for r in found} == close


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)]
    found = simhash.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 51)} | {(1000 + i, 1000) for i in range(1, 40)}


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark):
    df = documents(spark)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "2", "4", "7", "8", "None"]  # 3 and 6 have no word either; 5 repeats 1; one of the two 8s


def test_empty(spark):
    assert simhash.near_duplicates(nothing(spark)).collect() == []
    assert simhash.deduplicate(nothing(spark)).collect() == []
    assert len(ROWS) == 11
