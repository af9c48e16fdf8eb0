import hashlib
import re

import pytest
from edges import documents, nothing

from tideview.llm import decontaminate

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def plain(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    hit.update(range(k, k + m))
                    found |= wins[tuple(w[k : k + m])] - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def check(spark, docs, items, **options):
    found = decontaminate.contamination(docs, items, **options)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    return got


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
B = "alpha beta gamma"


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_by_brute_force(spark, broadcast_rows):
    rows = [
        (1, f"x {A} y"), (2, A.upper().replace(" ", "--")), (3, f"{A} " * 3 + "z " * 800), (4, " ".join(A.split()[:12])),
        (5, "é alpha; BETA gamma É alpha beta gamma"), (6, "alpha beta, delta gamma"), (7, f"{A} {A}"), (8, None), (9, ""),
        (10, " ".join(A.split()[2:]) + " " + A), (None, A), (11, A), (11, A), (11, "two texts"), (12, "solo"), (13, "Solo solo solo"),
    ]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    items = items_of(spark, [(10, A), (9, B), (8, B), (7, None), (6, ""), (5, "solo"), (None, "x one two"), (10, "delta gamma")])
    got = check(spark, docs, items, broadcast_rows=broadcast_rows)
    assert sum(r[-1] for r in got) > 8


def test_windows_that_overlap_and_repeat(spark):
    line = "a b a b a b a b a b a b a b a b"
    docs = documents(spark, [(i, f"q {line} r {line[:20]}", "en", "s", 1) for i in range(3)])
    check(spark, docs, items_of(spark, [(1, line), (2, "b a b")]))


def test_edges_and_nothing(spark):
    check(spark, documents(spark), items_of(spark, [(1, "nobody had seen it before They went on as the road was good"), (2, "一")]))
    check(spark, documents(spark), items_of(spark, []))
    check(spark, nothing(spark), items_of(spark, [(1, A)]))


def test_no_python_in_the_plan(spark, capsys):
    decontaminate.contamination(documents(spark), items_of(spark, [(1, A)])).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_clean_keeps_columns_and_repeated_rows(spark):
    docs = documents(spark)
    kept = decontaminate.clean(docs, items_of(spark, [(1, "another text of the same id")]))
    assert kept.columns == docs.columns and kept.count() == 10
