import collections
import re

import numpy as np
from edges import PROSE, documents, nothing

from tideview.llm import divergence


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        dups += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(hit)


def numbers(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_base_columns_by_brute_force(spark):
    more = ["a b c d e " * 4, "a b c d e a b c d e f", "x\nx\n\nx y\nx y\n x y", "one two three four"]
    rows = [(100 + i, t, "en", "s", 1) for i, t in enumerate(more)]
    df = documents(spark).unionByName(documents(spark, rows))
    texts = sorted(((str(r.doc_id), *base(r.text)) for r in df.collect()))
    got = divergence.judge(df).collect()
    assert sorted((str(r.doc_id), *numbers(r)) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_distances_by_numpy(spark):
    texts = [f"{PROSE} the {i} of the {i % 3} and so on" for i in range(30)] + ["THE !!! ### " * 9]
    df = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], clashes=False)
    common = 4
    words = [t.encode().lower().split() for t in texts]
    held = collections.Counter(w for ws in words for w in set(ws))
    top = sorted(held, key=lambda w: (-held[w], w))[:common]
    hist = np.array([[ws.count(w) for w in top] + [sum(w not in top for w in ws)] for ws in words], float)
    hist /= hist.sum(axis=1, keepdims=True)
    reference = hist.mean(axis=0)

    def distance(p, q):
        m = (p + q) / 2
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
        return np.sqrt((kl(p) + kl(q)) / 2)

    for r in divergence.judge(df, common=common).collect():
        assert abs(r.js_words - distance(hist[r.doc_id], reference)) < 1e-6


def test_verdicts(spark):
    prose = [(i, " ".join([PROSE, f"Then {i} came and the {i * 7} went by."] * 1) + " " + " ".join(f"w{i}x{k} the of" for k in range(30)), "en", "s", 1) for i in range(40)]
    junk = [(100 + i, " ".join(f"W{i}{k}###$$$ %%%{k}&&&" for k in range(60)), "en", "s", 1) for i in range(2)]
    short = [(200, "## $$ ** && || << >> ## $$ **", "en", "s", 1)]
    got = {r.doc_id: r.kept for r in divergence.judge(documents(spark, prose + junk + short)).collect()}
    assert all(got[i] for i in range(40)) and not got[100] and not got[101]
    assert got[200]  # too short to be compared


def test_languages_beyond_the_bound_share_a_reference(spark):
    df = documents(spark)
    assert len(divergence.judge(df, max_languages=1).collect()) == 11


def test_every_language_has_its_own_reference(spark):
    rows = []
    for k, n in enumerate((20, 12, 8, 8, 5)):
        for i in range(n):
            rows.append((100 * k + i, " ".join(f"l{k}w{j % 9} L{k}x{i}y{j}" for j in range(60)), f"l{k}", "s", 1))
    rows += [(900 + i, PROSE * 8, None, "s", 1) for i in range(3)]
    df = documents(spark, rows).unionByName(documents(spark))
    all_own, few_broadcast = (sorted(divergence.judge(df, max_languages=m).collect(), key=repr) for m in (500, 2))
    assert all_own == few_broadcast
    assert all(r.kept for r in few_broadcast if (r.doc_id or 0) in range(100, 500))


def test_hashes_decide_nothing(spark):
    words = [b"a", b"b"] * 40
    assert divergence.repeat_words(words) == 80
    assert divergence.repeat_words([b"%d" % i for i in range(50)]) == 0


def test_empty(spark):
    assert divergence.judge(nothing(spark)).collect() == []
