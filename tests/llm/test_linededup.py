import random
import re
import time

import numpy as np
import pytest
from edges import LONG, documents, nothing
from pyspark.sql import functions as F

from tideview.llm import linededup
from tideview.llm.common import Scratch

DRAW = random.Random(8)


def sentence(n=9):
    return " ".join(f"s{DRAW.randrange(10**6)}" for _ in range(n)).capitalize() + "."


def own(lines=6, size=3):
    return "\n".join(" ".join(sentence() for _ in range(size)) for _ in range(lines))


def pieces(text, **shape):
    c = linededup.chunks([text.encode()], **shape)
    return [text.encode()[a:z] for a, z in zip(c["start"], c["end"])]


def test_chunks_put_together_are_the_text():
    text = own(9) + "\n\nshort\nlines\nhere\n" + own(2, 1)
    assert b"".join(pieces(text)) == text.encode()
    many = [own(2).encode(), None, b"", b" \n ", own(3).encode()]
    together = linededup.chunks(many)
    for i, t in enumerate(many):
        alone = linededup.chunks([t])
        assert (together["hash"][together["of"] == i] == alone["hash"]).all()
        assert (together["start"][together["of"] == i] == alone["start"]).all()


def test_boundaries_resist_shifts():
    passage = "\n".join(sentence(7) for _ in range(40))
    a, b = pieces(passage), pieces("Another line\nand one\n" + passage)
    assert len(set(a) & set(b)) >= len(a) - 2


def run(spark, rows, **options):
    df = documents(spark, rows)
    out = linededup.remove_repeats(df, n_chars="n_chars", **options)
    assert out.columns == [*df.drop("n_removed_words").columns, "n_removed_words"]
    return {(r.doc_id, r.source): r for r in out.collect()}


def test_passage_of_whole_lines_stays_once(spark):
    passage = " ".join(sentence() for _ in range(7))
    texts = {i: own() + "\n" + passage + "\n" + own() for i in (30, 10, 20)}
    clean = {i: own() for i in (5, 40)}
    got = run(spark, [(i, t, "en", "s", len(t)) for i, t in (texts | clean).items()])
    assert got[10, "s"].text == texts[10] and got[10, "s"].n_removed_words == 0
    for i in (20, 30):
        assert got[i, "s"].text == texts[i].replace(passage + "\n", "") and got[i, "s"].n_removed_words == 63
        assert got[i, "s"].n_chars == len(got[i, "s"].text)
    assert all(got[i, "s"].text == t for i, t in clean.items())


def test_passage_of_short_lines_and_within_a_line(spark):
    short = "\n".join(sentence(6) for _ in range(16))
    inline = " ".join(sentence(6) for _ in range(16))
    for passage, glue in ((short, "\n"), (inline, " ")):
        texts = {i: own(3) + glue + passage + glue + own(3) for i in (1, 2, 3)}
        got = run(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
        assert got[1, "s"].text == texts[1]
        for i in (2, 3):
            assert 40 <= got[i, "s"].n_removed_words <= 96 + 12, passage


def test_a_short_line_that_many_share_stays(spark):
    texts = {i: "All rights reserved by us.\n" + own(2) for i in range(20)}
    got = run(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    assert all(got[i, "s"].text == t for i, t in texts.items())


def test_same_words_but_other_bytes_stay(spark):
    passage = " ".join(sentence() for _ in range(7))
    got = run(spark, [(1, passage, "en", "s", 0), (2, passage.replace(" ", "  "), "en", "s", 0)])
    assert got[2, "s"].n_removed_words == 0


def test_edges(spark):
    df = documents(spark)
    got = linededup.remove_repeats(df).collect()
    assert len(got) == 11
    assert sorted((r.text is None, r.doc_id or 0) for r in got if not r.text) == [(False, 3), (True, 2)]
    assert next(r.text for r in got if r.doc_id == 4).startswith("word0 and0") and LONG
    # 5 repeats 1 in both of its rows; the text of 1 is too short to go (19 words)
    assert [r.n_removed_words for r in got if r.doc_id == 5] == [0, 0]


def test_repeated_rows_are_cut_alike(spark):
    text = own(4)
    rows = [(2, text, "en", "a", 0), (2, text, "en", "b", 0), (1, text, "en", "a", 0), (None, text, "en", "a", 0)]
    got = run(spark, rows)
    assert got[1, "a"].text == text
    assert got[2, "a"].text == got[2, "b"].text == got[None, "a"].text == ""


def test_empty(spark):
    assert linededup.remove_repeats(nothing(spark), n_chars="n_chars").collect() == []


def test_two_texts_with_47_words_in_common_share_a_window():
    for k in range(300):
        words = [f"p{DRAW.randrange(10**6)}" for _ in range(47)]
        passage = "".join(w + DRAW.choice([" ", " ", " ", ", ", "\n"]) for w in words).strip()
        a, b = (linededup.windows([(own(2) + DRAW.choice(" \n") + passage + DRAW.choice(" \n") + own(2)).encode()]) for _ in "ab")
        assert set(a["hash"]) & set(b["hash"]), passage


def test_least_by_brute_force():
    for k in range(30):
        h = np.random.default_rng(k).integers(1, 40, 60).astype(np.uint64)
        whole = np.arange(60) < 60 - 7 + 1
        want = {i + j for i in range(54) for j in range(7) if h[i + j] == h[i : i + 7].min()}
        assert set(np.flatnonzero(linededup._least(h, whole, 7))) == want


def test_every_passage_of_51_words_and_more_is_found(spark):
    rows, places = [], {}
    for k in range(120):
        n, lines = DRAW.randrange(51, 101), DRAW.randrange(4, 9)
        words = [f"q{DRAW.randrange(10**6)}" for _ in range(n)]
        glue = "\n" if k % 2 else " "
        step = -(-n // lines)
        passage = glue.join(" ".join(words[i : i + step]) for i in range(0, n, step))
        for copy in range(3):
            text = own(2, 2) + glue + passage + glue + own(2, 2)
            rows.append((3 * k + copy, text, "en", "s", 0))
            places[3 * k + copy] = (text, set(words))
    got = run(spark, rows)
    for i, (text, words) in places.items():
        text, words = places[i]
        after = got[i, "s"].text
        left = sum(w in words for w in after.split())
        if i % 3 == 0:
            assert after == text
        else:
            assert left <= len(words) - 24, text
            assert [w for w in after.split() if w not in words] == [w for w in text.split() if w not in words]


def test_short_passages_that_are_not_repeated_together_stay(spark):
    lines = [" ".join(f"c{k}x{i}" for i in range(8)) + "." for k in range(40)]
    rows = [(k, own(2) + "\n" + line + "\n" + own(2), "en", "s", 0) for k, line in enumerate(lines)]
    mine = "\n".join(lines)
    got = run(spark, [*rows, (100, mine, "en", "s", 0)])
    assert got[100, "s"].text == mine


def test_a_passage_within_its_own_document(spark):
    words = "again and " * 60
    got = run(spark, [(1, words, "en", "s", 0)])
    assert 24 <= len(got[1, "s"].text.split()) <= 72


@pytest.mark.parametrize("line_end", ["\n\n", "\r\n", "\n   ", " \n"])
def test_equal_lines_under_other_line_breaks(spark, line_end):
    lines = [" ".join(f"b{k}x{i}" for i in range(30)) for k in range(20)]
    got = run(spark, [(1, "\n".join(lines), "en", "s", 0), (2, line_end.join(lines), "en", "s", 0)])
    assert got[2, "s"].n_removed_words == 600 and not got[2, "s"].text.strip()
    assert got[1, "s"].text == "\n".join(lines)


def removed_by_brute_force(texts):
    """Words that go from each text, from the chunks of all texts and a dictionary of their bytes."""
    found, spots = {}, []
    for i in sorted(texts):
        t = texts[i].encode()
        bounds = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        c = linededup.windows([t])
        for at, n in sorted(zip(c["at"].tolist(), c["words"].tolist())):
            key = re.sub(rb"\s*\n\s*", b"\n", t[bounds[at][0] : bounds[at + n - 1][1]])
            spots.append((i, at, n, key))
            found.setdefault(key, (i, at))
    gone = {i: set() for i in texts}
    for i, at, n, key in spots:
        kept, first = found[key]
        if i != kept or at >= first + n:
            gone[i].update(range(at, at + n))
    return {i: len(x) for i, x in gone.items()}


@pytest.mark.parametrize("a_task", [5000, 3])
def test_against_brute_force(spark, monkeypatch, a_task):
    monkeypatch.setattr(linededup, "_A_TASK", a_task)
    passages = [own(DRAW.randrange(1, 4), 2).replace(". ", DRAW.choice([". ", ".  ", ".\n"])) for _ in range(8)]
    texts = {}
    for i in range(60):
        parts = [own(1, 2), *DRAW.sample(passages, DRAW.randrange(0, 4)), own(1, 1)]
        if i % 3 == 0:
            parts.append(passages[0])  # one passage in a third of all rows
        DRAW.shuffle(parts)
        texts[i] = DRAW.choice(["\n", " ", "\n\n"]).join(parts)
    texts[60], texts[61] = texts[7], ("round and " * 70).strip()
    got = run(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    want = removed_by_brute_force(texts)
    assert {i: got[i, "s"].n_removed_words for i in texts} == want and sum(want.values()) > 1000


@pytest.mark.parametrize("size", [1, 2, 3, 8, 11])
def test_least_of_some_in_a_row(size):
    draw = np.random.default_rng(size)
    for n in (1, 2, 7, 11, 60):
        h = draw.integers(0, 9, n).astype(np.uint64)
        whole = np.arange(n) <= n - size
        whole[draw.integers(0, n)] = False
        rows = [range(i, i + size) for i in np.flatnonzero(whole)]
        expected = [any(j in row and h[j] == min(h[i] for i in row) for row in rows) or h[j] == 0 for j in range(n)]
        assert linededup._least(h, whole, size).tolist() == expected


def test_saved_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for given in (None, "false"):
        if given:
            spark.conf.set(name, given)
        before = shuffles()
        df = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
        saved = Scratch(spark, "shuffles").saved(df.join(df.withColumnRenamed("n", "m"), "k"))
        end = time.monotonic() + 20
        while shuffles() - before and time.monotonic() < end:
            time.sleep(0.1)
        assert not shuffles() - before
        assert spark.conf.get(name, None) == given
        assert saved.agg(F.sum("n"), F.sum("m")).first()[:] == (10_000, 10_000)
    spark.conf.unset(name)
