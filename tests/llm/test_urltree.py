import re

import pytest
from pyspark.sql import functions as F

from tideview.llm import urltree
from tideview.llm.queries import URL_RULES

URLS = [
    "http://a.com/x", "https://EXAMPLE.com/en/1?q=/", "http://www.example.com/en/2#z", "http://b.example.com/en", "http://x.net/es/5",
    "http://x.net/fr/", "http://net/es/5", "http://notnet/es/5", "http://x.net/de/5", "ftp://Ünicode.ORG/É/9", "nothing", "", None, "://", "http://com",
    "http://com/", "http://a.com?x=/y", "http://a.b://c.com/d", "http://h.org//a//", "http://h.org/\n/x",
]


def plain(url):
    if not url or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.split(r"[/?#]", after, maxsplit=1)[0]
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def plain_rule(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for name in ("host", "path", "template", "seg", "n", "purity", "segments", "labelled"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_hosts_paths_and_rules(spark):
    got = urltree.judge(pages(spark, URLS), URL_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = plain(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_a_rule_needs_a_path(spark):
    with pytest.raises(ValueError):
        urltree.judge(pages(spark, URLS), [("block", "com")])


def test_templates_wildcards_and_purity(spark):
    rules = [("block", "h.org/tag/spam"), ("allow", "h.org/a/")]
    urls = [f"http://h.org/tag/spam{chr(97 + i)}{chr(97 + k)}" for i in range(10) for k in range(6)]  # 60 blocked, many names
    urls += ["http://h.org/tag/other", "http://h.org/a/1", "http://h.org/a/22", "http://h.org/b/1", "http://g.org/tag/other"]
    got = {r.path if r.host == "h.org" else "g": r for r in urltree.judge(pages(spark, urls), rules).collect()}
    assert got["/tag/other"].template == "/tag/*" and got["/tag/other"].rule is None
    assert got["/tag/other"].verdict == "block" and got["/tag/other"].purity > 0.9
    assert got["g"].verdict == "allow" and got["/b/1"].verdict == "allow"
    assert got["/a/1"].template == got["/a/22"].template


def test_similar_siblings_merge_and_others_do_not(spark):
    rows = [(host, seg, n) for host, seg, n in [("h", ["en", "{n}"], 100), ("h", ["de", "{n}"], 90), ("h", ["img", "x.png"], 80)]]
    counts = spark.createDataFrame(rows, "host string, segments array<string>, n long").withColumn("labelled", F.lit(0).cast("long"))
    counts = counts.withColumn("blocked", F.lit(0).cast("long"))
    from tideview.llm.common import Scratch

    got = {tuple(r.segments): r.template for r in urltree.templates(counts, Scratch(spark, "t")).collect()}
    assert got == {("en", "{n}"): "/~en/{n}", ("de", "{n}"): "/~en/{n}", ("img", "x.png"): "/img/x.png"}


def test_empty_repeated_and_deep(spark):
    assert urltree.judge(pages(spark, []), URL_RULES).collect() == []
    urls = ["http://d.org/" + "a/" * 5000] * 3 + ["http://d.org/" + "1" * 50_000]
    got = urltree.judge(pages(spark, urls), URL_RULES).collect()
    assert len(got) == 4 and len({r.template for r in got}) == 2
