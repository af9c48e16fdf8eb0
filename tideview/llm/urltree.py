"""URL filters: rules by host and path, and a tree of path templates for what no rule fits.

A rule names a host and the start of a path, and fits that host and its subdomains; of several the longest decides.
The urls that rules judge are the labelled ones. For the others, each host has a tree of path templates:

1. Digits in a segment become ``{n}``, so paths that differ in numbers are one.
2. Level by level, a node with more than ``fanout`` different segments gets the wildcard ``*``
   for all of them: the segment is variable.
3. Siblings that are left are compared with the most frequent one of their node. If the
   Jensen-Shannon distance of what follows them is at most ``similar + noise / sqrt(n)``, and the
   labelled ones among them are blocked alike (or neither has labelled urls), they are merged.
4. A template's purity is blocked / (labelled + smoothing): ``smoothing`` more urls count as allowed, so it
   takes evidence to block. Urls of a template with a purity above ``reject`` are blocked.

Segments beyond ``max_depth`` count as one. The tree is built from counts by template, never from
the urls of a host in one place.

Defined results: a null url, or one without ``://``, has an empty host and path, fits
no rule and forms a template of its own. A rule without ``/`` is refused. Only A-Z is lower-cased, in hosts alone. An empty path does not
start with ``/``. Repeated rows count each. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both are empty strings for a null url and one without ``://``."""
    after = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: str, path: str, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, text) that fits, as a struct; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r)):
        if "/" not in rule:
            raise ValueError(f"a rule is a host and the start of a path: {rule!r}")
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _kinds(path: str, max_depth: int) -> Column:
    """Segments with numbers replaced; a leading slash gives no segment, a closing one gives an empty one."""
    plain = F.regexp_replace(F.regexp_replace(F.col(path), "^/", ""), "[0-9]+", "{n}")
    return F.split(plain, "/", max_depth)


def templates(counts: DataFrame, scratch: Scratch, fanout: int = 20, similar: float = 0.15, noise: float = 1.0) -> DataFrame:
    """host, segments, template for every row of ``counts`` (host, segments, n, labelled, blocked)."""
    state = scratch.saved(counts.withColumn("template", F.lit("")), "level")
    depth = state.agg(F.max(F.size("segments"))).first()[0] or 0  # at most max_depth
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    node = ["host", "template"]
    for level in range(depth):
        deep = F.size("segments") > level
        seg = F.when(deep, F.col("segments")[level])
        following = F.when(F.size("segments") > level + 1, F.element_at("segments", level + 2)).otherwise(F.lit("$"))
        here = state.where(deep).withColumn("seg", seg).withColumn("next", following)
        width = here.select(*node, "seg").distinct().groupBy(*node).agg((F.count("*") > fanout).alias("wide"))
        kids = here.groupBy(*node, "seg", "next").agg(*sums).join(width, node)
        kids = kids.withColumn("sign", F.when(F.col("wide"), F.lit("*")).otherwise(F.col("seg")))
        kids = scratch.saved(kids, "kids")
        total = kids.groupBy(*node, "sign").agg(*sums)
        leader = total.groupBy(*node).agg(F.max(F.struct("n", "sign", "labelled", "blocked")).alias("first"))
        spread = kids.groupBy(*node, "sign", "next").agg(F.sum("n").alias("m"))
        mine = spread.join(total.select(*node, "sign", "n"), [*node, "sign"])
        share = mine.select(*node, "sign", "next", (F.col("m") / F.col("n")).alias("p"))
        lead = leader.select(*node, F.col("first.sign").alias("sign")).join(share, [*node, "sign"])
        lead = lead.select(*node, "next", F.col("p").alias("q"))
        # 1 - JSD (base 2) is a sum over what both have: terms of one side alone add p / 2 each.
        p, q = F.col("p"), F.col("q")
        common = share.join(lead, [*node, "next"]).groupBy(*node, "sign").agg(
            F.sum(p * F.log2((p + q) / p) + q * F.log2((p + q) / q)).alias("overlap")
        )
        near = total.join(leader, node).join(common, [*node, "sign"], "left")
        js = F.sqrt(F.greatest(1 - F.coalesce("overlap", F.lit(0.0)) / 2, F.lit(0.0)))
        rate = lambda b, n: (b + 1) / (n + 2)
        both = (F.col("labelled") > 0) & (F.col("first.labelled") > 0)
        neither = (F.col("labelled") == 0) & (F.col("first.labelled") == 0)
        alike = F.abs(rate(F.col("blocked"), F.col("labelled")) - rate(F.col("first.blocked"), F.col("first.labelled"))) < 0.25
        merged = (js <= similar + noise / F.sqrt("n")) & (neither | (both & alike))
        name = F.when(merged, F.col("first.sign")).otherwise(F.col("sign"))
        siblings = near.select(*node, "sign", name.alias("name"))
        # A merged branch shows by ~ that it stands for several.
        many = siblings.groupBy(*node, "name").agg((F.count("*") > 1).alias("many"))
        siblings = siblings.join(many, [*node, "name"])
        shown = F.when(F.col("many"), F.concat(F.lit("~"), "name")).otherwise(F.col("name"))
        named = kids.select(*node, "seg", "sign").distinct().join(siblings, [*node, "sign"])
        named = scratch.saved(named.select(*node, "seg", shown.alias("shown")), "named")
        moved = state.withColumn("seg", seg).join(named, [*node, "seg"], "left")
        longer = F.when(F.col("shown").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "shown"))
        moved = moved.withColumn("template", longer)
        state = scratch.saved(moved.select("host", "segments", "n", "labelled", "blocked", "template"), "level")
    return state


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    page_id: str = "page_id",
    url: str = "url",
    max_depth: int = 6,
    smoothing: float = 5.0,
    reject: float = 0.5,
    **tree,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "urltree")
    host, path = host_and_path(url)
    parsed = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    found = rule_of("host", "path", rules)
    parsed = parsed.select("*", found["rule"].alias("rule"), found["verdict"].alias("given"))
    parsed = parsed.withColumn("segments", _kinds("path", max_depth))
    counts = parsed.groupBy("host", "segments").agg(
        F.count("*").alias("n"),
        F.count("given").alias("labelled"),
        F.count(F.when(F.col("given") == "block", 1)).alias("blocked"),
    )
    placed = templates(counts, scratch, **tree)
    pure = placed.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    pure = pure.withColumn("purity", F.round(F.col("b") / (F.col("l") + smoothing), 9))
    judged = placed.select("host", "segments", "template").join(pure, ["host", "template"])
    judged = scratch.saved(judged.select("host", "segments", "template", "purity"), "purity")
    verdict = F.coalesce("given", F.when(F.col("purity") > reject, "block").otherwise("allow"))
    return parsed.join(judged, ["host", "segments"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )
