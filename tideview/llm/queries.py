"""One query for each operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.llm import convrepair, crf, decontaminate, divergence, linededup, mixing, nbsvm, secrets, simhash, tokenalign, toolcalls, trie, urltree
from tideview.llm.common import remainder, table

#: Shares of tokens that op9 and the last stage of the pipeline aim at.
TARGETS = {"good": 0.93, "poor": 0.05, "toxic": 0.02}
#: Verdict, and host with the start of a path.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def quality_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows that may be learnt from."""
    return labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic, poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op2_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.extract(table(spark, sf_dir, "pages"))


def op3_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 1
    scored = trie.score(docs, trie.build(docs.where(~held_out), order=3))
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


#: Tools that turns_as_calls makes calls of.
TURN_SCHEMA = {
    "type": "object",
    "properties": {
        "prompt": {"type": "string", "minLength": 1},
        "turn": {"type": "integer", "minimum": 0},
        "role": {"type": "string", "enum": ["user", "system"]},
    },
    "required": ["prompt", "turn", "role"],
    "additionalProperties": False,
}


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as linked, ordered and validated calls."""
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, {"reply": TURN_SCHEMA, "instruct": TURN_SCHEMA})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.train(docs, quality_labels(table(spark, sf_dir, "labels")))
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return nbsvm.classify(docs, model).select("doc_id", held_out, "score", "predicted")


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after the repeated passages are cut out."""
    cut = linededup.remove_repeats(table(spark, sf_dir, "documents"), n_chars="n_chars")
    return cut.select("doc_id", "n_removed_words", "n_chars", "text")


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("text_hash")


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domain_labels(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels, TARGETS)


def op10_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align(table(spark, sf_dir, "documents"))


def op13_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is the owner, source and language are the repository."""
    return secrets.scan(table(spark, sf_dir, "documents"), owner="source", repo=["source", "lang"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_divergence": op1_divergence,
        "op2_crf": op2_crf,
        "op3_trie": op3_trie,
        "op4_tool_calls": op4_tool_calls,
        "op5_simhash": op5_simhash,
        "op6_nbsvm": op6_nbsvm,
        "op7_line_chunks": op7_line_chunks,
        "op8_prefix_join": op8_prefix_join,
        "op9_soft_mixing": op9_soft_mixing,
        "op10_url_tree": op10_url_tree,
        "op11_repair": op11_repair,
        "op12_align": op12_align,
        "op13_ownership": op13_ownership,
    }


_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP8 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, m, list_slice(w, s, s + m - 1) as x from (
    select item_id, w, least(13, len(w)) as m, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s
    from i where len(w) > 0)),
pos as (select doc_id, m, s, list_slice(w, s, s + m - 1) as x from (
    select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as s
    from d, (select distinct m from win) where len(w) >= m)),
hits as (select doc_id, s, pos.m, item_id from pos join win on pos.m = win.m and pos.x = win.x),
hit as (select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(range(s, s + m)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join hit using (doc_id) left join named using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are tested against brute force."""
    return {"op8_prefix_join": _OP8}
