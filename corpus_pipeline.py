"""From raw documents to a weighted training set, one operator of tideview.llm per stage.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideview.llm import decontaminate, linededup, mixing, nbsvm, simhash
from tideview.llm.common import Scratch, table
from tideview.llm.queries import domain_labels, quality_labels

#: Shares of tokens that the last stage aims at; the first stage has removed poor documents.
TARGETS = {"good": 0.98, "toxic": 0.02}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = nbsvm.train(docs, quality_labels(table(spark, sf_dir, "labels")))
    return nbsvm.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars follows the text."""
    return linededup.remove_repeats(docs, n_chars="n_chars").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Documents without a word, as line dedup may leave behind, form one such group.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left with its domain posteriors, its rate, and how often to take it."""
    return mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), TARGETS)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
]

#: SQL can't express the classifiers, so there is none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
