"""Row sets with duplicates: difference, delete, insert, and the view check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.functions.expressions import cols
from tideview.operators.digests import where_they_differ
from tideview.operators.joins import matching_rows, rows_without_match

# A row repeated more often than this is written out by several tasks.
COPIES_PER_PIECE = 100_000


def bag_difference(rows: DataFrame, minus: DataFrame) -> DataFrame:
    """``rows EXCEPT ALL minus``: NULLs are equal, duplicates count.

    Copies are counted before the shuffle, so a row that makes up a third of the
    input sends one row per task.
    """
    return _written_out(_surplus(rows, minus).where(F.col("__n") > 0))


def _surplus(rows: DataFrame, minus: DataFrame) -> DataFrame:
    """Each different row with how many copies more ``rows`` has of it, as ``__n``."""
    signed = rows.withColumn("__n", F.lit(1)).unionByName(minus.withColumn("__n", F.lit(-1)))
    return signed.groupBy(*cols(rows.columns)).agg(F.sum("__n").alias("__n")).where(F.col("__n") != 0)


def _written_out(counted: DataFrame) -> DataFrame:
    """Each row ``__n`` times. Very many copies are cut into pieces, which are spread
    again, so that no single task writes them all."""
    names = [c for c in counted.columns if c != "__n"]
    n, piece = F.col("__n"), F.col("__piece")
    few = counted.where(n <= COPIES_PER_PIECE)
    many = (
        counted.where(n > COPIES_PER_PIECE)
        .withColumn("__piece", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / COPIES_PER_PIECE))))
        .withColumn("__n", F.least(F.lit(COPIES_PER_PIECE), n - piece * COPIES_PER_PIECE))
        .repartition(F.xxhash64(*cols(names), piece))
        .drop("__piece")
    )
    copies = F.explode(F.array_repeat(F.lit(True), n.cast("int"))).alias("__c")
    return few.unionByName(many).select(*cols(names), copies).drop("__c")


def delete_matching(result: DataFrame, delta: DataFrame) -> DataFrame:
    """Delete every row that equals a delta row, all its copies included."""
    return rows_without_match(result, delta)


def delete_bag(result: DataFrame, delta: DataFrame) -> DataFrame:
    """Delete one copy per delta row."""
    return bag_difference(result, delta)


def delete_where_exists(result: DataFrame, delta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Delete the rows that agree with a delta row on the given columns."""
    return rows_without_match(result, delta, columns)


def victims(result: DataFrame, delta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows ``delete_where_exists`` deletes."""
    return matching_rows(result, delta, columns)


def insert_rows(result: DataFrame, delta: DataFrame) -> DataFrame:
    """Add rows, matched by column name."""
    return result.unionByName(delta)


def verify_view(result: DataFrame, recomputed: DataFrame, digests: bool = False) -> DataFrame:
    """Rows the result lacks (``missing``) or should not have (``stale``).

    Empty when both are the same bag. Both kinds are always reported, from one count
    of the copies on each side. With ``digests`` both sides are first summed up by bucket, at once, and
    only buckets that differ are counted row by row. That pays where both are expected to be equal.
    """
    if digests:
        recomputed, result = where_they_differ(recomputed.select(*cols(result.columns)), result, result.columns)
    n = F.col("__n")
    problem = F.when(n > 0, "missing").otherwise("stale")
    surplus = _surplus(recomputed, result)
    return _written_out(surplus.select(*cols(result.columns), problem.alias("problem"), F.abs(n).alias("__n")))
