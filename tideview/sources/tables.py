"""Base tables, literal rows and the key check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.functions.expressions import any_of, cols


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of one parquet table; filters and column choice reach the files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows written out in the program, e.g. a hand-made change."""
    return spark.createDataFrame(list(rows), schema)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not unique or hold a NULL, with how often they occur.

    The count is combined before the shuffle, so a key that fills a third of the
    table still sends one row per task.
    """
    names = list(keys)
    counted = df.groupBy(*cols(names)).agg(F.count(F.lit(1)).alias("__n"))
    found = counted.where((F.col("__n") > 1) | any_of(c.isNull() for c in cols(names)))
    return found.toDF(*names, "n" if "n" not in names else "n_rows")


def keys_look_sound(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no key holds a NULL and no two rows have a key of the same hash; then ``key_violations`` is
    empty. Only hashes are shuffled, so a large table with sound keys is checked at a fraction of the cost."""
    names = list(keys)
    null = any_of(c.isNull() for c in cols(names))
    hashed = df.select(F.xxhash64(*cols(names)).alias("__h"), null.alias("__null"))
    counted = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"), F.max("__null").alias("__null"))
    return counted.where("__n > 1 or __null").isEmpty()
