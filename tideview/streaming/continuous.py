"""Keep the views of a workspace up to date from streams of change files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tideview.plans.workspace import Workspace


def feed_schema(rows: T.StructType) -> T.StructType:
    """Schema of change files for a table with the given columns."""
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", rows),
            T.StructField("after", rows),
            T.StructField("seq", T.LongType()),
        ]
    )


def change_stream(
    work: Workspace, folders: Mapping[str, str], max_files: int | None = None
) -> DataFrame:
    """One stream of the change files of several tables, marked with their table."""
    out = None
    for source, folder in folders.items():
        reader = work.spark.readStream.schema(feed_schema(work.table(source).schema))
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        part = reader.parquet(folder).select(
            F.lit(source).alias("source"),
            "op",
            "seq",
            F.col("before").alias(f"before_{source}"),
            F.col("after").alias(f"after_{source}"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no change folder given")
    return out


def apply_batch(
    work: Workspace, sources: list[str], rows: DataFrame, writer: str, number: int
) -> None:
    """Apply one micro-batch. A batch that is replayed changes nothing.

    The stream is known by ``writer``, its checkpoint folder: a new checkpoint
    counts its batches from the start again and must not be taken for a replay.
    Rows of one key are folded in ``seq`` order before the views are touched, and a change
    that is older than one of an earlier batch is dropped.
    """
    feeds = {
        s: rows.where(F.col("source") == s).select(
            "op", F.col(f"before_{s}").alias("before"), F.col(f"after_{s}").alias("after"), "seq"
        )
        for s in sources
    }
    work.apply_ordered(feeds, (writer, number))


def start(
    work: Workspace,
    folders: Mapping[str, str],
    checkpoint: str,
    max_files: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start maintenance; by default it takes all files there are and stops.

    ``trigger`` is passed to Spark, e.g. ``processingTime="1 minute"``.
    """
    sources = list(folders)
    return (
        change_stream(work, folders, max_files)
        .writeStream.foreachBatch(lambda rows, number: apply_batch(work, sources, rows, checkpoint, number))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
