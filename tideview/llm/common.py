"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideview.sources.storage import Files, shared_dir, shuffles_removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written into the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[tuple[DataFrame, str]] = []

    def saved(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.path}/{self._n:03d}-{name}"
        self._n += 1
        with shuffles_removed(self.spark):  # a plan of its own is executed, no one else reads its shuffles
            df.write.parquet(path)
        self._saved.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self._saved[-1][0]

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``saved`` returned and nothing reads any more."""
        Files(self.spark).delete(next(path for saved, path in self._saved if saved is df))

    def local_path(self, name: str) -> str:
        """A name below the folder for tasks that write files of their own."""
        return f"{self.path}/{name}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to put beside those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % by


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.binary()).to_pylist()


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six characters."""
    return text.split() if text else []


Batches = Iterator[pa.RecordBatch]


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """For mapInArrow: one output batch for each input batch, pieces of at most ``PIECE`` rows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                yield function(batch.slice(start, PIECE))

    return run


#: Rows of a batch that are worked on at a time; only memory depends on it.
PIECE = 2000


def uniform(doc_id: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


