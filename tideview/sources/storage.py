"""Shared folder, staged tables and the few file operations needed.

Everything that has to outlive a lost executor is written below the folder the
cluster names in ``spark.checkpoint.dir``. Staging a DataFrame as parquet (and
not caching it) has a second use: the scan of a staged table knows its real
size, so Spark's own broadcast threshold decides on facts. To make the file size
tell the data's size, staged tables are written without dictionaries, and without compression
if that hides much of it: a value repeated a billion times must not look small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL_DEFAULT: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Only a local master without the setting gets a folder made for it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DEFAULT:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        _LOCAL_DEFAULT[app] = "file://" + tempfile.mkdtemp(prefix="tideview-")
    return _LOCAL_DEFAULT[app]


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for scans the size of the files read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def row_width(df: DataFrame) -> int:
    """Spark's default size of a row of these columns."""
    return max(8, df._jdf.schema().defaultSize())


def broadcast_limit(df: DataFrame) -> int:
    """Spark's own bound for a broadcast side, in bytes."""
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed in here leaves no shuffle files. Else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


PLAIN = {"compression": "snappy", "parquet.enable.dictionary": "false"}
# Files from this size up to Spark's broadcast bound are looked at; their rows may be so many times larger at most.
_LOOKED_AT, _HIDDEN = 64 << 10, 8


class Staging:
    """Tables written once and read several times during one maintenance run."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{root or shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        self._written: list[DataFrame] = []
        self._paths: list[str] = []

    def has(self, df: DataFrame) -> bool:
        """Whether ``df`` is a scan that ``table`` or ``scan`` returned."""
        return any(df is w for w in self._written)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = f"{self.path}/{len(self._written):03d}-{name}"
        with shuffles_removed(df.sparkSession):  # a plan of its own is executed, no one else reads its shuffles
            df.write.options(**PLAIN).parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        size = plan_bytes(written)
        if _LOOKED_AT <= size <= broadcast_limit(written) and written.count() * row_width(written) > _HIDDEN * size:
            written.write.options(**{**PLAIN, "compression": "uncompressed"}).parquet(f"{path}-plain")
            Files(self.spark).delete(path)
            path += "-plain"
        return self.scan(path, df.schema)

    def path_of(self, df: DataFrame) -> str:
        """Where ``table`` wrote it."""
        return next(p for w, p in zip(self._written, self._paths) if w is df)

    def scan(self, path: str, schema: T.StructType) -> DataFrame:
        """A table that a staging wrote, maybe in an earlier run."""
        self._written.append(self.spark.read.schema(schema).parquet(path))
        self._paths.append(path)
        return self._written[-1]

    def close(self) -> None:
        """Delete the staged tables; results that still read them become invalid."""
        Files(self.spark).delete(self.path)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class Files:
    """Hadoop file system calls, so any storage Spark can write to works."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength())

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Create a file; fails if it exists. It appears under its name only when whole."""
        fs, p = self._at(path)
        if fs.exists(p):
            raise FileExistsError(path)
        draft = p.suffix("." + uuid.uuid4().hex + ".tmp")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not fs.rename(draft, p):
            fs.delete(draft, False)
            raise FileExistsError(path)
