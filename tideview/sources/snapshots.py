"""A keyed row set kept as versions in a folder.

A version is a small manifest that names parquet folders: folders of rows and
folders of keys that went. Publishing a change adds one folder of each kind and
then one manifest, so its cost follows the change; readers see the version whose
manifest they find, whole. What a reader pays for the keys that went is bounded
by folding them in (``compact``) once they have grown.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import cols, keys_match, quoted, renamed
from tideview.operators.joins import broadcast_limit
from tideview.sources.storage import PLAIN, Files, plan_bytes

VERSION = "__version"
BUCKET = "__bucket"
PLACE = "__place"

# A writer's name and its running number, e.g. a stream's checkpoint and micro-batch.
Batch = tuple[str, int]


@dataclass(frozen=True)
class Step:
    """Keys that leave the row set, then rows that enter it; either may be None.

    ``gone`` and ``covered`` may say the same as ``removed`` in a shorter way: values of some of the key columns
    with which all rows leave, and whole keys of further rows, in which these columns are NULL.
    """

    removed: DataFrame | None
    added: DataFrame | None
    gone: DataFrame | None = None
    covered: DataFrame | None = None


def live_rows(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not removed after they were added.

    Keys may be NULL in part (a stored view row lacks some tables), so they are
    compared null-safe. A key removed by several versions is there several times, which does no harm.
    """
    later = F.expr(f"{keys_match(keys, '__g', '<=>')} and {VERSION} < __gone")
    return rows.join(gone.selectExpr(*renamed(keys, "__g"), f"{VERSION} as __gone"), later, "left_anti")


def number_steps(steps: Sequence[Step], first: int) -> tuple[DataFrame | None, DataFrame | None]:
    """All added rows and all removed keys of the steps, with their version."""
    added = [
        s.added.withColumn(VERSION, F.lit(first + i)) for i, s in enumerate(steps) if s.added is not None
    ]
    removed = [
        s.removed.withColumn(VERSION, F.lit(first + i))
        for i, s in enumerate(steps)
        if s.removed is not None
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return union(added), union(removed)


def apply_steps(stored: DataFrame, steps: Sequence[Step], keys: Sequence[str]) -> DataFrame:
    """The row set after the steps; with one anti join however many there are if none has ``gone``."""
    if len(steps) == 1 or any(s.gone is not None for s in steps):
        for step in steps:
            stored = _after_step(stored, step, keys)
        return stored
    added, removed = number_steps(steps, 1)
    rows = stored.withColumn(VERSION, F.lit(0))
    if added is not None:
        rows = rows.unionByName(added)
    if removed is not None:
        rows = live_rows(rows, removed, keys)
    return rows.drop(VERSION)


def _after_step(rows: DataFrame, step: Step, keys: Sequence[str]) -> DataFrame:
    if step.gone is None:
        if step.removed is not None:
            rows = rows.join(step.removed.selectExpr(*renamed(keys, "__g")), F.expr(keys_match(keys, "__g", "<=>")), "left_anti")
        return rows if step.added is None else rows.unionByName(step.added)
    names = step.gone.columns
    gone = step.gone.selectExpr(*renamed(names, "__g"))
    out = rows.join(gone, F.expr(keys_match(names, "__g")), "left_anti")
    if step.covered is not None:  # the others need not be compared with these
        without = F.col(quoted(names[0])).isNull()
        covered = step.covered.selectExpr(*renamed(keys, "__g"))
        alone = rows.where(without).join(covered, F.expr(keys_match(keys, "__g", "<=>")), "left_anti")
        out = out.where(~without).unionByName(alone)
    return out if step.added is None else out.unionByName(step.added)


@dataclass(frozen=True)
class Cluster:
    """How the first folder of a store is laid out: ``buckets`` folders by the hash of a column."""

    column: str
    buckets: int

    def of(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Manifest:
    number: int
    rows: tuple[str, ...]
    gone: tuple[str, ...]
    next_version: int
    batches: Mapping[str, int]

    def has(self, batch: Batch | None) -> bool:
        """Whether this batch, or a later one of the same writer, is in this version."""
        return batch is not None and batch[1] <= self.batches.get(batch[0], -1)

    def batches_with(self, batch: Batch | None) -> dict[str, int]:
        return {**self.batches, **({} if batch is None else {batch[0]: batch[1]})}


class SnapshotStore:
    """Versions of one keyed row set below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._files = Files(spark)
        head = json.loads(self._files.read_text(f"{self.root}/store.json"))
        self.keys: list[str] = head["keys"]
        self.schema = T.StructType.fromJson(head["schema"])
        self.cluster = Cluster(**head["cluster"]) if head.get("cluster") else None

    @classmethod
    def create(
        cls, spark: SparkSession, root: str, rows: DataFrame, keys: Sequence[str], cluster: Cluster | None = None
    ) -> SnapshotStore:
        """A new store whose version 0 are ``rows``.

        With ``cluster`` the bulk of the rows is kept in buckets, so that a reader who
        knows which values it wants skips the other folders. Later changes are not, until they are folded in.

        All or nothing: a load that fails leaves no store, and what one that was killed has left
        (there is no version, so it is no store) is cleared away.
        """
        root, files = root.rstrip("/"), Files(spark)
        if cls.exists(spark, root):
            raise FileExistsError(root)
        files.delete(root)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
        files.write_new(
            f"{root}/store.json",
            json.dumps({"keys": list(keys), "schema": schema.jsonValue(), "cluster": cluster and vars(cluster)}),
        )
        store = cls(spark, root)
        try:
            path = store._write_all(rows.withColumn(VERSION, F.lit(0)))
        except Exception:
            files.delete(root)
            raise
        store._switch(Manifest(0, (path,), (), 1, {}))
        return store

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return bool(SnapshotStore._numbers(Files(spark), root.rstrip("/")))

    # --- reading -------------------------------------------------------------

    @staticmethod
    def _numbers(files: Files, root: str) -> list[int]:
        names = files.names(f"{root}/versions")
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        if number is None:
            number = self._numbers(self._files, self.root)[-1]
        d = json.loads(self._files.read_text(f"{self.root}/versions/{number:010d}.json"))
        return Manifest(number, tuple(d["rows"]), tuple(d["gone"]), d["next_version"], d["batches"])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        m = self.manifest(number)
        out = self._rows(m)
        if m.gone:
            out = live_rows(out, self._scan(m.gone, self.keys), self.keys)
        return out.drop(VERSION, BUCKET)

    def parts(self, number: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(rows, keys that went) of a version, both with their versions; (rows, None) if none went.

        Rows of a clustered store have their bucket in ``BUCKET``.
        """
        m = self.manifest(number)
        rows = self._rows(m)
        return (rows, self._scan(m.gone, self.keys)) if m.gone else (rows.drop(VERSION), None)

    def _rows(self, m: Manifest) -> DataFrame:
        names = self.schema.fieldNames()
        if self.cluster is None:
            return self._scan(m.rows, names)
        out = self._scan(m.rows[:1], names, [T.StructField(BUCKET, T.IntegerType())])
        if m.rows[1:]:
            late = self._scan(m.rows[1:], names)
            out = out.unionByName(late.withColumn(BUCKET, self.cluster.of(F.col(quoted(self.cluster.column)))))
        return out

    def _scan(self, folders: Sequence[str], names: Sequence[str], more: Sequence[T.StructField] = ()) -> DataFrame:
        fields = [self.schema[n] for n in names] + [T.StructField(VERSION, T.IntegerType()), *more]
        paths = [f"{self.root}/data/{f}" for f in folders]
        return self.spark.read.schema(T.StructType(fields)).parquet(*paths)

    # --- publishing ------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{uuid.uuid4().hex}-{kind}"
        # Keys that went are joined when reading: their size must be plain to Spark.
        options = PLAIN if kind == "gone" else {}
        df.write.options(**options).parquet(f"{self.root}/data/{folder}")
        return folder

    def _write_all(self, df: DataFrame) -> str:
        """Write what becomes the first folder. A bucket's rows are spread over a few tasks by key."""
        if self.cluster is None:
            return self._write(df, "rows")
        folder = f"{uuid.uuid4().hex}-rows"
        self._write_placed(self._placed(df).repartition(BUCKET, PLACE), folder)
        return folder

    def _write_placed(self, rows: DataFrame, folder: str) -> None:
        sorted_rows = rows.drop(PLACE).sortWithinPartitions(BUCKET, *cols(self.keys))
        sorted_rows.write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")

    def _placed(self, df: DataFrame) -> DataFrame:
        """With the bucket of each row and the task of that bucket it falls to."""
        bucket = self.cluster.of(F.col(quoted(self.cluster.column)))
        return df.withColumns({BUCKET: bucket, PLACE: F.pmod(F.xxhash64(*cols(self.keys)), F.lit(8))})

    def _fold(self, m: Manifest) -> str:
        """Write the version anew, as the first folder of the next one.

        Rows of a clustered store and keys that went are both dealt out as the rows will be written, and compared
        there, so that the rows are shuffled once and not once for the comparison and once for the buckets.
        """
        version = F.lit(m.next_version)
        gone = self._scan(m.gone, self.keys) if m.gone else None
        if not self.cluster or gone is None or plan_bytes(gone) <= broadcast_limit(gone) or not self._hash_alike():
            return self._write_all(self.read(m.number).withColumn(VERSION, version))
        folder = f"{uuid.uuid4().hex}-rows"
        rows = self._placed(self._rows(m)).repartition(BUCKET, PLACE)
        names = [BUCKET, PLACE, *self.keys]
        went = self._placed(gone).selectExpr(*renamed(names, "__g"), f"{VERSION} as __gone").repartition("__g0", "__g1")
        # Spark would put an anti join before the dealing out, and shuffle for each.
        paired = rows.join(went, F.expr(f"{keys_match(names, '__g')} and {VERSION} < __gone"), "left")
        live = paired.where("__gone is null").select(*cols(rows.columns))
        self._write_placed(live.withColumn(VERSION, version), folder)
        return folder

    def _hash_alike(self) -> bool:
        """Whether equal keys have equal hashes, as those of floating point or with a collation need not."""
        exact = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.DecimalType, T.BinaryType)
        kinds = [self.schema[k].dataType for k in self.keys]
        return all(isinstance(k, exact) or k == T.StringType() for k in kinds)

    def _switch(self, m: Manifest) -> None:
        text = json.dumps(
            {"rows": m.rows, "gone": m.gone, "next_version": m.next_version, "batches": m.batches}
        )
        self._files.write_new(f"{self.root}/versions/{m.number:010d}.json", text)

    def done(self, batch: Batch | None) -> bool:
        """Whether a numbered batch has been published already."""
        return self.manifest().has(batch)

    def publish(self, steps: Sequence[Step], batch: Batch | None = None) -> int:
        """Write what the steps add and remove, then switch to the new version.

        A batch number that was published before is skipped, so a replay after a
        crash changes nothing. Two writers cannot create the same version: the
        slower one fails and has to start over from the new state.
        """
        m = self.manifest()
        if m.has(batch):
            return m.number
        added, removed = number_steps(steps, m.next_version)
        names = self.schema.fieldNames()
        jobs = []
        if added is not None:
            jobs.append((added.select(*cols(names), VERSION), "rows"))
        if removed is not None:
            jobs.append((removed.select(*cols(self.keys), VERSION), "gone"))
        # The two are independent; side by side they share the executors.
        with ThreadPoolExecutor(2) as pool:
            folders = list(pool.map(lambda job: self._write(*job), jobs))
        rows = m.rows + tuple(f for f in folders if f.endswith("-rows"))
        gone = m.gone + tuple(f for f in folders if f.endswith("-gone"))
        number, version = m.number + 1, m.next_version + max(1, len(steps))
        self._switch(Manifest(number, rows, gone, version, m.batches_with(batch)))
        return number

    def replace(self, rows: DataFrame, batch: Batch | None = None) -> int:
        """Publish ``rows`` as the whole new content."""
        m = self.manifest()
        if m.has(batch):
            return m.number
        path = self._write_all(rows.select(*cols(self.schema.fieldNames())).withColumn(VERSION, F.lit(m.next_version)))
        self._switch(Manifest(m.number + 1, (path,), (), m.next_version + 1, m.batches_with(batch)))
        return m.number + 1

    # --- upkeep ------------------------------------------------------------------

    def compact(self, above: float = 0.0, most_folders: int = 50) -> bool:
        """Keep reading cheap; true if there was something to do.

        When the changes exceed ``above`` of the first folder all is written anew. When
        they are merely many, they are put together and the first folder stays.
        """
        m = self.manifest()
        changes = (*m.rows[1:], *m.gone)
        if not changes:
            return False
        sizes = [self._files.size(f"{self.root}/data/{f}") for f in (m.rows[0], *changes)]
        if sum(sizes[1:]) > above * sizes[0]:
            path = self._fold(m)
            folded = replace(m, rows=(path,), gone=(), next_version=m.next_version + 1)
        elif len(changes) > most_folders:
            rows, gone = m.rows[:1], ()
            if m.gone:
                removed = self._scan(m.gone, self.keys)
                last = removed.groupBy(*cols(self.keys)).agg(F.max(VERSION).alias(VERSION))
                gone = (self._write(last, "gone"),)
            if m.rows[1:]:
                added = self._scan(m.rows[1:], self.schema.fieldNames())
                if m.gone:
                    added = live_rows(added, removed, self.keys)
                rows += (self._write(added, "rows"),)
            folded = replace(m, rows=rows, gone=gone)
        else:
            return False
        self._switch(replace(folded, number=m.number + 1))
        return True

    def expire(self, keep: int = 2) -> None:
        """Delete versions but the newest ``keep``, and the data only they use.

        Data of a publish under way is younger than the newest version and would be
        taken for waste: call this from the writer only.
        """
        numbers = self._numbers(self._files, self.root)
        used = set()
        for n in numbers[-keep:]:
            m = self.manifest(n)
            used |= {*m.rows, *m.gone}
        for n in numbers[:-keep]:
            self._files.delete(f"{self.root}/versions/{n:010d}.json")
        for folder in self._files.names(f"{self.root}/data"):
            if folder not in used:
                self._files.delete(f"{self.root}/data/{folder}")

    def drop(self) -> None:
        """Remove the store: manifests first, so that no reader finds half of it."""
        self._files.delete(f"{self.root}/versions")
        self._files.delete(self.root)
