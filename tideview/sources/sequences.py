"""The last sequence number of each key, for streams whose batches may come out of order.

Numbers are appended in layers; what a key has is the largest number in any of them, so a
batch removes nothing and rewrites nothing. A layer is cut into buckets by the hash of the key, more of them the larger
it is, and a reader who asks for some keys reads only the buckets that these fall into. Layers of about one
size are merged once there are four, so a row is rewritten about as often as the logarithm of the table's size, and
a reader meets few layers. A small layer has one bucket and is read whole; its size is bounded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideview.functions.expressions import cols, keys_match, quoted, renamed
from tideview.operators.joins import distinct_if_large
from tideview.sources.snapshots import Batch
from tideview.sources.storage import Files

SLOT = "__slot"
#: Rows of a bucket that are aimed at, and the most buckets of a layer.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 1 << 16
#: So many layers of one size are merged; sizes differ by this factor.
_FAN = 4
#: Up to so many buckets are named one by one; beyond that the layer is listed.
_NAMED = 256


@dataclass(frozen=True)
class Layer:
    folder: str
    buckets: int
    rows: int

    @property
    def size(self) -> int:
        """Layers of one size class are merged."""
        n, k = max(self.rows, 1), 0
        while n >= _FAN:
            n, k = n // _FAN, k + 1
        return k


class SequenceLog:
    """Numbers by key below ``root``, with the batches that wrote them."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[T.StructField], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.fields = spark, root.rstrip("/"), list(keys)
        self.keys = [f.name for f in keys]
        self.bucket_rows = bucket_rows
        self._files = Files(spark)
        self.schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in keys], T.StructField("seq", T.LongType())])

    # --- versions -------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        names = self._files.names(f"{self.root}/versions")
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))

    def _version(self, number: int) -> tuple[list[Layer], dict[str, int]]:
        text = self._files.read_text(f"{self.root}/versions/{number:010d}.json")
        d = json.loads(text)
        return [Layer(**x) for x in d["layers"]], d["batches"]

    def _newest(self) -> tuple[int, list[Layer], dict[str, int]]:
        numbers = self._numbers()
        return (numbers[-1], *self._version(numbers[-1])) if numbers else (-1, [], {})

    @property
    def layers(self) -> list[Layer]:
        return self._newest()[1]

    def done(self, batch: Batch) -> bool:
        """Whether this batch, or a later one of its writer, was appended."""
        return batch[1] <= self._newest()[2].get(batch[0], -1)

    # --- reading ----------------------------------------------------------------------

    def _slot(self, buckets: int) -> Column:
        typed = [F.col(quoted(f.name)).cast(f.dataType) for f in self.fields]
        return F.pmod(F.xxhash64(*typed), F.lit(buckets)).cast("int")

    def _scan(self, layer: Layer, slots: set[int] | None = None) -> DataFrame | None:
        """A layer, or those of its buckets that are asked for."""
        folder = f"{self.root}/data/{layer.folder}"
        reader = self.spark.read.schema(self.schema)
        if slots is None or len(slots) >= layer.buckets:
            return reader.parquet(folder).select(*self.schema.names)
        if len(slots) > _NAMED:
            whole = self.spark.read.schema(T.StructType([*self.schema, T.StructField(SLOT, T.IntegerType())]))
            return whole.parquet(folder).where(F.col(SLOT).isin(sorted(slots))).select(*self.schema.names)
        there = set(self._files.names(folder))
        paths = [f"{folder}/{name}" for name in (f"{SLOT}={s}" for s in sorted(slots)) if name in there]
        return reader.parquet(*paths) if paths else None

    def last(self, wanted: DataFrame) -> DataFrame:
        """The keys of ``wanted`` that have a number, with their largest.

        ``wanted`` has the key columns and is read twice. The bucket numbers that come to the driver are at most
        as many as the buckets of the largest layer.
        """
        layers = self.layers
        most = max((layer.buckets for layer in layers), default=1)
        slots: set[int] | None = None
        if most > 1:
            # Numbers of buckets are powers of two, so the finest cut gives the others.
            slots = {r[0] for r in wanted.select(self._slot(most).alias("s")).distinct().take(most)}
        parts = [self._scan(x, slots if slots is None or x.buckets == most else {s % x.buckets for s in slots}) for x in layers]
        parts = [p for p in parts if p is not None]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        keys = distinct_if_large(wanted.selectExpr(*renamed(self.keys, "__w")))
        met = [p.join(keys, F.expr(keys_match(self.keys, "__w")), "left_semi") for p in parts]
        return reduce(DataFrame.unionByName, met).groupBy(*cols(self.keys)).agg(F.max("seq").alias("seq"))

    # --- writing -----------------------------------------------------------------------

    def _write(self, rows: DataFrame, n: int) -> Layer:
        buckets = min(MOST_BUCKETS, 1 << (max(0, n - 1) // self.bucket_rows).bit_length())
        folder = uuid.uuid4().hex
        placed = rows.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in self.fields], "seq").withColumn(SLOT, self._slot(buckets))
        # One shuffle: rows of a key are in one bucket, so they are combined where they are written.
        newest = placed.repartition(SLOT).groupBy(SLOT, *cols(self.keys)).agg(F.max("seq").alias("seq"))
        newest.write.partitionBy(SLOT).parquet(f"{self.root}/data/{folder}")
        return Layer(folder, buckets, n)

    def append(self, rows: DataFrame, batch: Batch, keep: int = 4) -> None:
        """Add the numbers of a batch, once. ``rows`` (keys, seq) should be staged: it is read twice."""
        number, layers, batches = self._newest()
        if self.done(batch):
            return
        n = rows.count()
        if n:
            layers = [*layers, self._write(rows, n)]
        while full := next((k for k in sorted({x.size for x in layers}) if sum(x.size == k for x in layers) >= _FAN), None):
            layers = self._merged(layers, full)
        self._switch(number + 1, layers, {**batches, batch[0]: batch[1]})
        self._expire(keep)

    def _merged(self, layers: list[Layer], size: int) -> list[Layer]:
        """Those up to a size as one layer. Keys in several of them count more than once; the layer's next merge mends that."""
        old = [x for x in layers if x.size <= size]
        rows = reduce(DataFrame.unionByName, [self._scan(x) for x in old])
        layer = self._write(rows, sum(x.rows for x in old))
        found = self.spark.read.parquet(f"{self.root}/data/{layer.folder}").count()
        return [x for x in layers if x.size > size] + [Layer(layer.folder, layer.buckets, found)]

    def _switch(self, number: int, layers: list[Layer], batches: dict[str, int]) -> None:
        text = json.dumps({"layers": [asdict(x) for x in layers], "batches": batches})
        self._files.write_new(f"{self.root}/versions/{number:010d}.json", text)

    def _expire(self, keep: int) -> None:
        """Drop versions but the newest ``keep``, and layers that only they use. For the writer only."""
        numbers = self._numbers()
        used = {x.folder for n in numbers[-keep:] for x in self._version(n)[0]}
        for n in numbers[:-keep]:
            self._files.delete(f"{self.root}/versions/{n:010d}.json")
        for folder in self._files.names(f"{self.root}/data"):
            if folder not in used:
                self._files.delete(f"{self.root}/data/{folder}")
