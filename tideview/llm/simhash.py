"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the
XXH64 hashes (seed 42) of the document's shingles. Two fingerprints that differ in at
most ``radius`` bits agree in at least two of ``radius + 2`` blocks, so both hold the
same value under one of the masks that keep two blocks. Distinct fingerprints are
joined on (mask, value) and their distance is verified. Copies share a fingerprint
and never meet in the join.

A value that more than ``bucket`` fingerprints share is not paired out. Its fingerprints go
through balls instead: a at most radius // 2 bits from a point v, and b at most
radius - radius // 2 bits from it, are linked, and every link has such a point. All
fingerprints around one v are therefore linked to the smallest near one, which costs
rows in proportion to the number of fingerprints, not to its square. No link of the
components is lost either way.

Defined results: a null or empty text has fingerprint 0 and is linked like any other;
a null id keeps its row and takes part, but is no component id unless its component
has no other. Repeated rows are returned as often as they come. Further columns of
the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import Scratch, by_batch, split_words, texts

BITS = 64


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = split_words(text.lower() if text else text)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())]
    rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(n, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_signed(fingerprint(t, shingle)) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(work), "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The masks that keep two of radius + 2 blocks."""
    n = radius + 2
    cuts = [i * BITS // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [_signed(a | b) for a, b in combinations(blocks, 2)]


def _ball(fp: str, radius: int) -> Column:
    """All numbers at most ``radius`` bits from a fingerprint."""
    flips = [0]
    for r in range(1, radius + 1):
        flips += [_signed(sum(1 << b for b in bits)) for bits in combinations(range(BITS), r)]
    return F.transform(F.array(*map(F.lit, flips)), lambda x: x.bitwiseXOR(F.col(fp)))


def links(distinct: DataFrame, scratch: Scratch, radius: int = 3, bucket: int = 2000) -> DataFrame:
    """Pairs u < v of distinct fingerprints (column fp) whose closure is that of all links."""
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("mask", "value")
    )
    keys = ["mask", "value"]
    large = scratch.saved(keyed.groupBy(*keys).count().where(F.col("count") > bucket).drop("count"), "large")
    far = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    hot = not large.isEmpty()
    small = keyed.join(large, keys, "left_anti") if hot else keyed
    left, right = small.withColumnRenamed("fp", "u"), small.withColumnRenamed("fp", "v")
    pairs = left.join(right, keys).where((F.col("u") < F.col("v")) & (far <= radius)).select("u", "v")
    if hot:
        crowded = scratch.saved(keyed.join(large, keys, "left_semi").select("fp").distinct(), "crowded")
        near = crowded.select("fp", F.explode(_ball("fp", radius // 2)).alias("at"))
        heads = near.groupBy("at").agg(F.min("fp").alias("u"))
        around = crowded.select(F.col("fp").alias("v"), F.explode(_ball("fp", radius - radius // 2)).alias("at"))
        star = heads.join(around, "at").where(F.col("u") != F.col("v"))
        pairs = pairs.union(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return pairs.distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge.

    Large star and small star take turns until nothing changes; the edges of each
    turn are written to the shared folder. A turn only takes minima by node and joins
    them back, so a node with very many neighbours is no group to hold.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = scratch.saved(edges.select("u", "v"), "edges")
    before = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.saved(large.where("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), "m").where("a <> m")
        e = scratch.saved(small.select(F.col("m").alias("u"), F.col("a").alias("v")).distinct(), "small-star")
        after = state(e)
        if after == before:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = after


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, bucket: int = 2000
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_copies for every row of ``docs``.

    component_id is the smallest doc_id that links reach; n_copies counts the rows
    with the same fingerprint.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.saved(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    groups = scratch.saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    found = components(links(groups.select("fp"), scratch, radius, bucket), scratch)
    rooted = groups.join(found, F.col("fp") == F.col("node"), "left")
    rooted = scratch.saved(rooted.select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "n", "component_id")
    return marked.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("n").alias("n_copies"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay: of each component the row with the smallest id.

    Of rows that repeat the smallest id one stays. Rows without an id stay, as nothing
    tells them apart.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(stay.withColumnRenamed("doc_id", doc_id), doc_id, "left_semi")
    return named.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
