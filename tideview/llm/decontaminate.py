"""Benchmark decontamination by a prefix-filtered set join. Spark functions only.

An item is cut into windows of ``window`` consecutive words (an item of fewer words,
but not none, is one window). A window is the set of its shingles of ``shingle``
words with their positions; it occurs in a document only if all of them do.

1. Every document's shingles are joined with the shingles that the benchmark has.
   What is left is about as large as the overlap.
2. Rarity is the number of times a shingle is left, counted over all documents. For
   exact containment the prefix of a window is one shingle: its rarest. A window
   whose rarest shingle is nowhere occurs nowhere.
3. The document shingles are joined with the prefixes. The position within the
   window gives the one place where the window can lie; it has to fit in the document's length.
4. A candidate is verified: the shingles that cover the window (not their hashes but
   their words) stand at the positions they must.

The benchmark's shingle hashes are broadcast only if there are at most
``broadcast_rows`` of them (16 bytes each); beyond that the join shuffles.

Defined results: null and empty texts have no words; an item without words has no
window; a null item_id does not count as an item, but its words hit. Rows that repeat an
item_id add their windows to that item. Repeated documents are judged alike. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideview.llm.common import Scratch, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What names a document: rows with the same id and text are one.
KEY = ["doc_id", "text_hash"]


def words(text: str) -> Column:
    """Words of a text, A-Z lower-cased and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)  # then lower() changes A-Z alone
    low = F.when(plain, F.lower(F.col(text))).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _BETWEEN), ""), F.array().cast("array<string>"))


def _zipped(column: str, k: int) -> Column:
    """A struct of the k words from each position on; past the end they are null."""
    w = F.col(column)
    n = F.size(w)
    return F.arrays_zip(
        *[(w if i == 0 else F.slice(w, F.lit(i + 1), F.greatest(n - i, F.lit(0)))).alias(f"w{i}") for i in range(k)]
    )


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item_id, words (of one window), m (how many)."""
    split = items.select(F.col(item_id).alias("item_id"), words(text).alias("all")).where(F.size("all") > 0)
    m = F.least(F.size("all"), F.lit(window))
    start = F.explode(F.sequence(F.lit(1), F.size("all") - m + 1))
    return split.select("item_id", "all", m.alias("m"), start.alias("start")).select(
        "item_id", F.slice("all", F.col("start"), F.col("m")).alias("words"), "m"
    ).distinct()


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shingle: int = 5,
    broadcast_rows: int = 1_000_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, text_hash, start (from 0), m, item_id: every place where a window of an item stands."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    size = F.least(F.col("m"), F.lit(shingle))
    wins = windows_of(items, item_id, item_text, window)
    wins = wins.select("item_id", "words", "m", size.alias("k"), F.xxhash64("words").alias("win"))
    wins = scratch.saved(wins, "windows")
    distinct = wins.dropDuplicates(["words"]).drop("item_id")
    at = F.explode(F.sequence(F.lit(0), F.col("m") - F.col("k"))).alias("at")
    parts = distinct.select("win", "m", "k", "words", at)
    shingle_text = F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ")
    parts = scratch.saved(parts.select("win", "m", "k", "at", shingle_text.alias("shingle")), "parts")

    read = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(text).alias("words")
    )
    found = None
    for k in [r[0] for r in parts.select("k").distinct().sort("k").take(shingle)]:
        names = [f"w{i}" for i in range(k)]
        looked = parts.where(F.col("k") == k).select(F.split("shingle", " ").alias("s")).distinct()
        looked = looked.select(F.xxhash64(*[F.col("s")[i] for i in range(k)]).alias("hash")).distinct()
        looked = scratch.saved(looked, f"hashes-{k}")
        if looked.count() <= broadcast_rows:
            looked = F.broadcast(looked)
        placed = read.where(F.size("words") >= k).select(
            *KEY, F.size("words").alias("n_words"), F.posexplode(_zipped("words", k)).alias("pos", "s")
        )
        placed = placed.select(*KEY, "n_words", "pos", *[F.col("s")[n].alias(n) for n in names])
        placed = placed.withColumn("hash", F.xxhash64(*names)).where(F.col(names[-1]).isNotNull())
        met = placed.join(looked, "hash").select(
            *KEY, "n_words", "pos", F.lit(k).alias("k"), F.concat_ws(" ", *names).alias("shingle")
        )
        found = met if found is None else found.unionByName(met)
    if found is None:
        none = T.StructType(
            [docs.schema[doc_id], T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType())]
            + [T.StructField("m", T.IntegerType()), items.schema[item_id]]
        )
        empty = docs.sparkSession.createDataFrame([], none)
        return empty.toDF("doc_id", "text_hash", "start", "m", "item_id")
    found = scratch.saved(found.distinct(), "shingles")

    rarity = found.groupBy("k", "shingle").agg(F.count("*").alias("n"))
    known = parts.join(rarity, ["k", "shingle"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "shingle", "k", "m"))
    prefix = known.groupBy("win").agg(rarest.alias("p")).where("p.n > 0").select("win", "p.at", "p.shingle", "p.k", "p.m")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("m") <= F.col("n_words"))
    candidates = found.join(prefix, ["k", "shingle"]).where(fits).select(*KEY, "win", "k", "m", start.alias("start"))

    covering = (F.col("at") % F.col("k") == 0) | (F.col("at") == F.col("m") - F.col("k"))
    needed = parts.where(covering).select("win", "at", "shingle")
    each = candidates.join(needed, "win").withColumn("pos", F.col("start") + F.col("at"))
    have = found.select(*[F.col(c).alias(f"f_{c}") for c in KEY], F.col("pos").alias("f_pos"), F.col("shingle").alias("f_s"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("f_doc_id"))
        & (F.col("text_hash") == F.col("f_text_hash"))
        & (F.col("pos") == F.col("f_pos"))
        & (F.col("shingle") == F.col("f_s"))
    )
    held = each.join(have, same).groupBy(*KEY, "win", "start", "k", "m").agg(F.count("*").alias("n"))
    all_of_them = F.ceil(F.col("m") / F.col("k"))
    verified = held.where(F.col("n") == all_of_them).select(*KEY, "start", "m", "win")
    return verified.join(wins.select("win", "item_id"), "win").select(*KEY, "start", "m", "item_id")


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 20, **options
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    n_hit counts the words inside any occurrence of a window; a document is contaminated if
    share * n_hit >= n_words and any word is hit.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits = scratch.saved(occurrences(docs, items, doc_id, text, scratch=scratch, **options), "occurrences")
    spans = hits.groupBy(*KEY, "start").agg(F.max("m").alias("m"))
    ends = F.col("start") + F.col("m")
    before = Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(ends).over(before), F.lit(0))
    spans = spans.withColumn("new", F.greatest(ends - F.greatest(reached, F.col("start")), F.lit(0)))
    hit = spans.groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    named = hits.where(F.col("item_id").isNotNull()).select(*KEY, "item_id").distinct()
    listed = named.groupBy(*KEY).agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids")
    )
    found = hit.join(listed, _same(hit, listed), "left").select(
        *[hit[c].alias(f"h_{c}") for c in KEY], "n_hit", "n_items", F.array_join("ids", ",").alias("ids")
    )
    counted = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.size(words(text)).alias("n_words")
    )
    same = F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_hash") == F.col("h_text_hash"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, same, "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad_id, bad_hash = unused(docs, "bad_id", "bad_hash")
    bad = contamination(docs, items, doc_id, text, **options).where("contaminated")
    bad = bad.select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(text)) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")
