"""Quality rules by distribution divergence.

Every document has a histogram of character classes and one of its language's most
common words (the rest in one bin). A language's reference is the mean of the
documents' normalised histograms; its common words are those that most of its documents
hold. The distance of a document to its language is the square root of the Jensen-Shannon divergence (base 2),
between 0 and 1. A document is rejected if

- it has at least ``min_words_for_chars`` words and the distance of its character classes
  exceeds ``max_chars``, or
- it has at least ``min_words_for_words`` words and the distance of its common words exceeds
  ``max_words + noise / sqrt(words)`` (a short text is far from any reference by chance), or
- it fails a base rule: fewer than ``min_words`` words, or more than ``max_repeat``
  percent of its words in windows of five words that occur twice or more.

References cover all documents, and every language has its own; documents without a language
share one. The common words of the ``max_languages`` most frequent languages are broadcast; those of the others, none of which
has many of the documents then, are joined by language. The result does not depend on it.

Defined results: null and empty texts have no words and fail the base rule. Repeated
rows count, and are judged, each. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideview.llm.common import Scratch, by_batch, split_words, texts

_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: Character classes: small letters, capitals, digits, white space, marks of prose, other ASCII, not ASCII.
CLASSES = 7
_SPREAD = 16  # pieces of a language's words while the most common are sought
_HELD = 500_000  # words a task counts before it hands them on


def _classes() -> np.ndarray:
    """Class of each byte; bytes that continue a code point have none (CLASSES)."""
    out = np.full(256, 5)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[_SPACE] = 3
    out[np.frombuffer(b".,;:'\"-()?", np.uint8)] = 4
    out[0x80:0xC0] = CLASSES
    out[0xC0:] = 6
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five words that are found twice or more, the first included."""
    n = len(words) - 4
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    mixed = (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for k in range(5):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    if len(np.unique(rolled)) == n:  # equal windows have equal hashes
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = joined(ids[:-1], ids[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], ids[4:])
    again = np.bincount(five)[five] > 1
    hit = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + 5, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def measure(text: bytes | None, classes: np.ndarray) -> tuple[list[bytes], int, int, int, int, np.ndarray]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words, counts by character class."""
    if not text:
        return [], 0, 0, 0, 0, np.zeros(CLASSES, np.int64)
    of_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by_class = np.bincount(classes, weights=of_byte, minlength=CLASSES + 1)[:CLASSES].astype(np.int64)
    words = split_words(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    word_chars = int(by_class.sum() - of_byte[_SPACE].sum())
    return words, word_chars, int(of_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeat_words(words), by_class


def _plain(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.col(text).cast("string").alias("text"),
    )


def common_words(plain: DataFrame, common: int) -> DataFrame:
    """lang, word (bytes, lower case), place: the ``common`` words that most documents of a language hold."""

    def count(batches):
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                ["lang", "word", "n"],
            )

        for batch in batches:
            for language, t in zip(batch.column(1).to_pylist(), texts(batch)):
                seen.update((language, w) for w in set(split_words(t.lower() if t else t)))
                if len(seen) > _HELD:
                    yield handed()
                    seen.clear()
        yield handed()

    counted = plain.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = [F.col("n").desc(), F.col("word")]
    piece = F.pmod(F.xxhash64("word"), F.lit(_SPREAD)).alias("piece")
    first = counted.select("*", piece).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*most))
    )
    second = first.where(F.col("place") <= common).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy(*most))
    )
    return second.where(F.col("place") <= common).select("lang", "word", "place")


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of an array of counts and an array of shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    share = F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.zip_with(share, reference, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) / 2)


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    common: int = 24,
    max_chars: float = 0.29,
    max_words: float = 0.23,
    noise: float = 1.0,
    min_words_for_chars: int = 40,
    min_words_for_words: int = 80,
    min_words: int = 10,
    max_repeat: int = 20,
    max_languages: int = 500,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_chars, js_words."""
    scratch = Scratch(docs.sparkSession, "divergence")
    plain = _plain(docs, doc_id, text, lang)
    ranked = plain.where("lang <> ''").groupBy("lang").count().orderBy(F.desc("count"), "lang")
    languages = [r[0] for r in ranked.take(max_languages + 1)]
    all_frequent, languages = len(languages) <= max_languages, languages[:max_languages]
    frequent = F.col("lang").isin(["", *languages])
    found = common_words(plain, common)
    if not all_frequent:
        found = scratch.saved(found, "words")
    places: dict[str, dict[bytes, int]] = {}
    for r in found.where(frequent).take((max_languages + 1) * common):
        places.setdefault(r.lang, {})[bytes(r.word)] = r.place - 1

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        joined = batch.column(3).to_pylist() if batch.num_columns > 3 else None
        classes = _classes()
        rows, chars, hists = [], [], []
        for i, (language, t) in enumerate(zip(batch.column(1).to_pylist(), texts(batch))):
            words, *numbers, by_class = measure(t, classes)
            known = {w["word"]: w["place"] - 1 for w in joined[i] or ()} if joined else places.get(language, {})
            hist = [0.0] * (common + 1)
            for w, n in Counter(t.lower().split()).items() if t else ():
                hist[known.get(w, common)] += n
            rows.append((len(words), *numbers))
            chars.append(by_class.astype(float).tolist())
            hists.append(hist)
        columns = list(zip(*rows)) if rows else [[]] * 5
        doubles = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], pa.array(chars, doubles), pa.array(hists, doubles)],
            ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"],
        )

    schema = (
        "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, chars array<double>, words array<double>"
    )
    if all_frequent:
        counts = plain.mapInArrow(by_batch(count), schema)
    else:
        listed = found.where(~frequent).groupBy("lang").agg(F.collect_list(F.struct("word", "place")).alias("known"))
        others = plain.where(~frequent).join(listed, "lang", "left").select("doc_id", "lang", "text", "known")
        counts = plain.where(frequent).mapInArrow(by_batch(count), schema).unionByName(others.mapInArrow(by_batch(count), schema))
    counted = scratch.saved(counts, "counts")
    n_chars = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    means = counted.where("n_words > 0").groupBy("lang").agg(
        F.array(*[F.avg(F.col("chars")[i] / n_chars) for i in range(CLASSES)]).alias("ref_chars"),
        F.array(*[F.avg(F.col("words")[i] / F.col("n_words")) for i in range(common + 1)]).alias("ref_words"),
    )
    judged = counted.join(scratch.saved(means, "references"), "lang", "left")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    far = lambda counts, ref: F.round(F.coalesce(_distance(F.col(counts), F.col(ref)), F.lit(0.0)), 9)
    odd_chars = (F.col("n_words") >= min_words_for_chars) & (F.col("js_chars") > max_chars)
    allowed = max_words + noise / F.sqrt(F.greatest("n_words", F.lit(1)))
    odd_words = (F.col("n_words") >= min_words_for_words) & (F.col("js_words") > allowed)
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judged.select(
        "doc_id", *numbers, base_failed.alias("base_failed"),
        far("chars", "ref_chars").alias("js_chars"), far("words", "ref_words").alias("js_words"),
    )
    return judged.select("doc_id", *numbers, "base_failed", (~F.col("base_failed") & ~odd_chars & ~odd_words).alias("kept"), "js_chars", "js_words")
