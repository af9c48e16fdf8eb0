"""Line dedup by content-defined chunks of lines.

A text is a sequence of lines. As lines may be of any length, they are wrapped: a wrapped line begins where a
line begins and at each word whose hash is the least of some ``wrap`` words in a row. A hash that rolls over the hashes
of ``roll`` wrapped lines puts a boundary before the line where it is the least of some ``among`` lines in a row. So boundaries
depend on nearby content alone, and a passage that is shifted into another text gets the same
ones, but for the first few. A boundary is also where a text or a line of ``long_words`` words or more begins.

What is compared are chunks of whole wrapped lines: from each boundary as many as make ``min_words`` words. Two
texts that share 47 words in a row share a chunk, however the lines are cut, and the chunks of
a longer passage overlap. The last ``min_words`` words of a text and of a long line are a chunk too. A short line that many
documents share stays.

Chunks are compared by the bytes of their words and of the white space between them; white space that holds a line break counts as one
line break. So blank lines, line ends of other systems and indents do not matter, but spaces within a line do.

Chunks are counted by hash over all documents. One found more than once is kept
in the document with the smallest id (there in its first place) and is repeated elsewhere; in the document that keeps it only
where it does not overlap the kept place. Chunks that overlap and repeat one kept passage are a run, and runs are compared with it byte by byte.
What the equal ones cover is removed.

A hash that very many chunks have is dealt out over several tasks, with a copy of its kept place for each.

Defined results: null and empty texts stay as they are, as do lines of white space
alone, unless they lie within a removed run. Rows that repeat an id with the same text are one document to
the counting and are cut alike. Rows without an id can't keep a passage for others
and lose nothing if no row with an id has it. Further columns stay untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import Scratch, by_batch, texts, unused

_U = np.uint64
_FACTOR, _ROLL = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_FACTOR), -1, 1 << 64))
_BREAK = _U(0xA24BAED4963EE407)
_CHUNK = [("of", pa.int32()), ("chunk", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("hash", pa.int64())]
_WINDOW = [("of", pa.int32()), ("at", pa.int32()), ("words", pa.int32()), ("hash", pa.int64())]
#: Bytes that are cut up at a time, unless one text is longer.
_BYTES = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_known: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, up to the n-th at least."""
    if n > 4 * _BYTES or not _known:
        m = max(n, 4 * _BYTES)
        made = [np.multiply.accumulate(np.concatenate([[_U(1)], np.full(m, x)])) for x in (_FACTOR, _INVERSE)]
        if n > 4 * _BYTES:
            return made[0], made[1]
        _known.extend(made)
    return _known[0], _known[1]


def _any_of(data: np.ndarray, signs: bytes) -> np.ndarray:
    known = np.zeros(256, bool)
    known[np.frombuffer(signs, np.uint8)] = True
    return known[data]


def _each(x: np.ndarray, over: np.ufunc, size: int) -> np.ndarray:
    """The least or greatest of each ``size`` numbers in a row: of twice as many by each step, the last two overlap."""
    have = 1
    while 2 * have <= size:
        x = over(x[:-have], x[have:])
        have *= 2
    return over(x[: len(x) - (size - have)], x[size - have :])


def _least(h: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
    """Whether each number is the least of some ``size`` in a row, of those rows that are ``whole`` (by their first)."""
    beyond = np.zeros(size - 1, _U)
    least = np.where(whole, _each(np.concatenate([h, ~beyond]), np.minimum, size), _U(0))
    return _each(np.concatenate([beyond, least]), np.maximum, size) == h


class _Lines:
    """The words and wrapped lines of some texts, and where the boundaries are."""

    def __init__(self, rows: list[bytes | None], long_words: int = 20, wrap: int = 2, among: int = 11, roll: int = 2):
        self.sizes = np.array([len(t) if t else 0 for t in rows], np.int64)
        self.data = data = np.frombuffer(b"".join(t for t in rows if t), np.uint8)
        n = len(data)
        ends = np.cumsum(self.sizes)
        space = _any_of(data, b" \t\n\r\x0b\x0c")
        before, after = np.ones(n, bool), np.ones(n, bool)  # white space or a text's end there
        before[1:], after[:-1] = space[:-1], space[1:]
        filled = self.sizes > 0
        before[(ends - self.sizes)[filled]] = True
        after[ends[filled] - 1] = True
        self.word, self.close = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.text_ends = ends
        self.n = len(self.word)
        if not self.n:
            return
        self.text = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(self.word, ends), prepend=0))
        self.new_text = np.append(True, self.text[1:] != self.text[:-1])
        behind = np.searchsorted(self.word, np.flatnonzero(data == 10))  # the first word behind each line break
        line_start = self.new_text.copy()
        line_start[behind[behind < self.n]] = True

        # Hashes of words, and of the white space behind them.
        power, back = _powers(n)
        summed = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * power[:n], dtype=_U)])
        words = _mixed((summed[self.close] - summed[self.word]) * back[self.word])
        gap = np.full(self.n, _BREAK)
        inner = np.flatnonzero(~line_start[1:])
        gap[inner] = _mixed((summed[self.word[inner + 1]] - summed[self.close[inner]]) * back[self.close[inner]] ^ _BREAK)
        self.power, self.back, self.gap = power, back, gap
        self.summed = np.concatenate([[_U(0)], np.cumsum((words + gap) * power[: self.n], dtype=_U)])

        self.unit = np.flatnonzero(line_start | _least(words, self._one_text(self.text, wrap), wrap))
        self.unit_end = np.append(self.unit[1:], self.n)
        of = self.text[self.unit]
        rolled = hashes = self.hashed(self.unit, self.unit_end)
        for by in range(1, min(roll, len(hashes))):
            rolled = rolled + np.append(np.where(of[by:] == of[:-by], hashes[by:] * _ROLL ** _U(by), _U(0)), np.zeros(by, _U))
        cut = _least(_mixed(rolled), self._one_text(of, among), among) | self.new_text[self.unit]
        # Lines as they are, for long ones.
        first = np.flatnonzero(line_start)
        end = np.append(first[1:], self.n)
        long = end - first >= long_words
        cut[np.searchsorted(self.unit, first[long])] = True
        self.boundary = np.flatnonzero(cut)
        self.line_ends = end[long | np.append(self.new_text[first[1:]], True)]  # of long lines and of texts

    @staticmethod
    def _one_text(text: np.ndarray, size: int) -> np.ndarray:
        """Whether this one and those that follow it, ``size`` in all, are of one text."""
        out = np.zeros(len(text), bool)
        m = max(0, len(text) - size + 1)
        out[:m] = text[:m] == text[size - 1 :]
        return out

    def hashed(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of the words from a to z and the white space between them."""
        return _mixed((self.summed[z] - self.summed[a] - self.gap[z - 1] * self.power[z - 1]) * self.back[a])


def chunks(rows: list[bytes | None], **shape) -> dict[str, np.ndarray]:
    """What lies between the boundaries of some texts, in order: number of the text, number in the text, first byte and end in
    it, words, hash of its words. Texts without words have none.
    """
    lines = _Lines(rows, **shape)
    if not lines.n:
        return {name: np.zeros(0, kind.to_pandas_dtype()) for name, kind in _CHUNK}
    a = lines.unit[lines.boundary]
    z = np.append(a[1:], lines.n)
    of = lines.text[a]
    offset = (lines.text_ends - lines.sizes)[of]
    number = np.arange(len(of)) - np.searchsorted(of, of)
    start = np.where(number == 0, 0, lines.word[a] - offset)
    last = np.append(of[1:] != of[:-1], True)
    end = np.where(last, lines.sizes[of], np.append(start[1:], 0))
    return {"of": of, "chunk": number, "start": start, "end": end, "words": z - a, "hash": lines.hashed(a, z).view(np.int64)}


def windows(rows: list[bytes | None], size: int = 24, **shape) -> dict[str, np.ndarray]:
    """The chunks of some texts that are compared, in order: number of the text, first word (its number in the
    text), words (``size`` or as many more as end a wrapped line), hash of words and white space.
    """
    lines = _Lines(rows, **shape)
    if not lines.n:
        return {name: np.zeros(0, kind.to_pandas_dtype()) for name, kind in _WINDOW}
    a = lines.unit[lines.boundary]
    last = np.searchsorted(lines.unit_end, a + size)
    a, last = a[last < len(lines.unit)], last[last < len(lines.unit)]
    z = lines.unit_end[last]
    b = lines.unit[np.maximum(0, np.searchsorted(lines.unit, lines.line_ends - size, side="right") - 1)]
    a, z = np.append(a, b), np.append(z, lines.line_ends)
    fits = (z - a >= size) & (lines.text[a] == lines.text[z - 1])
    a, z = a[fits], z[fits]
    order = np.lexsort([z, a])
    a, z = a[order], z[order]
    new = np.append(True, (a[1:] != a[:-1]) | (z[1:] != z[:-1]))[: len(a)]
    a, z = a[new], z[new]
    of = lines.text[a]
    return {"of": of, "at": a - np.searchsorted(lines.text, of), "words": z - a, "hash": lines.hashed(a, z).view(np.int64)}


def _groups(rows: list[bytes | None]):
    """(first, end) of runs of rows with about _BYTES bytes."""
    first = held = 0
    for i, t in enumerate(rows):
        held += len(t) if t else 0
        if held >= _BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(rows):
        yield first, len(rows)


def _stretches(of: np.ndarray, at: np.ndarray, until: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of each run: chunks of one text with equal keys, each overlapping the next one."""
    order = np.lexsort([until, at, *keys, of])
    new = np.ones(len(order), bool)
    same = at[order][1:] < until[order][:-1]
    for x in (of, *keys):
        same &= np.diff(x[order]) == 0
    new[1:] = ~same
    return order[new], order[np.append(new[1:], True)[: len(new)]]


def _gone(row: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Row, start, end, words of what goes: runs ``x``, in order by row and first word, that touch each other are one."""
    n = len(row)
    shift = row.astype(np.int64) << 32
    at, until = x["at"] + shift, x["until"] + shift
    before = np.append(np.int64(-1), np.maximum.accumulate(until)[:-1])[:n]
    new = at > before
    first = np.flatnonzero(new)
    farthest = np.maximum.accumulate(np.where(until > before, np.arange(n), 0))
    last = farthest[np.append(first[1:], n)[: len(first)] - 1]
    # A rest of a line before the run keeps its line break.
    tail = np.where(x["opens"][first] | ~x["closes"][last], x["tail"][last], 0)
    return row[first], x["start"][first] - x["lead"][first], x["end"][last] + tail, until[last] - at[first]


def _bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    space = np.concatenate([[True], _any_of(np.frombuffer(text, np.uint8), b" \t\n\r\x0b\x0c"), [True]])
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def _joined(text: bytes) -> bytes:
    """With white space that holds a line break as one line break; the text begins and ends with a word."""
    if b"\n" not in text:
        return text
    return b"\n".join(line for line in map(bytes.strip, text.split(b"\n")) if line)


def _around(text: bytes, start: int, end: int) -> tuple[int, bool, int, bool]:
    """Blanks before that open the line, whether it is opened, what goes behind (blanks, a line break), whether that ends the line."""
    head = text.rfind(b"\n", 0, start) + 1
    opens = not text[head:start].strip()
    stop = text.find(b"\n", end)
    stop = len(text) if stop < 0 else stop + 1
    closes = not text[end:stop].strip()
    if not closes:
        stop = end + next(i for i in range(stop - end) if text[end + i : end + i + 1].strip())
    return (start - head if opens else 0), opens, stop - end, closes


#: Rows of one key that a task meets at most, unless a thousandth of all rows is more.
_A_TASK = 5000


def _hot(counted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """keys, tasks: keys of ``counted`` (keys, n) too frequent for one task, with the number of tasks. As their rows are
    ``rows`` in all, at most a thousand keys are so.
    """
    most = max(_A_TASK, rows // 1000)
    return counted.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("tasks"))


def _dealt(rows: DataFrame, one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has each key once; the rows of hot keys are dealt out over several tasks."""
    hot = F.broadcast(hot)  # a thousand rows at most
    tasks = F.coalesce("tasks", F.lit(1))
    part = F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "text_hash", "at"), "tasks").cast("int"))
    many = rows.join(hot, keys, "left").withColumn("part", part).drop("tasks")
    copies = one.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    return many.join(copies, [*keys, "part"]).drop("part")


def removals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None, min_words: int = 24, **shape
) -> DataFrame:
    """doc_id, text_hash, repeated: for the documents that have some, their repeated stretches in order."""
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")
    ).where(F.col("text").isNotNull())

    def cut(batches):
        for batch in batches:
            rows = texts(batch)
            for first, end in _groups(rows):
                found = windows(rows[first:end], min_words, **shape)
                of = pa.array(found.pop("of") + first)
                columns = [batch.column(0).take(of), batch.column(1).take(of)]
                columns += [pa.array(found[name], kind) for name, kind in _WINDOW[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", *[name for name, _ in _WINDOW[1:]]])

    schema = "doc_id long, text_hash long, at int, words int, hash long"
    cuts = scratch.saved(plain.mapInArrow(cut, schema), "chunks")
    often = cuts.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("k_id"))
    often = scratch.saved(often.where("n > 1 and k_id is not null"), "often")
    hot = _hot(often, ["hash"], cuts.count())
    suspects = scratch.saved(_dealt(cuts, often.select("hash", "k_id"), hot, ["hash"]), "suspects")
    scratch.drop(cuts)
    # The kept place of each chunk: the smallest id, there the smallest text hash and the first place.
    firsts = suspects.where("doc_id = k_id").groupBy("hash").agg(F.min(F.struct("text_hash", "at", "words")).alias("k"))
    firsts = firsts.select("hash", F.col("k.text_hash").alias("k_hash"), F.col("k.at").alias("k_at"), F.col("k.words").alias("k_words"))
    own = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    other = _dealt(suspects, firsts, hot, ["hash"]).where(F.col("words") == F.col("k_words"))
    other = other.where(~own | (F.col("at") >= F.col("k_at") + F.col("words")))
    spot = F.struct("at", "words", "k_id", "k_hash", "k_at")
    spots = other.groupBy("doc_id", "text_hash").agg(F.collect_set(spot).alias("spots"))  # of one document

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        spots = batch.column(2)
        of = np.repeat(np.arange(len(spots)), spots.value_lengths().fill_null(0).to_numpy())
        at, words, k_id, k_hash, k_at = (spots.flatten().field(i).to_numpy() for i in range(5))
        first, last = _stretches(of, at, at + words, [at - k_at, k_hash, k_id])
        row = pa.array(of[first])
        columns = [at[first], at[last] + words[last], k_id[first], k_hash[first], k_at[first]]
        columns = [pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *columns], names)

    names = ["doc_id", "text_hash", "at", "until", "k_id", "k_hash", "k_at"]
    schema = "doc_id long, text_hash long, at int, until int, k_id long, k_hash long, k_at int"
    stretches = scratch.saved(spots.mapInArrow(by_batch(join), schema), "runs")
    scratch.drop(suspects)
    # The bytes of each run meet those of the kept one once, in the last join. The texts are dealt out once for both.
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash"))

    def of_document(df: DataFrame) -> DataFrame:
        listed = df.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*names[2:])).alias("spots"))
        return plain.join(listed.toDF("s_id", "s_hash", "spots"), same).select("doc_id", "text_hash", "text", "spots")

    def show(batch: pa.RecordBatch) -> pa.RecordBatch:
        spots = batch.column(3)
        counts = spots.value_lengths().fill_null(0).to_pylist()
        each = spots.flatten()
        ats, untils = each.field("at").to_numpy(), each.field("until").to_numpy()
        shown, around, done = [], [], 0
        for t, n in zip(texts(batch), counts):
            starts, ends = _bounds(t)
            for a, z in zip(starts[ats[done : done + n]].tolist(), ends[untils[done : done + n] - 1].tolist()):
                shown.append(_joined(t[a:z]))
                around.append((a, z, *_around(t, a, z)))
            done += n
        of = pa.array(np.repeat(np.arange(len(counts)), counts))
        columns = [batch.column(0).take(of), batch.column(1).take(of), *[each.field(x) for x in names[2:]]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_())
        columns += [pa.array(x, kind) for x, kind in zip(list(zip(*around)) or [[]] * 6, kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(shown, pa.binary())], [*names, "start", "end", "lead", "opens", "tail", "closes", "bytes"])

    schema += ", start int, end int, lead int, opens boolean, tail int, closes boolean, bytes binary"
    size = (F.col("until") - F.col("at")).alias("size")
    kept = stretches.select(F.col("k_id").alias("doc_id"), F.col("k_hash").alias("text_hash"), F.col("k_at").alias("at"), size).distinct()
    kept = kept.select("doc_id", "text_hash", "at", (F.col("at") + F.col("size")).alias("until"), *[F.lit(0).cast(x).alias(n) for n, x in (("k_id", "long"), ("k_hash", "long"), ("k_at", "int"))])
    kept = of_document(kept).mapInArrow(by_batch(show), schema)
    kept = kept.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.col("at").alias("k_at"), size, F.col("bytes").alias("k_bytes"))
    place = ["k_id", "k_hash", "k_at", "size"]
    kept = kept.dropDuplicates(place)  # rows that repeat a document show its stretches each
    mine = of_document(stretches).mapInArrow(by_batch(show), schema).withColumn("size", size)
    counted = stretches.groupBy("k_id", "k_hash", "k_at", size).agg(F.count("*").alias("n"))
    hot = _hot(counted, place, stretches.count())
    repeated = _dealt(mine, kept, hot, place).where("bytes = k_bytes")
    spot = F.struct("at", "until", "start", "end", "lead", "opens", "tail", "closes")
    return repeated.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(spot)).alias("repeated"))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, min_words: int = 24, **shape
) -> DataFrame:
    """The rows of ``docs`` with the repeated runs cut out of their text, and ``n_removed_words``.

    ``n_chars`` names a column that holds the text's length and has to follow it. A column
    of the input that is called n_removed_words gives way.
    """
    docs = docs.drop("n_removed_words")
    scratch = Scratch(docs.sparkSession, "linededup")
    r_id, r_hash, kept, gone = unused(docs, "r_id", "r_hash", "kept", "gone")

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        repeated, n = batch.column(2), batch.num_rows
        row = np.repeat(np.arange(n), repeated.value_lengths().fill_null(0).to_numpy())
        each = repeated.flatten()
        fields = ("at", "until", "start", "end", "lead", "opens", "tail", "closes")
        row, start, end, words = _gone(row, {f: each.field(f).to_numpy(zero_copy_only=False) for f in fields})
        # What stays: from the text's begin or the end of a run to the next one or the text's end.
        runs = np.bincount(row, minlength=n)
        behind = np.cumsum(runs)
        a, z = np.insert(end, behind - runs, 0), np.insert(start, behind, 2**31 - 1)
        part = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["a", "z"])
        keep = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs + 1)), pa.int32()), part)
        removed = np.bincount(row, weights=words, minlength=n).astype(np.int64)
        columns = [batch.column(0), batch.column(1), keep, pa.array(removed)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "kept", "gone"])

    schema = "doc_id long, text_hash long, kept array<struct<a:int,z:int>>, gone long"
    found = removals(docs, doc_id, text, scratch, min_words, **shape).mapInArrow(by_batch(spans), schema).where("gone > 0")
    found = scratch.saved(found, "kept").toDF(r_id, r_hash, kept, gone)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(r_id)) & (F.xxhash64(F.col(text)) == F.col(r_hash))
    data = F.col(text).cast("binary")  # spans are in bytes
    parts = F.transform(kept, lambda s: F.substring(data, s["a"] + 1, s["z"] - s["a"]).cast("string"))
    cut = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(parts, ""))
    joined = docs.join(found, same, "left")
    out = joined.select(
        *[cut.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed_words"),
    )
    if n_chars:
        out = out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns, "n_removed_words")
