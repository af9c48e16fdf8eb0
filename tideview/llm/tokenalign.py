"""Cross-tokenizer alignment: every distinct text is tokenised and aligned once.

Documents are shuffled by their full text, which leaves one row for each distinct text with its number of copies.
Tasks tokenise chunks of these texts with both tokenizers and keep the token ids; a chunk also names the id pairs that its tokens
link, each with the number of documents that hold it (copies count). These numbers are added up over the corpus. Each chunk then
gets back the numbers of its own pairs and measures its texts, and the measures are joined to the doc_ids by
the text's SHA-256.

Only pairs of chunks are shuffled, never links of documents: a pair that all documents hold comes
once from each chunk, and copies of a text come once. A chunk ends after ``chunk`` bytes of text, so it is bounded but for a single
longer text.

Defined results: a null or empty text, one that is no valid UTF-8, and one whose joined tokens of either tokenizer differ from a space
and the text have no tokens: zeros and an empty ``groups_sha256``. Repeated rows each get a row; a null doc_id is a document
like any other. Of several partners of an id with one highest count all are best. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import Scratch, parallelism

#: Where the vocabulary files are, on every executor.
FOLDER = "/opt/tokenizers"
#: Byte-level BPE: the split into words that belongs to the vocabulary (a fixed value of the tokenizer).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """The bytes of each token, one after the other, and where they start."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = np.array(tokens, dtype=object)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


def _byte_signs() -> dict[str, int]:
    """Byte-level BPE writes a byte as a printable sign: itself where that is printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def tokenizers(folder: str):
    """(encode A, encode B, vocabulary A, vocabulary B) of this process."""
    import sentencepiece
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
        vocab, signs = json.load(f)["model"]["vocab"], _byte_signs()
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        # The same vocabulary as ranks, for the faster library.
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    pieces = []
    for i in range(b.get_piece_size()):
        pieces.append(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())

    def encode_a(text: str) -> np.ndarray:
        return a.encode_to_numpy(" " + text).astype(np.int64)

    def encode_b(text: str) -> np.ndarray:
        return np.array(b.encode(text), dtype=np.int64)

    return encode_a, encode_b, Vocabulary(tokens), Vocabulary(pieces)


def encoded(text: bytes | None, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of both; none if the tokens do not give the text back."""
    none = np.zeros(0, dtype=np.int64)
    if not text:
        return none, none
    try:
        said = text.decode()
    except UnicodeDecodeError:
        return none, none
    encode_a, encode_b, vocab_a, vocab_b = tokenizers(folder)
    a, b = encode_a(said), encode_b(said)
    # Byte-level tokens can only lose bytes, never change them.
    if vocab_a.lengths[a].sum() != len(text) + 1 or vocab_b.joined(b) != b" " + text:
        return none, none
    return a, b


def ends_of(tokens: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens end, and a mark for each byte offset at which one does."""
    ends = np.cumsum(vocab.lengths[tokens])
    marks = np.zeros(ends[-1] + 1, dtype=np.int8)
    marks[ends] = 1
    return ends, marks


def links(marks_a: np.ndarray, marks_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all pairs of tokens whose byte ranges overlap; both cover the same bytes.

    Between two neighbouring ends of either tokenizer lies one link: that of the tokens that cover it.
    """
    ends = np.flatnonzero(marks_a | marks_b)
    return tuple(np.cumsum(m, dtype=np.int64)[ends - 1] for m in (marks_a, marks_b))


class Signs:
    """Ids of a chunk as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size: int):
        self.size = size
        ids = [str(i) for i in range(size)]
        self.table = np.array([i + end for end in ",|;" for i in ids], dtype=object)

    def groups(self, a, b, last_a, last_b) -> str:
        """``last_a``, ``last_b``: whether a token ends a group."""
        before_b = np.cumsum(last_b) - last_b  # groups before each token
        before_a = np.cumsum(last_a) - last_a
        b_until = np.concatenate([[0], np.flatnonzero(last_b) + 1])  # tokens in the first g groups
        a_until = np.concatenate([[0], np.flatnonzero(last_a) + 1])
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + b_until[before_a]] = a + self.size * last_a
        order[np.arange(len(b)) + a_until[before_b + 1]] = b + 2 * self.size * last_b
        return "".join(self.table[order].tolist())[:-1]


def _both(ids: bytes, n: list[int]) -> list[np.ndarray]:
    return np.split(np.frombuffer(ids, dtype=np.uint16).astype(np.int64), np.cumsum(n)[:-1]) if n else []


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


_CHUNK = "keys array<binary>, n_a array<long>, n_b array<long>, a binary, b binary, groups array<string>, n_groups array<long>, pairs array<long>, held array<long>"


def _chunks(folder: str, most: int):
    """Rows (text, copies) to rows of ``_CHUNK``."""

    def finish(texts: list[bytes], copies: list[int]) -> pa.RecordBatch:
        _, _, vocab_a, vocab_b = tokenizers(folder)
        signs = _signs(max(len(vocab_a.tokens), len(vocab_b.tokens)))
        out = {k.split()[0]: [] for k in _CHUNK.split(", ")}
        all_a, all_b, pairs, weights = [], [], [], []
        for text, n in zip(texts, copies):
            a, b = encoded(text, folder)
            out["keys"].append(hashlib.sha256(text).digest())
            out["n_a"].append(len(a))
            out["n_b"].append(len(b))
            all_a.append(a.astype(np.uint16))
            all_b.append(b.astype(np.uint16))
            if not len(a):
                out["groups"].append("")
                out["n_groups"].append(0)
                continue
            (ends_a, marks_a), (ends_b, marks_b) = ends_of(a, vocab_a), ends_of(b, vocab_b)
            last_a, last_b = marks_b[ends_a].astype(np.int64), marks_a[ends_b].astype(np.int64)
            out["n_groups"].append(int(last_a.sum()))
            out["groups"].append(hashlib.sha256(signs.groups(a, b, last_a, last_b).encode()).hexdigest())
            at_a, at_b = links(marks_a, marks_b)
            own = np.unique(_pair(a[at_a], b[at_b]))
            pairs.append(own)
            weights.append(np.full(len(own), n, dtype=np.int64))
        every, where = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = np.zeros(len(every), dtype=np.int64)
        if pairs:
            np.add.at(held, where, np.concatenate(weights))
        row = [out["keys"], out["n_a"], out["n_b"], np.concatenate(all_a).tobytes(), np.concatenate(all_b).tobytes(), out["groups"], out["n_groups"], every, held]
        kinds = [pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 2, pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], list(out))

    def run(batches):
        texts, copies, size = [], [], 0
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(text or b"")
                copies.append(n)
                size += len(texts[-1])
                if size >= most or len(texts) >= 4000:
                    yield finish(texts, copies)
                    texts, copies, size = [], [], 0
        if texts:
            yield finish(texts, copies)

    return run


@lru_cache(maxsize=2)
def _signs(size: int) -> Signs:
    return Signs(size)


_MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _measures(folder: str):
    """Chunks with the corpus's counts of their pairs to rows of key, measures, groups_sha256."""

    def finish(row: pa.RecordBatch) -> pa.RecordBatch:
        _, _, vocab_a, vocab_b = tokenizers(folder)
        counts = row.column(row.schema.get_field_index("counts")).flatten()
        pairs, count, best = (counts.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        r = row.drop_columns(["counts"]).to_pylist()[0]
        order = np.argsort(pairs)
        pairs, count, best = pairs[order], count[order], best[order]
        found = []
        for a, b in zip(_both(r["a"], r["n_a"]), _both(r["b"], r["n_b"])):
            if not len(a):
                found.append((0, 0, 0))
                continue
            at_a, at_b = links(ends_of(a, vocab_a)[1], ends_of(b, vocab_b)[1])
            at = np.searchsorted(pairs, _pair(a[at_a], b[at_b]))
            found.append((len(at), int(best[at].sum()), int(count[at].sum())))
        columns = [r["n_a"], r["n_b"], r["n_groups"], *map(list, zip(*found))]
        arrays = [pa.array(r["keys"], pa.binary()), *[pa.array(c, pa.int64()) for c in columns], pa.array(r["groups"], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["key", *_MEASURES, "groups_sha256"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield finish(batch.slice(i, 1))

    return run


def align(docs: DataFrame, folder: str = FOLDER, chunk: int = 2 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "tokenalign"), parallelism(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    chunks = texts.select(F.col("text").cast("binary"), "copies").mapInArrow(_chunks(folder, chunk), _CHUNK)
    # In buckets by chunk, so that token ids are never shuffled.
    name = "chunks_" + uuid.uuid4().hex
    chunks = chunks.withColumn("chunk", F.monotonically_increasing_id())
    chunks.write.bucketBy(n, "chunk").option("path", scratch.local_path("chunks")).option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)

    own = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    corpus = own.groupBy("pair").agg(F.sum("held").alias("n"))
    corpus = scratch.saved(corpus.withColumn("a", F.shiftright("pair", 32)), "counts")
    most = corpus.groupBy("a").agg(F.max("n").alias("most"))
    corpus = corpus.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = own.select("chunk", "pair").join(corpus, "pair")
    back = back.groupBy("chunk").agg(F.collect_list(F.struct("pair", "n", "best")).alias("counts"))

    given = chunks.drop("pairs", "held").join(back.hint("shuffle_merge"), "chunk", "left").drop("chunk")
    schema = "key binary, " + ", ".join(f"{m} long" for m in _MEASURES) + ", groups_sha256 string"
    measures = scratch.saved(given.mapInArrow(_measures(folder), schema), "measures")
    spark.sql(f"drop table {name}")
    keyed = docs.select(F.col("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"))
    return keyed.join(measures, "key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), *_MEASURES, "groups_sha256")
