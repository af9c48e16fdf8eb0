"""LM scoring with an Elias-Fano n-gram trie.

Tokens are the words of a text (A-Z lower-cased) and one end. The trie has a level for each length
1 to ``order``; a node is an n-gram seen in training, numbered by its place in its level.

- Level 1 holds the words' 64-bit hashes, sorted, and their exact counts.
- In a level k > 1 a context (a node of level k - 1) owns a range of nodes, given by monotone pointers. A node's
  last word is kept as its place among the successors of the context's suffix, to which the last number of the
  range before is added; so the level is one monotone sequence, and a node is found by searching its
  context's range for the first number not below the one wanted.
- The probability of a node is kept in ``bins`` quantised logarithms: absolute discounting, interpolated
  with the shorter context, max(c - D, 0) / c(h) + D t(h) / c(h) p(w | shorter h), where t(h) counts the successors of h. The weight of what
  a context leaves to the shorter one is quantised as well.

Words are dealt to shards by hash; longer n-grams go with their first word. A shard of a
level is one file of bit-packed arrays in the shared folder, written by one task from the sorted, counted blocks
of n-grams that the training tasks send, and mapped into memory by the scoring tasks. The number of shards follows the
size of the input. Nothing is pruned, and nothing but sums and shard sizes comes to the driver.

Defined results: a null or empty text is one end. The end also is the context of a text's first word. Words never
seen have the probability 0.5 / (N + 0.5 (V + 1)). Without training rows every token has 0.5 / 0.5 = 1. Two words with the same 64-bit hash would
be taken for one (expected once for some five thousand million different words). Repeated rows count, and are scored, each. Further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import Scratch, parallelism
from tideview.llm.eliasfano import Sequence, map_arrays, write_arrays
from tideview.sources.storage import plan_bytes

_U = np.uint64
_END = b""  # no word is empty
#: n-grams that a training task gathers before it counts and sends them.
_GATHERED = 4_000_000
#: Rows scored or counted at a time.
_ROWS = 2000


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _start(shard: int, shards: int) -> int:
    """The first hash of a shard."""
    return -((-shard << 32) // shards) << 32


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes, sorted; each text's tokens, led by an end, as places in them; where each text begins."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words = split.flatten()
    filled = pc.binary_length(words).to_numpy() > 0  # white space at either end splits off an empty word
    if not filled.all():
        words = words.filter(pa.array(filled))
    behind = np.concatenate([[0], np.cumsum(filled)])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
    known = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(_END), *[digest(w) for w in known.dictionary.cast(pa.binary()).to_pylist()]], _U)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begins = behind + 2 * np.arange(len(behind))
    flat = np.full(begins[-1], place[0])
    body = np.ones(len(flat), bool)
    body[begins[:-1]] = body[begins[1:] - 1] = False
    flat[body] = place[known.indices.to_numpy() + 1]
    return hashes[order], flat, begins


@dataclass
class Shape:
    """What the driver knows of a trie: folder, shards, and each level's numbers."""

    path: str
    shards: int
    offsets: list[np.ndarray]  # of each level: first node of each shard, and the number of nodes
    tokens: int = 0

    @property
    def words(self) -> int:
        return int(self.offsets[0][-1])


class Trie:
    """A mapped trie. Nodes are numbered over all shards; -1 is no node."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.levels = []
        for k, offsets in enumerate(shape.offsets):
            full = np.diff(offsets) > 0
            self.levels.append([map_arrays(_file(shape.path, k, s)) if full[s] else None for s in range(shape.shards)])
        self.sequences: dict = {}

    def _sequence(self, level: int, shard: int, name: str) -> Sequence:
        key = (level, shard, name)
        if key not in self.sequences:
            self.sequences[key] = Sequence(self.levels[level][shard], name)
        return self.sequences[key]

    def _by_shard(self, level: int, nodes: np.ndarray):
        """(shard, where): nodes of a level, of -1 none, grouped by their shard."""
        offsets = self.shape.offsets[level]
        if len(nodes) and nodes[0] >= 0 and (nodes[1:] >= nodes[:-1]).all():
            cuts = np.searchsorted(nodes, offsets)
            for s in np.flatnonzero(np.diff(cuts)):
                yield s, slice(cuts[s], cuts[s + 1])
            return
        of = np.searchsorted(offsets, nodes, side="right") - 1
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.shape.shards + 1))
        for s in range(self.shape.shards):
            if cuts[s] < cuts[s + 1]:
                yield s, order[cuts[s] : cuts[s + 1]]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Nodes of level 1."""
        out = np.full(len(hashes), -1)
        of = shard_of(hashes, self.shape.shards)
        for s in np.unique(of):
            if self.levels[0][s] is None:
                continue
            at = np.flatnonzero(of == s)
            keys = self._sequence(0, s, "keys")
            place = keys.find(hashes[at] - _U(_start(int(s), self.shape.shards)))
            out[at] = np.where(place >= 0, place + self.shape.offsets[0][s], -1)
        return out

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        """Counts of words; of -1 zero."""
        out = np.zeros(len(nodes), np.int64)
        for s, at in self._by_shard(0, nodes):
            out[at] = self.levels[0][s]["counts"][nodes[at] - self.shape.offsets[0][s]]
        return out

    def unigram(self, nodes: np.ndarray) -> np.ndarray:
        n, v = self.shape.tokens, self.shape.words
        return np.log10((self.counts(nodes) + 0.5) / (n + 0.5 * (v + 1)))

    def ranges(self, level: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the successors, in ``level``, of nodes of the level before (as nodes; empty for -1)."""
        begin, end = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        for s, at in self._by_shard(level - 1, contexts):
            if self.levels[level][s] is None:
                continue
            pointers, local = self._sequence(level, s, "pointers"), contexts[at] - self.shape.offsets[level - 1][s]
            first = self.shape.offsets[level][s]
            begin[at], end[at] = (x.astype(np.int64) + first for x in pointers.access_pairs(local))
        return begin, end

    def find(self, level: int, heads: np.ndarray, of: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of a level k > 1 from contexts (distinct, sorted nodes; each wanted one's is heads[of]; ``of`` is sorted) and words
        relative to the context's suffix; -1 is none. And the words' places among the context's successors.
        """
        out = np.full(len(of), -1)
        begins, ends = self.ranges(level, heads)
        for s, where in self._by_shard(level - 1, heads):
            if self.levels[level][s] is None:
                continue
            keys, first = self._sequence(level, s, "keys"), self.shape.offsets[level][s]
            begin, end = begins[where] - first, ends[where] - first
            base = np.zeros(len(begin), _U)
            later = np.flatnonzero(begin > 0)
            base[later] = keys.access(begin[later] - 1)
            a, z = np.searchsorted(of, [where.start, where.stop])
            head = of[a:z] - where.start
            want = relative[a:z].astype(_U) + base[head] + _U(1)
            there = np.flatnonzero((end > begin)[head] & (want <= _U(self.levels[level][s]["top"][0])))
            place = keys.find(want[there])
            hit = np.flatnonzero((place >= begin[head[there]]) & (place < end[head[there]]))
            out[a + there[hit]] = place[hit] + first
        return out, np.where(out >= 0, out - begins[of], -1)

    def _coded(self, level: int, nodes: np.ndarray, code: str, book: str, of_level: int) -> np.ndarray:
        out = np.zeros(len(nodes))
        for s, at in self._by_shard(of_level, nodes):
            if self.levels[level][s] is not None:
                part = self.levels[level][s]
                out[at] = part[book][part[code][nodes[at] - self.shape.offsets[of_level][s]]]
        return out

    def probability(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """log10 p of nodes of a level k > 1."""
        return self._coded(level, nodes, "codes", "book", level)

    def weight(self, level: int, contexts: np.ndarray) -> np.ndarray:
        """log10 of what a context of the level before leaves to the shorter one; 0 without successors."""
        return self._coded(level, contexts, "weights", "weight_book", level - 1)

    def parent_begin(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Where the range of successors that holds each node begins (in the first level: the root's, 0)."""
        out = np.zeros(len(nodes), np.int64)
        for s, at in self._by_shard(level, nodes) if level else ():
            first, pointers = self.shape.offsets[level][s], self._sequence(level, s, "pointers")
            local = (nodes[at] - first).astype(_U)
            after = pointers.successor(local + _U(1))  # the first range that begins behind the node
            out[at] = pointers.access(after - 1).astype(np.int64) + first
        return out

    def lower(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """log10 p of nodes of any level."""
        return self.probability(level, nodes) if level else self.unigram(nodes)

    def path(self, ids: np.ndarray, flat: np.ndarray, begins: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For levels 1 to ``depth``: distinct nodes, sorted, and for each token of texts put together the place in them
        of the n-gram that ends at it; -1 is none. ``ids`` are the nodes of the distinct words that ``flat`` has as places.
        """
        known = ids >= 0
        out = [(ids[known], np.append(np.where(known, np.cumsum(known) - 1, -1), -1)[flat])]
        relative = out[0][0]
        for level in range(1, depth):
            nodes, of = out[-1]
            before = self._before(of, begins)
            some = np.flatnonzero((before >= 0) & (of >= 0))
            (heads, words), pair = _distinct_pairs(before[some], of[some])
            new = np.diff(heads, prepend=-1) > 0
            found, relative = self.find(level, nodes[heads[new]], np.cumsum(new) - 1, relative[words])
            hit = found >= 0
            place = np.full(len(of), -1)
            place[some] = np.where(hit, np.cumsum(hit) - 1, -1)[pair]
            relative = relative[hit]
            out.append((found[hit], place))
        return out

    @staticmethod
    def _before(of: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each token what the one before it has; -1 at a text's begin."""
        before = np.concatenate([[-1], of[:-1]])
        before[begins[:-1]] = -1
        return before

    def score(self, ids: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of each token; the ends that lead the texts are given 0."""
        path = self.path(ids, flat, begins, len(self.levels))
        out = self.unigram(ids)[flat]
        for level in range(1, len(self.levels)):
            contexts, of = path[level - 1]
            nodes, found = path[level]
            # One entry more, for -1.
            out += np.append(self.weight(level, contexts), 0.0)[self._before(of, begins)]
            out = np.where(found >= 0, np.append(self.probability(level, nodes), 0.0)[found], out)
        out[begins[:-1]] = 0.0
        return out


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs, sorted, and the place in them of each pair given; no number is negative."""
    wide, place = int(b.max(initial=0)) + 1, len(a).bit_length()
    size = wide * (int(a.max(initial=0)) + 1)
    if size < 1 << 63 - place:  # a pair and its place fit into one number: sorted faster than places by pair
        packed = np.sort((a * wide + b) << place | np.arange(len(a)))
        order, keys = packed & (1 << place) - 1, packed >> place
        new = np.diff(keys, prepend=-1) != 0
        of = np.empty(len(a), np.int64)
        of[order] = np.cumsum(new) - 1
        keys = keys[new]
        return (keys // wide, keys % wide), of
    if size < 1 << 63:
        keys, of = np.unique(a * wide + b, return_inverse=True)
        return (keys // wide, keys % wide), of
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return (a[order][new], b[order][new]), of


def _counted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, sorted, and how often each is given; no number is negative."""
    wide = int(b.max(initial=0)) + 1
    if wide * (int(a.max(initial=0)) + 1) >= 1 << 63:
        (a, b), of = _distinct_pairs(a, b)
        return a, b, np.bincount(of)
    keys = np.sort(a * wide + b)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] // wide, keys[first] % wide, np.diff(first, append=len(keys))


def _file(path: str, level: int, shard: int) -> str:
    return f"{path}/level-{level + 1}-{shard:05d}.bin"


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _to_bytes(*arrays: np.ndarray) -> bytes:
    kinds = "".join(a.dtype.str + " " for a in arrays).encode()
    return len(kinds).to_bytes(2, "little") + len(arrays[0]).to_bytes(8, "little") + kinds + b"".join(a.tobytes() for a in arrays)


def _from_bytes(data: bytes) -> list[np.ndarray]:
    size, n = int.from_bytes(data[:2], "little"), int.from_bytes(data[2:10], "little")
    out, at = [], 10 + size
    for kind in data[10:at].decode().split():
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def quantised(values: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the book of means: bins of equal size over the sorted values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return np.searchsorted(distinct, values).astype(np.min_scalar_type(bins - 1)), distinct
    edges = np.unique(np.quantile(values, np.arange(1, bins) / bins))
    codes = np.searchsorted(edges, values, side="right")
    sums, n = np.bincount(codes, values, len(edges) + 1), np.bincount(codes, minlength=len(edges) + 1)
    return codes.astype(np.min_scalar_type(bins - 1)), sums / np.maximum(n, 1)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _block_rows(shards: np.ndarray, n: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each shard with the arrays' part of it; the arrays are sorted by shard."""
    cuts = np.searchsorted(shards, np.arange(n + 1))
    full = [s for s in range(n) if cuts[s] < cuts[s + 1]]
    data = [_to_bytes(*[_small(a[cuts[s] : cuts[s + 1]]) for a in arrays]) for s in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])


def _pieces(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _first_level(plain: DataFrame, path: str, shards: int) -> DataFrame:
    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            hashes, n = _merged(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return _block_rows(shard_of(hashes, shards), shards, [hashes, n])

        for piece in _pieces(batches):
            hashes, flat, begins = tokens(piece.column("text"))
            n = np.bincount(flat, minlength=len(hashes))
            n[flat[0]] -= len(begins) - 1  # an end leads each text
            held.append((hashes, n))
            if sum(len(h) for h, _ in held) > _GATHERED:
                yield sent()
        if held:
            yield sent()

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        parts = [_from_bytes(d) for d in rows["data"]]
        keys, n = _merged(np.concatenate([p[0].astype(_U) for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        start = _start(shard, shards)
        span = (_start(shard + 1, shards) if shard + 1 < shards else 1 << 64) - start
        local = keys - _U(start)
        arrays = Sequence.build(local, span, "keys") | {"counts": _small(n), "top": np.array([span - 1], _U)}
        write_arrays(_file(path, 0, shard), arrays)
        return pd.DataFrame({"shard": [shard], "nodes": [len(keys)], "tokens": [int(n.sum())]})

    blocks = plain.mapInArrow(count, "shard int, data binary")
    return blocks.groupBy("shard").applyInPandas(build, "shard int, nodes long, tokens long")


def _next_level(plain: DataFrame, shape: Shape, level: int, discount: float, bins: int) -> DataFrame:
    def count(batches):
        trie = Trie(shape)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        offsets = shape.offsets[level - 1]

        def sent():
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            a, b, n = _counted_pairs(a, b)
            shard = np.searchsorted(offsets, a, side="right") - 1
            local = a - offsets[shard]
            step = np.diff(local, prepend=0)
            step[np.flatnonzero(np.diff(shard)) + 1] = local[np.flatnonzero(np.diff(shard)) + 1]
            return _block_rows(shard, shape.shards, [step, b, n])

        for piece in _pieces(batches):
            hashes, flat, begins = tokens(piece.column("text"))
            nodes, of = trie.path(trie.words(hashes), flat, begins, level)[-1]
            before = trie._before(of, begins)
            some = (before >= 0) & (of >= 0)
            held.append((nodes[before[some]], nodes[of[some]]))
            if sum(len(a) for a, _ in held) > _GATHERED:
                yield sent()
        if any(len(a) for a, _ in held):
            yield sent()

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(shape)
        shard = int(rows["shard"].iloc[0])
        parts = [_from_bytes(d) for d in rows["data"]]
        contexts = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
        suffixes = np.concatenate([p[1].astype(np.int64) for p in parts])
        (contexts, suffixes), of = _distinct_pairs(contexts, suffixes)
        n = np.bincount(of, np.concatenate([p[2].astype(np.int64) for p in parts])).astype(np.int64)
        del parts, of
        owned = int(np.diff(shape.offsets[level - 1])[shard])
        pointers = np.searchsorted(contexts, np.arange(owned + 1))
        # The suffix's own context: for words the root, else the node whose range holds it.
        relative = suffixes - trie.parent_begin(level - 1, suffixes)
        # Within a context nodes are sorted by suffix and so by relative word.
        last = np.flatnonzero(np.diff(contexts)) if len(contexts) else np.zeros(0, np.int64)
        rise = relative[last] + 1
        base = np.zeros(len(contexts), np.int64)
        base[last + 1] = rise
        keys = np.cumsum(base) + relative + 1
        total, kinds = np.add.reduceat(np.append(n, 0), np.minimum(pointers[:-1], len(n))), np.diff(pointers)
        total = np.where(kinds > 0, total, 0)
        lower = trie.lower(level - 1, suffixes)
        left = discount * kinds / np.maximum(total, 1)
        p = np.maximum(n - discount, 0) / total[contexts] + left[contexts] * 10.0**lower
        codes, book = quantised(np.log10(p), bins)
        some = kinds > 0
        weights = np.zeros(owned, np.min_scalar_type(bins))
        inner, weight_book = quantised(np.log10(left[some]), bins - 1)
        weights[some] = inner + weights.dtype.type(1)
        top = int(keys[-1]) + 1
        arrays = Sequence.build(keys, top, "keys") | Sequence.build(pointers, len(keys) + 1, "pointers")
        arrays |= {"codes": codes, "book": book, "weights": weights, "weight_book": np.append(0.0, weight_book), "top": np.array([top - 1], _U)}
        write_arrays(_file(shape.path, level, shard), arrays)
        return pd.DataFrame({"shard": [shard], "nodes": [len(keys)], "tokens": [int(n.sum())]})

    blocks = plain.mapInArrow(count, "shard int, data binary")
    return blocks.groupBy("shard").applyInPandas(build, "shard int, nodes long, tokens long")


def build(train: DataFrame, text: str = "text", order: int = 2, discount: float = 0.75, bins: int = 256, shard_bytes: int = 16 << 20) -> Shape:
    """Build a trie in the shared folder from the whole texts of ``train``."""
    scratch = Scratch(train.sparkSession, "trie")
    plain = train.select(F.col(text).cast("string").alias("text"))
    shards = min(max(1, math.ceil(plan_bytes(train) / shard_bytes)), 8 * parallelism(train.sparkSession))
    shape = Shape(scratch.local_path("levels"), shards, [])
    for level in range(order):
        made = _next_level(plain, shape, level, discount, bins) if level else _first_level(plain, shape.path, shards)
        sizes = np.zeros(shards, np.int64)
        for r in made.take(shards):  # one row each
            sizes[r.shard] = r.nodes
            shape.tokens += 0 if level else r.tokens
        shape.offsets.append(np.concatenate([[0], np.cumsum(sizes)]))
    return shape


def score(docs: DataFrame, shape: Shape, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""

    def work(batches):
        trie = Trie(shape)
        for piece in _pieces(batches):
            hashes, flat, begins = tokens(piece.column("text"))
            ids = trie.words(hashes)
            base, known = trie.unigram(ids), ids >= 0
            known &= trie.counts(ids) > 0
            body = np.ones(len(flat), bool)
            body[begins[:-1]] = False
            sums = lambda x: np.add.reduceat(np.where(body, x, 0), begins[:-1])
            n = np.diff(begins) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(sums(known[flat].astype(np.int64)), pa.int64()),
                    pa.array(np.full(len(n), shape.tokens), pa.int64()),
                    pa.array(sums(base[flat]), pa.float64()),
                    pa.array(sums(trie.score(ids, flat, begins)), pa.float64()),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return picked.mapInArrow(work, schema)
