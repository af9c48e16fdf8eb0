"""Elias-Fano sequences in numpy, and files of arrays that are mapped into memory.

A monotone sequence of n numbers below u is kept in about 2 + log2(u / n) bits each: low bits as
they are, high parts as a unary bit vector. All look-ups take arrays.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_BLOCK = 8  # words of 64 bits between two entries of a directory
_U = np.uint64
#: Seven fields of nine bits: of each field the lowest and the highest bit, and the bits before the words of a block.
_NINES = _U(sum(1 << 9 * i for i in range(7)))
_NINTHS = _NINES << _U(8)
_FULL = _U(sum(64 * (i + 1) << 9 * i for i in range(7)))
_SHIFTS = np.array([63, *range(0, 63, 9)], _U)  # of a word's field; the first word has none, the top bit is 0
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: The place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], _U).ravel()


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits one after another."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 2, _U)
    if not n or not width:
        return words
    at = np.arange(n, dtype=_U) * _U(width)
    word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.bitwise_or.reduceat(values << off, first)
    over = np.flatnonzero(off + _U(width) > _U(64))
    words[word[over] + 1] |= values[over] >> (_U(64) - off[over])
    return words


class Sequence:
    """A monotone sequence; ``parts`` holds its arrays under names that start with ``name``."""

    def __init__(self, parts: dict[str, np.ndarray], name: str):
        self.n, self.width = (int(x) for x in parts[name + ".shape"])
        self.low, self.high = parts[name + ".low"], parts[name + ".high"]
        self.zeros, self.sums = parts[name + ".zeros"], parts[name + ".sums"]
        self.ones = np.arange(len(self.zeros), dtype=np.int64) * (64 * _BLOCK) - self.zeros

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        values = np.asarray(values, _U)
        n = len(values)
        width = min(63, max(0, (int(universe) // n).bit_length() - 1)) if n else 63
        low = _pack(values & _U((1 << width) - 1), width)
        at = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = n + (int(universe) >> width) + 2
        high = np.zeros(-(-bits // (64 * _BLOCK)) * _BLOCK + _BLOCK, _U)
        if n:
            word = at >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(_U), first)
        ones = np.bitwise_count(high).reshape(-1, _BLOCK).astype(_U)
        before = np.cumsum(ones, axis=1)
        free = 64 * _BLOCK - before[:, -1].astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(free)[:-1]])
        sums = np.bitwise_or.reduce(before[:, :-1] << _SHIFTS[1:], axis=1)
        return {name + ".shape": np.array([n, width]), name + ".low": low, name + ".high": high, name + ".zeros": zeros, name + ".sums": sums}

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th bit of this kind."""
        directory = self.ones if bit else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        rest = (k - directory[block]).astype(_U)
        # The words of the block that begin at or before the bit, all seven compared at once.
        sums = self.sums[block] if bit else _FULL - self.sums[block]
        wanted = rest * _NINES
        at_most = ((((wanted | _NINTHS) - (sums & ~_NINTHS)) | (sums ^ wanted)) ^ (sums & ~wanted)) & _NINTHS
        number = ((at_most >> _U(8)) * _NINES >> _U(54) & _U(7)).astype(np.int64)
        rest -= sums >> _SHIFTS[number] & _U(511)
        word = block * _BLOCK + number
        bits = self.high[word] if bit else ~self.high[word]
        # So for the bytes of the word.
        sums = bits - (bits >> _U(1) & _U(0x5555555555555555))
        sums = (sums & _U(0x3333333333333333)) + (sums >> _U(2) & _U(0x3333333333333333))
        sums = (sums + (sums >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
        shift = (((rest * _ONES | _TOPS) - sums & _TOPS) >> _U(7)) * _ONES >> _U(56) << _U(3)
        rest -= (sums << _U(8)) >> shift & _U(255)
        place = _IN_BYTE[(bits >> shift & _U(255)) << _U(3) | rest] + shift
        return word * 64 + place.astype(np.int64)

    def _next(self, at: np.ndarray, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th bit of this kind, which is the first of its kind from ``at`` on."""
        word = at >> 6
        bits = (self.high[word] if bit else ~self.high[word]) >> (at & 63).astype(_U)
        place = at + np.bitwise_count(~bits & (bits - _U(1)))
        far = np.flatnonzero(bits == 0)
        if len(far):
            place[far] = self._select(k[far], bit)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.width)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        left = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return ((self.low[word] >> off) | left) & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(_U) << _U(self.width)) | self._low(i)

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at these places and at those behind them."""
        i = np.asarray(i, np.int64)
        place, j = self._select(i, 1), i + 1
        behind = self._next(place + 1, j, 1)
        return ((place - i).astype(_U) << _U(self.width)) | self._low(i), ((behind - j).astype(_U) << _U(self.width)) | self._low(j)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first place with a number of at least each value, the end of those with its high part, and its low bits."""
        values = np.asarray(values, _U)
        part = (values >> _U(self.width)).astype(np.int64)
        first = np.zeros(len(part), np.int64)  # behind the zero that ends the part before
        some = np.flatnonzero(part > 0)
        first[some] = self._select(part[some] - 1, 0) + 1
        begin, end = first - part, self._next(first, part, 0) - part
        want = values & _U((1 << self.width) - 1)
        low, high = begin, end.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low, end, want

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place with a number of at least each value (n if there is none)."""
        return self._search(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place with each value; -1 if there is none."""
        place, end, want = self._search(values)
        maybe = np.flatnonzero(place < end)
        out = np.full(len(place), -1)
        maybe = maybe[self._low(place[maybe]) == want[maybe]]
        out[maybe] = place[maybe]
        return out


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; it appears under its name only when whole, so a task may run twice."""
    head, blobs, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, at, len(a)]
        blobs.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(blobs[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for b in blobs:
            out.write(b)
    store.move(draft, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped. What isn't a file here is first copied to one that has no name."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        file = open(path, "rb")  # noqa: SIM115
    else:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        with store.open_input_stream(path) as stream:
            while piece := stream.read(1 << 24):
                file.write(piece)
        file.flush()
    with file:
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    length = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + length])
    return {
        name: np.frombuffer(data, np.dtype(kind), n, 8 + length + at) if n else np.zeros(0, np.dtype(kind))
        for name, (kind, at, n) in head.items()
    }
