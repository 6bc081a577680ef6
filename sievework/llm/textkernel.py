"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a run of bytes other than space and 0x09-0x0D. All hashes are 64-bit: a word's hash is a
polynomial over a random byte table, mixed; an n-gram's hash combines the hashes of its words by
position, mixed again. Work proceeds in chunks of whole texts, so that memory follows the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser with full avalanche (xor-shift and odd multipliers)."""
    x = x + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = mix(np.arange(1, 257, dtype=U64), 77)
_TABLE[_SPACE] = 0
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_powers = np.ones(1, U64)


def _power(n: int) -> np.ndarray:
    """At least the first n powers of the base; those that only a very long word asks for are not kept."""
    global _powers
    if len(_powers) >= n:
        return _powers
    steps = np.full(max(n, 4096), _BASE, U64)
    steps[0] = 1
    out = np.multiply.accumulate(steps)
    if n <= 1 << 16:
        _powers = out
    return out


class Words:
    """The words of a chunk of texts.

    hash: per word; start, end: byte offsets in ``data``; bound: for text i its words are
    bound[i]..bound[i+1]; data: the chunk's bytes; offset: byte offsets of the texts.
    """

    __slots__ = ("hash", "start", "end", "bound", "data", "offset")

    def __init__(self, data: np.ndarray, offset: np.ndarray, lower: bool):
        self.data, self.offset = data, offset
        n = len(data)
        space = _SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offset] = True  # a text's first byte begins a word whatever stands before it
        begin = ~space
        begin[1:] &= space[:-1] | first[1:n]
        self.start = np.flatnonzero(begin)
        last = ~space
        last[:-1] &= space[1:] | first[1:n]
        self.end = np.flatnonzero(last) + 1
        self.bound = np.searchsorted(self.start, offset)
        if len(self.start):
            values = (_LOWER_TABLE if lower else _TABLE)[data[self.start[0] :]]
            gaps = np.diff(np.append(self.start, n))
            place = np.arange(n - self.start[0], dtype=np.int64)
            place -= np.repeat(self.start - self.start[0], gaps)
            values *= _power(int(gaps.max()) + 1)[place]
            self.hash = mix(np.add.reduceat(values, self.start - self.start[0]), 1)
        else:
            self.hash = np.zeros(0, U64)

    def text_of_word(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))

    def ngrams(self, n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and their first words' indexes; none spans two texts."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        total = np.zeros(count, U64)
        factor = mix(np.arange(n, dtype=U64), seed * 131 + n) | U64(1)
        for k in range(n):
            total += self.hash[k : k + count] * factor[k]
        fits = np.ones(count, bool)
        for bound in self.bound[1:-1]:
            fits[max(0, bound - n + 1) : bound] = False
        at = np.flatnonzero(fits)
        return mix(total[at], seed), at

    def word_bytes(self, first: int, last: int) -> bytes:
        """The bytes from the start of word ``first`` to the end of word ``last - 1``."""
        return self.data[self.start[first] : self.end[last - 1]].tobytes() if last > first else b""


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, starting at 0) of a string column; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offset[0] : offset[-1]] if len(offset) else whole, offset - offset[0]


def word_chunks(column: pa.Array, lower: bool, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) for chunks of about ``chunk`` bytes; a longer text stands alone."""
    data, offset = string_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offset, offset[row] + chunk, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, Words(data[offset[row] : offset[end]], offset[row : end + 1] - offset[row], lower)
        row = end


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per text, sorted: (hashes, bounds). A text of fewer than n words has one shingle, its
    whole sequence; a text without words has none."""
    hashes, at = words.ngrams(n)
    bound = np.searchsorted(at, words.bound)
    out, ends = [], [0]
    for i in range(len(bound) - 1):
        if bound[i + 1] > bound[i]:
            own = np.unique(hashes[bound[i] : bound[i + 1]])
        elif words.bound[i + 1] > words.bound[i]:
            own = sequence_hash(words.hash[words.bound[i] : words.bound[i + 1]], 9)[None]
        else:
            own = hashes[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else hashes[:0], np.array(ends)


def sequence_hash(hashes: np.ndarray, seed: int) -> np.uint64:
    """One hash of a sequence of word hashes."""
    factor = mix(np.arange(len(hashes), dtype=U64), seed) | U64(1)
    return mix(np.array([(hashes * factor).sum(dtype=U64) + U64(len(hashes))]), seed + 1)[0]
