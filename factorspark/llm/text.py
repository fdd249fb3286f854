"""Words, n-grams and hashes of many texts at once: numpy arrays over the bytes of an Arrow column.

Texts are UTF-8; null counts as empty. A word is a maximal run of ASCII letters, digits and bytes above 127 (so letters of
every script stay together); A-Z count as a-z. Nothing crosses from one text into the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def release() -> None:
    """Hand back what a worker holds after a task: the tables of this module, Arrow's pool, free pages of the C library where it can."""
    _table.clear()
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, bytes, offsets). A longer text is a run of its own."""
    buf, offs = buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, buf[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


class Rolling:
    """Hashes of any byte range of one run, after lower-casing A-Z unless ``raw``."""

    def __init__(self, buf: np.ndarray, raw: bool = False):
        n = len(buf)
        self.bytes = buf if raw else LOWER[buf]
        p, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * p[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of one run: start, end, hash per word; ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.rolling = Rolling(buf)
        is_word = IS_WORD[self.rolling.bytes]
        before, after = np.zeros_like(is_word), np.zeros_like(is_word)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.hash = self.rolling.hash(self.start, self.end)
        self.first = np.searchsorted(self.start, offs)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_hashes(phrase: str) -> np.ndarray:
    """Hashes of the words of one phrase, equal to those of ``Words``."""
    buf = np.frombuffer(phrase.encode(), np.uint8)
    return Words(buf, np.array([0, len(buf)], np.int64)).hash


def member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted_keys, or -1. A table of hash bits answers for most values that are absent."""
    found = np.full(len(values), -1, np.int64)
    if not len(sorted_keys) or not len(values):
        return found
    bits = max(12, int(len(sorted_keys) * 16 - 1).bit_length())
    key = f"{sorted_keys.ctypes.data}:{len(sorted_keys)}:{bits}"
    if _table.get("key") != key:
        table = np.zeros(1 << bits, bool)
        table[(sorted_keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        _table.update(key=key, table=table, keep=sorted_keys)
    maybe = np.flatnonzero(_table["table"][(values >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.searchsorted(sorted_keys, values[maybe])
    at[at == len(sorted_keys)] = 0
    hit = sorted_keys[at] == values[maybe]
    found[maybe[hit]] = at[hit]
    return found


_table: dict = {}


def totals(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets; an empty range gives 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of n words; a text of 1 to n-1 words has one shingle of all its words, an empty one none."""
    h, count = words.hash, np.diff(words.first)
    doc = words.text_of()
    k = max(len(h) - n + 1, 0)
    acc = np.zeros(k, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0xD1342543DE82EF95) + h[j:j + k]
    full = (doc[:k] == doc[n - 1:n - 1 + k]) if k else np.zeros(0, bool)
    docs, hashes = doc[:k][full], mix(acc[full])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            more = count[short] > j
            extra[more] = extra[more] * np.uint64(0xD1342543DE82EF95) + h[words.first[short[more]] + j]
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, mix(extra + np.uint64(1))])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes
