"""Byte-level BPE with given ranks: encode and decode whole texts.

Each match of the split pattern is encoded by itself. Inside a match a rank queue holds one bucket of linked-list positions
per merge rank; a two-level bitmap marks the buckets in use, find-first-set gives the lowest rank, and positions whose pair has
changed since they were queued are skipped. n symbols cost O(n log n), so a match of megabytes is no special case.

Null and empty text: no tokens, decoded to nothing. Repeated rows are encoded each. A null id is passed through.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.llm.text import release

#: A worker keeps the ids of so many different matches, twice; older ones go.
CACHE_ENTRIES = 250_000
#: Matches of a text that are held at once.
CHUNK = 1 << 16
#: Ranks of pairs of ids that a task remembers.
PAIR_ENTRIES = 250_000


class Encoder(dict):
    """Maps a match (str) to its ids as little-endian uint32 bytes; keeps two generations of CACHE_ENTRIES at most."""

    def __init__(self, rank_file: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.packed = {k: v.to_bytes(4, "little") for k, v in self.ranks.items()}
        self.n_words = (max(self.tokens) >> 8) + 1
        self.byte_ids = [self.ranks[bytes([i])] for i in range(256)]
        self.size = np.zeros(max(self.tokens) + 1, np.int64)
        for k, v in self.tokens.items():
            self.size[k] = len(v)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens[k] for k in sorted(self.tokens)), np.uint8)
        self.pairs: dict[int, int] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            raw = match.encode()
            ids = self.packed.get(raw)
            if ids is None:
                ids = array("I", self.merge(raw)).tobytes()
            if len(raw) > 64:
                return ids
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[match] = ids
        return ids

    def rank_of(self, pair: int) -> int:
        """Rank of two adjacent ids (one in the high, one in the low 32 bits), -1 without one; remembered."""
        rank = self.pairs[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return rank

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one match: always the pair of lowest rank, the leftmost of equal ones.

        The rank queue: ``buckets[rank]`` is a heap of positions, bit ``rank % 256`` of ``words[rank // 256]`` says that the
        bucket is in use, and bit ``rank // 256`` of ``summary`` that the word has such a bit.
        """
        known, rank_of = self.pairs.get, self.rank_of
        byte_ids = self.byte_ids
        ids = [byte_ids[x] for x in raw]
        n = len(ids)
        buckets: dict[int, list[int]] = {}
        words = [0] * self.n_words
        summary = 0
        for i in range(n - 1):
            pair = ids[i] << 32 | ids[i + 1]
            rank = known(pair)
            if rank is None:
                rank = rank_of(pair)
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    high = rank >> 8
                    words[high] |= 1 << (rank & 255)
                    summary |= 1 << high
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = word = word & word - 1
                if not word:
                    summary &= summary - 1
            j = after[i]
            if j >= n or ids[i] < 0 or known(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: an earlier merge took one of the two
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            at, pair = i, -1
            if k < n:
                before[k] = i
                pair = rank << 32 | ids[k]
            for _ in (0, 1):
                if pair >= 0:
                    new = known(pair)
                    if new is None:
                        new = rank_of(pair)
                    if new >= 0:
                        if new in buckets:
                            heappush(buckets[new], at)
                        else:
                            buckets[new] = [at]
                            high = new >> 8
                            words[high] |= 1 << (new & 255)
                            summary |= 1 << high
                at = before[i]
                pair = ids[at] << 32 | rank if at >= 0 else -1
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None, pattern) -> bytes:
        """Ids of a whole text, packed."""
        get = self.__getitem__
        if not text:
            return b""
        if len(text) < CHUNK * 8:
            return b"".join(map(get, pattern.findall(text)))
        found, parts = (m.group() for m in pattern.finditer(text)), []
        while part := list(islice(found, CHUNK)):
            parts.append(b"".join(map(get, part)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        parts = []
        for at in range(0, len(ids), 4 * CHUNK):
            x = np.frombuffer(ids[at:at + 4 * CHUNK], "<u4")
            size = self.size[x]
            ends = np.cumsum(size)
            parts.append(self.flat[np.repeat(self.begin[x] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


_encoders: dict[int, Encoder] = {}


def encoder(rank_file: bytes) -> Encoder:
    """The worker's encoder of these ranks; kept between tasks."""
    key = hash(rank_file)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def tokenize(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids binary (packed uint32), decoded binary) per row; without ``with_ids`` the SHA-256 of both instead.

    The rank file (under 1 MB) is read on the driver and broadcast, so that workers need no file.
    """
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc, pat = encoder(ranks.value), regex.compile(pattern)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            counts, left, right = [], [], []
            for i in range(len(texts)):
                ids = enc.encode(texts[i].as_py(), pat)
                back = enc.decode(ids)
                counts.append(len(ids) // 4)
                left.append(ids if with_ids else hashlib.sha256(ids).hexdigest())
                right.append(back if with_ids else hashlib.sha256(back).hexdigest())
            kind = pa.binary() if with_ids else pa.string()
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(left, kind), pa.array(right, kind)], names=names)
        release()

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    names = [id_col, "n_tokens", "ids", "decoded"] if with_ids else [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = "binary" if with_ids else "string"
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, {names[2]} {kind}, {names[3]} {kind}")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
