"""Alignment of two tokenizers over a corpus, each different text once.

Equal texts meet by a shuffle on the whole text; each different text is tokenised and aligned once, with its number of copies as weight,
and rows get its measures back by the SHA-256 of their text.

A is a byte-level BPE (its JSON file), fed with a space and the text; B is a sentencepiece model, fed with the text, which adds the
space itself. Strings of special tokens are ordinary text. With A's split pattern given, short texts of Latin letters are encoded by the
same ranks through a faster library, if the file's merges are in the order of its ids; the ids are the same. Both token rows are laid
over the same bytes. Places where a token of A and one of B end cut the text into groups; an A and a B token are linked where their
bytes overlap. Every stretch between two neighbouring token ends, of either side, is one link.

An id pair's count is the number of links of the corpus that hold it, copies included. Different texts are gathered in blocks of about
``BLOCK_BYTES``; a block keeps its different id pairs with their counts and, per link, the number of its pair. Pair counts are summed
over the blocks, and every block gets back the counts of its own pairs, so the pair table is neither broadcast nor collected, and the
shuffle grows with the different pairs of blocks, not with the links.

A null or empty text, and one whose joined tokens differ from a space and the text, has no tokens: all its measures are zero and its
groups are the empty text. A null id is passed through; every row has an output row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.llm.text import release
from factorspark.session import cut_lineage, scratch_path

#: Different texts of about so many bytes make a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of texts that are tokenised at once.
STEP_BYTES = 1 << 18
#: Texts below this length with letters below U+0250 may go the faster way: what counts as a letter there is settled in all versions of Unicode.
FAST_CHARS, LATIN_END = 1 << 14, "\u0250"
MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and their ids as text followed by the separators of groups."""

    def __init__(self, a_file: bytes, b_file: bytes, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        a_bytes = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.flat = [np.frombuffer(b"".join(side), np.uint8) for side in (a_bytes, b_bytes)]
        self.size = [np.array([len(x) for x in side], np.int64) for side in (a_bytes, b_bytes)]
        self.words = [f"{i}{mark}" for i in range(len(a_bytes)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(b_bytes)) for mark in ",;"]
        self.fast = self._ranked(json.loads(a_file), a_bytes, pattern) if pattern else None

    @staticmethod
    def _ranked(spec: dict, a_bytes: list[bytes], pattern: str):
        """The same vocabulary as ranks; None unless the file says byte-level BPE only, its merges in the order of its ids."""
        import tiktoken

        model, first = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        special = {x["id"] for x in spec["added_tokens"]}
        if merged != sorted(set(merged)) or len(merged) + 256 + len(special) != len(a_bytes):
            return None
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(a_bytes) if i not in special}, special_tokens={})

    def _a_ids(self, texts: list[str]) -> list:
        fast = [self.fast is not None and len(t) < FAST_CHARS and max(t, default="") < LATIN_END for t in texts]
        rest = iter(self.a.encode_batch_fast([" " + t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [self.fast.encode_ordinary(" " + t) if f else next(rest).ids for t, f in zip(texts, fast, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side (ids of all texts in a row, number of each text's); no tokens for an empty text and for one whose joined tokens differ."""
        raw = [(" " + t).encode() for t in texts]
        length = np.array([len(x) for x in raw], np.int64)
        good = length > 1
        sides = []
        for ids, size, flat in zip((self._a_ids(texts), self.b.encode(texts, num_threads=1)), self.size, self.flat, strict=True):
            count = np.array([len(x) for x in ids], np.int64)
            ids = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
            text = np.repeat(np.arange(len(texts)), count)
            good &= np.bincount(text, size[ids], len(texts)).astype(np.int64) == length
            sides.append((ids, text, size, flat))
        want = np.frombuffer(b"".join(x for x, g in zip(raw, good, strict=True) if g), np.uint8)
        owner = np.repeat(np.flatnonzero(good), length[good])
        same = good.copy()
        for ids, text, size, flat in sides:
            ids = ids[good[text]]
            width, begin = size[ids], (np.cumsum(size) - size)[ids]
            at = np.repeat(begin - np.cumsum(width) + width, width) + np.arange(len(want))
            same[owner[flat[at] != want]] = False
        return [(ids[same[text]], np.bincount(text[same[text]], minlength=len(texts))) for ids, text, _, _ in sides]


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligned:
    """Tokens of several texts over their joined bytes; per link the A and B id and the text."""

    def __init__(self, kit: Tokenizers, texts: list[str]):
        n = len(texts)
        (self.a, self.n_a), (self.b, self.n_b) = kit.encode(texts)
        a_end, b_end = np.cumsum(kit.size[0][self.a]), np.cumsum(kit.size[1][self.b])
        total = int(a_end[-1]) if len(a_end) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[a_end] = is_b[b_end] = True
        ends = np.flatnonzero(is_a | is_b)
        is_a, is_b = is_a[ends], is_b[ends]
        self.link_a, self.link_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        both = is_a & is_b
        self.link_text = np.repeat(np.arange(n), self.n_a)[self.link_a]
        self.n_links = np.bincount(self.link_text, minlength=n)
        self.n_groups = np.bincount(self.link_text[both], minlength=n)
        # tokens in the order of the group texts: a group's A tokens, then its B tokens
        group = np.cumsum(both) - both
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.link_a[both]] = b_last[self.link_b[both]] = True
        a_group, b_group = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_group[self.link_a], b_group[self.link_b] = group, group
        groups = int(both.sum())
        in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[a_group]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[b_group]
        shift = 2 * len(kit.size[0])
        order[place_a], order[place_b] = self.a * 2 + a_last, shift + self.b * 2 + b_last
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        codes = order.tolist()
        self.groups = ["".join(map(kit.words.__getitem__, codes[i:j]))[:-1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def pairs(self) -> np.ndarray:
        """A id and B id of every link in one number."""
        return self.a[self.link_a] << 32 | self.b[self.link_b]


_kits: dict[int, Tokenizers] = {}


def tokenizers(a_file: bytes, b_file: bytes, pattern: str | None) -> Tokenizers:
    """The worker's tokenizers of these files; kept between tasks."""
    key = hash((a_file, b_file, pattern))
    if key not in _kits:
        _kits.clear()
        _kits[key] = Tokenizers(a_file, b_file, pattern)
    return _kits[key]


def blocks(texts: DataFrame, a_path: str, b_path: str, pattern: str | None = None, block_bytes: int = BLOCK_BYTES, with_groups: bool = True) -> DataFrame:
    """One row per block of different texts: their measures and groups, the block's id pairs with weighted counts, the pair number of every link.

    ``texts`` has (text, copies). Both tokenizer files (a few MB) are read on the driver and broadcast, so that workers need no file.
    """
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = texts.sparkSession.sparkContext.broadcast(tuple(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = tokenizers(*shared.value, pattern)
        from zstandard import ZstdCompressor

        base, made = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, made
            parts = [list(x) for x in zip(*held, strict=True)]
            keys, counts, groups, pairs, weights = parts
            pairs, weights = np.concatenate(pairs), np.concatenate(weights)
            order = np.argsort(pairs, kind="stable")
            new = np.flatnonzero(np.append(True, pairs[order[1:]] != pairs[order[:-1]])) if len(order) else order
            number = np.empty(len(order), np.int32)
            number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            total = np.add.reduceat(weights[order], new) if len(order) else weights
            row = {"block": base | made, "shas": list(chain.from_iterable(keys)), "counts": np.concatenate(counts).tobytes(), "groups": list(chain.from_iterable(groups)),
                   "links": ZstdCompressor().compress(number.tobytes()), "pairs": pairs[order[new]], "n": total}
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row.values(), schema, strict=True)], schema=schema)

        for batch in batches:
            rows, width = [], 0
            for i in range(batch.num_rows):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                width += len(rows[-1][0])
                if width >= STEP_BYTES or i + 1 == batch.num_rows:
                    x = Aligned(kit, [t for t, _ in rows])
                    copies = np.array([m for _, m in rows], np.int64)
                    held.append(([hashlib.sha256(t.encode()).digest() for t, _ in rows], np.stack([x.n_a, x.n_b, x.n_groups, x.n_links], axis=1),
                                 x.groups if with_groups else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups], x.pairs(), copies[x.link_text]))
                    size += width
                    rows, width = [], 0
                    if size >= block_bytes:
                        yield block()
        if held:
            yield block()
        release()

    schema = pa.schema([("block", pa.int64()), ("shas", pa.list_(pa.binary())), ("counts", pa.binary()), ("groups", pa.list_(pa.string())), ("links", pa.binary()),
                        ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    return texts.mapInArrow(run, "block bigint, shas array<binary>, counts binary, groups array<string>, links binary, pairs array<bigint>, n array<bigint>")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): every linked id pair of the corpus (A id in the high, B id in the low 32 bits), its count, and whether no other
    pair of the B id has a higher one."""
    rows = made.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).select(F.col("p.pairs").alias("pair"), "p.n")
    total = cut_lineage(rows.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = cut_lineage(total.groupBy(b.alias("b")).agg(F.max("n").alias("top")))
    return cut_lineage(total.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def measured(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sha, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every different text."""
    rows = made.select("block", F.posexplode("pairs").alias("at", "pair"))
    known = rows.join(pairs, "pair").select(F.col("block").alias("owner"), "at", (F.col("n") * 2 + F.col("best").cast("int")).alias("value"))
    names = ["sha", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        """A block and the counts of its own pairs: as many as its texts hold."""
        from zstandard import ZstdDecompressor

        shas, counts, groups, links = (block[c][0] for c in ("shas", "counts", "groups", "links"))
        table = np.frombuffer(counts.as_py(), np.int64).reshape(-1, 4)
        link = np.frombuffer(ZstdDecompressor().decompress(links.as_py()), np.int32)
        values = np.zeros(own.num_rows, np.int64)
        values[own["at"].to_numpy()] = own["value"].to_numpy()
        ends = np.concatenate([[0], np.cumsum(table[:, 3])])
        sums = []
        for one in (values & 1, values >> 1):
            run_ = np.concatenate([[0], np.cumsum(one[link])])
            sums.append(pa.array(run_[ends[1:]] - run_[ends[:-1]]))
        return pa.Table.from_arrays([shas.values, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(4)), *sums, groups.values], names=names)

    both = made.select("block", "shas", "counts", "groups", "links").groupBy("block").cogroup(known.groupBy("owner"))
    return both.applyInArrow(run, f"sha binary, {MEASURES}, n_best bigint, count_sum bigint, groups string")


def align(df: DataFrame, a_path: str, b_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
          with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """((id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row, (a, b, n, best) of every linked id pair).

    Groups are texts such as ``5,7|12;3|9,4``; without ``with_groups`` their SHA-256 in hexadecimal.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    path = scratch_path(spark, "alignment")
    blocks(texts, a_path, b_path, pattern, block_bytes, with_groups).write.parquet(path)
    made = spark.read.parquet(path)
    pairs = pair_counts(made)
    found = cut_lineage(measured(made, pairs))
    rows = df.select(F.col(id_col).alias("_key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    rows = rows.join(found, "sha").drop("sha").withColumnRenamed("_key", id_col)
    return rows, pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n", "best")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows, _ = align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, with_groups=False)
    return rows.withColumnRenamed("groups", "groups_sha256")
