"""Near duplicates by SimHash: 64-bit fingerprints that differ in at most three bits, searched through Golay codewords.

Fingerprint. A text is lower-cased (A-Z), cut into words at space, tab, line feed, vertical tab, form feed and carriage return, and
into shingles of three words joined by a space, repeats included; one or two words are one shingle. A bit of the fingerprint is set
when more than half of the shingles' XXH64 (seed 42) have it. A text without words (null, empty, only white space) has fingerprint
zero and is linked like any other.

Keys. The fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay code [23, 12, 7] is perfect: every segment has
exactly one codeword within three bits, named by its 12 data bits. A segment of even parity has its own codeword as key; one of odd
parity has the codewords of all segments that differ in at most one bit (one or six of them). Two segments that differ in at most one
bit so share a key: they are equal, or one is odd and reaches the other's codeword. With three errors in all, either one segment is
equal and another has at most one error (key: the equal segment and a codeword of the other), or each has exactly one (key: a codeword
of each). Keys have 33 to 36 bits; a fingerprint has about 50 of them.

Links. Fingerprints that share a key are compared bit by bit. Two that have a key for themselves are compared where keys are counted.
Of larger keys not all pairs are made: everyone first meets one member (a leader, another one each round, as long as rounds settle
many), links are contracted to components, and only what then lies outside a key's largest component is compared with all of the key.
No link between components is lost, as each linked pair shares a key.

Every row has an output row; rows that repeat an id are rows of their own. A row with a null id takes part in the links, but is no
component's least id; a component of such rows alone has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.graph import components
from factorspark.llm.tables import read
from factorspark.session import cut_lineage

WORDS, DISTANCE, SEED = 3, 3, 42
#: Another round of leaders follows one that settled this share of the rows; more rounds only leave less to the exact comparison.
SETTLED = 0.1
#: First bit and number of bits of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, a fixed value.
GENERATOR = 0b110001110101
#: Shingles of a text that are hashed at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(len(words) - n + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        part = words[at:at + CHUNK + n - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(id, fp): fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), n) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp bigint")


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit vectors by the generator polynomial."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= (v >> bit & 1) * (GENERATOR << bit - 11)
    return v


def _errors() -> np.ndarray:
    """The only error of at most three bits with each of the 2,048 syndromes."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique(two[:, None] | one)
    every = np.unique(np.concatenate([[0], one, three]))
    table = np.full(2048, -1)
    table[syndrome(every)] = every
    return table


ERRORS = _errors()


def codewords(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword name), sorted and distinct: the nearest codeword of every segment, for one of odd parity also those of all segments at one bit."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    near = ERRORS[syndrome(segment)[:, None] ^ syndrome(flips)]
    names = (segment[:, None] ^ flips ^ near) >> 11
    odd = np.bitwise_count(segment) & 1 == 1
    names[~odd, 1:] = names[~odd, :1]
    names.sort(axis=1)
    new = np.ones(names.shape, bool)
    new[:, 1:] = names[:, 1:] != names[:, :-1]
    row, _ = np.nonzero(new)
    return row, names[new]


def product(row: np.ndarray, left: np.ndarray, other: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, left value, right value) of all combinations within each of n rows."""
    count = np.bincount(other, minlength=n)
    first = np.cumsum(count) - count
    times = count[row]
    at = np.repeat(first[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row, times), np.repeat(left, times), right[at]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of fingerprints: equal segment and codeword of another, for each order; codewords of all three."""
    fp = fp.astype(np.uint64)
    segments = [(fp >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [codewords(s, bits) for s, (_, bits) in zip(segments, SEGMENTS, strict=True)]
    rows, out = [], []
    for i, equal in enumerate(segments):
        for j in range(3):
            if i != j:
                row, name = near[j]
                rows.append(row)
                out.append((3 * i + j) << 40 | equal[row] << 12 | name)
    row, a, b = product(*near[0], *near[1], len(fp))
    row, ab, c = product(row, a << 12 | b, *near[2], len(fp))
    rows.append(row)
    out.append(9 << 40 | ab << 12 | c)
    return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) of different fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                fp = b.column(0).slice(at, 2048).to_numpy()
                row, key = keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _apart(a: str, b: str, distance: int) -> Column:
    """Different components, few different bits."""
    return (F.col(f"{a}.root") != F.col(f"{b}.root")) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= distance)


def _pairs(joined: DataFrame, a: str, b: str) -> DataFrame:
    return joined.select(F.greatest(f"{a}.fp", f"{b}.fp").alias("a"), F.least(f"{a}.fp", f"{b}.fp").alias("b")).distinct()


def clusters(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of the different fingerprints ``fps`` that are linked to others; the root is the least of the component. ``distance`` is 3 at most."""
    if distance > 3:
        raise ValueError("the keys reach three bits")
    every = keyed(fps)
    # an aggregate feeds a join only from a checkpoint: its exchange then lies directly under the join, where a hot key is split
    met = cut_lineage(every.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    links = cut_lineage(met.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct())
    rows = cut_lineage(every.join(met.where("n > 2").select("key"), "key").withColumn("root", F.col("fp")))
    left, k = rows.count(), 0
    while left:
        lead = cut_lineage(rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(k)), "fp", "root")).alias("lead")).select("key", "lead.fp", "lead.root"))
        near = rows.alias("x").join(lead.alias("y"), F.col("x.key") == F.col("y.key")).where(_apart("x", "y", distance))
        links = links.unionAll(cut_lineage(_pairs(near, "x", "y")))
        rows = _mixed(rows, cut_lineage(components(links)))
        before, left, k = left, rows.count(), k + 1
        if left > before * (1 - SETTLED):
            break
    size = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(size.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top")).select("key", F.col("top.root").alias("top")))
    few = cut_lineage(rows.join(large, "key").where("root <> top").select("key", "fp", "root"))
    rest = few.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & _apart("x", "y", distance))
    return components(links.unionAll(cut_lineage(_pairs(rest, "x", "y")))).select(F.col("node").alias("fp"), "root")


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their new roots, of the keys that still hold different ones."""
    placed = cut_lineage(rows.select("key", "fp").join(roots, rows["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root")))
    mixed = cut_lineage(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"))
    return cut_lineage(placed.join(mixed, "key"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component_id) of every row: the least id that can be reached over links."""
    found = cut_lineage(fingerprints(df, id_col, text_col))
    ids = cut_lineage(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut_lineage(clusters(ids, distance))
    placed = cut_lineage(ids.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    least = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(placed.join(least, "root").select("fp", "component_id"))
    return found.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
