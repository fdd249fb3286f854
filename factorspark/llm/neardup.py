"""Near duplicates by BagMinHash: weighted Jaccard similarity of multisets of five-word shingles, 0.8 or more.

Signature. A shingle that occurs w times covers the weights 0..w. The weight axis is cut into shells [0,1), [1,2), [2,4), [4,8), ...;
each shell of each shingle carries a Poisson process whose rate is the shell's width, and every point has a time, a register and a
place on the axis. Points placed below w count; a register keeps its earliest time. Two registers agree with the probability of the
weighted Jaccard similarity, and a process is left as soon as its times exceed all registers of the text.

Groups. Texts with the same multiset form one class, and one text of each class goes on. Registers are banded; texts that share a band
meet a leader, and the exact similarity of the pair decides. Where a band's texts still lie in different components, further leaders
are tried. What then is left apart in a common band is searched exactly, without pairing the band's texts with each other: with all
shingles in one order, rare ones first, two texts of similarity t share one of their first n - ceil(t n) + 1 shingles; pairs that do,
in sizes and places that still allow t, are verified. (A pair at 0.8 shares no band with a probability of about 5e-8.) The components
of the verified links are the near-duplicate classes.

Texts without words (null, empty, only marks) are duplicates of nothing. Texts of fewer than five words have one shingle. Rows that
share an id are one document. A row with a null id is in no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.graph import components
from factorspark.llm.tables import read
from factorspark.llm.text import Words, mix, release, shingles, slices
from factorspark.session import cut_lineage

WORDS, THRESHOLD = 5, 0.8
REGISTERS, BANDS = 128, 32
#: Counters of the shingle frequencies that order the exact search; the order is only a matter of speed.
SKETCH_BITS = 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle."""
    doc, h = shingles(Words(buf, offs), n)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(doc)))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest times, n_docs x registers; infinite for a text without shingles."""
    out = np.full(n_docs * registers, np.inf)
    shells = np.frexp(weight.astype(float) - 0.5)[1].clip(0) + 1  # w = 1: 1; 2: 2; 3, 4: 3; ...
    at = np.repeat(np.arange(len(doc)), shells)
    shell = np.arange(len(at)) - np.repeat(np.cumsum(shells) - shells, shells)
    seed = mix(h[at] + shell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    width = np.where(shell > 0, low, 1.0)
    d, w = doc[at], weight[at].astype(float)
    time, point = np.zeros(len(at)), np.zeros(len(at), np.uint64)
    while len(d):
        k = int(np.clip(100_000 // len(d), 1, 128))
        x = mix(seed[:, None] + (point[:, None] + np.arange(1, k + 1, dtype=np.uint64)) * _STEP)
        gaps = -np.log(uniform(x)) / width[:, None]
        times = np.cumsum(np.concatenate([time[:, None], gaps], axis=1), axis=1)[:, 1:]
        y = mix(x + _STEP)
        register = (y & np.uint64(registers - 1)).astype(np.int64)
        place = low[:, None] + width[:, None] * (uniform(mix(y)) - 2.0 ** -54)
        counts = place < w[:, None]
        np.minimum.at(out, (d[:, None] * registers + register)[counts], times[counts])
        last = out.reshape(n_docs, registers).max(1)
        time, point = times[:, -1], point + np.uint64(k)
        go = time < last[d]
        seed, low, width, d, w, time, point = seed[go], low[go], width[go], d[go], w[go], time[go], point[go]
    return out.reshape(n_docs, registers)


def band_keys(times: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n_docs x bands keys of neighbouring registers."""
    bits = times.view(np.uint64).reshape(len(times), bands, -1)
    acc = np.zeros(bits.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for j in range(bits.shape[2]):
        acc = mix(acc * _STEP + bits[:, :, j])
    return acc


def signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, m1, m2, bands): shingles of the text, two sums that identify its multiset, band keys (none without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in slices(b.column(1)):
                n = len(offs) - 1
                doc, h, w = bags(buf, offs)
                size = np.bincount(doc, w, minlength=n).astype(np.int64)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, doc, mix(h + np.uint64(salt * int(_STEP) % 2 ** 64)) * w.astype(np.uint64))
                    sums.append(pa.array(total.view(np.int64)))
                keys = band_keys(signatures(doc, h, w, n))
                full = size > 0
                offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(keys[full]).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), pa.array(size), *sums, lists], names=["id", "size", "m1", "m2", "bands"])
        release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, size bigint, m1 bigint, m2 bigint, bands array<bigint>")


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bag): sorted shingles and their counts as bytes, for the exact comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in slices(b.column(1)):
                n = len(offs) - 1
                doc, h, w = bags(buf, offs)
                ends = np.searchsorted(doc, np.arange(n + 1))
                bag = [h[a:z].tobytes() + w[a:z].astype(np.uint32).tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), pa.array(bag, pa.binary())], names=["id", "bag"])
        release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    n, m = len(a) // 12, len(b) // 12
    h, g = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    w, v = np.frombuffer(a, np.uint32, n, 8 * n).astype(np.int64), np.frombuffer(b, np.uint32, m, 8 * m).astype(np.int64)
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    both = int(np.minimum(w[i], v[j]).sum())
    return both / max(int(w.sum() + v.sum()) - both, 1)


def verified(pairs: DataFrame, bag: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    both = pairs.join(bag.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(bag.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            keep = [similarity(x[i].as_py(), y[i].as_py()) >= threshold for i in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    kind = dict(pairs.dtypes)["a"]
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _leaders(met: DataFrame, order: str) -> DataFrame:
    """Pairs of each text with one leader of its band that lies in another component."""
    lead = met.groupBy("key").agg((F.max if order == "greatest" else F.min)(F.struct("id", "root")).alias("lead"))
    pairs = met.join(lead, "key").where(F.col("root") != F.col("lead.root"))
    return pairs.select(F.greatest("id", "lead.id").alias("a"), F.least("id", "lead.id").alias("b")).distinct()


def _frequencies(bags_: DataFrame) -> np.ndarray:
    """Counts of shingles by hash slot; of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for x in b.column(0):
                raw = x.as_py()
                total += np.bincount((np.frombuffer(raw, np.uint64, len(raw) // 12) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = bags_.select("bag").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _prefix_pairs(apart: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``apart`` (id, root, bag) in different components that can reach the threshold."""
    counts = apart.sparkSession.sparkContext.broadcast(_frequencies(apart))  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(2)[i].as_py()
                m = len(raw) // 12
                h, w = np.frombuffer(raw, np.uint64, m), np.frombuffer(raw, np.uint32, m, 8 * m).astype(np.int64)
                n = int(w.sum())
                copy = np.arange(n) - np.repeat(np.cumsum(w) - w, w)
                rank = np.repeat(counts.value[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], w)
                key = mix(np.repeat(h, w) + copy.astype(np.uint64) * _STEP)
                k = n - int(np.ceil(threshold * n - 1e-9)) + 1
                first = np.lexsort((key, rank))[:k]
                one = pa.array(np.zeros(k, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), b.column(0).slice(i, 1).take(one), b.column(1).slice(i, 1).take(one),
                                                  pa.array(np.full(k, n)), pa.array(n - np.arange(k))], names=["key", "id", "root", "size", "rest"])

    kind = dict(apart.dtypes)["id"]
    rows = apart.select("id", "root", "bag").mapInArrow(run, f"key bigint, id {kind}, root {kind}, size bigint, rest bigint")
    shared = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("key")
    rows = cut_lineage(rows.join(shared, "key"))
    x, y = rows.alias("x"), rows.alias("y")
    size = F.col("x.size") + F.col("y.size")
    possible = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & (
        F.least("x.rest", "y.rest") >= size * (threshold / (1 + threshold)) - 1e-6) & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * threshold - 1e-6)
    return x.join(y, possible).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, same_id, kept): near-duplicate class (its least id), the least id with the same multiset, and whether the row's id stands for its class."""
    found = cut_lineage(signed(df, id_col, text_col))
    usable = found.where("size > 0 AND id IS NOT NULL")
    same = cut_lineage(usable.groupBy("m1", "m2", "size").agg(F.min("id").alias("same")))
    named = usable.join(same, ["m1", "m2", "size"])
    bands = named.where(F.col("id") == F.col("same")).select("id", F.explode("bands").alias("key")).distinct()
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = cut_lineage(bands.join(shared, "key").select("key", "id"))
    links = named.where(F.col("id") != F.col("same")).select(F.col("id").alias("a"), F.col("same").alias("b")).distinct()
    wanted = met.select("id").distinct()
    bag = cut_lineage(packed(df.join(wanted, df[id_col] == wanted["id"], "left_semi"), id_col, text_col).groupBy("id").agg(F.first("bag").alias("bag")))
    near, tested, roots = None, None, None
    for order in ("least", "greatest", "prefix"):
        placed = met.withColumn("root", F.col("id")) if roots is None else met.join(roots, met["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
        if roots is not None:
            mixed = placed.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("key")
            placed = placed.join(mixed, "key")
        if order == "prefix":
            pairs = _prefix_pairs(cut_lineage(placed.select("id", "root").distinct().join(bag, "id")), threshold)
        else:
            pairs = _leaders(cut_lineage(placed), order)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        new = cut_lineage(verified(pairs, bag, threshold))
        tested = pairs if tested is None else tested.unionAll(pairs)
        near = new if near is None else near.unionAll(new)
        if order != "prefix":
            roots = cut_lineage(components(near))
    edges = links if near is None else links.unionAll(near)
    final = components(edges)
    rows = found.select("id").join(final, found["id"] == final["node"], "left")
    least = usable.join(same, ["m1", "m2", "size"]).groupBy("id").agg(F.min("same").alias("same_id"))
    rows = rows.select("id", F.coalesce("root", "id").alias("class_id")).join(least, "id", "left").select("id", "class_id", F.coalesce("same_id", "id").alias("same_id"))
    return rows.select(F.col("id").alias(id_col), "class_id", "same_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns."""
    gone = classes(df, id_col, text_col, threshold).where("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
