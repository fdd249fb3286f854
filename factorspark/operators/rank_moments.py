"""Sums over average ranks per group, without a shuffle of single rows.

Tasks pack the values of a group into arrays before the one exchange; a group of up to ``GROUP_ROWS`` rows is ranked where its arrays
meet. A larger group is cut at its own quantiles into buckets of about half that size and takes two exchanges, one per side; a bucket
knows how many values lie below it. A value frequent enough to be a quantile has a bucket of its own, whose rank needs no sort, so
that bucket is spread over several groups. All ranks are exact: the quantiles only say where to cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one group ranked in memory, 16 bytes each, and long rows a task packs at a time.
GROUP_ROWS = 1 << 20
PACK_ROWS = 1 << 19


def _buckets(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Even: between two cuts; odd: equal to a cut."""
    return np.searchsorted(cuts, v, "left") + np.searchsorted(cuts, v, "right")


def _ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks from 1; NaN is the largest value and equal to itself."""
    _, at, ties = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(ties) - (ties - 1) / 2)[at]


def _packed(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(group, x, y) of every group in each run of ``PACK_ROWS`` rows."""

    def flush(held):
        t = pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate([("_x", "list"), ("_y", "list")])
        keys = zip(*[t[c].to_pylist() for c in by])
        xs, ys = t["_x_list"].combine_chunks(), t["_y_list"].combine_chunks()
        for i, key in enumerate(keys):
            yield key, xs[i].values.to_numpy(zero_copy_only=False), ys[i].values.to_numpy(zero_copy_only=False)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACK_ROWS:
            yield from flush(held)
            held, n = [], 0
    if n:
        yield from flush(held)


def _pieces(key: tuple, x: np.ndarray, y: np.ndarray, b: np.ndarray, counts, rows: int, turn: int) -> Iterator[tuple]:
    """One row per bucket, (key, bucket, salt, x, y); only buckets of one value are salted."""
    order = np.argsort(b, kind="stable")
    at = np.flatnonzero(np.diff(b[order], prepend=-1))
    for lo, hi in zip(at, [*at[1:], len(b)]):
        k, rows_of = int(b[order[lo]]), order[lo:hi]
        yield (*key, k, turn % -(-int(counts[k]) // rows) if k % 2 else 0, x[rows_of], y[rows_of])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _flat(t: pa.Table, c: str) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(k.flatten().to_numpy(zero_copy_only=False) for k in t[c].chunks)])


def rank_moments(df: DataFrame, by: list[str], x: str, y: str, rows: int = GROUP_ROWS) -> DataFrame:
    """Per group of rows that have both: ``n``, ``rank_ic`` (Spearman, average ranks) and ``held``, the covariance of the rank of x with y
    over the rank's spread. Both are NULL where a side does not vary and where a key is NULL."""
    d = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    fields = [T.StructField(c, d.schema[c].dataType) for c in by]
    where = [T.StructField("_b", T.LongType()), T.StructField("_s", T.LongType())]
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_x", "_y")]
    sums = [T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("_sxx", "_syy", "_sxy", "_sxf")]]
    # groups over the bound: at most one per ``rows`` rows of input
    large = d.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).collect()
    sizes = {tuple(r[:-1]): r["_n"] for r in large if None not in tuple(r[:-1])}
    skip = {tuple(r[:-1]) for r in large}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, n = None, [], 0
        for b in _schema_first(batches):
            if isinstance(b, pa.Schema):
                schema = b
                continue
            key, xs, ys = b
            if key in skip:
                continue
            out.append((*key, xs, ys))
            n += len(xs)
            if n >= PACK_ROWS:
                yield _table(out, schema)
                out, n = [], 0
        if out:
            yield _table(out, schema)

    def _schema_first(batches):
        first = next(batches, None)
        if first is None:
            return
        yield pa.schema([*[first.schema.field(c) for c in by], pa.field("_x", pa.list_(pa.float64())), pa.field("_y", pa.list_(pa.float64()))])

        def again():
            yield first
            yield from batches

        yield from _packed(again(), by)

    def settle(key: tuple, t: pa.Table, rx: np.ndarray, ry: np.ndarray, f: np.ndarray, n: int) -> pa.Table:
        """Sums over centred ranks; the mean rank of a group is (n + 1) / 2."""
        a, b = rx - (n + 1) / 2, ry - (n + 1) / 2
        vals = [len(rx), float(a @ a), float(b @ b), float(a @ b), float(a @ f)]
        return pa.table([pa.array([k.as_py()], t.schema.field(c).type) for k, c in zip(key, by)] + [pa.array([v]) for v in vals], names=[*by, *[s.name for s in sums]])

    def small(key, t):
        xs, ys = _flat(t, "_x"), _flat(t, "_y")
        return settle(key, t, _ranks(xs), _ranks(ys), ys, len(xs))

    # one turn per group: its arrays are at most ``rows`` long
    parts = d.mapInArrow(whole, T.StructType([*fields, *arrays])).groupBy(*by).applyInArrow(small, T.StructType([*fields, *sums]))
    if sizes:
        parts = parts.unionByName(_large(d, by, sizes, rows, fields, where, arrays, sums, settle))
    if skip - set(sizes):  # rows whose key is NULL have no ranks
        parts = parts.unionByName(d.filter(" OR ".join(f"`{c}` IS NULL" for c in by)).groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > rows)
                                  .select("*", *[F.lit(None).cast("double").alias(s.name) for s in sums[1:]]))
    g = parts.groupBy(*by).agg(*[F.sum(s.name).alias(s.name) for s in sums])
    keyed = F.lit(True)
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    vx, vy = F.col("_sxx") / F.col("n"), F.col("_syy") / F.col("n")
    ic = F.when(keyed & (vx > 1e-18) & (vy > 1e-18), F.col("_sxy") / F.col("n") / (F.sqrt(vx) * F.sqrt(vy)))
    return g.select(*by, "n", ic.alias("rank_ic"), F.when(keyed & (vx > 0), F.col("_sxf") / F.col("n") / F.sqrt(vx)).alias("held"))


def _large(d: DataFrame, by: list[str], sizes: dict, rows: int, fields, where, arrays, sums, settle) -> DataFrame:
    """The sums of the groups in ``sizes``, in two exchanges. Cuts and counts are a few numbers per ``rows`` rows."""
    k = max(2 * -(-max(sizes.values()) // rows), 2)
    share = F.array(*[F.lit(i / k) for i in range(1, k)])
    chosen = d.sparkSession.createDataFrame(list(sizes), T.StructType(fields))
    big = d.join(F.broadcast(chosen), by, "left_semi")
    at = big.groupBy(*by).agg(F.percentile_approx("_x", share).alias("_x"), F.percentile_approx("_y", share).alias("_y")).collect()
    cuts = {tuple(r[:-2]): (np.unique(np.array(r["_x"])), np.unique(np.array(r["_y"]))) for r in at}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kinds = {}, None

        def seen():
            nonlocal kinds
            for b in batches:
                kinds = kinds or [b.schema.field(c) for c in by]
                yield b

        for key, xs, ys in _packed(seen(), by):
            for side, v in enumerate((xs, ys)):
                c = np.bincount(_buckets(v, cuts[key][side]), minlength=2 * len(cuts[key][side]) + 1)
                out[key, side] = out.get((key, side), 0) + c
        if out:
            schema = pa.schema([*kinds, pa.field("_side", pa.int64()), pa.field("_b", pa.int64()), pa.field("_c", pa.int64())])
            yield _table([(*key, side, b, int(c)) for (key, side), cs in out.items() for b, c in enumerate(cs)], schema)

    found = big.mapInArrow(count, T.StructType([*fields, T.StructField("_side", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_c", T.LongType())]))
    counts = {(key, side): np.zeros(2 * len(c[side]) + 1, np.int64) for key, c in cuts.items() for side in (0, 1)}
    for r in found.groupBy(*by, "_side", "_b").agg(F.sum("_c").alias("_c")).collect():
        counts[tuple(r[:-3]), r["_side"]][r["_b"]] = r["_c"]

    def ranks(key: tuple, side: int, b: int, v: np.ndarray) -> np.ndarray:
        c = counts[key, side]
        below = int(c[:b].sum())
        return np.full(len(v), below + (c[b] + 1) / 2) if b % 2 else below + _ranks(v)

    def plan(t: pa.Schema) -> pa.Schema:
        return pa.schema([*[t.field(c) for c in by], pa.field("_b", pa.int64()), pa.field("_s", pa.int64()), pa.field("_x", pa.list_(pa.float64())), pa.field("_y", pa.list_(pa.float64()))])

    def by_x(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def seen():
            nonlocal kinds
            for b in batches:
                kinds = kinds or plan(b.schema)
                yield b

        turn = int(np.random.default_rng().integers(1 << 30))
        for turn, (key, xs, ys) in enumerate(_packed(seen(), by), turn):
            yield _table(list(_pieces(key, xs, ys, _buckets(xs, cuts[key][0]), counts[key, 0], rows, turn)), kinds)

    def by_y(key, t):
        group, b = tuple(v.as_py() for v in key[:-2]), key[-2].as_py()
        xs, ys = _flat(t, "_x"), _flat(t, "_y")
        out = _pieces(group, ranks(group, 0, b, xs), ys, _buckets(ys, cuts[group][1]), counts[group, 1], rows, b + key[-1].as_py())
        return pa.Table.from_batches([_table(list(out), plan(t.schema))])

    def last(key, t):
        group, b = tuple(v.as_py() for v in key[:-2]), key[-2].as_py()
        ys = _flat(t, "_y")
        return settle(key, t, _flat(t, "_x"), ranks(group, 1, b, ys), ys, sizes[group])

    kind = T.StructType([*fields, *where, *arrays])
    first = big.mapInArrow(by_x, kind).groupBy(*by, "_b", "_s").applyInArrow(by_y, kind)
    return first.groupBy(*by, "_b", "_s").applyInArrow(last, T.StructType([*fields, *sums]))
