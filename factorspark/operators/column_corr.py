"""Correlation of all column pairs from cross-product matrices.

A task adds up k x k matrices over its rows and hands on one row per pair, so what is shuffled grows with tasks times pairs, never with
rows times pairs. Missing are NULL, NaN and infinities; each pair uses the rows that have both. The k x k counts are the only data that
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs
from factorspark.session import scratch_path

CELLS = 4_000_000  # of one dense block of rows and columns
NOISE = 1e-13  # a variance below this share of the squares it is the difference of is rounding


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as ``c0 .. ck``, what is not finite as NULL."""
    value = lambda c: F.col(c).cast("double")
    return df.select(*[F.when(~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")), value(c)).alias(f"c{i}") for i, c in enumerate(cols)])


def _summed(df: DataFrame, k: int, dense: Callable[[pa.RecordBatch], np.ndarray], products: Callable[[np.ndarray], list[np.ndarray]],
            keep: tuple[np.ndarray, np.ndarray], names: list[str]) -> DataFrame:
    """(_i, _j, names...): sums over all rows of the k x k ``products`` of dense blocks, for the kept pairs."""
    schema = ", ".join(["_i INT", "_j INT", *[f"{n} DOUBLE" for n in names]])
    step = max(1, CELLS // max(k, 1))
    i, j = (np.asarray(x, np.int32) for x in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = products(dense(b.slice(at, step)))
                total = part if total is None else [t + p for t, p in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t[i, j]) for t in total]], names=["_i", "_j", *names])

    return df.mapInArrow(run, schema).groupBy("_i", "_j").agg(*[F.sum(n).alias(n) for n in names])


def _columns(b: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, NaN where missing."""
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(b.num_columns)])


def _pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def named_pairs(df: DataFrame, cols: list[str], found: DataFrame) -> DataFrame:
    """Every pair of the column list with its correlation, NULL where it has none."""
    pairs = df.sparkSession.createDataFrame([(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j],
                                            "_i INT, _j INT, factor_a STRING, factor_b STRING")
    return pairs.join(found, ["_i", "_j"], "left").select("factor_a", "factor_b", "corr")


def pearson_pairs(df: DataFrame, cols: list[str], min_n: int = 2) -> DataFrame:
    """(factor_a, factor_b, corr) of every column pair; NULL under ``min_n`` common rows or where a side is constant on them.

    Values are taken relative to the column means, so that large levels cost no digits.
    """
    d, k = _numbers(df, cols), len(cols)
    means = d.agg(*[F.avg(f"c{i}") for i in range(k)]).first()
    shift = np.array([m or 0.0 for m in means])

    def products(v: np.ndarray) -> list[np.ndarray]:
        has = (~np.isnan(v)).astype(np.float64)
        x = np.where(has > 0, v - shift, 0.0)
        sx, sxx = x.T @ has, (x * x).T @ has
        return [has.T @ has, sx, sx.T, sxx, sxx.T, x.T @ x]

    s = _summed(d, k, _columns, products, _pairs(k), ["_n", "_x", "_y", "_xx", "_yy", "_xy"])
    c = F.col
    s = s.filter(c("_n") >= max(min_n, 2))
    s = s.withColumns({"_vx": c("_xx") - c("_x") * c("_x") / c("_n"), "_vy": c("_yy") - c("_y") * c("_y") / c("_n")})
    varied = (c("_vx") > NOISE * c("_xx")) & (c("_vy") > NOISE * c("_yy"))
    s = s.select("_i", "_j", F.when(varied, (c("_xy") - c("_x") * c("_y") / c("_n")) / F.sqrt(c("_vx")) / F.sqrt(c("_vy"))).alias("corr"))
    return named_pairs(df, cols, s)


def _presence(d: DataFrame, k: int) -> np.ndarray:
    """Rows that have both columns, for all pairs and the columns themselves."""
    def products(v: np.ndarray) -> list[np.ndarray]:
        has = (~np.isnan(v)).astype(np.float64)
        return [has.T @ has]

    n = np.zeros((k, k), np.int64)
    for r in _summed(d, k, _columns, products, np.triu_indices(k), ["_n"]).collect():
        n[r["_i"], r["_j"]] = n[r["_j"], r["_i"]] = round(r["_n"])
    return n


def _rankings(n: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(rankings needed, number of the ranking that column i takes in its pair with j).

    A ranking (i, j) orders column i over the rows that also have column j. Where j lacks none of i's rows that is the column's own
    ranking (i, i), and columns that lack the same rows share theirs: equal counts say so.
    """
    k = len(n)
    own = np.diag(n)
    same = (n == own[:, None]) & (n == own[None, :])
    alike = same.argmax(1)  # the first column with the same rows; the column itself at the latest
    wanted = [(i, i) for i in range(k)]
    number = {p: m for m, p in enumerate(wanted)}
    use = np.zeros((k, k), np.int64)
    for i in range(k):
        for j in range(k):
            p = (i, i) if n[i, j] == own[i] else (i, int(alike[j]))
            if p not in number:
                number[p] = len(wanted)
                wanted.append(p)
            use[i, j] = number[p]
    return wanted, use


def spearman_pairs(df: DataFrame, cols: list[str], min_n: int = 2) -> DataFrame:
    """(factor_a, factor_b, corr) of every column pair, each ranked over the rows that have both; NULL as in ``pearson_pairs``.

    Each column is ranked once over its own rows, and once more for each different set of rows that other columns lack, in one job for
    all of them; ranks meet again by row number, fixed by writing the columns to the shared folder first.
    """
    spark, k = df.sparkSession, len(cols)
    path = scratch_path(spark, "columns")
    _numbers(df, cols).select(F.monotonically_increasing_id().alias("_row"), "*").write.parquet(path)
    d = spark.read.parquet(path)
    n = _presence(d.drop("_row"), k)
    wanted, use = _rankings(n)
    size = len(wanted)
    mean = np.array([(n[p] + 1) / 2.0 for p in wanted])

    value = lambda p: F.col(f"c{p[0]}") if p[0] == p[1] else F.when(F.col(f"c{p[1]}").isNotNull(), F.col(f"c{p[0]}"))
    cells = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), value(p).alias("v")) for m, p in enumerate(wanted)]), lambda e: e["v"].isNotNull())
    long = d.select("_row", F.explode(cells).alias("_e")).select("_row", F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v"))
    ranks = cs.avg_rank(long, ["_m"], "_v", "_r").groupBy("_row").agg(F.collect_list("_m").alias("_m"), F.collect_list("_r").alias("_r"))

    def dense(b: pa.RecordBatch) -> np.ndarray:
        ms, rs = b.column(0), b.column(1)
        m = ms.flatten().to_numpy(zero_copy_only=False)
        r = rs.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((b.num_rows, size))
        out[np.repeat(np.arange(b.num_rows), ms.value_lengths().to_numpy(zero_copy_only=False)), m] = r - mean[m]
        return out

    i, j = _pairs(k)
    a, b = use[i, j], use[j, i]
    both = sorted({(int(x), int(y)) for x, y in zip(a, b, strict=True)} | {(m, m) for m in range(size)})
    s = _summed(ranks.select("_m", "_r"), size, dense, lambda x: [x.T @ x], tuple(np.array(both).T), ["_s"])
    # one row per column pair
    pairs = spark.createDataFrame([(int(x), int(y), int(p), int(q)) for x, y, p, q in zip(i, j, a, b, strict=True) if n[x, y] >= max(min_n, 2)],
                                  "_i INT, _j INT, _a INT, _b INT")
    side = lambda x, y, out: s.select(F.col("_i").alias(x), F.col("_j").alias(y), F.col("_s").alias(out))
    found = pairs.join(side("_a", "_b", "_xy"), ["_a", "_b"])
    found = found.join(side("_a", "_2", "_xx").filter("_a = _2").drop("_2"), "_a").join(side("_b", "_2", "_yy").filter("_b = _2").drop("_2"), "_b")
    corr = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt("_xx") / F.sqrt("_yy"))
    return named_pairs(df, cols, found.select("_i", "_j", corr.alias("corr")))
