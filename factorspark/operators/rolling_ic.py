"""Rank correlation inside a rolling window of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators.windows import Roll

STRETCH = 4096  # rows of a series that one call ranks, or eight windows if those are more


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a value adds to the rank of another: one below it, a half beside it."""
    return (a < b) + (a == b) * 0.5


def _first_ranks(w: np.ndarray) -> np.ndarray:
    """Average ranks inside each row."""
    return 0.5 + np.stack([_below(w, w[:, s:s + 1]).sum(1) for s in range(w.shape[1])], 1)


def window_rank_corr(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Spearman correlation of each ``n`` neighbours, one for every full window; NaN where a value is missing or a side is constant.

    The series is cut into blocks of n windows. Each block ranks its first window, then all blocks move on together by one place: the
    value that leaves and the one that enters change every rank by a half or one. A row costs a multiple of n, ranks are exact.
    """
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0)
    blocks = -(-m // n)
    width = 2 * n - 1
    cut = lambda v: np.lib.stride_tricks.sliding_window_view(np.concatenate([v, np.full(blocks * n + n - 1 - len(v), np.nan)]), width)[::n]
    sides = [cut(np.asarray(v, np.float64)) for v in (x, y)]
    lacking = np.isnan(sides[0]) | np.isnan(sides[1])
    ranks = [np.zeros(v.shape) for v in sides]
    out = np.full((blocks, n), np.nan)
    mid = (n + 1) / 2.0
    for p in range(n):
        for v, r in zip(sides, ranks, strict=True):
            if p == 0:
                r[:, :n] = _first_ranks(v[:, :n])
                continue
            old, new, kept = v[:, p - 1:p], v[:, p + n - 1:p + n], slice(p, p + n - 1)
            r[:, kept] += _below(new, v[:, kept]) - _below(old, v[:, kept])
            r[:, p + n - 1] = 0.5 + _below(v[:, p:p + n], new).sum(1)
        a, b = (r[:, p:p + n] - mid for r in ranks)
        sxy, sxx, syy = (a * b).sum(1), (a * a).sum(1), (b * b).sum(1)
        ok = (sxx > 0) & (syy > 0) & ~lacking[:, p:p + n].any(1)
        out[ok, p] = sxy[ok] / np.sqrt(sxx[ok] * syy[ok])
    return out.reshape(-1)[:m]


def rolling_rank_ic(df: DataFrame, n: int = 20, x: str = "factor", y: str = "fwd", roll: Roll | None = None) -> DataFrame:
    """``rank_ic``: Spearman correlation of the last ``n`` rows per series, for every row that has n - 1 rows before it; NULL where one of
    them lacks a value or a side is constant.

    A series is cut into stretches, each with the n - 1 rows before it, so a task holds one stretch at a time however long the series is.
    """
    if n < 2:
        raise ValueError("a correlation needs a window of two rows or more")
    roll = roll or Roll()
    size = max(STRETCH, 8 * n)
    number = F.row_number().over(Window.partitionBy(*roll.by).orderBy(*roll.order)) - 1
    own, ahead = F.floor(F.col("_rn") / size), F.floor((F.col("_rn") + n - 1) / size)
    d = df.withColumn("_rn", number).withColumn("_stretch", F.explode(F.sequence(own, ahead)))

    def rank(f: pa.Table) -> pa.Table:
        f = f.sort_by("_rn")
        got = window_rank_corr(*(f[c].to_numpy().astype(np.float64) for c in (x, y)), n)
        return f.slice(n - 1).drop_columns(["_rn", "_stretch"]).append_column("rank_ic", pa.array(got, pa.float64(), from_pandas=True))

    d = d.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")})
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name not in ("_rn", "_stretch"))
    return d.groupBy(*roll.by, "_stretch").applyInArrow(rank, kept + ", rank_ic double")
