"""Ranks, z-scores and head/tail picks across a cross-section.

A cross-section (all symbols of one date, all trials of a ledger) has no size bound, and one date or
one repeated value may hold a large share of all rows, so nothing here windows over it directly.
Ranking is a two-level prefix sum: rows are counted per distinct value (map-side combined, so copies
collapse before the shuffle), counts are summed per value bucket, bucket offsets come from a running
sum over the small bucket table, and each row gets its rank back by an equi join on its value. A value
shared by very many rows is only a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.math import corr

# Buckets per power of two. Values spread over ten octaves give 160,000 buckets: the bucket table of a group
# stays small enough for one running sum, and a group of 10^12 distinct values has a few million per bucket.
RESOLUTION = 16384


def value_bucket(x: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone integer bucket of a number: logarithmic in magnitude, so no data pass is needed. Infinities lie beyond all finite
    numbers, NaN after them, as Spark sorts them."""
    x = x.cast("double")
    finite = F.floor(F.log2(F.abs(x)) * resolution) + F.lit(1100 * resolution)
    mag = F.when(F.isnan(x), F.lit(2300 * resolution)).when(F.abs(x) == float("inf"), F.lit(2200 * resolution)).otherwise(finite)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, mag).otherwise(-mag)


def _tie_bucket(df: DataFrame, tiebreak: str) -> Column:
    """Monotone bucket of the tiebreak: leading characters of a string, value bucket of a number."""
    if dict(df.dtypes)[tiebreak] == "string":
        return F.substring(F.col(tiebreak), 1, 3)
    return value_bucket(F.col(tiebreak))


def _value_table(src: DataFrame, by: list[str], keys: list[str], v: str, prefix: str) -> DataFrame:
    """One row per distinct value (and tie bucket) of a group: rows before it, ties, group size."""
    before, ties, n, b = prefix + "before", prefix + "ties", prefix + "n", prefix + "bucket"
    counts = (src.filter(F.col(v).isNotNull()).groupBy(*by, *keys).agg(F.count("*").alias("_c"))
              .withColumn(b, value_bucket(F.col(v))))
    buckets = counts.groupBy(*by, b).agg(F.sum("_c").alias("_bc"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = whole.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*by, b, F.coalesce(F.sum("_bc").over(upto), F.lit(0)).alias("_off"),
                             F.sum("_bc").over(whole).alias(n))
    inside = Window.partitionBy(*by, b)
    lower = inside.orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*by, b, v)
    counts = counts.join(buckets, [*by, b])
    tied = len(keys) > 1
    counts = counts.withColumn(ties, F.sum("_c").over(same) if tied else F.col("_c"))
    counts = counts.withColumn(before, F.col("_off") + F.sum("_c").over(lower) - F.col(ties))
    if tied:
        earlier = same.orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn(prefix + "tie_off", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        return counts.select(*by, *keys, before, ties, n, prefix + "tie_off")
    return counts.select(*by, *keys, before, ties, n)


def ranked(df: DataFrame, by: list[str], value: str, tiebreak: str | None = None,
           prefix: str = "_") -> DataFrame:
    """Add ``{prefix}before`` (rows with a smaller value), ``{prefix}ties`` (rows with the same value),
    ``{prefix}n`` (rows with a value) per group and, with a unique tiebreak, the 1-based ``{prefix}pos``.

    Rows whose value is NULL keep NULL in all of them.
    """
    v, tb = f"{prefix}v", f"{prefix}tb"
    src = df.withColumn(v, F.col(value).cast("double"))
    keys = [v]
    if tiebreak:
        src = src.withColumn(tb, _tie_bucket(df, tiebreak))
        keys = [v, tb]
    out = src.join(_value_table(src, by, keys, v, prefix), [*by, *keys], "left")
    if tiebreak:
        local = Window.partitionBy(*by, v, tb).orderBy(tiebreak)
        out = out.withColumn(prefix + "pos", F.when(
            F.col(v).isNotNull(), F.col(prefix + "before") + F.col(prefix + "tie_off") + F.row_number().over(local)))
        out = out.drop(prefix + "tie_off", tb)
    return out.drop(v)


def avg_ranks(df: DataFrame, by: list[str], outs: dict[str, str], count_out: str | None = None) -> DataFrame:
    """Average ranks (ties share their mean) of several columns: ``{out: value}``.

    Every value table is counted from the same input, so its plan is evaluated once per column plus
    once for the rows, and identical exchanges below are reused.
    """
    src = df.withColumns({f"_v_{o}": F.col(v).cast("double") for o, v in outs.items()})
    res = src
    for i, o in enumerate(outs):
        p = f"_{o}_"
        res = res.join(_value_table(src, by, [f"_v_{o}"], f"_v_{o}", p), [*by, f"_v_{o}"], "left")
        res = res.withColumn(o, F.col(p + "before") + (F.col(p + "ties") + 1) / 2.0)
        if i == 0 and count_out:
            res = res.withColumn(count_out, F.col(p + "n"))
        res = res.drop(p + "before", p + "ties", p + "n")
    return res.drop(*[f"_v_{o}" for o in outs])


def avg_rank(df: DataFrame, by: list[str], value: str, out: str, count_out: str | None = None) -> DataFrame:
    """Average rank of one column inside each group."""
    return avg_ranks(df, by, {out: value}, count_out)


def cs_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Percentile rank: average rank over the count of present values."""
    return (avg_rank(df, by, value, out, "_cs_n")
            .withColumn(out, F.col(out) / F.col("_cs_n")).drop("_cs_n"))


def cs_rank_many(df: DataFrame, by: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Percentile ranks of several columns in one ranking job: ``r_<column>`` per (by, keys).

    The columns go to long form, are ranked inside (by, column), and come back by a group-by.
    """
    long = df.unpivot([*by, *keys], values, "_name", "_value").filter(F.col("_value").isNotNull())
    long = cs_rank(long, [*by, "_name"], "_value", "_pct")
    aggs = [F.max(F.when(F.col("_name") == v, F.col("_pct"))).alias(f"r_{v}") for v in values]
    return long.groupBy(*by, *keys).agg(*aggs)


def group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates by aggregate-then-join; the aggregate combines map-side.

    Both sides meet on the packed key. The aggregate is spread by the single columns, so it gets an exchange of its own before the
    join, one row per group; adaptive execution splits a hot group only where exchanges feed both sides directly. Rows with a NULL
    key get NULL.
    """
    key = next(k for k in ("_gk" + "_" * i for i in range(len(df.columns) + 1)) if k not in df.columns)
    whole = [F.col(c).isNotNull() for c in by]
    packed = F.when(reduce(and_, whole), F.struct(*by))
    stats = df.groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()])
    stats = stats.filter(reduce(and_, whole)).select(packed.alias(key), *aggs)
    return df.withColumn(key, packed).join(stats, key, "left").drop(key)


def cs_zscore(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    d = group_stats(df, by, _m=F.avg(value), _s=F.stddev_samp(value))
    return d.withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def cs_scale(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Scale to unit gross exposure per group."""
    d = group_stats(df, by, _g=F.sum(F.abs(F.col(value))))
    return d.withColumn(out, F.when(F.col("_g") > 0, F.col(value) / F.col("_g"))).drop("_g")


def head_tail(df: DataFrame, by: list[str], order: str, frac: float, tiebreak: str) -> DataFrame:
    """Rows in the lowest or highest ``ceil(frac * n)`` positions, labelled ``bottom`` / ``top``.

    A group too small for both ends keeps a row in the top end only.
    """
    r = ranked(df, by, order, tiebreak, prefix="_h_")
    k = F.ceil(F.col("_h_n") * F.lit(frac))
    side = (F.when(F.col("_h_pos") > F.col("_h_n") - k, "top").when(F.col("_h_pos") <= k, "bottom"))
    return (r.withColumn("side", side).filter(F.col("side").isNotNull())
            .drop("_h_before", "_h_ties", "_h_n", "_h_pos"))


def top_n(df: DataFrame, by: list[str], order: str, n: int, tiebreak: str, desc: bool = True) -> DataFrame:
    """Best ``n`` rows per group. Spark limits each task to n rows per group before the shuffle
    (window group limit), so a hot group sends n rows per task, not all of them."""
    key = F.col(order).desc_nulls_last() if desc else F.col(order).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(key, F.col(tiebreak))
    return (df.filter(F.col(order).isNotNull()).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


def winsor_bounds(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, from ranks instead of a whole group in one buffer."""
    r = ranked(df, by, value, prefix="_q_").filter(F.col(value).isNotNull())
    aggs = []
    for i, q in enumerate(qs):
        at = (F.col("_q_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("_q_before") <= k) & (k < F.col("_q_before") + F.col("_q_ties"))
        a = F.max(F.when(holds(lo), F.col(value)))
        b = F.max(F.when(holds(hi), F.col(value)))
        frac = F.max(at - lo)
        aggs.append((a + (b - a) * frac).alias(f"q{i}"))
    return r.groupBy(*by).agg(*aggs) if by else r.agg(*aggs)


def rank_corr(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Spearman correlation per group on average ranks of complete pairs; ``n`` pairs."""
    d = df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = avg_ranks(d, by, {"_rx": x, "_ry": y})
    agg = [F.count("*").alias("n"), corr("_rx", "_ry").alias("rank_ic")]
    g = d.groupBy(*by).agg(*agg) if by else d.agg(*agg)
    return g.filter(F.col("n") >= min_n)


def pearson(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Pearson correlation per group of complete pairs."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    agg = [F.count("*").alias("n"), corr(x, y).alias("ic")]
    g = d.groupBy(*by).agg(*agg) if by else d.agg(*agg)
    return g.filter(F.col("n") >= min_n)


def rank_in(by, x) -> Column:
    """Average rank as a window Column, for groups with a proven small size (factor lists, periods)."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(x)
    same = Window.partitionBy(*by, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0)
