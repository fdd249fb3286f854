"""As-of joins and series alignment.

Rows of both sides are unioned and the latest right row is carried forward by a window: one shuffle,
no inequality join. The window partition is (key, time chunk), not the key alone, so a key holding
most of the rows is spread over as many tasks as it has chunks; the last right row before each chunk
comes from a small per-chunk table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.math import div


def asof_join(left: DataFrame, right: DataFrame, by: str = "symbol", on: str = "ts", direction: str = "backward",
              values: list[str] | None = None, right_ts: str | None = None, chunk: str = "day") -> DataFrame:
    """Each left row with the latest right row at or before it (or first at or after it).

    ``right_ts`` names an output column for the matched right time. Right times are unique per key.
    ``chunk`` is a ``date_trunc`` unit: days suit bars, minutes suit raw ticks of busy keys.
    """
    values = values or [c for c in right.columns if c not in (by, on)]
    return asof_join_many(left, [(right, values, right_ts)], by, on, direction, chunk)


def asof_join_many(left: DataFrame, rights: list[tuple[DataFrame, list[str], str | None]], by: str = "symbol", on: str = "ts",
                   direction: str = "backward", chunk: str = "day") -> DataFrame:
    """As-of join with several right sides in one union and one window: the left side is shuffled once.

    ``rights`` holds (frame, value columns, name for the matched time or None).
    """
    back = direction == "backward"
    lcols = [c for c in left.columns if c not in (by, on)]
    lf = left.select(F.col(by), F.col(on), F.date_trunc(chunk, F.col(on)).alias("_k"),
                     (F.struct(*lcols) if lcols else F.struct(F.lit(1).alias("_x"))).alias("_l"))
    wanted = lf.select(by, "_k").distinct().withColumn("_want", F.lit(True))
    order = F.col("_k").asc() if back else F.col("_k").desc()
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    parts = []
    for i, (right, values, _) in enumerate(rights):
        r = right.select(F.col(by), F.col(on), F.date_trunc(chunk, F.col(on)).alias("_k"), F.struct(F.col(on).alias("_rt"), *values).alias(f"_r{i}"))
        # last (or first) right row per chunk, then carried over the chunks: one row per key and chunk
        pick = F.max_by(f"_r{i}", on) if back else F.min_by(f"_r{i}", on)
        chunks = r.groupBy(by, "_k").agg(pick.alias("_last")).join(wanted, [by, "_k"], "full")
        carry = (chunks.withColumn("_c", F.last("_last", ignorenulls=True).over(before))
                 .filter(F.col("_want") & F.col("_c").isNotNull())
                 .select(by, F.col("_c._rt").alias(on), "_k", F.col("_c").alias(f"_r{i}")))
        parts += [r.withColumn("_side", F.lit(0)), carry.withColumn("_side", F.lit(0))]
    both = union_all(lf.withColumn("_side", F.lit(1)), *parts)

    t = F.col(on).asc() if back else F.col(on).desc()
    w = Window.partitionBy(by, "_k").orderBy(t, F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"_m{i}": F.last(f"_r{i}", ignorenulls=True).over(w) for i in range(len(rights))}).filter(F.col("_side") == 1)
    cols = [F.col(f"_l.{c}").alias(c) for c in lcols]
    for i, (_, values, right_ts) in enumerate(rights):
        cols += [F.col(f"_m{i}.{v}").alias(v) for v in values]
        if right_ts:
            cols.append(F.col(f"_m{i}._rt").alias(right_ts))
    return out.select(by, on, *cols)


def align_ffill(bars: DataFrame, series: DataFrame, value: str, by="symbol", on="ts", fill=0.0) -> DataFrame:
    """Forward fill of a series onto bar times; bars before the first value get ``fill``."""
    d = asof_join(bars, series, by, on, values=[value])
    return d.withColumn(value, F.coalesce(value, F.lit(fill)))


def align_interpolate(bars: DataFrame, series: DataFrame, value: str, by="symbol", on="ts") -> DataFrame:
    """Linear interpolation between the values around each bar; flat beyond the last value."""
    d = asof_join(bars, series.select(by, on, F.col(value).alias("_v0")), by, on, "backward", right_ts="_t0")
    d = asof_join(d, series.select(by, on, F.col(value).alias("_v1")), by, on, "forward", right_ts="_t1")
    t, t0, t1 = (F.unix_timestamp(c) for c in (on, "_t0", "_t1"))
    share = F.coalesce(div(t - t0, t1 - t0), F.lit(0.0))
    v = F.when(F.col("_v0").isNull(), None).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    return d.withColumn(value, v).drop("_v0", "_v1", "_t0", "_t1")


def align_distribute(bars: DataFrame, series: DataFrame, value: str, hours: int = 8, by="symbol", on="ts") -> DataFrame:
    """A rate per settlement period spread evenly over its hours."""
    d = asof_join(bars, series, by, on, values=[value])
    return d.withColumn(value, F.coalesce(F.col(value) / hours, F.lit(0.0)))


def merge_market(bars: DataFrame, funding=None, oi=None, ls=None, liq=None, by="symbol", on="ts") -> DataFrame:
    """Bars with funding, open interest and long/short ratio as of each bar, and liquidation sums of the bar's bucket.

    Missing numbers become 0.
    """
    sides = [(side, col) for side, col in ((funding, "funding_rate"), (oi, "open_interest"), (ls, "long_short_ratio")) if side is not None]
    out = asof_join_many(bars, [(side, [col], None) for side, col in sides], by, on) if sides else bars
    added = [col for _, col in sides]
    if liq is not None:
        out = out.join(liq, [by, on], "left")
        added += [c for c in liq.columns if c not in (by, on)]
    return out.fillna(0.0, subset=added)


def range_join(intervals: DataFrame, points: DataFrame, by: str, start: str, end: str, on: str, unit_seconds: int = 86400,
               include_start: bool = False) -> DataFrame:
    """Points inside (start, end] of each interval of the same key.

    Both sides get a time bucket; an interval is repeated once per bucket it touches, so the join is an
    equi join on (key, bucket) followed by the exact range filter.
    """
    b = lambda c: F.floor(F.unix_timestamp(c) / unit_seconds)
    iv = intervals.withColumn("_bk", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    pt = points.withColumn("_bk", b(F.col(on)))
    lower = F.col(on) >= F.col(start) if include_start else F.col(on) > F.col(start)
    return iv.join(pt, [by, "_bk"]).filter(lower & (F.col(on) <= F.col(end))).drop("_bk")


def outer_align(a: DataFrame, b: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Full outer join on the keys with missing numbers filled."""
    vals = [c for d in (a, b) for c in d.columns if c not in keys]
    return a.join(b, keys, "full").fillna(fill, subset=vals)


def restrict(df: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in the universe."""
    return df.join(universe, keys, "left_semi")


def missing_rows(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_anti")


def calendar(df: DataFrame, step_seconds: int, by: str = "symbol", on: str = "ts") -> DataFrame:
    """Every expected bar time per key between its first and last bar."""
    ends = df.groupBy(by).agg(F.unix_timestamp(F.min(on)).alias("_a"), F.unix_timestamp(F.max(on)).alias("_z"))
    return (ends.select(by, F.explode(F.sequence("_a", "_z", F.lit(step_seconds).cast("bigint"))).alias("_s"))
            .select(by, F.timestamp_seconds("_s").alias(on)))


def alignment_report(df: DataFrame, step_seconds: int, by: str = "symbol", on: str = "ts") -> DataFrame:
    """Rows, distinct times, duplicates, expected rows and gap ratio per key."""
    d = df.groupBy(by, on).agg(F.count("*").alias("_c"))
    g = d.groupBy(by).agg(F.sum("_c").alias("n_rows"), F.count("*").alias("n_times"), F.min(on).alias("first_ts"), F.max(on).alias("last_ts"))
    expected = F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / step_seconds) + 1
    g = g.withColumns({"duplicates": F.col("n_rows") - F.col("n_times"), "expected": expected})
    return g.withColumn("gap_ratio", 1 - div(F.col("n_times"), F.col("expected")))


def overlap_report(f: DataFrame, t: DataFrame, by: str = "symbol", on: str = "ts") -> DataFrame:
    """Time ranges of factor and target per key, and how many times they share.

    Identical time sets are reported as a column, not as bias.
    """
    a = f.select(by, on).distinct().withColumn("_f", F.lit(1))
    b = t.select(by, on).distinct().withColumn("_t", F.lit(1))
    j = a.join(b, [by, on], "full")
    hit = lambda c: F.when(F.col(c) == 1, F.col(on))
    g = j.groupBy(by).agg(
        F.min(hit("_f")).alias("factor_start"), F.max(hit("_f")).alias("factor_end"), F.min(hit("_t")).alias("target_start"),
        F.max(hit("_t")).alias("target_end"), F.count("_f").alias("factor_times"), F.count("_t").alias("target_times"),
        F.count_if((F.col("_f") == 1) & (F.col("_t") == 1)).alias("shared"))
    return g.withColumn("identical", (F.col("shared") == F.col("factor_times")) & (F.col("shared") == F.col("target_times")))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
