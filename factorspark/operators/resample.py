"""Ticks and fine bars to coarser bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"month", "quarter", "year", "week"}


def bucket(ts: str, freq: str) -> Column:
    """Start of the time bucket: a calendar unit or a fixed span like ``"1 hour"``."""
    if freq in UNITS:
        return F.date_trunc(freq, F.col(ts))
    if freq in ("1 hour", "1 day", "1 minute"):
        return F.date_trunc(freq.split()[1], F.col(ts))
    return F.window(F.col(ts), freq)["start"]


def order_key(ts: str, tie: Column) -> Column:
    """Instant and tie-breaking integer packed into one decimal.

    A struct would say the same, but only fixed-width buffers let ``min_by`` / ``max_by`` run as a hash
    aggregate; with a struct every task would sort all its ticks first.
    """
    return (F.unix_micros(F.col(ts)).cast("decimal(17,0)") * F.lit(10 ** 18).cast("decimal(19,0)")
            + tie.cast("decimal(18,0)")).cast("decimal(37,0)")


def bars_from_ticks(df: DataFrame, freq: str, price: str, size: str, tie: Column, by: str = "symbol") -> DataFrame:
    """Open/high/low/close/volume per symbol and bucket; ``tie`` orders ticks of the same instant.

    Every aggregate combines map-side, so a symbol holding most ticks still sends one partial row per
    task and bucket through the shuffle.
    """
    d = df.withColumn("_at", order_key("ts", tie))
    return (d.groupBy(by, bucket("ts", freq).alias("_b"))
            .agg(F.min_by(price, "_at").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, "_at").alias("close"), F.sum(size).alias("volume"), F.count("*").alias("trades"))
            .withColumnRenamed("_b", "ts")
            .select(by, "ts", "open", "high", "low", "close", "volume", "trades"))


def resample(df: DataFrame, freq: str, by: str = "symbol") -> DataFrame:
    """Coarser bars from finer bars (down only)."""
    return (df.groupBy(by, bucket("ts", freq).alias("_b"))
            .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
            .withColumnRenamed("_b", "ts").select(by, "ts", "open", "high", "low", "close", "volume"))


def liquidation_sums(df: DataFrame, freq: str, by: str = "symbol") -> DataFrame:
    """Sell-side orders close longs, buy-side orders close shorts; sums per bucket, and both."""
    side = F.lower("side")
    return (df.groupBy(by, bucket("ts", freq).alias("_b"))
            .agg(F.sum(F.when(side == "sell", F.col("value_usd")).otherwise(0.0)).alias("liquidation_long"),
                 F.sum(F.when(side == "buy", F.col("value_usd")).otherwise(0.0)).alias("liquidation_short"),
                 F.sum("value_usd").alias("liquidation_total"))
            .withColumnRenamed("_b", "ts"))


def bar_gaps(df: DataFrame, roll) -> DataFrame:
    """Seconds from each bar to the one before it."""
    return df.withColumn("gap", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(roll.all)))


def bar_frequency(df: DataFrame, roll) -> DataFrame:
    """Median gap between bars per symbol. Gaps are few distinct numbers, so the exact percentile stays small."""
    return (bar_gaps(df, roll).filter(F.col("gap").isNotNull()).groupBy(*roll.by)
            .agg(F.percentile("gap", F.lit(0.5)).alias("freq_seconds")))
