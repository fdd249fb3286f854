"""Market regimes and funding features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.math import cut, div
from factorspark.operators.windows import Roll

VOL_LABELS = ["low_vol", "medium_vol", "high_vol", "extreme_vol"]


def funding_features(df: DataFrame, step_seconds: int, col: str = "funding_rate", roll: Roll | None = None) -> DataFrame:
    """Averages over 8 and 24 hours, 24-hour change, 30-day z-score, extreme flag and annual rate.

    Window lengths in rows follow from the bar step, which the caller gets from ``bar_frequency``.
    """
    r = roll or Roll()
    rows = lambda hours: max(1, int(hours * 3600 / step_seconds))
    z = r.zscore(col, rows(30 * 24))
    return df.select(
        *r.by, *r.order, r.mean(col, rows(8)).alias("funding_ma_8h"), r.mean(col, rows(24)).alias("funding_ma_24h"),
        r.delta(col, rows(24)).alias("funding_momentum"), z.alias("funding_zscore"),
        F.coalesce(F.abs(z) > 2, F.lit(False)).alias("funding_extreme"), (F.col(col) * 3 * 365).alias("funding_annualized"))


def vol_regime(df: DataFrame, bins: list[float], n: int = 20, ret: str = "ret", roll: Roll | None = None) -> DataFrame:
    """Label by rolling return volatility; missing before the window is full."""
    r = roll or Roll()
    return df.withColumn("vol", r.std(ret, n)).withColumn("vol_regime", cut(F.col("vol"), bins, VOL_LABELS[:len(bins) - 1]))


def trend_regime(df: DataFrame, n: int = 20, threshold: float = 0.1, price: str = "close", roll: Roll | None = None) -> DataFrame:
    r = roll or Roll()
    d = df.withColumn("trend", r.pct_change(price, n))
    t = F.col("trend")
    return d.withColumn("trend_regime", F.when(t > threshold, "bull").when(t < -threshold, "bear").when(t.isNotNull(), "sideways"))


def vol_median_regime(df: DataFrame, n: int = 20, ret: str = "ret", roll: Roll | None = None) -> DataFrame:
    """Rolling volatility against its own median per symbol."""
    from factorspark.operators.cross_section import winsor_bounds
    r = roll or Roll()
    d = df.withColumn("vol", r.std(ret, n))
    med = winsor_bounds(d.select(*r.by, "vol"), r.by, "vol", [0.5]).withColumnRenamed("q0", "_med")
    d = d.join(med, r.by, "left")
    return d.withColumn("regime", F.when(F.col("vol") > F.col("_med"), "high_vol").when(F.col("vol").isNotNull(), "low_vol")).drop("_med")


def funding_regime(col: str = "funding_rate", n: int = 30, z: float = 2.0, roll: Roll | None = None) -> Column:
    r = roll or Roll()
    mean, std = r.mean(col, n, 1), r.std(col, n, 2)
    score = div(F.col(col) - mean, F.when(std != 0, std))
    return F.when(score > z, "extreme_positive").when(score < -z, "extreme_negative").otherwise("normal")


def liq_regime(col: str = "liquidation_total", n: int = 30, q: float = 0.8, roll: Roll | None = None) -> Column:
    r = roll or Roll()
    return F.when(F.col(col) >= r.quantile(col, n, q, 1), "high_liquidation").otherwise("low_liquidation")


def combined_regime(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.coalesce(a, F.lit("none")), b)
