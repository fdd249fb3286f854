"""Normalisers, weights, positions and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs


def normalize(df: DataFrame, by: list[str], value: str, clip: float = 3.0, tails=(0.01, 0.99)) -> DataFrame:
    """Full-sample normalisers per group: clipped z-score, min-max, average rank, percentile, winsorised value.

    Statistics are aggregated map-side and joined back; quantiles come from ranks, not from one buffer.
    """
    v = F.col(value)
    stats = df.groupBy(*by).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    stats = stats.join(cs.winsor_bounds(df, by, value, list(tails)), by, "left")
    d = cs.avg_rank(df, by, value, "rank", "_n").join(stats, by, "left")
    z = F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s"))
    d = d.withColumns({
        "z": F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z))),
        "minmax": F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))),
        "pct": F.col("rank") / F.col("_n"),
        "winsor": F.when(v.isNotNull(), F.greatest(F.col("q0"), F.least(F.col("q1"), v))),
    })
    return d.drop("_m", "_s", "_lo", "_hi", "_n", "q0", "q1")


def factor_weights(metrics: DataFrame, method: str = "ic", lo: float = 0.0, hi: float = 1.0, name="name") -> DataFrame:
    """Weights over a factor list (registry-sized): equal, |IC|, |rank IC|, positive IR or rank of |IC|; clamped, renormalised."""
    whole = Window.partitionBy(F.lit(0))
    raw = {
        "equal": F.lit(1.0), "ic": F.abs("ic"), "rank_ic": F.abs(F.col("rank_ic") if "rank_ic" in metrics.columns else F.col("ic")),
        "ir": F.greatest(F.lit(0.0), F.col("ir")),
        "rank": F.row_number().over(whole.orderBy(F.abs("ic"), F.col(name).desc())).cast("double"),
    }[method]
    d = metrics.withColumn("_w", raw)
    total = F.sum("_w").over(whole)
    d = d.withColumn("_w", F.when(total > 0, F.col("_w") / total).otherwise(0.0))
    d = d.withColumn("_w", F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("_w"))))
    total = F.sum("_w").over(whole)
    return d.withColumn("weight", F.when(total > 0, F.col("_w") / total).otherwise(F.col("_w"))).drop("_w")


def composite(long_df: DataFrame, weights: DataFrame, keys=("symbol", "ts"), name="name", value="value", z_by=("ts",)) -> DataFrame:
    """Weighted sum of per-date z-scores of several factors. ``weights`` has one row per factor name."""
    z = cs.cs_zscore(long_df.filter(F.col(value).isNotNull()), [*z_by, name], value, "_z")
    d = z.join(F.broadcast(weights.select(name, "weight")), name)
    return d.groupBy(*keys).agg(F.sum(F.col("_z") * F.col("weight")).alias("signal"))


def positions(df: DataFrame, method: str, by: list[str], signal: str = "signal", tiebreak: str = "symbol", n: int = 10, threshold: float = 0.5) -> DataFrame:
    """Positions from a signal per cross-section: scaled long-short, long-only, equal top-n, or threshold."""
    s = F.col(signal)
    if method == "long_short":
        d = cs.group_stats(df, by, _g=F.max(F.abs(s)))
        return d.withColumn("position", F.when(F.col("_g") > 0, s / F.col("_g")).otherwise(0.0)).drop("_g")
    if method == "long_only":
        d = cs.group_stats(df, by, _g=F.sum(F.greatest(s, F.lit(0.0))))
        return d.withColumn("position", F.when(F.col("_g") > 0, F.greatest(s, F.lit(0.0)) / F.col("_g")).otherwise(0.0)).drop("_g")
    if method == "top_n":
        r = cs.ranked(df, by, signal, tiebreak, prefix="_p_")
        k = F.least(F.col("_p_n"), F.lit(n))
        out = r.withColumn("position", F.when(F.col("_p_pos") > F.col("_p_n") - k, F.lit(1.0) / k).otherwise(0.0))
        return out.drop("_p_pos", "_p_n", "_p_before", "_p_ties")
    if method == "threshold":
        side = F.when(s > threshold, 1.0).when(s < -threshold, -1.0).otherwise(0.0)
        d = cs.group_stats(df.withColumn("_s", side), by, _g=F.count_if(F.col("_s") != 0))
        return d.withColumn("position", F.when(F.col("_g") > 0, F.col("_s") / F.col("_g")).otherwise(0.0)).drop("_g", "_s")
    raise ValueError(method)


def topk_signal(df: DataFrame, by: list[str], k: int, value: str = "factor", tiebreak: str = "symbol") -> DataFrame:
    """+1 for the k largest, -1 for the k smallest of each cross-section, at most half of it on each side."""
    r = cs.ranked(df.filter(F.col(value).isNotNull()), by, value, tiebreak, prefix="_k_")
    kk = F.least(F.lit(k), F.floor(F.col("_k_n") / 2))
    s = F.when(F.col("_k_pos") > F.col("_k_n") - kk, 1.0).when(F.col("_k_pos") <= kk, -1.0).otherwise(0.0)
    return r.withColumn("signal", s).drop("_k_pos", "_k_n", "_k_before", "_k_ties")


def portfolio_weights(df: DataFrame, by: list[str], method: str = "rank", value: str = "factor", long_short: bool = True, leverage: float = 1.0) -> DataFrame:
    """Rank, z-score or raw weights per cross-section, unit gross times leverage (or long side only)."""
    d = df.filter(F.col(value).isNotNull())
    if method == "rank":
        d = cs.cs_rank(d, by, value, "_w").withColumn("_w", F.col("_w") - 0.5)
    elif method == "zscore":
        d = cs.cs_zscore(d, by, value, "_w")
    else:
        d = d.withColumn("_w", F.col(value))
    if not long_short:
        d = d.withColumn("_w", F.greatest(F.col("_w"), F.lit(0.0)))
    d = cs.cs_scale(d, by, "_w", "weight")
    return d.withColumn("weight", F.col("weight") * leverage).drop("_w")


def ml_signal(df: DataFrame, by: list[str], pred: str = "prediction", clip: float = 3.0) -> DataFrame:
    """Standardised prediction, clipped and scaled to [-1, 1]."""
    d = cs.cs_zscore(df, by, pred, "_z")
    return d.withColumn("signal", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce("_z", F.lit(0.0)))) / clip).drop("_z")


def position_sizes(stats: DataFrame, capital: float, kelly_fraction: float = 0.5, max_pct: float = 0.25, fixed_pct: float = 0.1,
                   target_risk: float = 0.02) -> DataFrame:
    """Kelly, fixed and risk-parity sizes from trade statistics per key."""
    from factorspark.functions.math import clip as math_clip, div
    b = div(F.col("mean_win"), F.col("mean_loss"))
    f = div(F.col("win_rate") * b - (1 - F.col("win_rate")), b) * kelly_fraction
    return stats.select(
        "symbol", (F.coalesce(math_clip(f, 0.0, max_pct), F.lit(0.0)) * capital).alias("kelly"), F.lit(capital * fixed_pct).alias("fixed"),
        (div(F.lit(target_risk), F.col("mean_loss")) * capital).alias("risk_parity"))


def concentration(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Herfindahl index of normalised absolute weights, largest and mean absolute position."""
    d = cs.group_stats(df, by, _g=F.sum(F.abs(F.col(weight))))
    s = F.when(F.col("_g") > 0, F.abs(F.col(weight)) / F.col("_g"))
    return d.groupBy(*by).agg(F.sum(s * s).alias("herfindahl"), F.max(F.abs(F.col(weight))).alias("max_position"), F.avg(F.abs(F.col(weight))).alias("mean_position"))


def lagged(df: DataFrame, cols: list[str], lags=(1, 5, 20), roll=None) -> DataFrame:
    """Lagged copies of columns, ``name_lag_k``."""
    from factorspark.operators.windows import Roll
    r = roll or Roll()
    return df.withColumns({f"{c}_lag_{k}": r.ref(c, k) for c in cols for k in lags})


def ml_features(df: DataFrame, factor: str = "factor", window: int = 60, roll=None) -> DataFrame:
    """Feature block of one factor next to its bars (close, volume); every value needs its full window."""
    from factorspark.functions.math import div
    from factorspark.operators.windows import Roll
    r = roll or Roll()
    ratio = lambda x, n: div(F.col(x), r.mean(x, n))
    df = df.withColumn("return_1d", r.pct_change("close"))
    return df.withColumns({
        "factor_raw": F.col(factor), "factor_zscore": div(F.col(factor) - r.mean(factor, window), r.std(factor, window)),
        "factor_rank": r.rank_percentile(factor, window) / 100 + 0.5 / window, "factor_ma_ratio": ratio(factor, window),
        "factor_momentum": r.delta(factor, 5), "factor_momentum_10": r.delta(factor, 10),
        "return_5d": r.pct_change("close", 5), "return_10d": r.pct_change("close", 10), "volatility_20d": r.std("return_1d", 20),
        "ma_ratio_20": ratio("close", 20), "ma_ratio_60": ratio("close", 60), "volume_ma_ratio": ratio("volume", 20)})
