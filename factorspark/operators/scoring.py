"""Factor scores against forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.math import corr, div, norm_cdf
from factorspark.operators import column_corr
from factorspark.operators import cross_section as cs
from factorspark.operators.performance import sharpe
from factorspark.operators.rank_moments import rank_moments
from factorspark.operators.windows import Roll


def ic_by_date(df, by=("ts",), x="factor", y="fwd", min_n=3) -> DataFrame:
    """Pearson IC per cross-section."""
    return cs.pearson(df, list(by), x, y, min_n)


def rank_ic_by_date(df, by=("ts",), x="factor", y="fwd", min_n=3) -> DataFrame:
    """Spearman IC per cross-section."""
    return cs.rank_corr(df, list(by), x, y, min_n)


def ic_by_period(df, unit: str, x="factor", y="fwd", min_n=10) -> DataFrame:
    d = df.withColumn("period", F.date_trunc(unit, "ts"))
    return cs.rank_corr(d, ["period"], x, y, min_n)


def ic_summary(ics: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, spread, bias-corrected skew, information ratio, hit rate and count of an IC series."""
    v, n = F.col(value), F.count(value)
    mean, std = F.avg(v), F.stddev_samp(v)
    skew = F.when(n >= 3, F.skewness(v) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
    aggs = [mean.alias("ic_mean"), std.alias("ic_std"), skew.alias("ic_skew"), F.when(std > 0, mean / std).alias("ir"),
            F.avg((v > 0).cast("double")).alias("hit_rate"), n.alias("n")]
    return ics.groupBy(*by).agg(*aggs) if by else ics.agg(*aggs)


def ic_rollup(df, x="factor", y="fwd", min_n=10) -> DataFrame:
    """Rank IC by month, quarter, year and over all dates in one job.

    Ranks differ per level, so each row is repeated once per level (four times) and ranked inside it.
    """
    levels = [F.struct(F.lit(u).alias("level"), F.date_trunc(u, "ts").alias("period")) for u in ("month", "quarter", "year")]
    levels.append(F.struct(F.lit("all").alias("level"), F.lit(None).cast("timestamp").alias("period")))
    d = df.select(x, y, F.explode(F.array(*levels)).alias("l")).select(x, y, "l.level", F.coalesce("l.period", F.timestamp_seconds(F.lit(0))).alias("period"))
    return cs.rank_corr(d, ["level", "period"], x, y, min_n)


def ic_by_cap(df, mode: str = "percentile", x="factor", y="fwd", cap="cap", hi=0.7, lo=0.3, min_n=10) -> DataFrame:
    """Rank IC per size bucket: by percentile rank of the cap, or Pearson IC by absolute cut-offs."""
    if mode == "percentile":
        d = cs.cs_rank(df.filter(F.col(cap).isNotNull()), [], cap, "_pct")
        bucket = F.when(F.col("_pct") >= hi, "large").when(F.col("_pct") < lo, "small").otherwise("mid")
        return cs.rank_corr(d.withColumn("bucket", bucket), ["bucket"], x, y, min_n)
    from factorspark.functions.math import cap_group
    return cs.pearson(df.withColumn("bucket", cap_group(F.col(cap))), ["bucket"], x, y, min_n)


def ic_by_vol(df, x="factor", y="fwd", ret="ret", n=20, min_periods=5, threshold=0.7, min_n=10, roll=None) -> DataFrame:
    """Rank IC for high- and low-volatility rows; volatility is per symbol, its percentile over the panel."""
    roll = roll or Roll()
    d = df.withColumn("_vol", roll.std(ret, n, min_periods)).filter(F.col("_vol").isNotNull())
    d = cs.cs_rank(d, [], "_vol", "_pct")
    d = d.withColumn("bucket", F.when(F.col("_pct") >= threshold, "high_vol").otherwise("low_vol"))
    return cs.rank_corr(d, ["bucket"], x, y, min_n)


def ic_by_regime(df, label: str, x="factor", y="fwd", min_n=30) -> DataFrame:
    return cs.rank_corr(df.filter(F.col(label).isNotNull()), [label], x, y, min_n)


def regime_spread(ics: DataFrame, value: str = "rank_ic") -> DataFrame:
    """Mean, population spread, extremes and range of per-regime ICs, zeros left out."""
    v = F.col(value)
    return ics.filter(v != 0).agg(F.avg(v).alias("mean_ic"), F.stddev_pop(v).alias("std_ic"), F.min(v).alias("min_ic"),
                                  F.max(v).alias("max_ic"), (F.max(v) - F.min(v)).alias("ic_range"))


def forward_returns_long(df, horizons, price="close", roll=None, keep=()) -> DataFrame:
    """One row per (row, horizon) with its forward return."""
    roll = roll or Roll()
    cols = {f"_f{h}": div(roll.lead(price, h), F.col(price)) - 1 for h in horizons}
    d = df.withColumns(cols)
    arr = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd_h")) for h in horizons])
    return d.withColumn("_h", F.explode(arr)).select(*keep, "_h.horizon", "_h.fwd_h")


def ic_by_split(df, split: Column, horizons=(1, 5, 10), x="factor", roll=None, min_n=3) -> DataFrame:
    """Rank IC per (split, horizon)."""
    d = forward_returns_long(df, horizons, roll=roll, keep=("ts", "symbol", x)).withColumn("split", split)
    return cs.rank_corr(d, ["split", "horizon"], x, "fwd_h", min_n)


def ic_decay(df, max_lag=5, x="factor", ret="ret", min_n=30, roll=None) -> DataFrame:
    """Rank IC of the factor with the return ``lag`` rows ahead, lags 0 .. max_lag."""
    roll = roll or Roll()
    d = df.withColumns({f"_l{k}": roll.lead(ret, k) if k else F.col(ret) for k in range(max_lag + 1)})
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("r")) for k in range(max_lag + 1)])
    d = d.select(x, F.explode(arr).alias("_e")).select(x, "_e.lag", "_e.r")
    return cs.rank_corr(d, ["lag"], x, "r", min_n).select("lag", "n", F.coalesce("rank_ic", F.lit(0.0)).alias("ic"))


def decay_flags(curve: DataFrame, ratio: float = 2.0, high: float = 0.3) -> DataFrame:
    """Half-life lag and the two signs of look-ahead: a sharp drop after lag 0, or a very high IC at lag 0."""
    at = lambda k: F.max(F.when(F.col("lag") == k, F.abs("ic")))
    base = curve.agg(at(0).alias("ic0"), at(1).alias("ic1"), F.collect_list(F.struct("lag", F.abs("ic").alias("a"))).alias("c"))
    half = F.array_min(F.transform(F.filter("c", lambda e: e["a"] <= F.col("ic0") / 2), lambda e: e["lag"]))
    sharp = (F.col("ic1") > 0) & (F.col("ic0") / F.col("ic1") > ratio)
    return base.select("ic0", "ic1", half.alias("half_life_lag"), F.coalesce(sharp, F.lit(False)).alias("drops_sharply"),
                       (F.col("ic0") > high).alias("unusually_high"))


def trend(df, t: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares line of y on t with r, standard error and normal-approximation p-value."""
    n = F.count(F.when(F.col(y).isNotNull(), F.col(t)))
    s = [n.alias("n"), F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), corr(y, t).alias("r_value"),
         F.regr_sxx(y, t).alias("_sxx"), F.regr_syy(y, t).alias("_syy")]
    d = df.groupBy(*by).agg(*s) if by else df.agg(*s)
    sse = F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0))
    se = F.when((F.col("n") > 2) & (F.col("_sxx") > 0), F.sqrt(sse / (F.col("n") - 2) / F.col("_sxx"))).otherwise(0.0)
    d = d.withColumn("std_err", se)
    p = F.when(F.col("std_err") > 1e-10, (1 - norm_cdf(F.abs(F.col("slope") / F.col("std_err")))) * 2) \
         .when(F.abs("slope") > 1e-10, 0.0).otherwise(1.0)
    return d.withColumn("p_value", p).drop("_sxx", "_syy")


def ic_half_life(ics, i: str, value: str, cap: int = 999) -> DataFrame:
    """Decay rate of log |IC| over its index and the half-life it implies."""
    a = F.abs(F.col(value))
    d = ics.filter(a > 1e-6).agg(F.count("*").alias("n"), F.regr_slope(F.ln(a), F.col(i)).alias("slope"))
    rate = F.when((F.col("n") >= 3) & (F.col("slope") < 0), -F.col("slope")).otherwise(0.0)
    d = d.select("n", rate.alias("decay_rate"))
    hl = F.when(F.col("decay_rate") > 1e-6, F.least(F.floor(F.lit(0.6931471805599453) / F.col("decay_rate")), F.lit(cap))).otherwise(cap)
    return d.withColumn("half_life", hl.cast("long"))


def t_test(df, group: Column, value: str, by: list[str] | None = None) -> DataFrame:
    """Two-sample t statistics, pooled and Welch, between rows where ``group`` holds and the others."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    s = [F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
         F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2")]
    d = df.groupBy(*by).agg(*s) if by else df.agg(*s)
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    welch = F.sqrt(v1 / n1 + v2 / n2)
    d = d.filter((n1 >= 2) & (n2 >= 2)).withColumns({"t_pooled": div(F.col("m1") - F.col("m2"), pooled), "t_welch": div(F.col("m1") - F.col("m2"), welch)})
    return d.withColumns({"p_pooled": (1 - norm_cdf(F.abs("t_pooled"))) * 2, "p_welch": (1 - norm_cdf(F.abs("t_welch"))) * 2}).drop("v1", "v2")


def long_short_returns(df, q=0.2, x="factor", y="fwd", by=("ts",), tiebreak="symbol") -> DataFrame:
    """Mean forward return of the top ``ceil(q n)`` minus the bottom per cross-section."""
    d = cs.head_tail(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), list(by), x, q, tiebreak)
    top, bot = F.avg(F.when(F.col("side") == "top", F.col(y))), F.avg(F.when(F.col("side") == "bottom", F.col(y)))
    return d.groupBy(*by).agg(top.alias("top_ret"), bot.alias("bottom_ret"), (top - bot).alias("ls_ret"))


def turnover(weights: DataFrame, by="symbol", ts="ts", w="weight") -> DataFrame:
    """Half the summed weight changes from each date to the next; a symbol absent on a date weighs zero.

    Each weight is charged on its own date and, reversed, on the next date of the panel; summing per
    (symbol, date) gives the change without a self join. The date table is one row per date.
    """
    dates = weights.select(ts).distinct()
    step = dates.withColumn("_next", F.lead(ts).over(Window.orderBy(ts)))
    own = weights.select(by, ts, F.col(w).alias("_d"))
    ahead = weights.join(F.broadcast(step), ts).filter(F.col("_next").isNotNull()).select(by, F.col("_next").alias(ts), (-F.col(w)).alias("_d"))
    change = own.unionByName(ahead).groupBy(by, ts).agg(F.sum("_d").alias("_d"))
    first = dates.agg(F.min(ts).alias("_first"))
    per_date = change.groupBy(ts).agg((F.sum(F.abs("_d")) / 2).alias("turnover"))
    return per_date.join(F.broadcast(first), F.col(ts) > F.col("_first")).drop("_first")


def corr_matrix(df, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair i < j over the rows that have both."""
    return column_corr.pearson_pairs(df, cols)


def spearman_matrix(df, cols: list[str], min_n: int = 2) -> DataFrame:
    """Spearman correlation of every column pair i < j; each pair is ranked over the rows that have both."""
    return column_corr.spearman_pairs(df, cols, min_n)


def factor_sharpe(df, cols: list[str], fwd: str = "fwd", by=("ts",), ppy: float = 252) -> DataFrame:
    """(factor, sharpe) of the portfolio that holds each date's z-scores of the factor; dates where it is flat do not count."""
    x = F.col("_x")
    long = df.unpivot([*by, fwd], [F.col(c).cast("double").alias(c) for c in cols], "factor", "_x").filter(x.isNotNull() & F.col(fwd).isNotNull())
    r = long.groupBy("factor", *by).agg(div(F.covar_pop(x, F.col(fwd)), F.stddev_pop(x)).alias("_r"))
    return r.groupBy("factor").agg(sharpe(F.col("_r"), ppy).alias("sharpe"))


def compare_factors(df, cols: list[str], fwd: str = "fwd", by=("ts",), ppy: float = 252, min_n: int = 11) -> DataFrame:
    """(factor, other, corr, sharpe, rank): the whole Spearman matrix of the chosen factors, each pair over the rows that have both
    (NULL under ``min_n`` of them, 1 on the diagonal), and the rank by Sharpe, best first; a missing Sharpe counts as 0."""
    half = spearman_matrix(df, cols, min_n)
    sides = F.array(F.struct(F.col("factor_a").alias("factor"), F.col("factor_b").alias("other")), F.struct(F.col("factor_b").alias("factor"), F.col("factor_a").alias("other")))
    matrix = half.select(F.explode(sides).alias("_s"), "corr").select("_s.factor", "_s.other", "corr")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "factor STRING")
    matrix = matrix.unionByName(names.select("factor", F.col("factor").alias("other"), F.lit(1.0).alias("corr")))
    ranked = names.join(factor_sharpe(df, cols, fwd, by, ppy), "factor", "left")
    # one row per chosen factor
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("sharpe", F.lit(0.0)).desc(), "factor")))
    return matrix.join(ranked, "factor")


def spearman_pairs(df, cols, threshold: float) -> DataFrame:
    """Pairs at or over the threshold in absolute value, strongest first."""
    m = spearman_matrix(df, cols).filter(F.abs("corr") >= threshold)
    return m.orderBy(F.abs("corr").desc(), "factor_a", "factor_b")


def heatmap(matrix: DataFrame, names: list[str]) -> DataFrame:
    """Both triangles and the diagonal with display positions."""
    pos = lambda c: F.array_position(F.array(*[F.lit(n) for n in names]), c) - 1
    up = matrix.select(F.col("factor_a").alias("x"), F.col("factor_b").alias("y"), F.col("corr").alias("value"))
    down = matrix.select(F.col("factor_b").alias("x"), F.col("factor_a").alias("y"), F.col("corr").alias("value"))
    diag = matrix.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "x STRING, y STRING, value DOUBLE")
    return up.unionByName(down).unionByName(diag).withColumns({"x_pos": pos(F.col("x")), "y_pos": pos(F.col("y"))})


def autocorrelation(df, x="factor", lags=(1, 5, 20), roll=None, by: list[str] | None = None) -> DataFrame:
    """Correlation of a series with its own lags, over all rows that have both."""
    roll = roll or Roll()
    d = df.withColumns({f"_l{k}": roll.ref(x, k) for k in lags})
    aggs = [corr(x, f"_l{k}").alias(f"autocorr_{k}") for k in lags]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def strategy_position(df, x="factor", n=20, roll=None) -> DataFrame:
    """Sign of the clipped rolling z-score, held from the next row on."""
    roll = roll or Roll()
    d = df.withColumn("position", F.coalesce(F.signum(roll.zscore(x, n)), F.lit(0.0)))
    return d.withColumn("held", F.coalesce(roll.ref("position", 1), F.lit(0.0)))


def evaluate_library(long_df, name="name", x="value", y="fwd", by=("ts",), min_n: int = 3, ppy: float = 252, top_n: int | None = None) -> DataFrame:
    """Per factor of a long panel, in one job: rank IC mean, spread and skew, IR, hit rate, t-based p-value, annual Sharpe of the portfolio that
    holds the standardised ranks of each cross-section, and the rank by |IC|; with ``top_n`` only the best.

    IC and portfolio return come from the same sums over the ranks (``rank_moments``). Cross-sections under ``min_n`` complete rows do not count. |IC| is
    compared to nine digits, ties by name; an IC that is zero to nine digits is no hit.
    """
    d = long_df.select(name, *by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = rank_moments(d, [name, *by], x, y).withColumnRenamed("held", "_r").filter(F.col("n") >= min_n).drop("n")
    v, n = F.col("rank_ic"), F.count("rank_ic")
    mean, std = F.avg(v), F.stddev_samp(v)
    skew = F.when(n >= 3, F.skewness(v) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
    s = g.groupBy(name).agg(mean.alias("ic_mean"), std.alias("ic_std"), skew.alias("ic_skew"), F.when(std > 0, mean / std).alias("ir"),
                            F.avg((v > 1e-9).cast("double")).alias("hit_rate"), n.alias("n"), sharpe(F.col("_r"), ppy).alias("sharpe"))
    t = div(F.col("ic_mean"), F.col("ic_std")) * F.sqrt(F.col("n").cast("double"))
    s = s.withColumn("p_value", (1 - norm_cdf(F.abs(t))) * 2)
    # one row per factor name: a registry-sized table
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.round(F.abs("ic_mean"), 9).desc_nulls_last(), name)))
    return s if top_n is None else s.filter(F.col("rank") <= top_n)
