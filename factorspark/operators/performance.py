"""Return series to performance, tail risk, costs and multiple-testing measures.

Series are bars (one row per key and time), so windows per key are bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.math import clip, div, norm_cdf, norm_ppf, norm_ppf_value
from factorspark.operators import cross_section as cs
from factorspark.operators.asof import asof_join
from factorspark.operators.windows import Roll, with_drawdown


def compounded(r: Column) -> Column:
    """Aggregate: product of (1 + r) minus one; a loss of everything or more gives -1."""
    worst = F.min(r)
    return F.when(worst > -1, F.exp(F.sum(F.ln(F.when(r > -1, r + 1)))) - 1).when(worst.isNotNull(), -1.0)


def sharpe(r: Column, ppy: float, rf: float = 0.0) -> Column:
    s = F.stddev_samp(r)
    return F.when(s > 1e-12, (F.avg(r) - rf / ppy) / s * math.sqrt(ppy))


def sortino(r: Column, ppy: float, target: float = 0.0) -> Column:
    """Mean excess over the root mean square of negative excesses."""
    e = r - target / ppy
    down = F.sqrt(F.avg(F.when(e < 0, e * e)))
    return F.when(down > 1e-10, F.avg(e) / down * math.sqrt(ppy))


def information_ratio(r: Column, b: Column, ppy: float) -> Column:
    e = r - b
    return F.when(F.stddev_samp(e) > 1e-10, F.avg(e) / F.stddev_samp(e) * math.sqrt(ppy))


def annual_return(total: Column, n: Column, ppy: float) -> Column:
    return F.when(total > -1, F.pow(total + 1, F.lit(float(ppy)) / n) - 1).otherwise(-1.0)


def performance(df: DataFrame, ppy: float, ret: str = "ret", by="symbol", order="ts") -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, largest drawdown, Calmar, win rate per key."""
    roll = Roll(by, order)
    d = df.filter(F.col(ret).isNotNull())
    d = with_drawdown(d.withColumn("equity", roll.equity(ret)), "equity", roll)
    r = F.col(ret)
    # the peak includes the starting capital of 1
    peak = F.greatest(F.col("peak"), F.lit(1.0))
    g = d.groupBy(*roll.by).agg(
        compounded(r).alias("total_return"), F.count(r).alias("n"), (F.stddev_samp(r) * math.sqrt(ppy)).alias("volatility"),
        sharpe(r, ppy).alias("sharpe"), sortino(r, ppy).alias("sortino"), F.max((peak - F.col("equity")) / peak).alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.max("dd_length").alias("max_dd_length"))
    g = g.withColumn("annual_return", annual_return(F.col("total_return"), F.col("n"), ppy))
    return g.withColumn("calmar", F.when(F.col("max_drawdown") > 1e-10, F.col("annual_return") / F.col("max_drawdown")))


def var_es(df: DataFrame, by: list[str], ret: str = "ret", levels=(0.95, 0.99)) -> DataFrame:
    """Historical value at risk (floored at 0) and expected shortfall per key; exact quantiles from ranks."""
    d = df.filter(F.col(ret).isNotNull())
    q = cs.winsor_bounds(d, by, ret, [1 - c for c in levels])
    names = [int(round(c * 100)) for c in levels]
    q = q.select(*by, *[F.greatest(-F.col(f"q{i}"), F.lit(0.0)).alias(f"var_{n}") for i, n in enumerate(names)])
    j = d.join(q, by) if by else d.join(F.broadcast(q))  # one row when there is no key
    aggs = []
    for n in names:
        var = F.max(f"var_{n}")
        tail = F.avg(F.when(F.col(ret) < -F.col(f"var_{n}"), F.col(ret)))
        aggs += [var.alias(f"var_{n}"), F.greatest(F.coalesce(-tail, var), F.lit(0.0)).alias(f"es_{n}")]
    return j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)


def monthly_returns(df: DataFrame, by="symbol", ret: str = "ret") -> DataFrame:
    return df.groupBy(by, F.date_trunc("month", "ts").alias("month")).agg(compounded(F.col(ret)).alias("month_return"))


# --- multiple testing
def expected_max_sharpe(n: Column) -> Column:
    """Expected largest of n standard normal draws."""
    return F.when(n <= 1, 0.0).otherwise(norm_ppf(1 - F.lit(1.0) / n))


def sharpe_std_error(sr: Column, n_obs: Column, skew: Column, kurt: Column) -> Column:
    v = (1 + sr * sr * 0.5 - skew * sr + (kurt - 3) / 4 * sr * sr) / n_obs
    return F.sqrt(F.greatest(v, F.lit(0.0)))


def deflated_sharpe(df: DataFrame, method: str = "order_statistic", sharpe_col="sharpe", trials="n_trials", n_obs: int = 252,
                    skew: float = 0.0, kurt: float = 3.0, min_trials: int = 5) -> DataFrame:
    """Add ``deflated`` and ``p_value`` for observed Sharpe ratios given the number of trials.

    ``order_statistic``: excess over the expected maximum in standard errors. ``haircut``: Sharpe minus half
    the penalised expected maximum, floored at zero. ``extreme_value``: Sharpe scaled by its significance
    against the extreme-value mean and spread.
    """
    sr, n = F.col(sharpe_col), F.col(trials).cast("double")
    se = sharpe_std_error(sr, F.lit(float(n_obs)), F.lit(skew), F.lit(kurt))
    if method == "order_statistic":
        z = F.when(se > 0, (sr - expected_max_sharpe(n)) / se).otherwise(sr - expected_max_sharpe(n))
        return df.withColumn("deflated", z).withColumn("p_value", 1 - norm_cdf(F.col("deflated")))
    if method == "haircut":
        ln = F.ln(n)
        a = F.sqrt(ln * 2)
        e_max = a - (F.ln(ln) + math.log(4 * math.pi)) / (a * 2)
        penalty = ln / F.ln(F.greatest(n, F.lit(10.0)))
        few = n <= min_trials
        d = F.when(few, sr).otherwise(F.greatest(F.lit(0.0), sr - e_max * penalty * 0.5))
        return df.withColumn("deflated", d).withColumn("p_value", F.when(few, 0.0).otherwise(1 - norm_cdf(div(sr, se))))
    if method == "extreme_value":
        gamma = 0.5772156649
        e_max = norm_ppf(1 - F.lit(1.0) / n) * (1 - gamma) + norm_ppf(1 - F.lit(1.0) / (n * math.e)) * gamma
        z = (sr - e_max) / F.sqrt(F.lit(math.pi ** 2 / 6) / n)
        p = 1 - norm_cdf(z)
        return df.withColumn("p_value", p).withColumn("deflated", sr * F.greatest(F.lit(0.0), 1 - F.col("p_value") * 2))
    raise ValueError(method)


def significance_threshold(n: Column, base: float = 2.0, confidence: float = 0.95) -> Column:
    """Sharpe needed after n trials: base times one plus the scaled growth of the expected maximum."""
    e_max = F.when(n <= 1, 0.0).otherwise(F.sqrt(F.ln(n.cast("double")) * 2))
    return F.lit(base) * (1 + e_max * (norm_ppf_value(confidence) / 1.645 * 0.15))


# --- strategies
def zscore_positions(df: DataFrame, x: str = "close", n: int = 20, roll: Roll | None = None) -> DataFrame:
    """``position`` = sign of the rolling z-score, ``held`` = the position taken one row earlier."""
    r = roll or Roll()
    d = df.withColumn("position", F.coalesce(F.signum(r.zscore(x, n)), F.lit(0.0)))
    return d.withColumn("held", F.coalesce(r.ref("position", 1), F.lit(0.0)))


def factor_strategy_returns(df: DataFrame, x: str = "close", ret: str = "ret", n: int = 20) -> DataFrame:
    return zscore_positions(df, x, n).withColumn("strategy_ret", F.col("held") * F.coalesce(F.col(ret), F.lit(0.0)))


def net_returns(df: DataFrame, position: str = "position", ret: str = "ret", funding: str = "funding_rate", taker_fee: float = 0.0004,
                slippage_bps: float = 5.0, max_position: float = 1.0, vol_rows: int = 24, roll: Roll | None = None) -> DataFrame:
    """Gross return, funding at settlement hours, fee, volatility-scaled slippage and net return per row.

    All costs are fractions of notional, like the returns they are taken from.
    """
    r = roll or Roll()
    d = df.withColumn("_p", F.coalesce(clip(F.col(position), -max_position, max_position), F.lit(0.0)))
    d = d.withColumn("_trade", F.abs(F.coalesce(r.delta("_p", 1), F.lit(0.0))))
    vol = F.coalesce(r.std(ret, vol_rows), F.lit(0.0))
    settles = F.hour("ts").isin(0, 8, 16)
    d = d.withColumns({
        "gross": r.ref("_p", 1) * F.col(ret),
        "funding_cost": F.when(settles, -F.col("_p") * F.coalesce(F.col(funding), F.lit(0.0))).otherwise(0.0),
        "fee": -F.col("_trade") * taker_fee,
        "slippage": -F.col("_trade") * (slippage_bps / 10000) * (1 + vol * 10),
    })
    return d.withColumn("net", F.col("gross") + F.col("funding_cost") + F.col("fee") + F.col("slippage")).drop("_p", "_trade")


def rebalance(df: DataFrame, freq: str, position: str = "position", roll: Roll | None = None) -> DataFrame:
    """Keep the position of rebalance dates (Mondays, or the first of a month) until the next one."""
    r = roll or Roll()
    on = {"weekly": F.dayofweek("ts") == 2, "monthly": F.dayofmonth("ts") == 1, "daily": F.lit(True)}[freq]
    d = df.withColumn("_set", F.when(on, F.col(position)))
    return d.withColumn("held_position", F.coalesce(r.ffill("_set"), F.lit(0.0))).drop("_set")


def cost_capacity(df: DataFrame, ppy: float, x: str = "close", fee: float = 0.0004, slippage_bps: float = 2.0, n: int = 20, by="symbol") -> DataFrame:
    """Annual trading cost, funding drag (signed and absolute), capacity and an implementability band per key."""
    r = Roll(by, "ts")
    d = zscore_positions(df, x, n, r)
    d = d.withColumn("_chg", F.abs(r.delta("position", 1))).withColumn("_fund", -F.col("held") * F.coalesce(F.col("funding_rate"), F.lit(0.0)))
    g = d.groupBy(by).agg((F.avg("_chg") * ((fee + slippage_bps / 10000) * ppy)).alias("trading_cost"), (F.avg("_fund") * ppy).alias("funding_cost"),
                          (F.avg(F.abs("_fund")) * ppy).alias("funding_cost_abs"), (F.avg("volume") * 0.01).alias("capacity"))
    total = F.col("trading_cost") + F.col("funding_cost_abs")
    band = F.when(total < 0.005, 1.0).when(total < 0.02, 0.7).when(total < 0.05, 0.4).otherwise(0.1)
    return g.withColumns({"total_cost": F.col("trading_cost") + F.col("funding_cost"), "total_cost_abs": total, "implementability": band})


def strategy_metrics(df: DataFrame, by: list[str], signal: str = "position", ret: str = "ret", cost: float = 0.0015, ppy: float = 252.0,
                     order: str = "ts") -> DataFrame:
    """Signal times return net of cost on every change: return, Sharpe, profit factor, win rate, trade count per key."""
    r = Roll(by, order)
    d = df.withColumn("_chg", F.coalesce(F.abs(r.delta(signal, 1)), F.lit(0.0)))
    d = d.withColumn("_s", F.coalesce(r.ref(signal, 1), F.lit(0.0)) * F.coalesce(F.col(ret), F.lit(0.0)) - F.col("_chg") * cost)
    s = F.col("_s")
    gains, losses = F.sum(F.when(s > 0, s).otherwise(0.0)), F.abs(F.sum(F.when(s < 0, s).otherwise(0.0)))
    active = F.count_if(s != 0)
    return d.groupBy(*by).agg(
        compounded(s).alias("total_return"), sharpe(s, ppy).alias("sharpe"), F.when(losses > 0, gains / losses).otherwise(0.0).alias("profit_factor"),
        F.when(active > 0, F.count_if(s > 0) / active).otherwise(0.0).alias("win_rate"), F.count_if(F.col("_chg") > 0).alias("n_trades"))


def funding_and_leverage(df: DataFrame, funding: DataFrame, leverage: float, position: str = "position") -> DataFrame:
    """Funding paid on each row's position at the latest rate, and leveraged returns after funding."""
    d = asof_join(df, funding.select("symbol", "ts", "funding_rate"))
    d = d.withColumn("funding_cost", -F.col(position) * F.coalesce(F.col("funding_rate"), F.lit(0.0)))
    return d.withColumn("leveraged_ret", (F.coalesce(F.col("ret"), F.lit(0.0)) * F.col(position) + F.col("funding_cost")) * leverage)


def sweep(df: DataFrame, grid: list[float], x: str = "close", ret: str = "ret", n: int = 20, ppy: float = 8760.0) -> DataFrame:
    """Every row under every parameter of a small grid, scored per parameter.

    The grid is a literal array exploded per row; the z-score is computed once, before the rows multiply.
    """
    r = Roll()
    d = df.withColumn("_z", r.zscore(x, n)).withColumn("threshold", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    d = d.withColumn("position", F.when(F.abs("_z") > F.col("threshold"), F.signum("_z")).otherwise(0.0))
    each = Roll(["symbol", "threshold"], "ts")
    d = d.withColumn("_s", F.coalesce(each.ref("position", 1), F.lit(0.0)) * F.col(ret))
    return d.groupBy("threshold").agg(sharpe(F.col("_s"), ppy).alias("sharpe"), F.sum("_s").alias("sum_return"), F.count_if(F.col("position") != 0).alias("active"))


# --- trades
def trades_from_positions(df: DataFrame, position: str = "position", price: str = "close", roll: Roll | None = None) -> DataFrame:
    """One row per stretch of constant non-zero position; exit at the following bar, or the last bar when none follows."""
    from factorspark.operators.windows import with_island
    r = roll or Roll()
    d = df.withColumns({"_nx": F.coalesce(r.lead(price, 1), F.col(price)), "_nt": F.coalesce(r.lead("ts", 1), F.col("ts"))})
    d = with_island(d, position, "trade_id", r).filter(F.col(position) != 0)
    g = d.groupBy(*r.by, "trade_id").agg(
        F.max(F.signum(position)).alias("side"), F.min("ts").alias("entry_ts"), F.min_by(price, "ts").alias("entry_price"),
        F.max("_nt").alias("exit_ts"), F.max_by("_nx", "ts").alias("exit_price"), F.count("*").alias("bars"))
    return g.withColumn("pnl_pct", F.col("side") * (div(F.col("exit_price"), F.col("entry_price")) - 1))


def trade_stats(trades: DataFrame, by="symbol") -> DataFrame:
    p = F.col("pnl_pct")
    win, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.abs(F.sum(F.when(p < 0, p).otherwise(0.0)))
    return trades.groupBy(by).agg(
        F.count("*").alias("n_trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.when(loss > 0, win / loss).otherwise(0.0).alias("profit_factor"),
        F.avg(p).alias("mean_return"), F.avg("bars").alias("mean_bars"), F.avg(F.when(p > 0, p)).alias("mean_win"), F.avg(F.when(p < 0, -p)).alias("mean_loss"))


def funding_by_trade(trades: DataFrame, funding: DataFrame) -> DataFrame:
    """Funding paid and received inside each holding (entry, exit]."""
    from factorspark.operators.asof import range_join
    j = range_join(trades, funding.select("symbol", F.col("ts").alias("_ft"), "funding_rate"), "symbol", "entry_ts", "exit_ts", "_ft")
    c = -F.col("side") * F.col("funding_rate")
    g = j.groupBy("symbol", "trade_id").agg(F.sum(F.when(c < 0, -c).otherwise(0.0)).alias("paid"), F.sum(F.when(c > 0, c).otherwise(0.0)).alias("received"),
                                            F.count("*").alias("settlements"))
    return trades.select("symbol", "trade_id").join(g, ["symbol", "trade_id"], "left").fillna(0)


def liquidation_hits(trades: DataFrame, bars: DataFrame, leverage: float = 10.0, mmr: float = 0.025) -> DataFrame:
    """First bar of each holding that reaches the liquidation price."""
    from factorspark.operators.asof import range_join
    liq = F.when(F.col("side") > 0, F.col("entry_price") * (1 - 1 / leverage + mmr)).otherwise(F.col("entry_price") * (1 + 1 / leverage - mmr))
    t = trades.withColumn("liq_price", liq).select("symbol", "trade_id", "side", "entry_ts", "exit_ts", "liq_price")
    j = range_join(t, bars.select("symbol", "ts", "high", "low"), "symbol", "entry_ts", "exit_ts", "ts")
    hit = F.when(F.col("side") > 0, F.col("low") <= F.col("liq_price")).otherwise(F.col("high") >= F.col("liq_price"))
    return j.filter(hit).groupBy("symbol", "trade_id").agg(F.min("ts").alias("hit_ts"), F.first("liq_price").alias("liq_price"))


def exit_hits(trades: DataFrame, bars: DataFrame, stop_pct=0.2, trail_pct=0.3, target_pct=0.5, activation_pct=0.2, target_trail_pct=0.1,
              max_hours: int = 12) -> DataFrame:
    """First bar of each holding that triggers each exit rule: stop, trailing stop, time, target, trailing target.

    Water marks run inside one holding, so the window group is one trade.
    """
    from factorspark.operators.asof import range_join
    j = range_join(trades.select("symbol", "trade_id", "side", "entry_ts", "exit_ts", "entry_price"),
                   bars.select("symbol", "ts", "high", "low", "close"), "symbol", "entry_ts", "exit_ts", "ts")
    w = Window.partitionBy("symbol", "trade_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    s, e, p = F.col("side"), F.col("entry_price"), F.col("close")
    # work in signed terms: a short is a long on the reflected price
    mark = F.when(s > 0, F.max("high").over(w)).otherwise(F.min("low").over(w))
    d = j.withColumn("_mark", mark).withColumn("_on", F.when(s > 0, F.col("_mark") >= e * (1 + activation_pct)).otherwise(F.col("_mark") <= e * (1 - activation_pct)))
    m = F.col("_mark")
    beyond = lambda long_rule, short_rule: F.when(s > 0, long_rule).otherwise(short_rule)
    rules = {
        "stop": beyond(p <= e * (1 - stop_pct), p >= e * (1 + stop_pct)),
        "trailing_stop": beyond(p <= m * (1 - trail_pct), p >= m * (1 + trail_pct)),
        "time": F.unix_timestamp("ts") - F.unix_timestamp("entry_ts") >= max_hours * 3600,
        "target": beyond(p >= e * (1 + target_pct), p <= e * (1 - target_pct)),
        "trailing_target": F.col("_on") & beyond(p <= m * (1 - target_trail_pct), p >= m * (1 + target_trail_pct)),
    }
    fired = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return (d.withColumn("rule", F.explode(fired)).groupBy("symbol", "trade_id", "rule")
            .agg(F.min("ts").alias("hit_ts"), F.min_by("close", "ts").alias("hit_price")))
