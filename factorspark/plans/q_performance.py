"""Performance, cost and trade queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from factorspark.functions import math as fm
from factorspark.operators import performance as pf
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import R
from factorspark.plans.registry import query

PPY = 252.0
_DD = f"""r AS (SELECT symbol, ts, ret FROM hret WHERE ret IS NOT NULL), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER {q.wcum()}) AS equity FROM r),
p AS (SELECT *, max(equity) OVER {q.wcum()} AS peak FROM e), u AS (SELECT *, CASE WHEN equity < peak THEN 1 ELSE 0 END AS un FROM p),
s AS (SELECT *, sum(1 - un) OVER {q.wcum()} AS spell FROM u),
d AS (SELECT *, sum(un) OVER (PARTITION BY symbol, spell ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM s)"""
_PERF = f"""SELECT symbol, exp(sum(ln(1 + ret))) - 1 AS total_return, count(ret) AS n, stddev_samp(ret) * sqrt({PPY}) AS volatility,
    avg(ret) / stddev_samp(ret) * sqrt({PPY}) AS sharpe, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt({PPY}) AS sortino,
    max((greatest(peak, 1) - equity) / greatest(peak, 1)) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
    CAST(max(dd) AS BIGINT) AS max_dd_length, pow(exp(sum(ln(1 + ret))), {PPY} / count(ret)) - 1 AS annual_return,
    (pow(exp(sum(ln(1 + ret))), {PPY} / count(ret)) - 1) / max((greatest(peak, 1) - equity) / greatest(peak, 1)) AS calmar FROM d GROUP BY symbol"""


@query("a20_performance", f"WITH {_DD} {_PERF}", "th hret", "total_return volatility sharpe sortino max_drawdown win_rate annual_return calmar")
def _(t):
    return pf.performance(t.hret, PPY)


@query("a21_sharpe", f"SELECT symbol, (avg(ret) - 0.02 / {PPY}) / stddev_samp(ret) * sqrt({PPY}) AS sharpe FROM hret GROUP BY 1", "th hret", "sharpe")
def _(t):
    return t.hret.groupBy("symbol").agg(pf.sharpe(F.col("ret"), PPY, 0.02).alias("sharpe"))


@query("a22_sortino", f"SELECT symbol, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt({PPY}) AS sortino FROM hret GROUP BY 1", "th hret", "sortino")
def _(t):
    return t.hret.groupBy("symbol").agg(pf.sortino(F.col("ret"), PPY).alias("sortino"))


@query("a23_calmar", f"WITH {_DD}, z AS ({_PERF}) SELECT symbol, calmar FROM z", "th hret", "calmar")
def _(t):
    return pf.performance(t.hret, PPY).select("symbol", "calmar")


@query("a24_information_ratio", "SELECT avg(ret - bench) / stddev_samp(ret - bench) * sqrt(365) AS info_ratio FROM daily", "ud fp daily", "info_ratio")
def _(t):
    return t.daily.agg(pf.information_ratio(F.col("ret"), F.col("bench"), 365).alias("info_ratio"))


@query("a25_var_es",
       """WITH v AS (SELECT symbol, greatest(-quantile_cont(ret, 0.05), 0) AS var_95, greatest(-quantile_cont(ret, 0.01), 0) AS var_99 FROM hret GROUP BY 1)
       SELECT symbol, max(var_95) AS var_95, greatest(coalesce(-avg(ret) FILTER (ret < -var_95), max(var_95)), 0) AS es_95,
       max(var_99) AS var_99, greatest(coalesce(-avg(ret) FILTER (ret < -var_99), max(var_99)), 0) AS es_99 FROM hret JOIN v USING (symbol) WHERE ret IS NOT NULL GROUP BY 1""",
       "th hret", "var_95 es_95 var_99 es_99")
def _(t):
    return pf.var_es(t.hret.select("symbol", "ret"), ["symbol"])


@query("a31_norm_cdf_ppf",
       f"""SELECT p_partkey, {q.norm_cdf('((p_retailprice - 1200) / 300)')} AS cdf, {q.norm_ppf('((p_size + 0.5) / 60.0)')} AS ppf FROM part""", "", "cdf ppf")
def _(t):
    return t.part.select("p_partkey", fm.norm_cdf((F.col("p_retailprice") - 1200) / 300).alias("cdf"), fm.norm_ppf((F.col("p_size") + 0.5) / 60.0).alias("ppf"))


_EMAX = q.norm_ppf("(1 - 1.0 / n_trials)")
_SE = "sqrt((1 + sharpe * sharpe * 0.5) / 252.0)"
_TN = "tn AS (SELECT trial, sharpe, CAST(trial % 50 + 2 AS BIGINT) AS n_trials FROM trials)"


def _tn(t):
    return t.trials.select("trial", "sharpe", (F.col("trial") % 50 + 2).alias("n_trials"))


@query("a32_deflated_sharpe",
       f"""WITH {_TN}, d AS (SELECT *, (sharpe - {_EMAX}) / {_SE} AS deflated FROM tn) SELECT *, 1 - {q.norm_cdf('deflated')} AS p_value FROM d""",
       "trials", "sharpe deflated p_value")
def _(t):
    return pf.deflated_sharpe(_tn(t))


@query("a32_deflated_sharpe_haircut",
       f"""WITH {_TN}, d AS (SELECT *, sqrt(2 * ln(n_trials)) AS a FROM tn),
       f AS (SELECT trial, sharpe, n_trials, CASE WHEN n_trials <= 5 THEN sharpe ELSE greatest(0, sharpe - (a - (ln(ln(n_trials)) + ln(4 * pi())) / (2 * a))
         * ln(n_trials) / ln(greatest(n_trials, 10)) * 0.5) END AS deflated FROM d)
       SELECT *, CASE WHEN n_trials <= 5 THEN 0.0 ELSE 1 - {q.norm_cdf(f'(sharpe / {_SE})')} END AS p_value FROM f""", "trials", "sharpe deflated p_value")
def _(t):
    return pf.deflated_sharpe(_tn(t), "haircut")


@query("a32_deflated_sharpe_extreme_value",
       f"""WITH {_TN}, d AS (SELECT *, (sharpe - ((1 - 0.5772156649) * {_EMAX} + 0.5772156649 * {q.norm_ppf(f'(1 - 1.0 / (n_trials * {math.e!r}))')}))
         / sqrt(pi() * pi() / 6 / n_trials) AS z FROM tn), p AS (SELECT trial, sharpe, n_trials, 1 - {q.norm_cdf('z')} AS p_value FROM d)
       SELECT *, sharpe * greatest(0, 1 - 2 * p_value) AS deflated FROM p""", "trials", "sharpe deflated p_value")
def _(t):
    return pf.deflated_sharpe(_tn(t), "extreme_value")


@query("a49_monthly_returns", "SELECT symbol, date_trunc('month', ts) AS month, exp(sum(ln(1 + r))) - 1 AS month_return FROM (SELECT symbol, ts, ret / 50 AS r FROM sp WHERE ret / 50 > -1) GROUP BY 1, 2",
       "sm sp", "month_return @month")
def _(t):
    return pf.monthly_returns(t.sp.select("symbol", "ts", (F.col("ret") / 50).alias("ret")).filter("ret > -1"))


_Z = f"({q.zscore('close', 20)})"
_PS = f"""z0 AS (SELECT h.*, d.high, d.low, d.volume, d.funding_rate FROM hret h JOIN drv d USING (symbol, ts)),
ps0 AS (SELECT *, coalesce(sign({_Z}), 0) AS position FROM z0),
ps AS (SELECT *, coalesce({q.lag('position')}, 0) AS held FROM ps0)"""


def _positions(t):
    d = t.drv.select("symbol", "ts", "high", "low", "close", "volume", "funding_rate")
    raw = fm.div(F.col("close"), R.ref("close", 1)) - 1
    d = d.withColumn("ret", fm.clip(raw / 100, -0.05, 0.05))
    return pf.zscore_positions(d)


@query("w36_factor_strategy_returns", f"WITH {_PS} SELECT symbol, ts, position, held, held * coalesce(ret, 0) AS strategy_ret FROM ps", "th drv hret", "position held strategy_ret @ts")
def _(t):
    d = _positions(t).withColumn("strategy_ret", F.col("held") * F.coalesce("ret", F.lit(0.0)))
    return d.select("symbol", "ts", "position", "held", "strategy_ret")


_NET = f"""nt AS (SELECT *, coalesce(abs(position - {q.lag('position')}), 0) AS trade, coalesce(({q.std('ret', 24)}), 0) AS vol, {q.lag('position')} * ret AS gross FROM ps),
nn AS (SELECT symbol, ts, gross, CASE WHEN hour(ts) IN (0, 8, 16) THEN -position * funding_rate ELSE 0 END AS funding_cost, -trade * 0.0004 AS fee,
    -trade * 0.0005 * (1 + vol * 10) AS slippage FROM nt)"""


@query("w37_net_returns", f"WITH {_PS}, {_NET} SELECT *, gross + funding_cost + fee + slippage AS net FROM nn", "th drv hret", "gross funding_cost fee slippage net @ts", 8)
def _(t):
    return pf.net_returns(_positions(t)).select("symbol", "ts", "gross", "funding_cost", "fee", "slippage", "net")


_UP = "up AS (SELECT symbol, ts, sign(ret) AS position FROM fp WHERE ret IS NOT NULL)"


@query("w38_rebalance",
       f"""WITH {_UP} SELECT symbol, ts, coalesce(last_value(CASE WHEN dayofweek(ts) = 1 THEN position END IGNORE NULLS) OVER {q.wcum()}, 0) AS held_position FROM up""",
       "ud fp", "held_position @ts")
def _(t):
    d = t.fp.filter(F.col("ret").isNotNull()).select("symbol", "ts", F.signum("ret").alias("position"))
    return pf.rebalance(d, "weekly").select("symbol", "ts", "held_position")


_TR = f"""ti AS (SELECT *, CASE WHEN row_number() OVER {q.wall()} > 1 AND {q.lag('position')} = position THEN 0 ELSE 1 END AS chg,
  coalesce(lead(close) OVER {q.wall()}, close) AS nx, coalesce(lead(ts) OVER {q.wall()}, ts) AS nt FROM ps),
tj AS (SELECT *, sum(chg) OVER {q.wcum()} AS trade_id FROM ti),
tr AS (SELECT symbol, CAST(trade_id AS BIGINT) AS trade_id, max(position) AS side, min(ts) AS entry_ts, first(close ORDER BY ts) AS entry_price, max(nt) AS exit_ts,
  last(nx ORDER BY ts) AS exit_price, count(*) AS bars, max(position) * (last(nx ORDER BY ts) / first(close ORDER BY ts) - 1) AS pnl_pct
  FROM tj WHERE position <> 0 GROUP BY 1, 2)"""


def _trades(t):
    return pf.trades_from_positions(_positions(t))


@query("w39_trades_from_positions", f"WITH {_PS}, {_TR} SELECT * FROM tr", "th drv hret", "side entry_price exit_price pnl_pct @entry_ts @exit_ts")
def _(t):
    return _trades(t)


_TS = """SELECT symbol, count(*) AS n_trades, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
    coalesce(sum(CASE WHEN pnl_pct > 0 THEN pnl_pct END) / -sum(CASE WHEN pnl_pct < 0 THEN pnl_pct END), 0) AS profit_factor, avg(pnl_pct) AS mean_return,
    avg(bars) AS mean_bars, avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END) AS mean_win, avg(CASE WHEN pnl_pct < 0 THEN -pnl_pct END) AS mean_loss FROM tr GROUP BY 1"""


@query("a30_trade_stats", f"WITH {_PS}, {_TR} {_TS}", "th drv hret", "win_rate profit_factor mean_return mean_bars mean_win mean_loss")
def _(t):
    return pf.trade_stats(_trades(t))


@query("w40_funding_by_trade",
       f"""WITH {_PS}, {_TR}, j AS (SELECT tr.symbol, trade_id, -side * f.funding_rate AS c FROM tr JOIN fund8 f ON tr.symbol = f.symbol AND f.ts > entry_ts AND f.ts <= exit_ts)
       SELECT tr.symbol, tr.trade_id, coalesce(sum(CASE WHEN c < 0 THEN -c ELSE 0 END) FILTER (c IS NOT NULL), 0) AS paid,
       coalesce(sum(CASE WHEN c > 0 THEN c ELSE 0 END) FILTER (c IS NOT NULL), 0) AS received, count(c) AS settlements
       FROM tr LEFT JOIN j ON tr.symbol = j.symbol AND tr.trade_id = j.trade_id GROUP BY 1, 2""", "th drv hret fund8", "paid received", 8)
def _(t):
    return pf.funding_by_trade(_trades(t), t.fund8)


@query("w41_liquidation_hits",
       f"""WITH {_PS}, {_TR}, l AS (SELECT *, CASE WHEN side > 0 THEN entry_price * (1 - 0.1 + 0.025) ELSE entry_price * (1 + 0.1 - 0.025) END AS liq_price FROM tr)
       SELECT l.symbol, trade_id, min(b.ts) AS hit_ts, max(liq_price) AS liq_price FROM l JOIN th b ON l.symbol = b.symbol AND b.ts > entry_ts AND b.ts <= exit_ts
       WHERE CASE WHEN side > 0 THEN b.low <= liq_price ELSE b.high >= liq_price END GROUP BY 1, 2""", "th drv hret", "liq_price @hit_ts")
def _(t):
    return pf.liquidation_hits(_trades(t), t.th)


@query("w42_exit_hits",
       f"""WITH {_PS}, {_TR}, j AS (SELECT tr.symbol, trade_id, side, entry_ts, entry_price AS e, b.ts, b.close AS p,
         CASE WHEN side > 0 THEN max(b.high) OVER w ELSE min(b.low) OVER w END AS m FROM tr JOIN th b ON tr.symbol = b.symbol AND b.ts > entry_ts AND b.ts <= exit_ts
         WINDOW w AS (PARTITION BY tr.symbol, trade_id ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       f AS (SELECT *, 'stop' AS rule, CASE WHEN side > 0 THEN p <= e * 0.8 ELSE p >= e * 1.2 END AS hit FROM j
         UNION ALL SELECT *, 'trailing_stop', CASE WHEN side > 0 THEN p <= m * 0.7 ELSE p >= m * 1.3 END FROM j
         UNION ALL SELECT *, 'time', epoch(ts) - epoch(entry_ts) >= 43200 FROM j
         UNION ALL SELECT *, 'target', CASE WHEN side > 0 THEN p >= e * 1.5 ELSE p <= e * 0.5 END FROM j
         UNION ALL SELECT *, 'trailing_target', CASE WHEN side > 0 THEN m >= e * 1.2 AND p <= m * 0.9 ELSE m <= e * 0.8 AND p >= m * 1.1 END FROM j)
       SELECT symbol, trade_id, rule, min(ts) AS hit_ts, first(p ORDER BY ts) AS hit_price FROM f WHERE hit GROUP BY 1, 2, 3""", "th drv hret", "hit_price @hit_ts")
def _(t):
    return pf.exit_hits(_trades(t), t.th)


@query("a53_position_sizes",
       f"""WITH {_PS}, {_TR}, s AS ({_TS}) SELECT symbol, 10000 * least(greatest((win_rate * (mean_win / mean_loss) - (1 - win_rate)) / (mean_win / mean_loss) * 0.5, 0), 0.25) AS kelly,
       1000.0 AS fixed, 10000 * 0.02 / mean_loss AS risk_parity FROM s""", "th drv hret", "kelly fixed risk_parity")
def _(t):
    from factorspark.operators.portfolio import position_sizes
    return position_sizes(pf.trade_stats(_trades(t)), 10000.0)


@query("a58_cost_capacity",
       f"""WITH {_PS}, x AS (SELECT symbol, abs(position - {q.lag('position')}) AS chg, -held * funding_rate AS fund, volume FROM ps),
       g AS (SELECT symbol, avg(chg) * (0.0004 + 0.0002) * 252 AS trading_cost, avg(fund) * 252 AS funding_cost, avg(abs(fund)) * 252 AS funding_cost_abs, avg(volume) * 0.01 AS capacity FROM x GROUP BY 1)
       SELECT *, trading_cost + funding_cost AS total_cost, trading_cost + funding_cost_abs AS total_cost_abs,
       CASE WHEN trading_cost + funding_cost_abs < 0.005 THEN 1.0 WHEN trading_cost + funding_cost_abs < 0.02 THEN 0.7 WHEN trading_cost + funding_cost_abs < 0.05 THEN 0.4 ELSE 0.1 END AS implementability FROM g""",
       "th drv hret", "trading_cost funding_cost funding_cost_abs capacity total_cost total_cost_abs implementability")
def _(t):
    return pf.cost_capacity(t.drv, 252)


@query("a67_strategy_metrics",
       f"""WITH {_PS}, x AS (SELECT symbol, coalesce(abs(position - {q.lag('position')}), 0) AS chg, held * coalesce(ret, 0) - coalesce(abs(position - {q.lag('position')}), 0) * 0.0015 AS s FROM ps)
       SELECT symbol, exp(sum(ln(1 + s))) - 1 AS total_return, avg(s) / stddev_samp(s) * sqrt(252) AS sharpe,
       sum(CASE WHEN s > 0 THEN s ELSE 0 END) / -sum(CASE WHEN s < 0 THEN s ELSE 0 END) AS profit_factor, count(*) FILTER (s > 0) / count(*) FILTER (s <> 0) AS win_rate,
       count(*) FILTER (chg > 0) AS n_trades FROM x GROUP BY 1""", "th drv hret", "total_return sharpe profit_factor win_rate")
def _(t):
    return pf.strategy_metrics(_positions(t), ["symbol"])


@query("a68_funding_and_leverage",
       f"""WITH {_PS} SELECT p.symbol, p.ts, -position * coalesce(f.funding_rate, 0) AS funding_cost,
       (coalesce(ret, 0) * position - position * coalesce(f.funding_rate, 0)) * 3 AS leveraged_ret
       FROM ps p ASOF LEFT JOIN fund8 f ON p.symbol = f.symbol AND p.ts >= f.ts""", "th drv hret fund8", "funding_cost leveraged_ret @ts", 8)
def _(t):
    d = _positions(t).select("symbol", "ts", "position", "ret")
    return pf.funding_and_leverage(d, t.fund8, 3.0).select("symbol", "ts", "funding_cost", "leveraged_ret")


@query("j15_parameter_sweep",
       f"""WITH {_PS}, zz AS (SELECT symbol, ts, ret, {_Z} AS z FROM z0), g AS (SELECT *, unnest([0.5, 1.0, 1.5]) AS threshold FROM zz),
       p AS (SELECT *, CASE WHEN abs(z) > threshold THEN sign(z) ELSE 0 END AS pos FROM g),
       s AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol, threshold ORDER BY ts), 0) * ret AS s FROM p)
       SELECT threshold, avg(s) / stddev_samp(s) * sqrt({PPY}) AS sharpe, sum(s) AS sum_return, count(*) FILTER (pos <> 0) AS active FROM s GROUP BY 1""",
       "th drv hret", "threshold sharpe sum_return")
def _(t):
    d = t.hret.select("symbol", "ts", "close", "ret")
    return pf.sweep(d, [0.5, 1.0, 1.5], ppy=PPY)
