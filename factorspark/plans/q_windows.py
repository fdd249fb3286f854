"""Window-function queries (rolling expressions per series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs
from factorspark.operators import windows as win
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import R
from factorspark.plans.registry import query

MOVING = "CASE WHEN var_pop({0}) OVER {2} > 1e-18 AND var_pop({1}) OVER {2} > 1e-18 THEN corr({0}, {1}) OVER {2} END"


@query("w01_ref", f"SELECT symbol, ts, {q.lag('close', 5)} AS ref5, {q.lag('volume', 1)} AS ref1 FROM th", "th", "ref5 ref1 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.ref("close", 5).alias("ref5"), R.ref("volume", 1).alias("ref1"))


@query("w02_delta", f"SELECT symbol, ts, close - {q.lag('close', 5)} AS delta5 FROM th", "th", "delta5 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.delta("close", 5).alias("delta5"))


@query("w03_pct_change", f"SELECT symbol, ts, close / {q.lag('close', 3)} - 1 AS chg3 FROM th", "th", "chg3 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.pct_change("close", 3).alias("chg3"))


@query("w04_rolling_mean_sum_count",
       f"""SELECT symbol, ts, {q.mean('close', 20)} AS mean20, {q.roll('sum(volume)', 10, 'volume')} AS sum10,
       count(close) OVER {q.w(10)} AS count10 FROM th""", "th", "mean20 sum10 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.mean("close", 20).alias("mean20"), R.sum("volume", 10).alias("sum10"),
                       R.count("close", 10).alias("count10"))


@query("w05_rolling_std_var", f"SELECT symbol, ts, {q.std('close', 20)} AS std20, {q.roll('var_samp(close)', 10, 'close')} AS var10 FROM th",
       "th", "std20 var10 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.std("close", 20).alias("std20"), R.var("close", 10).alias("var10"))


def _sql_skew(n):
    f = q.w(n)
    m1, m2, m3, m4 = (f"avg(pow(close, {k})) OVER {f}" for k in (1, 2, 3, 4))
    return m1, m2, m3, m4


_M = """SELECT symbol, ts, n, v, m, k2, k3, k4 FROM (SELECT symbol, ts, len(a) AS n, list_avg(a) AS m,
    list_avg(list_transform(a, lambda x: pow(x - list_avg(a), 2))) AS k2, list_avg(list_transform(a, lambda x: pow(x - list_avg(a), 3))) AS k3,
    list_avg(list_transform(a, lambda x: pow(x - list_avg(a), 4))) AS k4, list_avg(a) AS v
    FROM (SELECT symbol, ts, list(close) OVER {w} AS a FROM th))"""


@query("w06_rolling_skew_kurt",
       f"""WITH mm AS ({_M.format(w=q.w(20))})
       SELECT symbol, ts, CASE WHEN n = 20 AND k2 > 1e-18 THEN k3 / pow(k2, 1.5) * sqrt(20 * 19) / 18 END AS skew20,
       CASE WHEN n = 20 AND k2 > 1e-18 THEN ((k4 / (k2 * k2) - 3) * 21 + 6) * 19.0 / (18 * 17) END AS kurt20 FROM mm""",
       "th", "skew20 kurt20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.skew("close", 20).alias("skew20"), R.kurt("close", 20).alias("kurt20"))


@query("w07_rolling_max_min", f"SELECT symbol, ts, {q.roll('max(high)', 20, 'high')} AS max20, {q.roll('min(low)', 20, 'low')} AS min20 FROM th",
       "th", "max20 min20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.max("high", 20).alias("max20"), R.min("low", 20).alias("min20"))


_IDX = f"""SELECT symbol, ts, rn, {q.roll('arg_max(rn, (high, rn))', 10, 'high')} - rn + 10 AS idxmax10,
       {q.roll('arg_min(rn, (low, -rn))', 10, 'low')} - rn + 10 AS idxmin10
       FROM (SELECT *, row_number() OVER {q.wall()} AS rn FROM th)"""


@query("w08_idxmax_idxmin", f"SELECT symbol, ts, idxmax10, idxmin10 FROM ({_IDX})", "th", "idxmax10 idxmin10 @ts")
def _(t):
    return R.number(t.th).select("symbol", "ts", R.idxmax("high", 10).alias("idxmax10"), R.idxmin("low", 10).alias("idxmin10"))


@query("w09_top_n_per_group",
       """SELECT symbol, ts, volume, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) AS rank FROM ud)
       WHERE rank <= 5""", "ud", "volume @ts")
def _(t):
    return cs.top_n(t.ud, ["ts"], "volume", 5, "symbol").select("symbol", "ts", "volume", "rank")


@query("w10_rolling_median_quantile",
       f"""SELECT symbol, ts, {q.roll('quantile_cont(close, 0.5)', 10, 'close')} AS med10,
       {q.roll('quantile_cont(close, 0.8)', 20, 'close')} AS q80_20 FROM th""", "th", "med10 q80_20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.med("close", 10).alias("med10"), R.quantile("close", 20, 0.8).alias("q80_20"))


_EQ = f"""e0 AS (SELECT symbol, ts, exp(sum(ln(1 + coalesce(ret, 0))) OVER {q.wcum()}) AS equity FROM hret),
e1 AS (SELECT *, max(equity) OVER {q.wcum()} AS peak FROM e0)"""


@query("w11_drawdown",
       f"""WITH {_EQ}, e2 AS (SELECT *, CASE WHEN equity < peak THEN 1 ELSE 0 END AS u FROM e1),
       e3 AS (SELECT *, sum(1 - u) OVER {q.wcum()} AS spell FROM e2)
       SELECT symbol, ts, peak, (peak - equity) / peak AS drawdown,
       CAST(sum(u) OVER (PARTITION BY symbol, spell ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS dd_length FROM e3""",
       "th hret", "peak drawdown @ts")
def _(t):
    d = t.hret.select("symbol", "ts", R.equity("ret").alias("equity"))
    return win.with_drawdown(d).select("symbol", "ts", "peak", "drawdown", "dd_length")


_ARR = "SELECT symbol, ts, close, list(close) OVER {w} AS a FROM th"


@query("w12_rolling_mad",
       f"""SELECT symbol, ts, CASE WHEN len(a) = 20 THEN list_avg(list_transform(a, lambda x: abs(x - list_avg(a)))) END AS mad20
       FROM ({_ARR.format(w=q.w(20))})""", "th", "mad20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.mad("close", 20).alias("mad20"))


@query("w13_ts_rank",
       f"""SELECT symbol, ts, CASE WHEN len(a) = 20 THEN len(list_filter(a, lambda x: x <= close)) / 20.0 END AS ts_rank20
       FROM ({_ARR.format(w=q.w(20))})""", "th", "ts_rank20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.ts_rank("close", 20).alias("ts_rank20"))


@query("w14_rank_percentile",
       f"""SELECT symbol, ts, CASE WHEN len(a) = 20 THEN (len(list_filter(a, lambda x: x < close)) + 0.5 * len(list_filter(a, lambda x: x = close))) / 20.0 * 100 END AS pct20
       FROM ({_ARR.format(w=q.w(20))})""", "th", "pct20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.rank_percentile("close", 20).alias("pct20"))


_RN = f"(SELECT *, row_number() OVER {q.wall()} AS rn FROM th)"


@query("w15_rolling_slope",
       f"""SELECT symbol, ts, {q.roll('regr_slope(close, rn)', 20, 'close')} AS slope20,
       CASE WHEN count(close) OVER {q.w(20)} >= 20 AND var_pop(close) OVER {q.w(20)} > 1e-18 THEN regr_r2(close, rn) OVER {q.w(20)} END AS rsq20,
       close - ({q.roll('regr_slope(close, rn)', 20, 'close')} * rn + {q.roll('regr_intercept(close, rn)', 20, 'close')}) AS resi20 FROM {_RN}""",
       "th", "slope20 rsq20 resi20 @ts")
def _(t):
    return R.number(t.th).select("symbol", "ts", R.slope("close", 20).alias("slope20"), R.rsquare("close", 20).alias("rsq20"),
                                 R.resi("close", 20).alias("resi20"))


@query("w16_wma",
       f"""SELECT symbol, ts, CASE WHEN count(close) OVER {q.w(10)} >= 10 THEN
       (sum(close * rn) OVER {q.w(10)} - (rn - 10) * sum(close) OVER {q.w(10)}) / 55.0 END AS wma10 FROM {_RN}""", "th", "wma10 @ts")
def _(t):
    return R.number(t.th).select("symbol", "ts", R.wma("close", 10).alias("wma10"))


@query("w17_ema", f"SELECT symbol, ts, {q.ema('close', 12)} AS ema12 FROM {_RN}", "th", "ema12 @ts")
def _(t):
    return R.number(t.th).select("symbol", "ts", R.ema("close", 12).alias("ema12"))


@query("w18_rolling_corr",
       f"SELECT symbol, ts, CASE WHEN count(close) OVER {q.w(20)} >= 20 THEN {MOVING.format('close', 'volume', q.w(20))} END AS corr20 FROM th",
       "th", "corr20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.corr("close", "volume", 20).alias("corr20"))


@query("w19_rolling_cov", f"SELECT symbol, ts, {q.roll('covar_samp(close, volume)', 20, 'close', 'volume')} AS cov20 FROM th", "th", "cov20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.cov("close", "volume", 20).alias("cov20"))


@query("w20_cs_rank",
       f"""SELECT symbol, ts, {q.avg_rank('factor', 'ts')} / count(*) OVER (PARTITION BY ts) AS cs_rank FROM fp WHERE factor IS NOT NULL""",
       "ud fp", "cs_rank @ts")
def _(t):
    d = t.fp.select("symbol", "ts", "factor").filter(F.col("factor").isNotNull())
    return cs.cs_rank(d, ["ts"], "factor", "cs_rank").select("symbol", "ts", "cs_rank")


@query("w21_cs_zscore_scale",
       """SELECT symbol, ts, CASE WHEN s > 0 THEN (factor - m) / s END AS cs_z, CASE WHEN g > 0 THEN factor / g END AS cs_scaled
       FROM (SELECT *, avg(factor) OVER d AS m, stddev_samp(factor) OVER d AS s, sum(abs(factor)) OVER d AS g FROM fp WHERE factor IS NOT NULL
       WINDOW d AS (PARTITION BY ts))""", "ud fp", "cs_z cs_scaled @ts")
def _(t):
    d = t.fp.select("symbol", "ts", "factor").filter(F.col("factor").isNotNull())
    d = cs.group_stats(d, ["ts"], m=F.avg("factor"), s=F.stddev_samp("factor"), g=F.sum(F.abs("factor")))
    f = F.col("factor")
    return d.select("symbol", "ts", F.when(F.col("s") > 0, (f - F.col("m")) / F.col("s")).alias("cs_z"),
                    F.when(F.col("g") > 0, f / F.col("g")).alias("cs_scaled"))


@query("w22_rolling_z", f"SELECT symbol, ts, {q.zscore('close', 20)} AS z20 FROM th", "th", "z20 @ts")
def _(t):
    return t.th.select("symbol", "ts", R.zscore("close", 20).alias("z20"))


@query("w23_normalizers",
       f"""WITH b AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS s, min(close) AS lo, max(close) AS hi, quantile_cont(close, 0.01) AS q0,
       quantile_cont(close, 0.99) AS q1 FROM th GROUP BY 1)
       SELECT symbol, ts, greatest(-3, least(3, (close - m) / s)) AS z, (close - lo) / (hi - lo) AS minmax,
       {q.avg_rank('close', 'symbol')} / count(*) OVER (PARTITION BY symbol) AS pct,
       greatest(q0, least(q1, close)) AS winsor FROM th JOIN b USING (symbol)""", "th", "z minmax pct winsor @ts")
def _(t):
    from factorspark.operators.portfolio import normalize
    return normalize(t.th.select("symbol", "ts", "close"), ["symbol"], "close").select("symbol", "ts", "z", "minmax", "pct", "winsor")


@query("w24_equity", f"WITH {_EQ} SELECT symbol, ts, equity FROM e0", "th hret", "equity @ts")
def _(t):
    return t.hret.select("symbol", "ts", R.equity("ret").alias("equity"))


@query("w25_cum_vwap",
       f"SELECT symbol, ts, sum(volume) OVER {q.wcum()} AS cum_volume, sum(close * volume) OVER {q.wcum()} / sum(volume) OVER {q.wcum()} AS vwap FROM th",
       "th", "cum_volume vwap @ts")
def _(t):
    return t.th.select("symbol", "ts", R.cum_sum("volume").alias("cum_volume"),
                       (R.cum_sum(F.col("close") * F.col("volume")) / R.cum_sum("volume")).alias("vwap"))


@query("w26_ffill", f"SELECT symbol, ts, last_value(CASE WHEN close > 60 THEN close END IGNORE NULLS) OVER {q.wcum()} AS filled FROM th", "th", "filled @ts")
def _(t):
    return t.th.select("symbol", "ts", R.ffill(F.when(F.col("close") > 60, F.col("close"))).alias("filled"))


@query("w27_streak_island",
       f"""WITH a AS (SELECT symbol, ts, ret, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS hit, sign(ret) AS sg FROM hret),
       b AS (SELECT *, sum(1 - hit) OVER {q.wcum()} AS run,
         CASE WHEN row_number() OVER {q.wall()} > 1 AND lag(sg) OVER {q.wall()} IS NOT DISTINCT FROM sg THEN 0 ELSE 1 END AS chg FROM a)
       SELECT symbol, ts, CAST(sum(hit) OVER (PARTITION BY symbol, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS streak,
       CAST(sum(chg) OVER {q.wcum()} AS BIGINT) AS island FROM b""", "th hret", "@ts")
def _(t):
    d = t.hret.select("symbol", "ts", "ret", F.signum("ret").alias("sg"))
    d = win.with_streak(d, F.col("ret") > 0, "streak", R)
    return win.with_island(d, "sg", "island", R).select("symbol", "ts", "streak", "island")
