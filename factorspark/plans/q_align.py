"""Bars, as-of joins, alignment and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions import dates as dt
from factorspark.operators import asof as aj
from factorspark.operators import resample as rs
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import R
from factorspark.plans.registry import query
from factorspark.sources import bars as sb


@query("a01_bar_resample",
       """SELECT symbol, date_trunc('day', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
       sum(volume) AS volume FROM th GROUP BY 1, 2""", "th", "open high low close volume @ts")
def _(t):
    return rs.resample(t.th, "1 day")


@query("a02_trades_to_bars", "SELECT symbol, ts, open, high, low, close, volume, trades FROM ud", "ud", "open high low close volume @ts")
def _(t):
    return t.ud


_LQ = """SELECT symbol, date_trunc('hour', ts) AS ts, sum(CASE WHEN side = 'sell' THEN value_usd ELSE 0 END) AS liquidation_long,
    sum(CASE WHEN side = 'buy' THEN value_usd ELSE 0 END) AS liquidation_short, sum(value_usd) AS liquidation_total FROM liq GROUP BY 1, 2"""


@query("a03_liquidation_sums", _LQ, "liq", "liquidation_long liquidation_short liquidation_total @ts")
def _(t):
    return rs.liquidation_sums(t.liq, "1 hour")


@query("a04_bar_frequency",
       f"SELECT symbol, quantile_cont(gap, 0.5) AS freq_seconds FROM (SELECT symbol, epoch(ts) - epoch({q.lag('ts')}) AS gap FROM th) WHERE gap IS NOT NULL GROUP BY 1",
       "th", "freq_seconds")
def _(t):
    return rs.bar_frequency(t.th, R)


@query("p01_normalize_symbol",
       """SELECT c_custkey, upper(c_mktsegment) || '/USDT:USDT' AS perp, upper(c_mktsegment) || '/USDT' AS spot, upper(c_mktsegment) || 'USDT' AS flat FROM customer""")
def _(t):
    raw = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("usdt")))
           .when(F.col("c_custkey") % 3 == 1, F.concat("c_mktsegment", F.lit("/USDT"))).otherwise(F.concat("c_mktsegment", F.lit("/USDT:USDT"))))
    return t.customer.select("c_custkey", *[sb.normalize_symbol(raw, f).alias(f) for f in ("perp", "spot", "flat")])


@query("p02_bar_fields",
       f"""SELECT symbol, ts, (high + low + close) / 3 AS typical_price, close * volume AS dollar_volume,
       sum((high + low + close) / 3 * volume) OVER {q.wcum()} / sum(volume) OVER {q.wcum()} AS cum_vwap FROM th""", "th", "typical_price dollar_volume cum_vwap @ts")
def _(t):
    return sb.with_bar_fields(t.th).select("symbol", "ts", "typical_price", "dollar_volume", "cum_vwap")


@query("p03_ensure_vwap", "SELECT symbol, ts, coalesce(CASE WHEN close > 50 THEN close END, (high + low + close) / 3) AS vwap FROM th", "th", "vwap @ts")
def _(t):
    d = t.th.withColumn("vwap", F.when(F.col("close") > 50, F.col("close")))
    return sb.ensure_vwap(d).select("symbol", "ts", "vwap")


@query("p04_basic_features",
       f"""WITH r AS (SELECT *, close / {q.lag('close')} - 1 AS return_1 FROM th)
       SELECT symbol, ts, return_1, close / {q.lag('close', 7)} - 1 AS return_7, {q.std('return_1', 7)} AS vol_7, {q.std('return_1', 30)} AS vol_30,
       {q.mean('volume', 7)} AS volume_ma_7, {q.mean('volume', 30)} AS volume_ma_30, volume / ({q.mean('volume', 7)}) AS volume_ratio,
       {q.mean('close', 7)} AS ma_7, {q.mean('close', 30)} AS ma_30, CAST(({q.mean('close', 7)}) > ({q.mean('close', 30)}) AS INTEGER) AS ma_cross,
       (high - low) / close AS range, (close - open) / open AS body FROM r""", "th",
       "return_1 return_7 vol_7 vol_30 volume_ma_7 volume_ma_30 volume_ratio ma_7 ma_30 range body @ts")
def _(t):
    return sb.with_basic_features(t.th).drop("open", "high", "low", "close", "volume", "trades")


@query("p05_returns",
       f"""SELECT symbol, ts, close / {q.lag('close')} - 1 AS ret, lead(close, 1) OVER {q.wall()} / close - 1 AS fwd_1,
       lead(close, 5) OVER {q.wall()} / close - 1 AS fwd_5, lead(close, 10) OVER {q.wall()} / close - 1 AS fwd_10 FROM sm""", "sm", "ret fwd_1 fwd_5 fwd_10 @ts")
def _(t):
    return sb.with_returns(t.sm).select("symbol", "ts", "ret", "fwd_1", "fwd_5", "fwd_10")


@query("p06_funding_adjusted_return", f"SELECT symbol, ts, close / {q.lag('close')} - 1 - funding_rate AS adj_return FROM drv", "th drv", "adj_return @ts")
def _(t):
    return sb.funding_adjusted_return(sb.with_returns(t.drv, ())).select("symbol", "ts", "adj_return")


@query("j01_asof_backward",
       """SELECT b.symbol, b.ts, b.close, f.funding_rate, f.ts AS rate_ts FROM th b ASOF LEFT JOIN fund8 f ON b.symbol = f.symbol AND b.ts >= f.ts""",
       "th fund8", "close funding_rate @ts @rate_ts", 8)
def _(t):
    return aj.asof_join(t.th.select("symbol", "ts", "close"), t.fund8, right_ts="rate_ts")


@query("j01_asof_ticks",
       """SELECT e.event_id, e.event_type AS symbol, e.ts, f.funding_rate FROM events e ASOF LEFT JOIN fund8 f ON e.event_type = f.symbol AND e.ts >= f.ts""",
       "fund8", "funding_rate @ts", 8)
def _(t):
    """Raw ticks on the left: a hot symbol is split into minute chunks."""
    e = t.events.select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return aj.asof_join(e, t.fund8, chunk="minute")


@query("j02_asof_forward",
       """SELECT b.symbol, b.ts, b.close, f.funding_rate, f.ts AS rate_ts FROM th b ASOF LEFT JOIN fund8 f ON b.symbol = f.symbol AND b.ts <= f.ts""",
       "th fund8", "close funding_rate @ts @rate_ts", 8)
def _(t):
    return aj.asof_join(t.th.select("symbol", "ts", "close"), t.fund8, direction="forward", right_ts="rate_ts")


@query("j03_align_ffill",
       """SELECT b.symbol, b.ts, coalesce(o.open_interest, 0) AS open_interest FROM th b ASOF LEFT JOIN oi o ON b.symbol = o.symbol AND b.ts >= o.ts""",
       "th oi", "open_interest @ts")
def _(t):
    return aj.align_ffill(t.th.select("symbol", "ts"), t.oi, "open_interest")


@query("j04_align_interpolate",
       """WITH a AS (SELECT b.symbol, b.ts, f.funding_rate AS v0, f.ts AS t0 FROM th b ASOF LEFT JOIN fund8 f ON b.symbol = f.symbol AND b.ts >= f.ts),
       c AS (SELECT a.*, f.funding_rate AS v1, f.ts AS t1 FROM a ASOF LEFT JOIN fund8 f ON a.symbol = f.symbol AND a.ts <= f.ts)
       SELECT symbol, ts, CASE WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 WHEN t1 = t0 THEN v0
       ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END AS funding_rate FROM c""", "th fund8", "funding_rate @ts", 8)
def _(t):
    return aj.align_interpolate(t.th.select("symbol", "ts"), t.fund8, "funding_rate")


@query("j05_align_distribute",
       """SELECT b.symbol, b.ts, coalesce(f.funding_rate / 8, 0) AS funding_rate FROM th b ASOF LEFT JOIN fund8 f ON b.symbol = f.symbol AND b.ts >= f.ts""",
       "th fund8", "funding_rate @ts", 8)
def _(t):
    return aj.align_distribute(t.th.select("symbol", "ts"), t.fund8, "funding_rate")


@query("j06_merge_market",
       f"""WITH l AS ({_LQ}), a AS (SELECT b.symbol, b.ts, b.close, f.funding_rate FROM th b ASOF LEFT JOIN fund8 f ON b.symbol = f.symbol AND b.ts >= f.ts),
       o AS (SELECT a.*, x.open_interest FROM a ASOF LEFT JOIN oi x ON a.symbol = x.symbol AND a.ts >= x.ts),
       r AS (SELECT o.*, y.long_short_ratio FROM o ASOF LEFT JOIN ls y ON o.symbol = y.symbol AND o.ts >= y.ts)
       SELECT r.symbol, r.ts, close, coalesce(funding_rate, 0) AS funding_rate, coalesce(open_interest, 0) AS open_interest,
       coalesce(long_short_ratio, 0) AS long_short_ratio, coalesce(liquidation_long, 0) AS liquidation_long, coalesce(liquidation_short, 0) AS liquidation_short,
       coalesce(liquidation_total, 0) AS liquidation_total FROM r LEFT JOIN l ON r.symbol = l.symbol AND r.ts = l.ts""",
       "th fund8 oi ls liq", "close funding_rate open_interest long_short_ratio liquidation_long liquidation_short liquidation_total @ts")
def _(t):
    return aj.merge_market(t.th.select("symbol", "ts", "close"), t.fund8, t.oi, t.ls, rs.liquidation_sums(t.liq, "1 hour"))


@query("j07_inner_join", "SELECT a.symbol, a.ts, a.close, o.open_interest FROM th a JOIN oi o ON a.symbol = o.symbol AND a.ts = o.ts", "th oi", "close open_interest @ts")
def _(t):
    return t.th.select("symbol", "ts", "close").join(t.oi, ["symbol", "ts"])


@query("j08_outer_align",
       """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, coalesce(a.open_interest, 0) AS open_interest, coalesce(b.funding_rate, 0) AS funding_rate
       FROM oi a FULL JOIN fund8 b ON a.symbol = b.symbol AND a.ts = b.ts""", "oi fund8", "open_interest funding_rate @ts")
def _(t):
    return aj.outer_align(t.oi, t.fund8, ["symbol", "ts"])


@query("j09_anti_join", "SELECT symbol, ts, close FROM th WHERE NOT EXISTS (SELECT 1 FROM oi WHERE oi.symbol = 'click' AND oi.ts = th.ts)", "th oi", "close @ts")
def _(t):
    clicks = t.oi.filter(F.col("symbol") == "click")  # the hours without a click are missing
    return aj.missing_rows(t.th.select("symbol", "ts", "close"), clicks, ["ts"])


_UNI = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("j10_semi_join", f"SELECT symbol, ts, close FROM ud WHERE symbol IN ({_UNI})", "ud", "close @ts")
def _(t):
    u = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("symbol"))
    return aj.restrict(t.ud.select("symbol", "ts", "close"), u, ["symbol"])


@query("j11_dimension_lookup",
       """SELECT symbol, ts, close, CASE WHEN c_acctbal >= 7000 THEN 'large' WHEN c_acctbal >= 2000 THEN 'mid' ELSE 'small' END AS cap
       FROM ud JOIN customer ON symbol = c_custkey""", "ud", "close @ts")
def _(t):
    from factorspark.functions.math import cap_group
    dim = t.customer.select(F.col("c_custkey").alias("symbol"), cap_group(F.col("c_acctbal"), 7000, 2000).alias("cap"))
    return t.ud.select("symbol", "ts", "close").join(dim, "symbol")


_FUNDING_FEATS = f"""SELECT symbol, ts, {q.mean('funding_rate', 8)} AS funding_ma_8h, {q.mean('funding_rate', 24)} AS funding_ma_24h,
    funding_rate - {q.lag('funding_rate', 24)} AS funding_momentum, {q.zscore('funding_rate', 720)} AS funding_zscore,
    coalesce(abs({q.zscore('funding_rate', 720)}) > 2, false) AS funding_extreme, funding_rate * 1095 AS funding_annualized FROM drv"""


@query("w35_funding_features", _FUNDING_FEATS, "th drv", "funding_ma_8h funding_ma_24h funding_momentum funding_zscore funding_annualized @ts")
def _(t):
    from factorspark.operators.regimes import funding_features
    return funding_features(t.drv.select("symbol", "ts", "funding_rate"), 3600)


_HOLD = """hold AS (SELECT o_orderkey AS id, o_orderdate AS t0, o_orderdate + INTERVAL 30 HOUR AS t1 FROM orders)"""


@query("j14_settlements_in",
       f"""WITH {_HOLD} SELECT id, unnest(generate_series(t0 + INTERVAL 8 HOUR, t1, INTERVAL 8 HOUR)) AS settlement FROM hold""", "", "@settlement")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t0"), (F.col("o_orderdate") + F.expr("INTERVAL 30 HOURS")).alias("t1"))
    return d.select("id", F.explode(dt.settlements_between(F.col("t0"), F.col("t1"))).alias("settlement"))


@query("u05_table_function_expand", f"""WITH {_HOLD} SELECT id, CAST(len(generate_series(t0 + INTERVAL 8 HOUR, t1, INTERVAL 8 HOUR)) AS BIGINT) AS n FROM hold""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t0"), (F.col("o_orderdate") + F.expr("INTERVAL 30 HOURS")).alias("t1"))
    return d.select("id", F.explode(dt.settlements_between(F.col("t0"), F.col("t1"))).alias("s")).groupBy("id").agg(F.count("*").alias("n"))


@query("f_date_functions",
       """SELECT event_id, to_timestamp(floor(epoch(ts) / 28800) * 28800) AT TIME ZONE 'UTC' AS prev_s, to_timestamp((floor(epoch(ts) / 28800) + 1) * 28800) AT TIME ZONE 'UTC' AS next_s,
       hour(ts) IN (0, 8, 16) AS is_s, date_trunc('month', ts) AS month, date_trunc('quarter', ts) AS quarter, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow,
       CAST(day(ts) AS INTEGER) AS dom, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events""", "", "@prev_s @next_s @month @quarter")
def _(t):
    ts = F.col("ts")
    return t.events.select("event_id", dt.prev_settlement(ts).alias("prev_s"), dt.next_settlement(ts).alias("next_s"), dt.is_settlement_hour(ts).alias("is_s"),
                           dt.period(ts, "month").alias("month"), dt.period(ts, "quarter").alias("quarter"), F.dayofweek(ts).alias("dow"),
                           F.dayofmonth(ts).alias("dom"), dt.to_millis(ts).alias("ms"))


@query("a38_data_ranges", "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM th GROUP BY 1", "th", "@first_ts @last_ts")
def _(t):
    return t.th.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("a40_alignment_report",
       """SELECT symbol, count(*) AS n_rows, count(DISTINCT ts) AS n_times, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(DISTINCT ts) AS duplicates,
       CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 3600) + 1 AS BIGINT) AS expected,
       1 - count(DISTINCT ts) / (floor((epoch(max(ts)) - epoch(min(ts))) / 3600) + 1) AS gap_ratio FROM th GROUP BY 1""", "th", "gap_ratio @first_ts @last_ts")
def _(t):
    return aj.alignment_report(t.th, 3600)


_CAL = "cal AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM th GROUP BY symbol)"


@query("a40_missing_times", f"WITH {_CAL} SELECT symbol, ts FROM cal EXCEPT SELECT symbol, ts FROM th", "th", "@ts")
def _(t):
    return aj.missing_rows(aj.calendar(t.th, 3600), t.th, ["symbol", "ts"])


@query("a41_overlap_report",
       """SELECT coalesce(a.symbol, b.symbol) AS symbol, min(a.ts) AS factor_start, max(a.ts) AS factor_end, min(b.ts) AS target_start, max(b.ts) AS target_end,
       count(a.ts) AS factor_times, count(b.ts) AS target_times, count(*) FILTER (a.ts = b.ts) AS shared,
       count(*) FILTER (a.ts = b.ts) = count(a.ts) AND count(*) FILTER (a.ts = b.ts) = count(b.ts) AS identical
       FROM th a FULL JOIN oi b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY 1""", "th oi", "@factor_start @factor_end @target_start @target_end")
def _(t):
    return aj.overlap_report(t.th, t.oi)


@query("p11_fill_bars",
       f"""SELECT symbol, ts, coalesce(last_value(CASE WHEN close > 50 THEN close END IGNORE NULLS) OVER {q.wcum()}, 0) AS close FROM th""", "th", "close @ts")
def _(t):
    return sb.fill_bars(t.th.withColumn("close", F.when(F.col("close") > 50, F.col("close"))), ("close",)).select("symbol", "ts", "close")


@query("s18_select_panel",
       "SELECT symbol, ts, close, volume FROM th WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'", "th", "close volume @ts")
def _(t):
    return sb.select_panel(t.th, ["click", "view"], ["close", "volume"], "2024-01-05", "2024-01-20")
