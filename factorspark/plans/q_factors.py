"""Factor-library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark import factors as fx
from factorspark.factors import indicators as ind
from factorspark.factors.base import FACTORS, SETS
from factorspark.factors.price import WINDOWS, cross_sectional_set, lag_grid
from factorspark.plans import sqltext as q
from factorspark.plans.registry import query
from factorspark.sources.bars import ensure_vwap

# Helper columns of the hourly series, in SQL.
H = f"""h0 AS (SELECT *, row_number() OVER {q.wall()} AS rn, {q.lag('close')} AS c1, {q.lag('volume')} AS v1, (high + low + close) / 3 AS vwap FROM th),
h AS (SELECT *, close / c1 AS ratio, ln(volume + 1) AS lv, ln(volume / v1 + 1) AS lvr, abs(close / c1 - 1) * volume AS moved, c1 / close - 1 AS back,
CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS up, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS down,
CASE WHEN v1 IS NOT NULL THEN greatest(volume - v1, 0) END AS vup, CASE WHEN v1 IS NOT NULL THEN greatest(v1 - volume, 0) END AS vdown,
CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, (high + low + close) / 3 AS tp FROM h0)"""


def _moving_corr(x, y, n):
    f = q.w(n)
    return (f"CASE WHEN count({x}) OVER {f} >= {n} AND count({y}) OVER {f} >= {n} AND var_pop({x}) OVER {f} > 1e-18 "
            f"AND var_pop({y}) OVER {f} > 1e-18 THEN corr({x}, {y}) OVER {f} END")


def _families(d):
    mean, std, roll = (lambda x: f"({q.mean(x, d)})"), (lambda x: f"({q.std(x, d)})"), (lambda a, *x: f"({q.roll(a, d, *x)})")
    up = f"({q.roll('avg(CASE WHEN c1 IS NOT NULL THEN CAST(close > c1 AS INTEGER) END)', d, 'c1')})"
    dn = f"({q.roll('avg(CASE WHEN c1 IS NOT NULL THEN CAST(close < c1 AS INTEGER) END)', d, 'c1')})"
    s = lambda x: f"({q.roll(f'sum({x})', d, x)})"
    hi, lo = roll("max(high)", "high"), roll("min(low)", "low")
    ix = f"({q.roll('arg_max(rn, (high, rn))', d, 'high')} - rn + {d})"
    iy = f"({q.roll('arg_min(rn, (low, -rn))', d, 'low')} - rn + {d})"
    tot, vtot = f"({q.roll('sum(up + down)', d, 'up')} + 1e-12)", f"({q.roll('sum(vup + vdown)', d, 'vup')} + 1e-12)"
    arr = f"list(close) OVER {q.w(d)}"
    return {
        "ROC": f"lag(close, {d}) OVER {q.wall()} / close", "MA": f"{mean('close')} / close", "STD": f"{std('close')} / close",
        "BETA": f"{roll('regr_slope(close, rn)', 'close')} / close",
        "RSQR": f"CASE WHEN count(close) OVER {q.w(d)} >= {d} AND var_pop(close) OVER {q.w(d)} > 1e-18 THEN regr_r2(close, rn) OVER {q.w(d)} END",
        "RESI": f"(close - ({roll('regr_slope(close, rn)', 'close')} * rn + {roll('regr_intercept(close, rn)', 'close')})) / close",
        "MAX": f"{hi} / close", "MIN": f"{lo} / close",
        "QTLU": f"{roll('quantile_cont(close, 0.8)', 'close')} / close", "QTLD": f"{roll('quantile_cont(close, 0.2)', 'close')} / close",
        "RANK": f"CASE WHEN count(close) OVER {q.w(d)} >= {d} THEN len(list_filter({arr}, lambda x: x <= close)) / {d}.0 END",
        "RSV": f"(close - {lo}) / ({hi} - {lo} + 1e-12)", "IMAX": f"{ix} / {d}.0", "IMIN": f"{iy} / {d}.0", "IMXD": f"({ix} - {iy}) / {d}.0",
        "CORR": _moving_corr("close", "lv", d), "CORD": _moving_corr("ratio", "lvr", d),
        "CNTP": up, "CNTN": dn, "CNTD": f"{up} - {dn}",
        "SUMP": f"{s('up')} / {tot}", "SUMN": f"{s('down')} / {tot}", "SUMD": f"({s('up')} - {s('down')}) / {tot}",
        "VMA": f"{mean('volume')} / (volume + 1e-12)", "VSTD": f"{std('volume')} / (volume + 1e-12)",
        "WVMA": f"{std('moved')} / ({mean('moved')} + 1e-12)",
        "VSUMP": f"{s('vup')} / {vtot}", "VSUMN": f"{s('vdown')} / {vtot}", "VSUMD": f"({s('vup')} - {s('vdown')}) / {vtot}",
    }


def _select(exprs: dict[str, str], frm: str = "h") -> str:
    return "SELECT symbol, ts, " + ",\n".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {frm}"


_KLINE = {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / (high - low + 1e-12)",
    "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
}


@query("l01_kline_shape", _select(_KLINE, "ud"), "ud", " ".join(_KLINE) + " @ts")
def _(t):
    return fx.compute_factors(t.ud, set_name="kline")


_RATIO0 = {f"{f.upper()}0": f"{f} / close" for f in ("open", "high", "low")} | {"VWAP0": "(high + low + close) / 3 / close"}


@query("l02_price_ratios", _select(_RATIO0, "ud"), "ud", " ".join(_RATIO0) + " @ts")
def _(t):
    return fx.compute_factors(ensure_vwap(t.ud), set_name="price_ratio")


_ALL = {f"{k}{d}": e for d in WINDOWS for k, e in _families(d).items()}
_GROUPS = {
    "l03_rolling_trend": ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN"),
    "l03_rolling_position": ("QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD"),
    "l03_rolling_balance": ("CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD"),
    "l03_rolling_volume": ("VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD"),
}


def _register_families():
    for name, stems in _GROUPS.items():
        cols = [f"{s}{d}" for s in stems for d in WINDOWS]

        @query(name, f"WITH {H} " + _select({c: _ALL[c] for c in cols}), "th", " ".join(cols) + " @ts")
        def _(t, cols=cols):
            return fx.compute_factors(t.th, cols)


_register_families()

_GRID = {f"{f.upper()}{i}": f"lag({f}, {i}) OVER {q.wall()} / " + ("(volume + 1e-12)" if f == "volume" else "close")
         for f in ("close", "open", "high", "low", "vwap", "volume") for i in range(60)}


@query("l04_lag_grid", f"WITH {H} " + _select(_GRID), "th", " ".join(_GRID) + " @ts")
def _(t):
    return lag_grid(ensure_vwap(t.th))


def _pct(x):
    return f"CASE WHEN {x} IS NOT NULL THEN {q.avg_rank(x, f'ts, ({x} IS NULL)')} / count({x}) OVER (PARTITION BY ts) END"


@query("l05_cross_sectional_formulas",
       f"""WITH b AS (SELECT *, open - ({q.mean('open', 10)}) AS dev, close - (high + low + close) / 3 AS gap, {q.lag('low', 5)} AS low5 FROM ud),
       r AS (SELECT *, {_pct('close')} AS rc, {_pct('volume')} AS rv, {_pct('open')} AS ro, {_pct('low5')} AS rl, {_pct('dev')} AS rd, {_pct('gap')} AS rg FROM b)
       SELECT symbol, ts, -({_moving_corr('rc', 'rv', 6)}) AS ALPHA001, -(ln(close) - ln({q.lag('close', 2)})) AS ALPHA002,
       -({_moving_corr('ro', 'rv', 10)}) AS ALPHA003, -rl AS ALPHA004, rd * -abs(rg) AS ALPHA005, -({_moving_corr('open', 'volume', 10)}) AS ALPHA006 FROM r""",
       "ud", "ALPHA001 ALPHA002 ALPHA003 ALPHA004 ALPHA005 ALPHA006 @ts")
def _(t):
    return cross_sectional_set(ensure_vwap(t.ud))


_RATIO = {}
for _d in WINDOWS:
    _RATIO[f"CLOSE_ROC{_d}"] = f"lag(close, {_d}) OVER {q.wall()} / close - 1"
    _RATIO[f"CLOSE_MA{_d}_RATIO"] = f"close / ({q.mean('close', _d)}) - 1"
for _d in (5, 10, 20):
    _RATIO[f"CLOSE_STD{_d}"] = f"({q.std('close', _d)}) / (({q.mean('close', _d)}) + 1e-10)"
    _RATIO[f"VOLUME_ROC{_d}"] = f"lag(volume, {_d}) OVER {q.wall()} / (volume + 1e-10) - 1"
    _RATIO[f"VOLUME_MA{_d}_RATIO"] = f"volume / (({q.mean('volume', _d)}) + 1e-10) - 1"


@query("l06_ratio_set", _select(_RATIO, "th"), "th", " ".join(_RATIO) + " @ts")
def _(t):
    return fx.compute_factors(t.th, set_name="ratio")


_RSI = lambda n: f"100 - 100 / (1 + ({q.mean('up', n)}) / (({q.mean('down', n)}) + 1e-10))"
_MACD = f"m AS (SELECT *, {q.ema('close', 12)} - {q.ema('close', 26)} AS macd FROM h)"
_IND = {
    "RSI_14": _RSI(14), "MACD": "macd", "MACD_SIGNAL": q.ema("macd", 9),
    "BOLLINGER_UPPER": f"({q.mean('close', 20)}) + 2 * ({q.std('close', 20)})", "BOLLINGER_LOWER": f"({q.mean('close', 20)}) - 2 * ({q.std('close', 20)})",
    "ATR_14": q.mean("tr", 14), "MACD_HIST": f"macd - {q.ema('macd', 9)}", "VOLATILITY_20": q.std("back", 20),
    "MOMENTUM_10": f"close / {q.lag('close', 10)} - 1", "VOLUME_MA_20": q.mean("volume", 20), "VOLUME_RATIO": f"volume / (({q.mean('volume', 20)}) + 1e-10)",
}


@query("l07_indicators", f"WITH {H}, {_MACD} " + _select(_IND, "m"), "th", " ".join(_IND) + " @ts")
def _(t):
    return fx.compute_factors(t.th, set_name="indicator")


_HH, _LL = q.roll("max(high)", 14, "high"), q.roll("min(low)", 14, "low")
_CAT = {
    "RSI": _RSI(7), "MACD": f"{q.ema('close', 12)} - {q.ema('close', 26)}", "MOMENTUM": f"close - {q.lag('close', 10)}",
    "ROC": f"(close / {q.lag('close', 10)} - 1) * 100", "SMA": q.mean("close", 20), "EMA": q.ema("close", 20),
    "BOLLINGER_UPPER": f"({q.mean('close', 20)}) + 2 * ({q.std('close', 20)})", "BOLLINGER_LOWER": f"({q.mean('close', 20)}) - 2 * ({q.std('close', 20)})",
    "ATR": q.mean("tr", 14), "STOCHASTIC_K": f"(close - ({_LL})) / NULLIF(({_HH}) - ({_LL}), 0) * 100",
    "WILLIAMS_R": f"(({_HH}) - close) / NULLIF(({_HH}) - ({_LL}), 0) * -100",
    "CCI": f"""CASE WHEN count(tp) OVER {q.w(20)} >= 20 THEN (tp - avg(tp) OVER {q.w(20)}) / NULLIF(0.015 * list_avg(list_transform(list(tp) OVER {q.w(20)},
        lambda x: abs(x - avg(tp) OVER {q.w(20)}))), 0) END""",
    "VOLUME_RATIO": f"volume / ({q.mean('volume', 20)})", "DONCHIAN_UPPER": q.roll("max(high)", 20, "high"), "DONCHIAN_LOWER": q.roll("min(low)", 20, "low"),
}
_CAT["CCI"] = f"cci"
_CCI = f"""cc AS (SELECT *, CASE WHEN len(a) >= 20 THEN (tp - list_avg(a)) / NULLIF(0.015 * list_avg(list_transform(a, lambda x: abs(x - list_avg(a)))), 0) END AS cci
FROM (SELECT *, list(tp) OVER {q.w(20)} AS a FROM h))"""


@query("l08_indicator_catalogue", f"WITH {H}, {_CCI} " + _select(_CAT, "cc"), "th", " ".join(_CAT) + " @ts")
def _(t):
    return ind.indicators(t.th, {k: ({"period": 7} if k == "RSI" else {}) for k in ind.CATALOGUE})


def _drop(x, n=1):
    return f"(lag({x}, {n}) OVER {q.wall()} / ({x} + 1e-10) - 1)"


_CRYPTO = {
    "CRYPTO_MOMENTUM": f"close / {q.lag('close', 24)} - 1", "CRYPTO_VOLATILITY": q.std("back", 24),
    "VOLUME_SPIKE": f"volume / (({q.mean('volume', 24)}) + 1e-10)", "PRICE_RANGE": "(high - low) / (close + 1e-10)",
    "CRYPTO_FUNDING_ZSCORE": q.zscore("funding_rate", 24), "CRYPTO_FUNDING_MOMENTUM": f"{q.lag('funding_rate', 8)} - funding_rate",
    "CRYPTO_PREMIUM_ZSCORE": q.zscore("premium", 24), "CRYPTO_OI_CHANGE_1": _drop("open_interest"), "CRYPTO_OI_ZSCORE": q.zscore("open_interest", 24),
    "CRYPTO_OI_PRICE_DIVERGENCE": f"{_drop('open_interest')} - {_drop('close')}",
    "CRYPTO_LIQUIDATION_SPIKE": f"liquidation_volume / (({q.mean('liquidation_volume', 24)}) + 1e-10)",
    "CRYPTO_BASIS_PCT": "(mark_price - index_price) / (index_price + 1e-10)", "CRYPTO_ORDERBOOK_IMBALANCE": "bid_ask_imbalance",
    "CRYPTO_SPREAD_NORM": "spread / (close + 1e-10)", "CRYPTO_LONG_SHORT_SKEW": "long_ratio - short_ratio",
}
_D = f"""d0 AS (SELECT *, row_number() OVER {q.wall()} AS rn, {q.lag('close')} AS c1, {q.lag('close')} / close - 1 AS back,
open_interest / {q.lag('open_interest')} - 1 AS oi1, liquidation_long + liquidation_short AS liq, (buy_volume - sell_volume) / (buy_volume + sell_volume + 1e-10) AS net,
CASE WHEN funding_rate > 0 THEN 1 ELSE 0 END AS fpos FROM drv),
d AS (SELECT *, sum(1 - fpos) OVER {q.wcum()} AS frun FROM d0)"""


@query("l09_crypto_set", f"WITH {_D} " + _select(_CRYPTO, "d"), "th drv", " ".join(_CRYPTO) + " @ts")
def _(t):
    return fx.compute_factors(t.drv, set_name="crypto")


def _chg(x, n):
    return f"({x} / lag({x}, {n}) OVER {q.wall()} - 1)"


def _clip(e, lo, hi):
    return f"CASE WHEN ({e}) IS NOT NULL THEN greatest({lo}, least({hi}, {e})) END"


_fz, _oz, _lz = q.zscore("funding_rate", 30), q.zscore("open_interest", 30), q.zscore("long_short_ratio", 30)
_DERIV = {
    "funding": {
        "FUNDING_RATE": "funding_rate", "FUNDING_RATE_MA8": q.mean("funding_rate", 8), "FUNDING_RATE_ZSCORE": _fz,
        "FUNDING_CUMSUM_8H": q.roll("sum(funding_rate)", 8, "funding_rate"), "FUNDING_CUMSUM_24H": q.roll("sum(funding_rate)", 24, "funding_rate"),
        "FUNDING_MOMENTUM": f"funding_rate - ({q.mean('funding_rate', 8)})", "FUNDING_REVERSAL": f"-({_clip(_fz, -3, 3)}) / 3",
        "FUNDING_EXTREME": f"CASE WHEN abs({_fz}) > 2 THEN 1.0 ELSE 0.0 END",
        "FUNDING_POSITIVE_STREAK": "sum(fpos) OVER (PARTITION BY symbol, frun ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 10.0",
        "FUNDING_APR": "funding_rate * 3 * 365",
    },
    "open_interest": {
        "OI_RAW": f"open_interest / (({q.mean('open_interest', 20)}) + 1e-10) - 1", "OI_CHANGE_1H": _chg("open_interest", 1),
        "OI_CHANGE_4H": _chg("open_interest", 4), "OI_CHANGE_24H": _chg("open_interest", 24), "OI_ZSCORE": _oz,
        "OI_PRICE_DIVERGENCE": f"{_chg('open_interest', 4)} * {_chg('close', 4)} * 100", "OI_ACCELERATION": f"oi1 - {q.lag('oi1')}",
        "OI_VALUE_RATIO": "open_interest_value / (open_interest + 1e-10)", "OI_VOLUME_RATIO": "open_interest / (volume + 1e-10)",
    },
    "long_short": {
        "LS_RATIO": "long_short_ratio", "LS_RATIO_ZSCORE": _lz, "LS_CONTRARIAN": f"-({_clip(_lz, -2, 2)}) / 2", "LS_MOMENTUM": _chg("long_short_ratio", 4),
        "LS_LONG_PCT": "long_ratio", "LS_SHORT_PCT": "short_ratio", "LS_IMBALANCE": "long_ratio - short_ratio",
    },
    "liquidation": {
        "LIQ_LONG_VOLUME": f"liquidation_long / (({q.mean('liquidation_long', 24)}) + 1e-10) - 1",
        "LIQ_SHORT_VOLUME": f"liquidation_short / (({q.mean('liquidation_short', 24)}) + 1e-10) - 1",
        "LIQ_RATIO": "liquidation_long / (liquidation_short + 1e-10)", "LIQ_TOTAL_ZSCORE": q.zscore("liq", 24),
        "LIQ_CASCADE_SIGNAL": f"CASE WHEN ({q.zscore('liq', 24)}) > 2 THEN 1.0 ELSE 0.0 END * (liquidation_long - liquidation_short) / (liq + 1e-10)",
    },
    "basis": {
        "BASIS": "basis", "BASIS_RATE": "basis_rate", "BASIS_ZSCORE": q.zscore("basis_rate", 30), "BASIS_MOMENTUM": f"basis_rate - {q.lag('basis_rate', 4)}",
        "BASIS_CONTANGO": "sign(basis_rate)",
    },
    "taker": {
        "TAKER_BUY_RATIO": "buy_sell_ratio", "TAKER_NET_FLOW": "net", "TAKER_NET_FLOW_MA": q.mean("net", 4),
        "TAKER_MOMENTUM": f"buy_sell_ratio - {q.lag('buy_sell_ratio', 4)}", "TAKER_PRESSURE": q.roll("sum(net)", 12, "net"),
    },
    "composite": {
        "CRYPTO_SENTIMENT": f"(-({q.mean('funding_rate', 8)}) * 100 - (long_short_ratio - 1) + (buy_sell_ratio - 0.5)) / 3",
        "LEVERAGE_PRESSURE": f"({_oz}) * ({_fz})", "SMART_MONEY_FLOW": "(buy_sell_ratio - 0.5) * (1 + oi1 * 10)",
        "LIQUIDATION_RISK": f"abs({_oz}) * abs(long_short_ratio - 1)",
    },
}


def _register_derivatives():
    for i, (name, exprs) in enumerate(_DERIV.items()):
        @query(f"l{10 + i}_{name}_factors", f"WITH {_D} " + _select(exprs, "d"), "th drv", " ".join(exprs) + " @ts")
        def _(t, name=name):
            d = fx.compute_factors(t.drv, set_name=name)
            if name == "liquidation":  # unbounded when one side is zero: compared on a log scale
                d = d.withColumn("LIQ_RATIO", F.ln(F.col("LIQ_RATIO") + 1))
            return d


_DERIV["liquidation"]["LIQ_RATIO"] = "ln(liquidation_long / (liquidation_short + 1e-10) + 1)"
_register_derivatives()

_BUILTIN = {
    "momentum_20d": f"close / {q.lag('close', 20)} - 1", "momentum_5d": f"close / {q.lag('close', 5)} - 1", "volatility_20d": q.std("close", 20),
    "volatility_10d": q.std("close", 10), "volume_ma_5": q.mean("volume", 5), "volume_ma_20": q.mean("volume", 20), "price_ma_20": q.mean("close", 20),
    "price_ma_50": q.mean("close", 50), "ema_12": q.ema("close", 12), "ema_26": q.ema("close", 26), "high_max_20": q.roll("max(high)", 20, "high"),
    "low_min_20": q.roll("min(low)", 20, "low"), "delta_close_5": f"close - {q.lag('close', 5)}",
    "wma_10": f"CASE WHEN count(close) OVER {q.w(10)} >= 10 THEN (sum(close * rn) OVER {q.w(10)} - (rn - 10) * sum(close) OVER {q.w(10)}) / 55.0 END",
    "corr_close_volume": _moving_corr("close", "volume", 20), "rsi_14": _RSI(14), "rsi_7": _RSI(7), "macd_histogram": f"macd - {q.ema('macd', 9)}",
    "rank_close": f"{q.avg_rank('close', 'ts')} / count(*) OVER (PARTITION BY ts)",
}


@query("l17_builtin_factors", f"WITH {H}, {_MACD} " + _select(_BUILTIN, "m"), "th", " ".join(_BUILTIN) + " @ts")
def _(t):
    from factorspark.operators.cross_section import cs_rank
    d = fx.compute_factors(t.th, set_name="builtin", keep=("close",))
    return cs_rank(d, ["ts"], "close", "rank_close").drop("close")


_PICK = ("KMID", "ROC5", "RSI_14", "CRYPTO_MOMENTUM", "VOLUME_SPIKE")
_PICK_SQL = {"KMID": _KLINE["KMID"], "ROC5": _ALL["ROC5"], "RSI_14": _IND["RSI_14"], "CRYPTO_MOMENTUM": _CRYPTO["CRYPTO_MOMENTUM"], "VOLUME_SPIKE": _CRYPTO["VOLUME_SPIKE"]}


@query("l18_batch_by_name", f"WITH {H} " + _select(_PICK_SQL), "th", " ".join(_PICK) + " @ts")
def _(t):
    # NO_SUCH is unknown and BASIS lacks its input column: both are skipped
    return fx.compute_factors(t.th, [*_PICK, "NO_SUCH", "BASIS"])


@query("l19_library_counts",
       f"""SELECT name, count(value) AS n_values FROM (UNPIVOT (WITH {{0}} {{1}}) ON {", ".join(_KLINE)} INTO NAME name VALUE value) GROUP BY 1"""
       .format("th2 AS (SELECT * FROM th)", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _KLINE.items()) + " FROM th2"), "th")
def _(t):
    """Listing of one category with the number of values each factor has on the data."""
    names = SETS["kline"]
    d = fx.compute_factors(t.th, names)
    return d.unpivot(["symbol", "ts"], names, "name", "value").groupBy("name").agg(F.count("value").alias("n_values"))
