"""Technical indicators, fixed and with keyword parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.factors.base import HELPER_DEPS, HELPERS, register_factor
from factorspark.functions.math import div
from factorspark.operators.windows import RN, Roll

c = F.col
HLC = ("high", "low", "close")


def rsi(r: Roll, period: int = 14) -> Column:
    """Relative strength from simple means of gains and losses."""
    return 100 - 100 / (1 + r.mean("_up", period) / (r.mean("_down", period) + 1e-10))


def macd(r: Roll, fast: int = 12, slow: int = 26) -> Column:
    return r.ema("close", fast) - r.ema("close", slow)


def momentum(r: Roll, period: int = 10) -> Column:
    return r.delta("close", period)


def roc(r: Roll, period: int = 10) -> Column:
    return r.pct_change("close", period) * 100


def sma(r: Roll, period: int = 20) -> Column:
    return r.mean("close", period)


def ema(r: Roll, period: int = 20) -> Column:
    return r.ema("close", period)


def bollinger(r: Roll, period: int = 20, mult: float = 2.0, upper: bool = True) -> Column:
    band = r.std("close", period) * mult
    return r.mean("close", period) + band if upper else r.mean("close", period) - band


def atr(r: Roll, period: int = 14) -> Column:
    """Mean of the largest of the three true-range candidates."""
    return r.mean("_tr", period)


def stochastic_k(r: Roll, period: int = 14) -> Column:
    return div(c("close") - r.min("low", period), r.max("high", period) - r.min("low", period)) * 100


def williams_r(r: Roll, period: int = 14) -> Column:
    return div(r.max("high", period) - c("close"), r.max("high", period) - r.min("low", period)) * -100


def cci(r: Roll, period: int = 20) -> Column:
    """Deviation of the typical price from its mean, over its mean absolute deviation."""
    return div(c("_tp") - r.mean("_tp", period), r.mad("_tp", period) * 0.015)


def volume_ratio(r: Roll, period: int = 20) -> Column:
    return div(c("volume"), r.mean("volume", period))


def donchian(r: Roll, period: int = 20, upper: bool = True) -> Column:
    return r.max("high", period) if upper else r.min("low", period)


# name -> (builder, keyword defaults, helper columns, other names it answers to)
CATALOGUE = {
    "RSI": (rsi, {"period": 14}, ("_up", "_down"), ("relative strength index",)),
    "MACD": (macd, {"fast": 12, "slow": 26}, (RN,), ()),
    "MOMENTUM": (momentum, {"period": 10}, (), ("mom",)),
    "ROC": (roc, {"period": 10}, (), ("rate of change",)),
    "SMA": (sma, {"period": 20}, (), ("ma",)),
    "EMA": (ema, {"period": 20}, (RN,), ()),
    "BOLLINGER_UPPER": (bollinger, {"period": 20, "mult": 2.0, "upper": True}, (), ("bollinger upper",)),
    "BOLLINGER_LOWER": (bollinger, {"period": 20, "mult": 2.0, "upper": False}, (), ("bollinger lower",)),
    "ATR": (atr, {"period": 14}, ("_c1", "_tr"), ("average true range",)),
    "STOCHASTIC_K": (stochastic_k, {"period": 14}, (), ("stochastic k", "stoch k")),
    "WILLIAMS_R": (williams_r, {"period": 14}, (), ("wr", "williams", "williams %r")),
    "CCI": (cci, {"period": 20}, ("_tp",), ("commodity channel index",)),
    "VOLUME_RATIO": (volume_ratio, {"period": 20}, (), ("volume ratio",)),
    "DONCHIAN_UPPER": (donchian, {"period": 20, "upper": True}, (), ("donchian upper",)),
    "DONCHIAN_LOWER": (donchian, {"period": 20, "upper": False}, (), ("donchian lower",)),
}


def resolve(name: str) -> str:
    """Catalogue name of an indicator given by name or alias, any case."""
    low = name.lower().strip()
    for key, (_, _, _, aliases) in CATALOGUE.items():
        if low == key.lower() or low in aliases:
            return key
    raise KeyError(name)


def indicators(df: DataFrame, wanted: dict[str, dict] | None = None, keys=("symbol", "ts")) -> DataFrame:
    """Compute indicators by name or alias with keyword overrides: ``{"rsi": {"period": 7}}``."""
    r = Roll(*keys)
    wanted = wanted if wanted is not None else {k: {} for k in CATALOGUE}
    helpers: list[str] = []
    out = []
    for name, params in wanted.items():
        fn, defaults, needs, _ = CATALOGUE[resolve(name)]
        for h in [d for n in needs for d in (*HELPER_DEPS.get(n, ()), n)]:
            if h not in helpers:
                helpers.append(h)
        out.append((name, fn, {**defaults, **params}))
    for h in helpers:
        df = df.withColumn(h, HELPERS[h](r))
    return df.select(*keys, *[fn(r, **kw).alias(name) for name, fn, kw in out])


def _add(name, category, build, inputs=("close",), needs=()):
    register_factor(name, category, inputs, needs)(build)


_add("RSI_14", "indicator", lambda r: rsi(r, 14), needs=("_up", "_down"))
_add("MACD", "indicator", lambda r: c("_macd"), needs=("_macd",))
_add("MACD_SIGNAL", "indicator", lambda r: r.ema("_macd", 9), needs=("_macd",))
_add("BOLLINGER_UPPER", "indicator", lambda r: bollinger(r))
_add("BOLLINGER_LOWER", "indicator", lambda r: bollinger(r, upper=False))
_add("ATR_14", "indicator", lambda r: atr(r, 14), HLC, ("_tr",))
_add("MACD_HIST", "indicator", lambda r: c("_macd") - r.ema("_macd", 9), needs=("_macd",))
_add("VOLATILITY_20", "indicator", lambda r: r.std("_back", 20), needs=("_back",))
_add("MOMENTUM_10", "indicator", lambda r: r.pct_change("close", 10))
_add("VOLUME_MA_20", "indicator", lambda r: r.mean("volume", 20), ("volume",))
_add("VOLUME_RATIO", "indicator", lambda r: c("volume") / (r.mean("volume", 20) + 1e-10), ("volume",))
_add("rsi_14", "builtin", lambda r: rsi(r, 14), needs=("_up", "_down"))
_add("rsi_7", "builtin", lambda r: rsi(r, 7), needs=("_up", "_down"))
_add("macd_histogram", "builtin", lambda r: c("_macd") - r.ema("_macd", 9), needs=("_macd",))
