"""Derivative-market factors: funding, open interest, long/short, liquidation, basis, taker flow, composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.factors.base import register_factor
from factorspark.functions.math import clip

c = F.col
FR, OI, LS = ("funding_rate",), ("open_interest",), ("long_short_ratio",)
LIQ = ("liquidation_long", "liquidation_short")
BR, TK, BS = ("basis_rate",), ("buy_volume", "sell_volume"), ("buy_sell_ratio",)


def _set(category):
    def add(name, build, inputs, needs=()):
        register_factor(name, category, inputs, needs)(build)
    return add


def _streak(r):
    run = Window.partitionBy(*r.by, "_frun").orderBy(*r.order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("_fpos").over(run) / 10


def _excess(r, x, n):
    """Relative distance to the rolling mean."""
    return c(x) / (r.mean(x, n) + 1e-10) - 1


_add = _set("funding")
_add("FUNDING_RATE", lambda r: c("funding_rate"), FR)
_add("FUNDING_RATE_MA8", lambda r: r.mean("funding_rate", 8), FR)
_add("FUNDING_RATE_ZSCORE", lambda r: r.zscore("funding_rate", 30), FR)
_add("FUNDING_CUMSUM_8H", lambda r: r.sum("funding_rate", 8), FR)
_add("FUNDING_CUMSUM_24H", lambda r: r.sum("funding_rate", 24), FR)
_add("FUNDING_MOMENTUM", lambda r: c("funding_rate") - r.mean("funding_rate", 8), FR)
_add("FUNDING_REVERSAL", lambda r: -clip(r.zscore("funding_rate", 30), -3.0, 3.0) / 3, FR)
_add("FUNDING_EXTREME", lambda r: F.coalesce(F.abs(r.zscore("funding_rate", 30)) > 2, F.lit(False)).cast("double"), FR)
_add("FUNDING_POSITIVE_STREAK", _streak, FR, ("_fpos", "_frun"))
_add("FUNDING_APR", lambda r: c("funding_rate") * 3 * 365, FR)

_add = _set("open_interest")
_add("OI_RAW", lambda r: _excess(r, "open_interest", 20), OI)
_add("OI_CHANGE_1H", lambda r: r.pct_change("open_interest", 1), OI)
_add("OI_CHANGE_4H", lambda r: r.pct_change("open_interest", 4), OI)
_add("OI_CHANGE_24H", lambda r: r.pct_change("open_interest", 24), OI)
_add("OI_ZSCORE", lambda r: r.zscore("open_interest", 30), OI)
_add("OI_PRICE_DIVERGENCE", lambda r: r.pct_change("open_interest", 4) * r.pct_change("close", 4) * 100, (*OI, "close"))
_add("OI_ACCELERATION", lambda r: c("_oi1") - r.ref("_oi1", 1), OI, ("_oi1",))
_add("OI_VALUE_RATIO", lambda r: c("open_interest_value") / (c("open_interest") + 1e-10), (*OI, "open_interest_value"))
_add("OI_VOLUME_RATIO", lambda r: c("open_interest") / (c("volume") + 1e-10), (*OI, "volume"))

_add = _set("long_short")
_add("LS_RATIO", lambda r: c("long_short_ratio"), LS)
_add("LS_RATIO_ZSCORE", lambda r: r.zscore("long_short_ratio", 30), LS)
_add("LS_CONTRARIAN", lambda r: -clip(r.zscore("long_short_ratio", 30), -2.0, 2.0) / 2, LS)
_add("LS_MOMENTUM", lambda r: r.pct_change("long_short_ratio", 4), LS)
_add("LS_LONG_PCT", lambda r: c("long_ratio"), ("long_ratio",))
_add("LS_SHORT_PCT", lambda r: c("short_ratio"), ("short_ratio",))
_add("LS_IMBALANCE", lambda r: c("long_ratio") - c("short_ratio"), ("long_ratio", "short_ratio"))

_add = _set("liquidation")
_add("LIQ_LONG_VOLUME", lambda r: _excess(r, "liquidation_long", 24), LIQ)
_add("LIQ_SHORT_VOLUME", lambda r: _excess(r, "liquidation_short", 24), LIQ)
_add("LIQ_RATIO", lambda r: c("liquidation_long") / (c("liquidation_short") + 1e-10), LIQ)
_add("LIQ_TOTAL_ZSCORE", lambda r: r.zscore("_liq", 24), LIQ, ("_liq",))
_add("LIQ_CASCADE_SIGNAL", lambda r: F.coalesce(r.zscore("_liq", 24) > 2, F.lit(False)).cast("double")
     * (c("liquidation_long") - c("liquidation_short")) / (c("_liq") + 1e-10), LIQ, ("_liq",))

_add = _set("basis")
_add("BASIS", lambda r: c("basis"), ("basis",))
_add("BASIS_RATE", lambda r: c("basis_rate"), BR)
_add("BASIS_ZSCORE", lambda r: r.zscore("basis_rate", 30), BR)
_add("BASIS_MOMENTUM", lambda r: r.delta("basis_rate", 4), BR)
_add("BASIS_CONTANGO", lambda r: F.signum("basis_rate"), BR)

_add = _set("taker")
_add("TAKER_BUY_RATIO", lambda r: c("buy_sell_ratio"), BS)
_add("TAKER_NET_FLOW", lambda r: c("_net"), TK, ("_net",))
_add("TAKER_NET_FLOW_MA", lambda r: r.mean("_net", 4), TK, ("_net",))
_add("TAKER_MOMENTUM", lambda r: r.delta("buy_sell_ratio", 4), BS)
_add("TAKER_PRESSURE", lambda r: r.sum("_net", 12), TK, ("_net",))

_add = _set("composite")
_add("CRYPTO_SENTIMENT", lambda r: (-r.mean("funding_rate", 8) * 100 - (c("long_short_ratio") - 1) + (c("buy_sell_ratio") - 0.5)) / 3,
     (*FR, *LS, *BS))
_add("LEVERAGE_PRESSURE", lambda r: r.zscore("open_interest", 30) * r.zscore("funding_rate", 30), (*OI, *FR))
_add("SMART_MONEY_FLOW", lambda r: (c("buy_sell_ratio") - 0.5) * (1 + c("_oi1") * 10), (*BS, *OI), ("_oi1",))
_add("LIQUIDATION_RISK", lambda r: F.abs(r.zscore("open_interest", 30)) * F.abs(c("long_short_ratio") - 1), (*OI, *LS))
