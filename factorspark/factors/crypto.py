"""Perpetual-futures factors over bars with funding, open interest, premium and book columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.factors.base import register_factor

c = F.col


def _add(name, build, inputs, needs=()):
    register_factor(name, "crypto", inputs, needs)(build)


def _drop(r, x, n=1):
    """Earlier value over the current one, minus one."""
    return r.ref(x, n) / (c(x) + 1e-10) - 1


_add("CRYPTO_MOMENTUM", lambda r: r.pct_change("close", 24), ("close",))
_add("CRYPTO_VOLATILITY", lambda r: r.std("_back", 24), ("close",), ("_back",))
_add("VOLUME_SPIKE", lambda r: c("volume") / (r.mean("volume", 24) + 1e-10), ("volume",))
_add("PRICE_RANGE", lambda r: (c("high") - c("low")) / (c("close") + 1e-10), ("high", "low", "close"))
_add("CRYPTO_FUNDING_ZSCORE", lambda r: r.zscore("funding_rate", 24), ("funding_rate",))
_add("CRYPTO_FUNDING_MOMENTUM", lambda r: -r.delta("funding_rate", 8), ("funding_rate",))
_add("CRYPTO_PREMIUM_ZSCORE", lambda r: r.zscore("premium", 24), ("premium",))
_add("CRYPTO_OI_CHANGE_1", lambda r: _drop(r, "open_interest"), ("open_interest",))
_add("CRYPTO_OI_ZSCORE", lambda r: r.zscore("open_interest", 24), ("open_interest",))
_add("CRYPTO_OI_PRICE_DIVERGENCE", lambda r: _drop(r, "open_interest") - _drop(r, "close"), ("open_interest", "close"))
_add("CRYPTO_LIQUIDATION_SPIKE", lambda r: c("liquidation_volume") / (r.mean("liquidation_volume", 24) + 1e-10), ("liquidation_volume",))
_add("CRYPTO_BASIS_PCT", lambda r: (c("mark_price") - c("index_price")) / (c("index_price") + 1e-10), ("mark_price", "index_price"))
_add("CRYPTO_ORDERBOOK_IMBALANCE", lambda r: c("bid_ask_imbalance"), ("bid_ask_imbalance",))
_add("CRYPTO_SPREAD_NORM", lambda r: c("spread") / (c("close") + 1e-10), ("spread", "close"))
_add("CRYPTO_LONG_SHORT_SKEW", lambda r: c("long_ratio") - c("short_ratio"), ("long_ratio", "short_ratio"))
