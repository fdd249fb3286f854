"""Price and volume factors: bar shape, rolling families, lag grid, ratio set, built-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.factors.base import register_factor
from factorspark.functions.math import div, greater, less, log
from factorspark.operators import cross_section as cs
from factorspark.operators.windows import RN, Roll

c = F.col
OHLC = ("open", "high", "low", "close")
WINDOWS = (5, 10, 20, 30, 60)


def _add(name, category, build, inputs=("close",), needs=(), sets=()):
    register_factor(name, category, inputs, needs, sets)(build)


# --- bar shape
def _range():
    return c("high") - c("low") + 1e-12


_add("KMID", "kline", lambda r: div(c("close") - c("open"), c("open")), OHLC)
_add("KLEN", "kline", lambda r: div(c("high") - c("low"), c("open")), OHLC)
_add("KMID2", "kline", lambda r: (c("close") - c("open")) / _range(), OHLC)
_add("KUP", "kline", lambda r: div(c("high") - greater(c("open"), c("close")), c("open")), OHLC)
_add("KUP2", "kline", lambda r: (c("high") - greater(c("open"), c("close"))) / _range(), OHLC)
_add("KLOW", "kline", lambda r: div(less(c("open"), c("close")) - c("low"), c("open")), OHLC)
_add("KLOW2", "kline", lambda r: (less(c("open"), c("close")) - c("low")) / _range(), OHLC)
_add("KSFT", "kline", lambda r: div(c("close") * 2 - c("high") - c("low"), c("open")), OHLC)
_add("KSFT2", "kline", lambda r: (c("close") * 2 - c("high") - c("low")) / _range(), OHLC)

# --- price ratios
for _f in ("open", "high", "low", "vwap"):
    _add(f"{_f.upper()}0", "price_ratio", lambda r, f=_f: div(c(f), c("close")), (_f, "close"))


# --- rolling families, one factor per window length
def _family(stem, build, inputs=("close",), needs=()):
    for d in WINDOWS:
        _add(f"{stem}{d}", "rolling", lambda r, d=d: build(r, d), inputs, needs)


_HL = ("high", "low", "close")
_up_share = lambda r, d: r.mean(F.when(c("_c1").isNotNull(), (c("close") > c("_c1")).cast("double")), d)
_dn_share = lambda r, d: r.mean(F.when(c("_c1").isNotNull(), (c("close") < c("_c1")).cast("double")), d)


def _balance(r, d, up, down, sign):
    """Gains, losses or their difference over total movement."""
    total = r.sum(c(up) + c(down), d) + 1e-12
    top = {"p": r.sum(up, d), "n": r.sum(down, d), "d": r.sum(up, d) - r.sum(down, d)}[sign]
    return top / total


_family("ROC", lambda r, d: div(r.ref("close", d), c("close")))
_family("MA", lambda r, d: div(r.mean("close", d), c("close")))
_family("STD", lambda r, d: div(r.std("close", d), c("close")))
_family("BETA", lambda r, d: div(r.slope("close", d), c("close")), needs=(RN,))
_family("RSQR", lambda r, d: r.rsquare("close", d), needs=(RN,))
_family("RESI", lambda r, d: div(r.resi("close", d), c("close")), needs=(RN,))
_family("MAX", lambda r, d: div(r.max("high", d), c("close")), ("high", "close"))
_family("MIN", lambda r, d: div(r.min("low", d), c("close")), ("low", "close"))
_family("QTLU", lambda r, d: div(r.quantile("close", d, 0.8), c("close")))
_family("QTLD", lambda r, d: div(r.quantile("close", d, 0.2), c("close")))
_family("RANK", lambda r, d: r.ts_rank("close", d))
_family("RSV", lambda r, d: (c("close") - r.min("low", d)) / (r.max("high", d) - r.min("low", d) + 1e-12), _HL)
_family("IMAX", lambda r, d: r.idxmax("high", d) / d, ("high",), (RN,))
_family("IMIN", lambda r, d: r.idxmin("low", d) / d, ("low",), (RN,))
_family("IMXD", lambda r, d: (r.idxmax("high", d) - r.idxmin("low", d)) / d, ("high", "low"), (RN,))
_family("CORR", lambda r, d: r.corr("close", "_lv", d), ("close", "volume"), ("_lv",))
_family("CORD", lambda r, d: r.corr("_ratio", "_lvr", d), ("close", "volume"), ("_ratio", "_lvr"))
_family("CNTP", _up_share, needs=("_c1",))
_family("CNTN", _dn_share, needs=("_c1",))
_family("CNTD", lambda r, d: _up_share(r, d) - _dn_share(r, d), needs=("_c1",))
_family("SUMP", lambda r, d: _balance(r, d, "_up", "_down", "p"), needs=("_up", "_down"))
_family("SUMN", lambda r, d: _balance(r, d, "_up", "_down", "n"), needs=("_up", "_down"))
_family("SUMD", lambda r, d: _balance(r, d, "_up", "_down", "d"), needs=("_up", "_down"))
_family("VMA", lambda r, d: r.mean("volume", d) / (c("volume") + 1e-12), ("volume",))
_family("VSTD", lambda r, d: r.std("volume", d) / (c("volume") + 1e-12), ("volume",))
_family("WVMA", lambda r, d: r.std("_moved", d) / (r.mean("_moved", d) + 1e-12), ("close", "volume"), ("_moved",))
_family("VSUMP", lambda r, d: _balance(r, d, "_vup", "_vdown", "p"), ("volume",), ("_vup", "_vdown"))
_family("VSUMN", lambda r, d: _balance(r, d, "_vup", "_vdown", "n"), ("volume",), ("_vup", "_vdown"))
_family("VSUMD", lambda r, d: _balance(r, d, "_vup", "_vdown", "d"), ("volume",), ("_vup", "_vdown"))

# --- ratio set
for _d in WINDOWS:
    _add(f"CLOSE_ROC{_d}", "ratio", lambda r, d=_d: div(r.ref("close", d), c("close")) - 1)
    _add(f"CLOSE_MA{_d}_RATIO", "ratio", lambda r, d=_d: div(c("close"), r.mean("close", d)) - 1)
for _d in (5, 10, 20):
    _add(f"CLOSE_STD{_d}", "ratio", lambda r, d=_d: r.std("close", d) / (r.mean("close", d) + 1e-10))
    _add(f"VOLUME_ROC{_d}", "ratio", lambda r, d=_d: r.ref("volume", d) / (c("volume") + 1e-10) - 1, ("volume",))
    _add(f"VOLUME_MA{_d}_RATIO", "ratio", lambda r, d=_d: c("volume") / (r.mean("volume", d) + 1e-10) - 1, ("volume",))

# --- built-in named factors. The 20-day momentum looks back, never ahead.
_add("momentum_20d", "builtin", lambda r: div(c("close"), r.ref("close", 20)) - 1)
_add("momentum_5d", "builtin", lambda r: div(c("close"), r.ref("close", 5)) - 1)
_add("volatility_20d", "builtin", lambda r: r.std("close", 20))
_add("volatility_10d", "builtin", lambda r: r.std("close", 10))
_add("volume_ma_5", "builtin", lambda r: r.mean("volume", 5), ("volume",))
_add("volume_ma_20", "builtin", lambda r: r.mean("volume", 20), ("volume",))
_add("price_ma_20", "builtin", lambda r: r.mean("close", 20))
_add("price_ma_50", "builtin", lambda r: r.mean("close", 50))
_add("ema_12", "builtin", lambda r: r.ema("close", 12), needs=(RN,))
_add("ema_26", "builtin", lambda r: r.ema("close", 26), needs=(RN,))
_add("high_max_20", "builtin", lambda r: r.max("high", 20), ("high",))
_add("low_min_20", "builtin", lambda r: r.min("low", 20), ("low",))
_add("delta_close_5", "builtin", lambda r: r.delta("close", 5))
_add("wma_10", "builtin", lambda r: r.wma("close", 10), needs=(RN,))
_add("corr_close_volume", "builtin", lambda r: r.corr("close", "volume", 20), ("close", "volume"))


def lag_grid(df: DataFrame, depth: int = 60, keys=("symbol", "ts"), roll: Roll | None = None) -> DataFrame:
    """Five price fields and volume at lags 0 .. depth-1, over the current close or volume.

    One ordered window frame collects the lagged rows once; the 6 x depth columns index into it.
    """
    roll = roll or Roll(*keys)
    fields = ("close", "open", "high", "low", "vwap", "volume")
    d = df.withColumn("_past", F.collect_list(F.struct(*fields)).over(roll.frame(depth)))
    cols = []
    for f in fields:
        base = "(volume + 1e-12D)" if f == "volume" else "close"
        cols += [f"try_divide(get(_past, size(_past) - {i + 1}).{f}, {base}) AS {f.upper()}{i}" for i in range(depth)]
    return d.selectExpr(*keys, *cols)


def cross_sectional_set(df: DataFrame, keys=("symbol", "ts"), roll: Roll | None = None) -> DataFrame:
    """Six formulas that mix cross-sectional ranks with rolling operators.

    The five ranked inputs go through one ranking job in long form, then back to columns.
    """
    roll = roll or Roll(*keys)
    base = df.withColumns({
        "_dev": c("open") - roll.mean("open", 10), "_gap": c("close") - c("vwap"), "_low5": roll.ref("low", 5),
        "ALPHA002": -(log(c("close")) - log(roll.ref("close", 2))),
        "ALPHA006": -roll.corr("open", "volume", 10),
    })
    d = cs.cs_rank_many(base, [keys[1]], [keys[0]], ["close", "volume", "open", "_low5", "_dev", "_gap"])
    d = base.select(*keys, "ALPHA002", "ALPHA006").join(d, list(keys), "left")
    return d.select(
        *keys, (-roll.corr("r_close", "r_volume", 6)).alias("ALPHA001"), "ALPHA002",
        (-roll.corr("r_open", "r_volume", 10)).alias("ALPHA003"), (-c("r__low5")).alias("ALPHA004"),
        (c("r__dev") * -F.abs(c("r__gap"))).alias("ALPHA005"), "ALPHA006")
