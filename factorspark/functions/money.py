"""Margin, liquidation and profit arithmetic on decimals with directed rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highest leverage of a band and its maintenance rate.
MAINTENANCE_RATES = ((5, "0.01"), (10, "0.025"), (20, "0.04"), (50, "0.05"), (125, "0.06"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(28,12)")


def maintenance_rate(leverage: Column) -> Column:
    out = F.when(leverage <= 0, None)
    for top, rate in MAINTENANCE_RATES:
        out = out.when(leverage <= top, F.lit(rate).cast("decimal(6,4)"))
    return out


def notional(qty: Column, price: Column) -> Column:
    return qty.cast("decimal(18,6)") * price.cast("decimal(18,6)")


def initial_margin(qty: Column, price: Column, leverage: Column) -> Column:
    """Notional over leverage, rounded up to 1e-8."""
    return F.ceil(_wide(notional(qty, price)) / leverage.cast("decimal(3,0)"), F.lit(8))


def maintenance_margin(qty: Column, mark: Column, rate: Column) -> Column:
    """Notional times rate, rounded up to 1e-8."""
    return F.ceil(notional(qty, mark) * rate, F.lit(8))


def margin_ratio(maintenance: Column, balance: Column) -> Column:
    """Maintenance over balance rounded up to 1e-4; 1 when the balance is gone."""
    one = F.lit("1").cast("decimal(18,4)")
    return F.when(balance <= 0, one).otherwise(F.ceil(_wide(maintenance) / F.when(balance > 0, balance.cast("decimal(18,6)")), F.lit(4)).cast("decimal(18,4)"))


def margin_status(ratio: Column) -> Column:
    return (F.when(ratio >= 1, "liquidation").when(ratio >= 0.9, "critical").when(ratio >= 0.7, "danger")
            .when(ratio >= 0.5, "warning").otherwise("healthy"))


def liquidation_price(entry: Column, leverage: Column, rate: Column, side: Column) -> Column:
    """Long: entry * (1 - 1/L + m) rounded down to a cent; short: entry * (1 + 1/L - m) rounded up."""
    lev = leverage.cast("decimal(3,0)")
    one = F.lit(1).cast("decimal(1,0)")
    e = entry.cast("decimal(18,6)")
    long_f, short_f = lev * (one + rate) - one, lev * (one - rate) + one
    down = F.floor((e * long_f).cast("decimal(34,12)") / lev, F.lit(2))
    up = F.ceil((e * short_f).cast("decimal(34,12)") / lev, F.lit(2))
    return F.when(side == "long", down.cast("decimal(20,2)")).otherwise(up.cast("decimal(20,2)"))


def max_size(margin: Column, price: Column, leverage: Column) -> Column:
    """Largest position the margin allows, rounded down to 0.001."""
    return F.floor((margin.cast("decimal(18,6)") * leverage.cast("decimal(3,0)")).cast("decimal(28,12)") / price.cast("decimal(12,6)"), F.lit(3))


def unrealized_pnl(qty: Column, entry: Column, mark: Column, side: Column) -> Column:
    return F.when(side == "long", (mark - entry) * qty).otherwise((entry - mark) * qty)


def return_pct(entry: Column, mark: Column, side: Column) -> Column:
    r = F.try_divide(mark - entry, entry) * 100
    return F.when(side == "long", r).otherwise(-r)
