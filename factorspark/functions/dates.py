"""Settlement times, periods and timeframes (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per timeframe name.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "8h": 28800, "1d": 86400}
SETTLEMENT_SECONDS = 8 * 3600


def timeframe_seconds(c: Column) -> Column:
    out = None
    for name, sec in TIMEFRAMES.items():
        out = F.when(c == name, sec) if out is None else out.when(c == name, sec)
    return out


def prev_settlement(ts: Column) -> Column:
    """Latest of 0, 8, 16 h at or before the instant."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / SETTLEMENT_SECONDS) * SETTLEMENT_SECONDS)


def next_settlement(ts: Column) -> Column:
    """First of 0, 8, 16 h strictly after the instant."""
    return F.timestamp_seconds((F.floor(F.unix_timestamp(ts) / SETTLEMENT_SECONDS) + 1) * SETTLEMENT_SECONDS)


def is_settlement_hour(ts: Column) -> Column:
    return F.hour(ts).isin(0, 8, 16)


def settlements_between(start: Column, end: Column) -> Column:
    """Array of settlement instants in (start, end]."""
    first = F.floor(F.unix_timestamp(start) / SETTLEMENT_SECONDS) + 1
    last = F.floor(F.unix_timestamp(end) / SETTLEMENT_SECONDS)
    seq = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(seq, lambda k: F.timestamp_seconds(k * SETTLEMENT_SECONDS))


def period(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)
