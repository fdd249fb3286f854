"""Order-book columns: best quotes and level arrays ``ARRAY<STRUCT<price, qty>>``, best level first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorspark.functions.math import div


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread(bid: Column, ask: Column, how: str = "absolute") -> Column:
    s = ask - bid
    return s if how == "absolute" else div(s, mid(bid, ask)) * (100 if how == "percent" else 10000)


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    """Share of the bid side over both, centred; NULL when both are empty."""
    return div(bid_size - ask_size, bid_size + ask_size)


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """Quotes weighted by the size on the other side."""
    return div(bid * ask_size + ask * bid_size, bid_size + ask_size)


def effective_spread(price: Column, bid: Column, ask: Column) -> Column:
    return F.abs(price - mid(bid, ask)) * 2


def sort_levels(levels: Column, side: str) -> Column:
    """Best price first: descending bids, ascending asks; equal prices by size."""
    s = F.array_sort(levels)
    return F.reverse(s) if side == "bid" else s


def best(levels: Column, field: str = "price") -> Column:
    return F.try_element_at(levels, F.lit(1))[field]


def depth_sum(levels: Column, k: int) -> Column:
    return F.aggregate(F.slice(levels, 1, k), F.lit(0.0), lambda a, x: a + x["qty"])


def depth_vwap(levels: Column, k: int) -> Column:
    v = F.aggregate(F.slice(levels, 1, k), F.lit(0.0), lambda a, x: a + x["price"] * x["qty"])
    return div(v, depth_sum(levels, k))


def depth_imbalance(bids: Column, asks: Column, k: int) -> Column:
    b, a = depth_sum(bids, k), depth_sum(asks, k)
    return div(b - a, b + a)


def basis(mark: Column, index: Column) -> Column:
    return mark - index


def basis_pct(mark: Column, index: Column) -> Column:
    return div(mark - index, index) * 100


def basis_annualized(mark: Column, index: Column, periods: float = 1095.0) -> Column:
    return div(mark - index, index) * periods
