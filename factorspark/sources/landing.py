"""Landed exchange payloads (JSON text) to typed rows, and exchange column names to canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOADS = {
    "bars": "ARRAY<ARRAY<DOUBLE>>",
    "funding": "ARRAY<STRUCT<fundingTime: BIGINT, fundingRate: STRING, markPrice: STRING>>",
    "liquidations": "ARRAY<STRUCT<time: BIGINT, side: STRING, price: STRING, avgPrice: STRING, origQty: STRING, executedQty: STRING>>",
    "agg_trades": "ARRAY<STRUCT<a: BIGINT, p: STRING, q: STRING, f: BIGINT, l: BIGINT, T: BIGINT, m: BOOLEAN>>",
    "ticks": "ARRAY<STRUCT<id: BIGINT, price: STRING, qty: STRING, time: BIGINT, isBuyerMaker: BOOLEAN>>",
    "depth": "STRUCT<lastUpdateId: BIGINT, bids: ARRAY<ARRAY<STRING>>, asks: ARRAY<ARRAY<STRING>>>",
}


def _num(c) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def parse_landing(df: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Rows (symbol, ts, ...) of one payload kind; ``df`` holds symbol, payload and, for depth, ts."""
    parsed = df.withColumn("_p", F.from_json(payload, PAYLOADS[kind]))
    if kind == "depth":
        side = lambda c: F.transform(F.coalesce(F.col(f"_p.{c}"), F.array()), lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("qty")))
        d = parsed.select("symbol", "ts", side("bids").alias("bids"), side("asks").alias("asks"), F.col("_p.lastUpdateId").alias("last_update_id"))
        best = lambda c: F.try_element_at(c, F.lit(1))["price"]
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["qty"])
        bid, ask = best(F.col("bids")), best(F.col("asks"))
        both = bid.isNotNull() & ask.isNotNull()
        return d.withColumns({"bid_depth": total(F.col("bids")), "ask_depth": total(F.col("asks")),
                              "spread": F.when(both, ask - bid).otherwise(0.0), "mid_price": F.when(both, (bid + ask) / 2).otherwise(0.0)})
    e = parsed.select("symbol", F.explode("_p").alias("e"))
    if kind == "bars":
        names = ("open", "high", "low", "close", "volume")
        return e.select("symbol", F.timestamp_millis(F.col("e")[0].cast("bigint")).alias("ts"),
                        *[(F.col("e")[i + 1] if n != "volume" else F.coalesce(F.get("e", F.lit(5)), F.lit(0.0))).alias(n) for i, n in enumerate(names)])
    ts = lambda c: F.timestamp_millis(F.col(f"e.{c}")).alias("ts")
    if kind == "funding":
        return e.select("symbol", ts("fundingTime"), _num("e.fundingRate").alias("funding_rate"), _num("e.markPrice").alias("mark_price"))
    if kind == "liquidations":
        zero_none = lambda c: F.when(_num(c) != 0, _num(c))
        price = F.coalesce(zero_none("e.avgPrice"), zero_none("e.price"), F.lit(0.0))
        qty = F.coalesce(zero_none("e.executedQty"), zero_none("e.origQty"), F.lit(0.0))
        d = e.filter(F.col("e.time").isNotNull()).select("symbol", ts("time"), F.coalesce(F.lower("e.side"), F.lit("unknown")).alias("side"), qty.alias("quantity"), price.alias("price"))
        return d.withColumn("value_usd", F.when((F.col("price") != 0) & (F.col("quantity") != 0), F.col("price") * F.col("quantity")))
    if kind == "agg_trades":
        return e.select("symbol", ts("T"), F.col("e.a").alias("agg_trade_id"), _num("e.p").alias("price"), _num("e.q").alias("quantity"),
                        F.col("e.f").alias("first_trade_id"), F.col("e.l").alias("last_trade_id"), F.col("e.m").alias("is_buyer_maker"))
    return e.select("symbol", ts("time"), F.col("e.id").alias("trade_id"), _num("e.price").alias("price"), _num("e.qty").alias("quantity"),
                    (_num("e.price") * _num("e.qty")).alias("quote_quantity"), F.coalesce("e.isBuyerMaker", F.lit(False)).alias("is_buyer_maker"))


# Column names of three exchanges and what they mean here.
COMMON = {"fundingRate": "funding_rate", "markPrice": "mark_price", "indexPrice": "index_price", "openInterest": "open_interest"}
MAPPINGS = {
    "binance": {"openTime": "ts", "quoteVolume": "quote_volume", **COMMON},
    "okx": {"ts": "ts", "instId": "symbol", "o": "open", "h": "high", "l": "low", "c": "close", "vol": "volume", "volCcyQuote": "quote_volume",
            "markPx": "mark_price", "idxPx": "index_price", "fundingRate": "funding_rate", "oi": "open_interest"},
    "bybit": {"timestamp": "ts", "startTime": "ts", "turnover": "quote_volume", **COMMON},
}
MARKERS = {"okx": {"instId", "o", "c"}, "bybit": {"turnover"}, "binance": {"openTime"}}
NUMERIC = {"open", "high", "low", "close", "volume", "quote_volume", "funding_rate", "mark_price", "index_price", "open_interest"}


def detect_exchange(df: DataFrame) -> str | None:
    """Exchange whose marker columns are all present (metadata only)."""
    have = set(df.columns)
    return next((x for x, m in MARKERS.items() if m <= have), None)


def normalize_exchange(df: DataFrame, exchange: str | None = None) -> DataFrame:
    exchange = exchange or detect_exchange(df)
    if exchange is None:
        raise ValueError(f"unknown exchange format: {df.columns}")
    names = {k: v for k, v in MAPPINGS[exchange].items() if k in df.columns}
    out = df.withColumnsRenamed(names)
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c in NUMERIC})
