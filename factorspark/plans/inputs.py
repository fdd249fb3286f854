"""Domain inputs derived from the given tables, as DataFrames and as the matching SQL CTEs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark import schemas
from factorspark.functions.math import div
from factorspark.operators.resample import bars_from_ticks
from factorspark.operators.windows import Roll

R = Roll("symbol", "ts")

CTE = {
    # main panel: one bar per user and day
    "ud": """ud AS (SELECT user_id AS symbol, date_trunc('day', ts) AS ts,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trades
        FROM events GROUP BY 1, 2)""",
    # regular series: one bar per event type and hour
    "th": """th AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trades
        FROM events GROUP BY 1, 2)""",
    # long history: one bar per supplier and month
    "sm": """sm AS (SELECT l_suppkey AS symbol, date_trunc('month', l_shipdate) AS ts,
        first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close,
        sum(l_quantity) AS volume, count(*) AS trades
        FROM lineitem GROUP BY 1, 2)""",
    # factor panel: 3-day momentum against the next day's return, per user and day
    "fp": """fp AS (SELECT symbol, ts, close / NULLIF(lag(close, 3) OVER w, 0) - 1 AS factor,
        volume / NULLIF(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) - 1 AS factor2,
        high / NULLIF(low, 0) - 1 AS factor3,
        close / NULLIF(lag(close, 1) OVER w, 0) - 1 AS ret,
        lead(close, 1) OVER w / NULLIF(close, 0) - 1 AS fwd, close, volume
        FROM ud WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
    # long-history panel: per supplier and month
    "sp": """sp AS (SELECT symbol, ts, close, volume, volume * 5e8 AS cap, close / NULLIF(lag(close, 3) OVER w, 0) - 1 AS factor,
        close / NULLIF(lag(close, 1) OVER w, 0) - 1 AS ret, lead(close, 1) OVER w / NULLIF(close, 0) - 1 AS fwd
        FROM sm WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
    # panel in long form
    "fl": """fl AS (SELECT symbol, ts, 'momentum' AS name, factor AS value, fwd FROM fp
        UNION ALL SELECT symbol, ts, 'volume', factor2, fwd FROM fp
        UNION ALL SELECT symbol, ts, 'range', factor3, fwd FROM fp)""",
    # funding of the hourly series: one rate per 8 hours, the same for all symbols' views
    "fund8": """fund8 AS (SELECT event_type AS symbol, to_timestamp(floor(epoch(ts) / 28800) * 28800) AT TIME ZONE 'UTC' AS ts,
        (avg(value) - 50) / 10000 AS funding_rate FROM events GROUP BY 1, 2)""",
    "oi": """oi AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, sum(value) AS open_interest
        FROM events GROUP BY 1, 2)""",
    "ls": """ls AS (SELECT event_type AS symbol, date_trunc('day', ts) AS ts,
        (1.0 + count(*) FILTER (value > 50)) / (1.0 + count(*) FILTER (value <= 50)) AS long_short_ratio FROM events GROUP BY 1, 2)""",
    "liq": """liq AS (SELECT event_id, event_type AS symbol, ts, CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END AS side,
        1.0 AS quantity, value AS price, value AS value_usd FROM events)""",
    # hourly bars with derivative columns, regular per symbol
    "drv": """drv AS (SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.volume,
        (b.open - 50) / 10000 AS funding_rate, b.volume * 3 AS open_interest, b.volume * b.close AS open_interest_value,
        (b.high - b.close) AS liquidation_long, (b.close - b.low) AS liquidation_short,
        b.high - b.low AS liquidation_volume,
        (1 + b.high) / (1 + b.open) AS long_short_ratio, b.high / NULLIF(b.high + b.low, 0) AS long_ratio, b.low / NULLIF(b.high + b.low, 0) AS short_ratio,
        b.close - (b.high + b.low) / 2 AS basis, (b.close - (b.high + b.low) / 2) / NULLIF((b.high + b.low) / 2, 0) AS basis_rate,
        b.close AS mark_price, (b.high + b.low) / 2 AS index_price, b.close - (b.high + b.low) / 2 AS premium,
        b.open + b.high AS buy_volume, b.low + b.close AS sell_volume,
        (b.open + b.high) / NULLIF(b.open + b.high + b.low + b.close, 0) AS buy_sell_ratio,
        (b.open - b.close) / NULLIF(b.open + b.close, 0) AS bid_ask_imbalance, b.high - b.low AS spread
        FROM th b)""",
    # equal-weight return of the panel and its volume-weighted benchmark: one row per date
    "daily": """daily AS (SELECT ts, avg(ret) AS ret, sum(ret * volume) / NULLIF(sum(volume), 0) AS bench FROM fp WHERE ret IS NOT NULL GROUP BY 1)""",
    # returns per hourly series
    "hret": """hret AS (SELECT symbol, ts, close, close / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS raw_ret,
        CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY ts) <> 0 THEN
        greatest(-0.05, least(0.05, (close / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1) / 100)) END AS ret FROM th)""",
    # cross-sectional position per user-day
    "trials": """trials AS (SELECT p_partkey AS trial, p_brand AS family, p_retailprice / 1000 AS sharpe,
        (p_size - 25) / 400.0 AS ic, p_retailprice / 800 AS ir, p_type AS status FROM part)""",
    "traces": """traces AS (SELECT event_id, event_type AS agent, CAST(user_id % 3 AS BIGINT) AS model, value / 1000 AS cost,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_id % 4 = 0 AS cached, ts FROM events)""",
}


def with_ctes(use: str, body: str) -> str:
    names = use.split()
    if not names:
        return body
    texts = ",\n".join(CTE[n] for n in names)
    if body.upper().startswith("WITH "):
        return f"WITH {texts},\n{body[5:]}"
    return f"WITH {texts}\n{body}"


class Inputs:
    """Lazily built inputs of one run; every DataFrame here reads the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in schemas.TABLES:
            reader = reader.schema(schemas.TABLES[name])
        return reader.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("trade_id"), F.col("user_id").alias("symbol"), "ts",
            F.col("value").alias("price"), F.lit(1.0).alias("quantity"))

    @cached_property
    def ud(self) -> DataFrame:
        e = self.table("events").select(F.col("user_id").alias("symbol"), "ts", "value", "event_id")
        return bars_from_ticks(e, "1 day", "value", "value", F.col("event_id"))

    @cached_property
    def th(self) -> DataFrame:
        e = self.table("events").select(F.col("event_type").alias("symbol"), "ts", "value", "event_id")
        return bars_from_ticks(e, "1 hour", "value", "value", F.col("event_id"))

    @cached_property
    def sm(self) -> DataFrame:
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity"), "l_orderkey", "l_linenumber")
        return bars_from_ticks(li, "month", "price", "l_quantity", F.col("l_orderkey") * 10 + F.col("l_linenumber"))

    @cached_property
    def fp(self) -> DataFrame:
        c = F.col("close")
        return self.ud.select(
            "symbol", "ts", (div(c, F.lag(c, 3).over(R.all)) - 1).alias("factor"),
            (div(F.col("volume"), F.avg("volume").over(R.frame(5))) - 1).alias("factor2"),
            (div(F.col("high"), F.col("low")) - 1).alias("factor3"),
            (div(c, F.lag(c, 1).over(R.all)) - 1).alias("ret"), (div(F.lead(c, 1).over(R.all), c) - 1).alias("fwd"),
            "close", "volume")

    @cached_property
    def sp(self) -> DataFrame:
        c = F.col("close")
        return self.sm.select(
            "symbol", "ts", "close", "volume", (F.col("volume") * 5e8).alias("cap"), (div(c, F.lag(c, 3).over(R.all)) - 1).alias("factor"),
            (div(c, F.lag(c, 1).over(R.all)) - 1).alias("ret"), (div(F.lead(c, 1).over(R.all), c) - 1).alias("fwd"))

    @cached_property
    def fl(self) -> DataFrame:
        wide = self.fp.select("symbol", "ts", "fwd", F.col("factor").alias("momentum"),
                              F.col("factor2").alias("volume"), F.col("factor3").alias("range"))
        return wide.unpivot(["symbol", "ts", "fwd"], ["momentum", "volume", "range"], "name", "value")

    def _eight_hours(self) -> Column:
        return F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 28800) * 28800)

    @cached_property
    def fund8(self) -> DataFrame:
        return (self.table("events").groupBy(F.col("event_type").alias("symbol"), self._eight_hours().alias("ts"))
                .agg(((F.avg("value") - 50) / 10000).alias("funding_rate")))

    @cached_property
    def oi(self) -> DataFrame:
        return (self.table("events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"))
                .agg(F.sum("value").alias("open_interest")))

    @cached_property
    def ls(self) -> DataFrame:
        return (self.table("events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").alias("ts"))
                .agg(((F.count_if(F.col("value") > 50) + 1.0) / (F.count_if(F.col("value") <= 50) + 1.0)).alias("long_short_ratio")))

    @cached_property
    def liq(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("event_type").alias("symbol"), "ts",
            F.when(F.col("event_id") % 2 == 0, "sell").otherwise("buy").alias("side"),
            F.lit(1.0).alias("quantity"), F.col("value").alias("price"), F.col("value").alias("value_usd"))

    @cached_property
    def drv(self) -> DataFrame:
        o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
        mid = (h + lo) / 2
        return self.th.select(
            "symbol", "ts", "open", "high", "low", "close", "volume",
            ((o - 50) / 10000).alias("funding_rate"), (v * 3).alias("open_interest"), (v * c).alias("open_interest_value"),
            (h - c).alias("liquidation_long"), (c - lo).alias("liquidation_short"), (h - lo).alias("liquidation_volume"),
            ((1 + h) / (1 + o)).alias("long_short_ratio"), div(h, h + lo).alias("long_ratio"), div(lo, h + lo).alias("short_ratio"),
            (c - mid).alias("basis"), div(c - mid, mid).alias("basis_rate"), c.alias("mark_price"), mid.alias("index_price"),
            (c - mid).alias("premium"), (o + h).alias("buy_volume"), (lo + c).alias("sell_volume"),
            div(o + h, o + h + lo + c).alias("buy_sell_ratio"), div(o - c, o + c).alias("bid_ask_imbalance"),
            (h - lo).alias("spread"))

    @cached_property
    def daily(self) -> DataFrame:
        return (self.fp.filter(F.col("ret").isNotNull()).groupBy("ts")
                .agg(F.avg("ret").alias("ret"), div(F.sum(F.col("ret") * F.col("volume")), F.sum("volume")).alias("bench")))

    @cached_property
    def hret(self) -> DataFrame:
        raw = div(F.col("close"), F.lag("close").over(R.all)) - 1
        return (self.th.select("symbol", "ts", "close", raw.alias("raw_ret"))
                .withColumn("ret", F.when(F.col("raw_ret").isNotNull(),
                                          F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("raw_ret") / 100)))))

    @cached_property
    def trials(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("trial"), F.col("p_brand").alias("family"), (F.col("p_retailprice") / 1000).alias("sharpe"),
            ((F.col("p_size") - 25) / 400.0).alias("ic"), (F.col("p_retailprice") / 800).alias("ir"), F.col("p_type").alias("status"))

    @cached_property
    def traces(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("event_type").alias("agent"), (F.col("user_id") % 3).alias("model"), (F.col("value") / 1000).alias("cost"),
            F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_id") % 4 == 0).alias("cached"), "ts")
