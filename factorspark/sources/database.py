"""Scans of stored market tables, over JDBC or Parquet: symbol, timeframe, exchange and time filters reach the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc_options(url: str, table: str, start: str, end: str, partitions: int = 32, **conn: str) -> dict[str, str]:
    """Reader options: the timestamp range is cut into equal parts, each read by its own task."""
    return {"url": url, "dbtable": table, "partitionColumn": "timestamp", "lowerBound": start, "upperBound": end,
            "numPartitions": str(partitions), "fetchsize": "10000", "pushDownPredicate": "true", **conn}


def jdbc_table(spark: SparkSession, url: str, table: str, start: str, end: str, **kw) -> DataFrame:
    """A stored table of a database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, start, end, **kw)).load()


def _scan(table: DataFrame, fields: tuple[str, ...], start, end, **equal) -> DataFrame:
    """Plain column filters only, so that either source can push them down."""
    if start is not None:
        table = table.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        table = table.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    for col, v in equal.items():
        if v is not None:
            table = table.filter(F.col(col) == v)
    return table.select("symbol", F.col("timestamp").alias("ts"), *fields)


def read_bars_jdbc(table: DataFrame, start=None, end=None, symbol=None, timeframe=None, exchange=None, market_type=None) -> DataFrame:
    return _scan(table, ("open", "high", "low", "close", "volume"), start, end, symbol=symbol, timeframe=timeframe, exchange=exchange, market_type=market_type)


def read_funding(table: DataFrame, start=None, end=None, symbol=None, exchange=None) -> DataFrame:
    return _scan(table, ("funding_rate",), start, end, symbol=symbol, exchange=exchange)


def read_open_interest(table: DataFrame, start=None, end=None, symbol=None, exchange=None) -> DataFrame:
    return _scan(table, ("open_interest",), start, end, symbol=symbol, exchange=exchange)


def read_ls_ratio(table: DataFrame, start=None, end=None, symbol=None, ratio_type=None, exchange=None) -> DataFrame:
    return _scan(table, ("ratio_type", "long_short_ratio"), start, end, symbol=symbol, ratio_type=ratio_type, exchange=exchange)


def read_liquidations(table: DataFrame, start=None, end=None, symbol=None, exchange=None) -> DataFrame:
    """Liquidations with their value split into the long and short side (a sell closes a long)."""
    d = _scan(table, ("side", "quantity", "price", "value_usd"), start, end, symbol=symbol, exchange=exchange)
    side = F.lower("side")
    return d.withColumns({"liquidation_long": F.when(side == "sell", F.col("value_usd")).otherwise(0.0),
                          "liquidation_short": F.when(side == "buy", F.col("value_usd")).otherwise(0.0)})
