"""Bar sources and the columns every bar table gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.math import div
from factorspark.operators.windows import Roll

TIME_NAMES = ("timestamp", "date", "datetime", "time", "ts")
PRICE_FIELDS = ("open", "high", "low", "close", "volume")


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV bars with any header case and any of the usual time column names.

    The header (one line) is read to learn the column names; the data pass uses a fixed schema.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{h}` " + ("DOUBLE" if h.lower() in PRICE_FIELDS else "STRING") for h in header)
    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.toDF(*[h.strip().lower() for h in header])
    times = [F.expr(f"try_cast(`{c}` AS TIMESTAMP)") for c in TIME_NAMES if c in df.columns]
    if not times:
        raise ValueError(f"no time column among {df.columns}")
    out = df.withColumn("_t", F.coalesce(*times)).drop(*[c for c in TIME_NAMES if c in df.columns]).withColumnRenamed("_t", "ts")
    if "symbol" not in out.columns:
        out = out.withColumn("symbol", F.lit(symbol))
    return out.select("symbol", "ts", *[c for c in out.columns if c not in ("symbol", "ts")])


def read_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def select_panel(df: DataFrame, symbols=None, fields=None, start=None, end=None) -> DataFrame:
    """Symbol, time and field selection; everything reaches the scan."""
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df.select("symbol", "ts", *(fields or [c for c in df.columns if c not in ("symbol", "ts")]))


def normalize_symbol(c: Column, form: str = "perp") -> Column:
    """``BTCUSDT`` / ``BTC/USDT`` / ``BTC/USDT:USDT`` to ``BTC/USDT:USDT`` (perp), ``BTC/USDT`` (spot) or ``BTCUSDT`` (flat)."""
    base = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), ":.*$", ""), "[/_-]", "")
    base = F.regexp_replace(base, "USDT$", "")
    if form == "flat":
        return F.concat(base, F.lit("USDT"))
    return F.concat(base, F.lit("/USDT:USDT" if form == "perp" else "/USDT"))


def with_bar_fields(df: DataFrame, roll: Roll | None = None) -> DataFrame:
    """Typical price, traded value and running volume-weighted price."""
    roll = roll or Roll()
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumns({"typical_price": tp, "dollar_volume": F.col("close") * F.col("volume")})
    return df.withColumn("cum_vwap", div(roll.cum_sum(F.col("typical_price") * F.col("volume")), roll.cum_sum("volume")))


def ensure_vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted price where present, else the typical price."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap", F.coalesce(F.col("vwap"), tp) if "vwap" in df.columns else tp)


def with_basic_features(df: DataFrame, roll: Roll | None = None) -> DataFrame:
    """Returns over 1 and 7, volatility and averages over 7 and 30, crossing flag, range and body."""
    r = roll or Roll()
    df = df.withColumn("return_1", r.pct_change("close", 1))
    return df.withColumns({
        "return_7": r.pct_change("close", 7),
        "vol_7": r.std("return_1", 7), "vol_30": r.std("return_1", 30),
        "volume_ma_7": r.mean("volume", 7), "volume_ma_30": r.mean("volume", 30),
        "volume_ratio": div(F.col("volume"), r.mean("volume", 7)),
        "ma_7": r.mean("close", 7), "ma_30": r.mean("close", 30),
        "ma_cross": (r.mean("close", 7) > r.mean("close", 30)).cast("int"),
        "range": div(F.col("high") - F.col("low"), F.col("close")),
        "body": div(F.col("close") - F.col("open"), F.col("open")),
    })


def with_returns(df: DataFrame, horizons=(1, 5, 10), roll: Roll | None = None) -> DataFrame:
    """One-bar return and forward returns; ``lead`` is used for labels only."""
    r = roll or Roll()
    out = {"ret": r.pct_change("close", 1)}
    out |= {f"fwd_{h}": div(r.lead("close", h), F.col("close")) - 1 for h in horizons}
    return df.withColumns(out)


def funding_adjusted_return(df: DataFrame) -> DataFrame:
    return df.withColumn("adj_return", F.col("ret") - F.coalesce(F.col("funding_rate"), F.lit(0.0)))


def fill_bars(df: DataFrame, fields=PRICE_FIELDS, default: float = 0.0, roll: Roll | None = None) -> DataFrame:
    """Forward fill, then a constant for what has no earlier value."""
    r = roll or Roll()
    return df.withColumns({f: F.coalesce(r.ffill(f), F.lit(default)) for f in fields})
