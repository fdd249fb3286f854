"""Stored factor values, ledgers, field exports, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark import schemas


def write_factor_values(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append (factor_id, symbol, value, timeframe, ts) without missing values, one folder per factor.

    Rows of one factor are spread over symbol buckets, so a factor with most rows is not one task.
    """
    d = df.select("factor_id", "symbol", "value", "timeframe", "ts").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    (d.withColumn("_b", F.pmod(F.xxhash64("symbol", F.date_trunc("month", "ts")), F.lit(64))).repartition("factor_id", "_b").drop("_b")
     .write.mode(mode).partitionBy("factor_id").parquet(path))


def read_factor_values(spark: SparkSession, path: str, factor_id: str, symbol=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Newest first; the factor is a partition filter, symbol and time reach the scan."""
    d = spark.read.schema(schemas.FACTOR_VALUES.replace("symbol STRING", "symbol BIGINT") if isinstance(symbol, int) else schemas.FACTOR_VALUES).parquet(path)
    d = d.filter(F.col("factor_id") == factor_id)
    if symbol is not None:
        d = d.filter(F.col("symbol") == symbol)
    if start is not None:
        d = d.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        d = d.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    d = d.orderBy(F.col("ts").desc(), "symbol")
    return d.limit(limit) if limit else d


def drop_factor(spark: SparkSession, path: str, factor_id: str) -> bool:
    """Delete all values of a factor: its partition folder, no data pass."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/factor_id={factor_id}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(folder) and fs.delete(folder, True))


def write_trials_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_trials_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIALS).json(path)


def export_field_store(df: DataFrame, path: str, fields: list[str], buckets: int = 64) -> None:
    """Float32 values in long form, one folder per field and symbol bucket, with calendar and instrument tables.

    Symbols are hashed into buckets, so the number of folders does not grow with the number of symbols; the rows
    of one folder are written by one task per month, so no task holds a whole field.
    """
    long = df.unpivot(["symbol", "ts"], fields, "field", "value").withColumn("value", F.col("value").cast("float"))
    long = long.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int"))
    (long.withColumn("_m", F.date_trunc("month", "ts")).repartition("field", "bucket", "_m").drop("_m").sortWithinPartitions("symbol", "ts")
     .write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/features"))
    df.select("ts").distinct().write.mode("overwrite").parquet(f"{path}/calendar")
    (df.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end")).write.mode("overwrite").parquet(f"{path}/instruments"))


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union keeping the last write per key; each task keeps one row per key before the shuffle."""
    d = existing.unionByName(incoming)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return d.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") == 1).drop("_i")
