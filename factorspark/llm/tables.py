"""Input tables of the text queries, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, key: Column, limit: int, n: int) -> DataFrame:
    """About ``limit`` of ``n`` rows, chosen by a hash of the key: the same rows on every run, all of them when n <= limit."""
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < F.lit(int(1_000_003 * limit / n)))
