"""Stored tables in buckets by key hash: a write reads the key columns of the buckets, and of the key range, that it touches.

A row's bucket follows from its key, so nothing outside the touched buckets can hold the same key. Files are sorted by key, and the range
of the incoming keys is pushed to the scan: keys that grow with time skip the row groups of earlier writes. ``part`` is an optional further
folder level, a function of the key columns (the day of a key's time). NULL is a key value like any other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 256


def placed(df: DataFrame, keys: list[str], buckets: int = BUCKETS, part: Column | None = None) -> DataFrame:
    """The rows with the folder levels ``part`` and ``bucket`` of their key."""
    taken = {"part", "bucket", "batch", "version"} & set(df.columns)
    if taken:
        raise ValueError(f"columns named like folder levels: {sorted(taken)}")
    day = F.lit("all") if part is None else F.coalesce(part.cast("string"), F.lit("none"))
    return df.withColumns({"part": day, "bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})


def touched(incoming: DataFrame, keys: list[str]) -> list:
    """One entry per folder that the placed rows fall in, with the range of each key there; bounded by the number of folders.

    Times travel as microseconds, which no time zone of the driver can shift.
    """
    kind = dict(incoming.dtypes)
    key = lambda k: F.unix_micros(k) if kind[k] == "timestamp" else F.col(k)
    ends = [f(key(k)).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]
    return incoming.groupBy("part", "bucket").agg(*ends, *[F.max(F.col(k).isNull()).alias(f"null_{i}") for i, k in enumerate(keys)]).collect()


def _folders(folders: list) -> Column:
    """Partition filter for the touched folders."""
    parts: dict[str, list[int]] = {}
    for r in folders:
        parts.setdefault(r["part"], []).append(r["bucket"])
    return reduce(or_, [(F.col("part") == p) & F.col("bucket").isin(b) for p, b in sorted(parts.items())])


def _range(folders: list, keys: list[str], kind: dict[str, str]) -> Column:
    """The range of every key over the touched folders, and NULL where it comes in; keys without plain literals are not bounded."""
    out = [F.lit(True)]
    for i, k in enumerate(keys):
        if kind[k].startswith(("struct", "array", "map")):
            continue
        value = lambda v, k=k: F.timestamp_micros(F.lit(v)) if kind[k] == "timestamp" else F.lit(v)
        found = [r for r in folders if r[f"lo_{i}"] is not None]
        inside = [F.col(k).between(value(min(r[f"lo_{i}"] for r in found)), value(max(r[f"hi_{i}"] for r in found)))] if found else []
        null = [F.col(k).isNull()] if any(r[f"null_{i}"] for r in folders) else []
        out.append(reduce(or_, inside + null))
    return reduce(and_, out)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's files with their folder levels; None before the first write."""
    try:
        return spark.read.parquet(path).withColumn("part", F.col("part").cast("string"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def absent(table: DataFrame | None, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One of the placed rows per key that the table lacks."""
    new = incoming.dropDuplicates(keys)
    if table is None:
        return new
    folders = touched(incoming, keys)
    if not folders:
        return new
    old = table.filter(_folders(folders)).filter(_range(folders, keys, dict(incoming.dtypes))).select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    return new.join(old, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys]), "left_anti")


def insert_new(df: DataFrame, path: str, keys: list[str], batch: int, buckets: int = BUCKETS, part: Column | None = None) -> None:
    """Insert the rows whose key the table lacks, as files of ``batch``. The same batch again replaces its own files."""
    rows = placed(df, keys, buckets, part)
    table = stored(df.sparkSession, path)
    new = absent(None if table is None else table.filter(F.col("batch") != batch), rows, keys)
    new = new.withColumn("batch", F.lit(batch)).repartition("part", "bucket").sortWithinPartitions("part", "bucket", *keys)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "bucket", "batch").parquet(path)


def read_inserted(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path).drop("part", "bucket", "batch")


def _current(spark: SparkSession, path: str) -> list:
    """(part, bucket, version) of each folder's newest committed version; bounded by the number of folders."""
    log = stored(spark, f"{path}/commits")
    return [] if log is None else log.groupBy("part", "bucket").agg(F.max("version").alias("version")).collect()


def _versions(spark: SparkSession, path: str, rows: list) -> DataFrame | None:
    """The rows of the given folder versions, read from their folders alone."""
    if not rows:
        return None
    names = [f"{path}/data/version={r['version']}/part={r['part']}/bucket={r['bucket']}" for r in rows]
    return spark.read.option("basePath", f"{path}/data").parquet(*names).withColumn("part", F.col("part").cast("string")).drop("version")


def upsert_stored(df: DataFrame, path: str, keys: list[str], order: str, version: int, buckets: int = BUCKETS) -> None:
    """Keep the last write per key by ``order`` (any of several that share the last one). Only touched buckets are read and written, each whole and as a new version.

    Readers see a version once its folders are logged, so a job that dies half-way leaves the table as it was; a version that is
    logged is not applied again.
    """
    spark = df.sparkSession
    log = stored(spark, f"{path}/commits")
    if log is not None and not log.filter(F.col("version") == version).isEmpty():
        return
    rows = placed(df, keys, buckets)
    folders = touched(rows, keys)
    if not folders:
        return
    hit = {(r["part"], r["bucket"]) for r in folders}
    old = _versions(spark, path, [r for r in _current(spark, path) if (r["part"], r["bucket"]) in hit])
    both = rows if old is None else old.unionByName(rows)
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    new = both.withColumn("_i", F.row_number().over(last)).filter(F.col("_i") == 1).drop("_i")
    new = new.repartition("part", "bucket").sortWithinPartitions("part", "bucket", *keys)
    new.write.mode("overwrite").partitionBy("part", "bucket").parquet(f"{path}/data/version={version}")
    # one row per touched folder
    spark.createDataFrame([(p, b, version) for p, b in sorted(hit)], "part STRING, bucket INT, version BIGINT").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed rows; None before the first write."""
    rows = _versions(spark, path, _current(spark, path))
    return None if rows is None else rows.drop("part", "bucket")
