import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.session import scratch_path
from factorspark.sources import keyed
from factorspark.streaming import io

def day():
    return F.to_date("ts")


def bars(spark, rows):
    d = spark.createDataFrame([(s, None if t is None else pd.Timestamp(t).to_pydatetime(), v) for s, t, v in rows], "symbol STRING, ts TIMESTAMP, v DOUBLE")
    return d


def values(df):
    return sorted((r["symbol"] or "", str(r["ts"]), r["v"]) for r in df.collect())


def test_insert_new_keeps_one_row_per_key(spark):
    """Repeated rows, NULL in either key, a key known from an earlier write, an empty batch, and a batch written again."""
    path = scratch_path(spark, "table")
    first = bars(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 1.0), (None, "2024-01-01", 2.0), ("b", None, 3.0)])
    then = bars(spark, [("a", "2024-01-01", 9.0), (None, "2024-01-01", 9.0), ("b", None, 9.0), ("b", "2024-01-02", 4.0), ("c", "2024-01-01", 5.0)])
    want = [("", "2024-01-01 00:00:00", 2.0), ("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-02 00:00:00", 4.0), ("b", "None", 3.0), ("c", "2024-01-01 00:00:00", 5.0)]
    for batch, d in ((0, first), (1, then), (1, then), (2, first.limit(0)), (3, first)):
        keyed.insert_new(d, path, ["symbol", "ts"], batch, 4, day())
    assert values(keyed.read_inserted(spark, path)) == want


def test_a_write_reads_only_touched_folders_and_key_columns(spark):
    path = scratch_path(spark, "table")
    days = pd.date_range("2024-01-01", periods=20)
    keyed.insert_new(bars(spark, [(s, t, 1.0) for s in "abcdefgh" for t in days]), path, ["symbol", "ts"], 0, 8, day())
    rows = keyed.placed(bars(spark, [("a", "2024-01-05", 1.0), ("z", "2024-01-05", 1.0)]), ["symbol", "ts"], 8, day())
    new = keyed.absent(keyed.stored(spark, path), rows, ["symbol", "ts"])
    assert [r["symbol"] for r in new.collect()] == ["z"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):]
    filters = scan[scan.index("PartitionFilters: "):scan.index("ReadSchema")]
    assert "2024-01-05" in filters[:filters.index("PushedFilters")] and "LessThanOrEqual(ts" in filters and "v:double" not in scan


def test_names_of_folder_levels_are_refused(spark):
    with pytest.raises(ValueError):
        keyed.placed(spark.createDataFrame([(1, 2)], "k INT, bucket INT"), ["k"])


def test_upserts_rewrite_touched_buckets_once(spark):
    path = scratch_path(spark, "table")
    d = lambda rows: spark.createDataFrame(rows, "k INT, at INT, v DOUBLE")
    assert keyed.read_upserted(spark, path) is None
    keyed.upsert_stored(d([(i, 1, float(i)) for i in range(40)]), path, ["k"], "at", 0, 8)
    keyed.upsert_stored(d([(3, 2, 30.0), (4, 0, 40.0), (3, 1, 31.0)]), path, ["k"], "at", 1, 8)
    keyed.upsert_stored(d([(5, 9, 50.0)]), path, ["k"], "at", 1, 8)  # logged already
    keyed.upsert_stored(d([]), path, ["k"], "at", 2, 8)
    got = {r["k"]: r["v"] for r in keyed.read_upserted(spark, path).collect()}
    assert got == {i: 30.0 if i == 3 else float(i) for i in range(40)}
    assert spark.read.parquet(f"{path}/commits").filter("version = 1").count() <= 2


def test_a_write_that_was_not_logged_is_not_seen(spark):
    path = scratch_path(spark, "table")
    d = lambda v: spark.createDataFrame([(1, v, float(v)), (2, v, float(v))], "k INT, at INT, v DOUBLE")
    keyed.upsert_stored(d(1), path, ["k"], "at", 0, 4)
    keyed.placed(d(2), ["k"], 4).write.partitionBy("part", "bucket").parquet(f"{path}/data/version=1")
    assert {r["v"] for r in keyed.read_upserted(spark, path).collect()} == {1.0}
    keyed.upsert_stored(d(3), path, ["k"], "at", 1, 4)
    assert {r["v"] for r in keyed.read_upserted(spark, path).collect()} == {3.0}


def test_streams_into_keyed_tables(spark, tmp_path):
    for n in range(4):
        spark.createDataFrame([(k, n, float(10 * n + k)) for k in range(n, n + 3)], "k INT, at INT, v DOUBLE").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("k INT, at INT, v DOUBLE").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    base = scratch_path(spark, "streams")
    io.write_idempotent(read(), f"{base}/a", f"{base}/ca", ["k"], 4, availableNow=True).awaitTermination()
    io.write_upserts(read(), f"{base}/b", f"{base}/cb", ["k"], "at", 4, availableNow=True).awaitTermination()
    assert sorted(r["k"] for r in keyed.read_inserted(spark, f"{base}/a").collect()) == list(range(6))
    assert {r["k"]: r["at"] for r in keyed.read_upserted(spark, f"{base}/b").collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3}
