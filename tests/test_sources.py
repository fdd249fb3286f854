import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark import session
from factorspark.sources import bars as sb
from factorspark.sources import database as db
from factorspark.sources import landing as la
from factorspark.sources import store as st


@pytest.mark.parametrize("name", ["timestamp", "Date", "DATETIME", "time"])
def test_csv_headers(spark, tmp_path, name):
    (tmp_path / "a.csv").write_text(f"{name},Open,HIGH,low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n")
    r = sb.read_bars_csv(spark, str(tmp_path / "a.csv"), "BTC").first()
    assert r["symbol"] == "BTC" and r["ts"].year == 2024 and r["high"] == 2.0 and r["volume"] == 10.0


def test_csv_without_time_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("open,close\n1,2\n")
    with pytest.raises(ValueError):
        sb.read_bars_csv(spark, str(tmp_path / "a.csv"))


@pytest.mark.parametrize("raw", ["BTCUSDT", "btc/usdt", "BTC/USDT:USDT", " BTC-USDT "])
def test_symbols(spark, raw):
    d = spark.createDataFrame([(raw,)], "s STRING")
    assert d.select(*[sb.normalize_symbol(F.col("s"), f) for f in ("perp", "spot", "flat")]).first()[:] == ("BTC/USDT:USDT", "BTC/USDT", "BTCUSDT")


def test_exchange_formats(spark):
    ts = pd.date_range("2024-01-01", periods=2, freq="h")
    okx = spark.createDataFrame(pd.DataFrame({"ts": ts, "instId": "BTC-USDT-SWAP", "o": 1, "h": 2, "l": 0, "c": 1, "vol": 5, "fundingRate": 1e-4, "markPx": 1.5}))
    assert la.detect_exchange(okx) == "okx"
    n = la.normalize_exchange(okx)
    assert {"close", "symbol", "volume", "mark_price", "funding_rate"} <= set(n.columns) and dict(n.dtypes)["close"] == "double"
    byb = spark.createDataFrame(pd.DataFrame({"timestamp": ts, "symbol": "B", "close": 1.0, "turnover": 4.0, "openInterest": 9.0}))
    assert {"quote_volume", "open_interest", "ts"} <= set(la.normalize_exchange(byb).columns)
    bin_ = spark.createDataFrame(pd.DataFrame({"openTime": ts, "symbol": "B", "close": 1.0, "fundingRate": 1e-4, "indexPrice": 2.0}))
    assert {"ts", "funding_rate", "index_price"} <= set(la.normalize_exchange(bin_).columns)
    with pytest.raises(ValueError):
        la.normalize_exchange(spark.range(1).toDF("x"))


def test_bars_payload(spark):
    d = spark.createDataFrame([("B", "[[1704067200000, 1, 2, 0.5, 1.5, 10], [1704070800000, 1.5, 3, 1, 2]]")], "symbol STRING, payload STRING")
    r = la.parse_landing(d, "bars").orderBy("ts").collect()
    assert [x["close"] for x in r] == [1.5, 2.0] and [x["volume"] for x in r] == [10.0, 0.0] and r[1]["ts"].hour == 1


def test_empty_book(spark):
    d = spark.createDataFrame([("B", None, '{"lastUpdateId": 1, "bids": [], "asks": [["101", "2"]]}')], "symbol STRING, ts TIMESTAMP, payload STRING")
    r = la.parse_landing(d, "depth").first()
    assert r["spread"] == 0.0 and r["bid_depth"] == 0.0 and r["ask_depth"] == 2.0


def test_append_and_upsert(spark):
    old = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 1)], "k INT, v DOUBLE, at INT")
    new = spark.createDataFrame([(2, 5.0, 2), (3, 3.0, 2), (3, 3.0, 2)], "k INT, v DOUBLE, at INT")
    assert [r["k"] for r in st.append_new(old, new, ["k"]).collect()] == [3]
    assert {r["k"]: r["v"] for r in st.upsert(old, new, ["k"], "at").collect()} == {1: 1.0, 2: 5.0, 3: 3.0}


def test_factor_values_round_trip(spark, tmp_path):
    p = str(tmp_path / "values")
    d = spark.createDataFrame([("f1", "A", 1.0, "1d", "2024-01-01"), ("f1", "A", None, "1d", "2024-01-02"), ("f1", "A", 3.0, "1d", "2024-01-03"), ("f2", "A", 9.0, "1d", "2024-01-01")],
                              "factor_id STRING, symbol STRING, value DOUBLE, timeframe STRING, ts STRING").withColumn("ts", F.to_timestamp("ts"))
    st.write_factor_values(d, p)
    assert [r["value"] for r in st.read_factor_values(spark, p, "f1").collect()] == [3.0, 1.0]
    assert [r["value"] for r in st.read_factor_values(spark, p, "f1", limit=1).collect()] == [3.0]
    assert st.drop_factor(spark, p, "f1") and not st.drop_factor(spark, p, "f1")
    assert st.read_factor_values(spark, p, "f1").count() == 0 and st.read_factor_values(spark, p, "f2").count() == 1


def test_jdbc_options():
    o = db.jdbc_options("jdbc:x", "ohlcv_data", "2024-01-01", "2024-02-01", 8, user="u")
    assert o["partitionColumn"] == "timestamp" and o["numPartitions"] == "8" and o["user"] == "u" and o["pushDownPredicate"] == "true"


def test_stored_table_filters_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "bars")
    d = pd.DataFrame({"symbol": ["A", "B"], "timestamp": pd.to_datetime(["2024-01-01", "2024-01-02"]), "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "timeframe": "1h", "exchange": "x", "market_type": "spot"})
    spark.createDataFrame(d).write.parquet(p)
    q = db.read_bars_jdbc(spark.read.parquet(p), "2024-01-01", "2024-01-03", "A", "1h")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan and "market_type" not in plan.split("ReadSchema")[1]
    assert q.count() == 1


def test_checkpoint_dir_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_broadcast_only_when_small(spark):
    small = session.broadcast_if_small(spark.range(10), 10)
    large = session.broadcast_if_small(spark.range(11), 10)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
