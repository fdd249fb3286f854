import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators.resample import bars_from_ticks
from factorspark.session import scratch_path
from factorspark.streaming import io, state
from factorspark.streaming import windows as sw

SCHEMA = "event_id BIGINT, ts TIMESTAMP, key STRING, value DOUBLE"


def files(spark, tmp_path, *batches):
    """Each batch becomes one file, read one per micro-batch."""
    path = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, pd.Timestamp(t).to_pydatetime(), k, float(v)) for n, t, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return io.read_event_stream(spark, path, SCHEMA, 1)


def drain(s, mode="append"):
    return io.drain(s, "test", mode).toPandas()


def rows(start, values, key="a", n0=0, step="1min"):
    return [(n0 + i, t, key, v) for i, (t, v) in enumerate(zip(pd.date_range(start, periods=len(values), freq=step), values))]


def test_bars_agree_with_batch(spark, tmp_path):
    a, b = rows("2024-01-01 00:00", range(1, 91)), rows("2024-01-01 01:30", range(90, 0, -1), n0=100)
    s = files(spark, tmp_path, a, b).withColumnsRenamed({"key": "symbol", "value": "price", "event_id": "trade_id"}).withColumn("quantity", F.lit(1.0))
    got = drain(sw.stream_bars(s, "1 hour", "0 seconds")).sort_values("ts").reset_index(drop=True)
    d = spark.createDataFrame([(n, pd.Timestamp(t).to_pydatetime(), k, float(v)) for n, t, k, v in a + b], "trade_id BIGINT, ts TIMESTAMP, symbol STRING, price DOUBLE").withColumn("quantity", F.lit(1.0))
    want = bars_from_ticks(d, "1 hour", "price", "quantity", F.col("trade_id")).toPandas().sort_values("ts").reset_index(drop=True)
    assert len(got) == 2  # the last hour is still open
    pd.testing.assert_frame_equal(got[["open", "high", "low", "close", "volume"]], want[["open", "high", "low", "close", "volume"]][:2])


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """A row is late against the watermark the batch before it ran with, so two batches separate it from the jump."""
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [1, 1]), rows("2024-01-01 05:00", [1]), rows("2024-01-01 05:10", [1]), rows("2024-01-01 00:30", [1]), rows("2024-01-01 09:00", [1]))
    g = io.with_lateness(s, "ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("ts"), "n")
    base = scratch_path(spark, "late")
    q = io.write_stream(g, f"{base}/out", f"{base}/cp", availableNow=True)
    q.awaitTermination()
    out = {r["ts"].hour: r["n"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert out[0] == 2 and io.dropped_rows(q) == 1


def test_changes_across_batches(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [1, 1, 2]), rows("2024-01-01 00:10", [2, 3], n0=10), rows("2024-01-03 00:00", [5], key="b", n0=20))
    d = drain(state.detect_changes(s, "key", ["value"], 3600.0)).sort_values(["key", "ts"])
    assert list(d[d.key == "a"]["change"]) == ["open", "update", "update", "close"] and list(d[d.key == "a"]["value"]) == [1, 2, 3, 3]
    assert list(d[d.key == "b"]["change"]) == ["open"]


def test_balance_tolerance(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [100.0, 100.005, 100.02, 120.0])).withColumnsRenamed({"key": "account", "value": "balance"}).withColumn("used", F.lit(50.0))
    d = drain(state.balance_changes(s, 1e-4)).sort_values("ts")
    assert list(d[d.change != "close"]["balance"]) == [100.0, 100.02, 120.0] and d["margin_usage"].iloc[0] == pytest.approx(0.5)


def test_drawdown_across_batches(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [100, 120, 90]), rows("2024-01-01 01:00", [60, 130], n0=10)).withColumnsRenamed({"key": "account", "value": "equity"})
    d = drain(state.drawdown_monitor(s, 0.5)).sort_values("ts")
    assert list(d["peak"]) == [100, 120, 120, 120, 130] and list(d["level"]) == ["normal", "normal", "normal", "critical", "normal"]


def test_alert_life_cycle(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [1, 9, 9]), rows("2024-01-01 00:03", [9, 9, 1, 9, 1], n0=10)).withColumnRenamed("key", "metric")
    d = drain(state.alert_state(s, 5.0, 120.0)).sort_values(["ts"])
    assert list(d["status"]) == ["pending", "firing", "resolved", "pending"]
    assert list(d["ts"].dt.minute) == [1, 3, 5, 6]


def test_timeouts(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [0], "slow") + rows("2024-01-01 00:00", [0], "fast", 5), rows("2024-01-01 00:05", [1], "fast", 10), rows("2024-01-02 00:00", [0], "new", 20))
    d = drain(state.timeouts(s.withColumn("done", F.col("value") == 1), "key", 3600.0))
    assert list(d["key"]) == ["slow"] and d["expired"].iloc[0].hour == 1


def test_trailing_exit_restarts(spark, tmp_path):
    px = [100, 110, 99, 50, 80, 60, 39]
    s = files(spark, tmp_path, rows("2024-01-01 00:00", px[:3]), rows("2024-01-01 01:00", px[3:], n0=10)).withColumnsRenamed({"key": "symbol", "value": "price"})
    d = drain(state.trailing_exits(s, 0.1)).sort_values("ts")
    mark, want = float("-inf"), []
    for p in px:
        mark = max(mark, p)
        if p <= mark * 0.9:
            want.append((mark, p))
            mark = float("-inf")
    assert list(zip(d["mark"], d["price"])) == want


def test_margin_level_changes(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [10, 55, 56, 90])).withColumnsRenamed({"key": "account", "value": "used"}).withColumn("balance", F.lit(100.0))
    d = drain(state.margin_monitor(s)).sort_values("ts")
    assert list(d["level"]) == ["normal", "warning", "critical"]


def test_updates_over_several_batches(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [1, 2]), rows("2024-01-01 00:10", [3, 4], n0=10)).withColumnsRenamed({"key": "order_id", "value": "qty"})
    s = s.withColumns({"price": F.lit(2.0), "requested": F.lit(10.0)})
    d = io.drain(sw.fill_progress(s), "fills", "update", ["order_id"]).toPandas()
    assert len(d) == 1 and d["filled"].iloc[0] == 10 and d["complete"].iloc[0]


def test_idempotent_intake(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:00", [1, 2]), [(0, "2024-01-01 00:10", "a", 1), (7, "2024-01-01 00:11", "a", 1)])
    assert sorted(drain(sw.idempotent(s, "event_id"))["event_id"]) == [0, 1, 7]


def test_conflicting_payloads(spark, tmp_path):
    s = files(spark, tmp_path, [(1, "2024-01-01 00:00", "a", 1), (2, "2024-01-01 00:01", "a", 1)], [(1, "2024-01-01 00:02", "a", 9), (2, "2024-01-01 00:03", "a", 1)], [(3, "2024-01-02 00:00", "a", 1)])
    assert list(drain(sw.conflicts(s, "event_id", F.col("value")))["event_id"]) == [1]


def test_asof_enrichment(spark, tmp_path):
    s = files(spark, tmp_path, rows("2024-01-01 00:30", [1, 1], step="1h"), rows("2024-01-01 06:00", [1], n0=10)).withColumnRenamed("key", "symbol")
    rates = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00"]), "funding_rate": [0.1, 0.2]}))
    base = scratch_path(spark, "asof")
    sw.asof_enrich(s, lambda _: rates, 7200, f"{base}/out", f"{base}/cp", availableNow=True).awaitTermination()
    d = spark.read.parquet(f"{base}/out").toPandas().sort_values("ts")
    assert list(d["funding_rate"][:2]) == [0.1, 0.2] and pd.isna(d["funding_rate"].iloc[2])


def test_concentration_does_not_depend_on_the_batches(spark, tmp_path):
    """Positions held from earlier files, equity that moves other positions over and back, a late row, a missing value."""
    schema = "account INT, position STRING, ts TIMESTAMP, value DOUBLE, equity DOUBLE"
    at = lambda m: pd.Timestamp(2024, 1, 1, 0, m).to_pydatetime()
    feed = [(1, "a", at(1), 60.0, 100.0), (1, "b", at(2), 10.0, 100.0), (2, "a", at(3), 90.0, 100.0), (1, "b", at(4), None, 15.0), (2, "a", at(2), 10.0, 500.0),
            (3, "a", at(1), 80.0, 100.0), (3, "b", at(5), 10.0, 400.0), (4, "a", at(1), 9.0, 0.0), (5, "a", at(1), 9.0, 10.0), (5, "a", at(2), 0.0, 10.0)]
    want = {(1, "a", 4.0), (1, "b", 10.0 / 15.0), (2, "a", 0.9)}
    for n, parts in enumerate(([feed], [[r] for r in feed], [[r] for r in reversed(feed)])):
        path = str(tmp_path / f"in{n}")
        for rows_ in parts:
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
        got = io.drain(state.concentration(io.read_event_stream(spark, path, schema, 1), 0.5), "test", "update", ["account", "position"]).filter("breach")
        assert {(r["account"], r["position"], r["share"]) for r in got.collect()} == want
