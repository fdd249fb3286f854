"""Keyed stream operators give one answer for one file, for many files, and for files that arrive in any order inside the delay."""

import os
import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factorspark.session import scratch_path
from factorspark.streaming import io, ordered, state

SCHEMA = "event_id BIGINT, ts TIMESTAMP, key STRING, value DOUBLE"


def feed(n=160, keys=4, seed=1):
    rng = random.Random(seed)
    at = pd.Timestamp(2024, 1, 1)
    rows = [(i, (at + pd.Timedelta(seconds=30 * i)).to_pydatetime(), f"k{rng.randrange(keys)}", float(rng.randint(1, 100))) for i in range(n)]
    # a last row far ahead of all others lets the watermark pass them
    return rows, (n, (at + pd.Timedelta(days=30)).to_pydatetime(), "end", 1.0)


def arrivals(rows):
    """One file; many; many in another order, no row more than nine minutes behind a newer one."""
    parts = [rows[i:i + 6] for i in range(0, len(rows), 6)]  # three minutes each
    mixed = []
    for i in range(0, len(parts), 3):
        mixed += parts[i:i + 3][::-1]
    return {"one": [rows], "many": parts, "mixed": mixed}


def put(path, parts):
    """Each part becomes one file; files are read in the order of their times."""
    os.makedirs(path)
    kind = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("key", pa.string()), ("value", pa.float64())])
    for i, part in enumerate(parts):
        cols = list(zip(*part))
        cols[1] = [pd.Timestamp(t, tz="UTC") for t in cols[1]]
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(cols, kind)], schema=kind), f"{path}/{i:03}.parquet")
        os.utime(f"{path}/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def run(spark, tmp_path, rows, last, op):
    out = {}
    for name, parts in arrivals(rows).items():
        path = str(tmp_path / name)
        put(path, [*parts, [last]])
        got = io.drain(op(io.read_event_stream(spark, path, SCHEMA, 8)), "test").collect()
        out[name] = sorted((tuple(r) for r in got if r[0] != "end"), key=str)
    assert out["one"] == out["many"] == out["mixed"] and out["one"]
    return out["one"]


def by_key(rows):
    keys = {}
    for r in rows:
        keys.setdefault(r[2], []).append(r)
    return keys.items()


def test_drawdown_in_any_order(spark, tmp_path):
    rows, last = feed()
    got = run(spark, tmp_path, rows, last, lambda s: ordered.drawdown(s, 0.5, "key", "value"))
    want = []
    for k, own in by_key(rows):
        peak = 0.0
        for n, ts, _, v in own:
            peak = max(peak, v)
            d = (peak - v) / peak
            want.append((k, ts, n, peak, d, "critical" if d / 0.5 >= 1 else "danger" if d / 0.5 >= 0.8 else "warning" if d / 0.5 >= 0.6 else "normal"))
    assert got == sorted(want, key=str)


def test_margin_levels_in_any_order(spark, tmp_path):
    rows, last = feed(seed=2)
    got = run(spark, tmp_path, rows, last, lambda s: ordered.margin_levels(s.withColumns({"used": F.col("value"), "balance": F.lit(100.0)}), key="key"))
    want = []
    for k, own in by_key(rows):
        before = None
        for _, ts, _, v in own:
            level = "critical" if v >= 85 else "danger" if v >= 70 else "warning" if v >= 50 else "normal"
            if level != before:
                want.append((k, ts, level))
            before = level
    assert got == sorted(want, key=str)


def test_trailing_exits_in_any_order(spark, tmp_path):
    rows, last = feed(seed=3)
    got = run(spark, tmp_path, rows, last, lambda s: ordered.trailing(s, 0.5, "key", "value"))
    want = []
    for k, own in by_key(rows):
        mark = float("-inf")
        for _, ts, _, p in own:
            mark = max(mark, p)
            if p <= mark * 0.5:
                want.append((k, ts, mark, p))
                mark = float("-inf")
    assert got == sorted(want, key=str)


def test_alerts_in_any_order(spark, tmp_path):
    rows, last = feed(seed=4)
    got = run(spark, tmp_path, rows, last, lambda s: ordered.alerts(s, 30.0, 240.0, "key"))
    want = []
    for k, own in by_key(rows):
        since = value = None
        firing = False
        for _, ts, _, v in [*own, (0, last[1], k, None)]:
            if since is not None and not firing and ts >= since + pd.Timedelta(seconds=240):
                want.append((k, (since + pd.Timedelta(seconds=240)).to_pydatetime(), "firing", value))
                firing = True
            if v is None:
                break
            if v > 30:
                if since is None:
                    since = pd.Timestamp(ts)
                    want.append((k, ts, "pending", v))
                value = v
            else:
                if firing:
                    want.append((k, ts, "resolved", v))
                since, firing = None, False
    assert got == sorted(want, key=str) and {r[2] for r in got} == {"pending", "firing", "resolved"}


def test_alert_fires_in_silence(spark, tmp_path):
    """One row over the threshold and nothing more of that key: the clock of the others fires it."""
    path = str(tmp_path / "in")
    at = lambda m: pd.Timestamp(2024, 1, 1, m // 60, m % 60).to_pydatetime()
    put(path, ([(0, at(0), "quiet", 9.0)], [(1, at(10), "other", 1.0)], [(2, at(40), "other", 1.0)], [(3, at(50), "other", 1.0)]))
    got = [tuple(r) for r in io.drain(ordered.alerts(io.read_event_stream(spark, path, SCHEMA, 1), 5.0, 300.0, "key"), "test").collect()]
    assert sorted(got, key=str) == [("quiet", at(0), "pending", 9.0), ("quiet", at(5), "firing", 9.0)]


@pytest.mark.parametrize("ttl", [120.0, 900.0])
def test_intake_in_any_order(spark, tmp_path, ttl):
    rows, last = feed(seed=5, keys=3)
    rows = [(n, ts, k, float(int(v) % 3)) for n, ts, k, v in rows]
    got = run(spark, tmp_path, rows, last, lambda s: ordered.intake(s.withColumn("payload", F.col("value").cast("int")), "key", "payload", ttl))
    want = []
    for k, own in by_key(rows):
        kept = None
        for n, ts, _, v in own:
            p = str(int(v))
            if kept is None or ts > kept[0] + pd.Timedelta(seconds=ttl):
                kept = (ts, p)
                want.append((k, ts, n, "accepted", p))
            elif p != kept[1]:
                want.append((k, ts, n, "conflict", p))
    assert got == sorted(want, key=str) and {r[3] for r in got} == {"accepted", "conflict"}


def test_late_rows_are_counted_and_silent_keys_go(spark, tmp_path):
    path, at = str(tmp_path / "in"), lambda d, m=0: pd.Timestamp(2024, 1, d, 0, m).to_pydatetime()
    put(path, ([(0, at(1), "a", 10.0)], [(1, at(3), "b", 10.0)], [(2, at(3, 5), "b", 10.0)], [(3, at(1, 1), "a", 99.0)], [(4, at(20), "b", 10.0)], [(5, at(20, 1), "b", 10.0)], [(6, at(20, 30), "a", 5.0)], [(7, at(21), "b", 1.0)], [(8, at(22), "b", 1.0)]))
    d = ordered.drawdown(io.read_event_stream(spark, path, SCHEMA, 1), 0.5, "key", "value", gone_after=86400.0)
    base = scratch_path(spark, "late")
    q = io.write_stream(d, f"{base}/out", f"{base}/cp", availableNow=True)
    q.awaitTermination()
    own = {r["event_id"]: r["peak"] for r in spark.read.parquet(f"{base}/out").collect() if r["key"] == "a"}
    assert io.dropped_rows(q) == 1
    assert own == {0: 10.0, 6: 5.0}  # the late row is not counted in; after weeks of silence the key begins anew


def test_a_hot_key_is_stepped_in_slices(spark):
    """A key's rows of one micro-batch stay in columns; a step once got all 25,000 as Python lists."""
    path = scratch_path(spark, "hot")
    n = 25_000
    d = spark.range(n).selectExpr("'k' AS metric", "id AS event_id", "timestamp_seconds(1700000000 + pmod(id * 7919, 25000)) AS ts", "CAST(pmod(id * 7919, 25000) % 100 AS DOUBLE) AS value")
    d.unionByName(d.limit(1).selectExpr("'other' AS metric", "event_id", "ts + INTERVAL 2 DAYS AS ts", "value")).coalesce(1).write.parquet(path)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def step(kept, rows, upto):
        us = [r[0] for r in rows]
        return max([kept, *us]), [[us[0], len(rows), us == sorted(us) and us[0] > kept]] if us else [], None

    got = io.drain(ordered.in_order(s, "metric", ["value"], "us BIGINT, rows BIGINT, ok BOOLEAN", step, 0), "hot").filter("metric = 'k'").toPandas()
    assert got["rows"].sum() == n and got["rows"].max() <= ordered.STEP_ROWS and got["ok"].all()
    fired = io.drain(ordered.alerts(s, 20.0, 30.0), "hot_alerts").filter("metric = 'k'").toPandas()
    assert (fired["status"] == "pending").sum() == 250 and (fired["status"] == "firing").sum() == 250 and (fired["status"] == "resolved").sum() == 249
    plain = io.drain(state.alert_state(s, 20.0, 30.0), "hot_state").filter("metric = 'k'").toPandas()
    assert (plain["status"] == "pending").sum() == 250 and (plain["status"] == "firing").sum() == 250 and (plain["status"] == "resolved").sum() == 249
