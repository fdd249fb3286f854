"""Keyed stream operators that answer in event order, whatever the order of arrival inside the allowed delay.

A key's rows wait in its state until the watermark has passed them; then they are put in order of time and tie breaker and handed on.
Event-time timers release them, and fire deadlines, also for keys that get no further row. Rows behind the watermark are dropped by
Spark before they reach the state and counted in the query's progress (``io.dropped_rows``). A key that has been silent for
``gone_after`` seconds and holds nothing back is removed. The state of a key is bounded by its rows of one delay.

Rows newer than the newest event time minus the delay are still held back when a bounded run ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

DAY = 86400.0
_STATE = "held BINARY, kept STRING, seen BIGINT"
# Rows a step gets at a time as Python values; a key's waiting rows stay in columns.
STEP_ROWS = 10_000
_NEVER = -(1 << 62)


def _plain(b: pd.DataFrame, cols: list[str]) -> pa.Table:
    return pa.Table.from_pandas(b[cols], preserve_index=False)


def _read(held: bytes | None) -> list[pa.Table]:
    return [pa.ipc.open_stream(held).read_all()] if held else []


def _write(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def in_order(s: DataFrame, key: str, cols: list[str], out: str, step: Callable, start, delay: str = "10 minutes", tie: str = "event_id", gone_after: float = 7 * DAY) -> DataFrame:
    """Fold each key's rows in event order: ``step(kept, rows, upto)`` gets the key's own state, its next rows (us, tie, *cols) and the
    watermark in microseconds, and returns (kept, output rows, instant it wants to be called at or None). ``out`` is the schema of the
    output rows, which begin with microseconds ``us``; the key is put in front."""
    types = dict(s.dtypes)
    names = [f.split()[0] for f in out.split(", ")]
    span = int(gone_after * 1e6)

    order = [(c, "ascending") for c in ("us", tie, *cols)]

    def fn(k, batches, state):
        held, kept, seen = state.get if state.exists else (None, json.dumps(start), 0)
        held, kept = _read(bytes(held) if held is not None else None), json.loads(kept)
        upto = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            held.extend(_plain(b, [*dict.fromkeys(["us", tie, *cols])]) for b in batches if len(b))
        t = pa.concat_tables(held, promote_options="permissive") if held else None
        del held
        if t is not None and t.num_rows:
            seen = max(seen, pc.max(t["us"]).as_py())
            late = pc.greater(t["us"], upto)
            ready, t = t.filter(pc.invert(late)), t.filter(late)
            ready = ready.take(pc.sort_indices(ready, sort_keys=order))
        else:
            ready = None
        n = ready.num_rows if ready is not None else 0
        due = None
        for i in range(0, max(n, 1), STEP_ROWS):
            part = ready.slice(i, STEP_ROWS) if n else None
            rows = [list(r) for r in zip(*(part[c].to_pylist() for c in ("us", tie, *cols)))] if n else []
            # no deadline passes between two slices: the next row tells, or the watermark after the last one
            kept, found, due = step(kept, rows, upto if i + STEP_ROWS >= n else _NEVER)
            if found:
                yield pd.DataFrame([[k[0], *r] for r in found], columns=[key, *names])
        left = t is not None and t.num_rows > 0
        if not left and due is None and upto >= seen + span:
            state.remove()
        else:
            state.update((_write(t) if left else b"", json.dumps(kept), seen))
            wanted = [*([pc.min(t["us"]).as_py()] if left else []), *([due] if due is not None else [])] or [seen + span]
            state.setTimeoutTimestamp(max(min(wanted) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    d = s.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("us"), tie, *cols).where("us IS NOT NULL")
    res = d.groupBy(key).applyInPandasWithState(fn, f"{key} {types[key]}, {out}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return res.select(key, F.timestamp_micros("us").alias("ts"), *names[1:])


def drawdown(s: DataFrame, limit: float, key: str = "account", value: str = "equity", delay: str = "10 minutes", tie: str = "event_id", gone_after: float = 7 * DAY) -> DataFrame:
    """Running peak and drawdown of every update in event order, with a level against the limit (warning 60 %, danger 80 %, critical 100 % of it)."""

    def step(peak, rows, upto):
        out = []
        for us, n, v in rows:
            if v is None:
                continue
            peak = v if peak is None else max(peak, v)
            out.append([us, n, peak, (peak - v) / peak if peak > 0 else 0.0])
        return peak, out, None

    kind = dict(s.dtypes)[tie]
    d = in_order(s.withColumn(value, F.col(value).cast("double")), key, [value], f"us BIGINT, {tie} {kind}, peak DOUBLE, drawdown DOUBLE", step, None, delay, tie, gone_after)
    r = F.col("drawdown") / limit
    return d.withColumn("level", F.when(r >= 1, "critical").when(r >= 0.8, "danger").when(r >= 0.6, "warning").otherwise("normal"))


def margin_levels(s: DataFrame, thresholds=(0.5, 0.7, 0.85), key: str = "account", delay: str = "10 minutes", tie: str = "event_id", gone_after: float = 7 * DAY) -> DataFrame:
    """A row when the margin level of an account differs from the one before it in event order."""
    u = F.try_divide("used", "balance")
    level = F.when(u >= thresholds[2], "critical").when(u >= thresholds[1], "danger").when(u >= thresholds[0], "warning").otherwise("normal")

    def step(last, rows, upto):
        out = []
        for us, _, v in rows:
            if v != last:
                out.append([us, v])
                last = v
        return last, out, None

    return in_order(s.withColumn("level", level), key, ["level"], "us BIGINT, level STRING", step, None, delay, tie, gone_after)


def trailing(s: DataFrame, trail: float, key: str = "symbol", price: str = "price", delay: str = "10 minutes", tie: str = "event_id", gone_after: float = 7 * DAY) -> DataFrame:
    """A row whenever the price, in event order, falls ``trail`` below its highest value since the last exit; the mark then restarts."""

    def step(mark, rows, upto):
        out = []
        for us, _, p in rows:
            if p is None:
                continue
            mark = p if mark is None else max(mark, p)
            if p <= mark * (1 - trail):
                out.append([us, mark, p])
                mark = None
        return mark, out, None

    return in_order(s.withColumn(price, F.col(price).cast("double")), key, [price], "us BIGINT, mark DOUBLE, price DOUBLE", step, None, delay, tie, gone_after)


def alerts(s: DataFrame, threshold: float, hold: float, key: str = "metric", value: str = "value", delay: str = "10 minutes", tie: str = "event_id", gone_after: float = 7 * DAY) -> DataFrame:
    """Alert life cycle per key: ``pending`` when the value goes over the threshold, ``firing`` once it has stayed over it for ``hold``
    seconds, ``resolved`` when it is back. A timer fires the alert at that instant, with the last value, though no further row comes."""
    span = int(hold * 1e6)

    def step(kept, rows, upto):
        since, last, firing = kept
        out = []

        def fire(now):
            nonlocal firing
            if since is not None and not firing and since + span <= now:
                firing = True
                out.append([since + span, "firing", last])

        for us, _, v in rows:
            fire(us)
            if v is None:
                continue
            if v > threshold:
                if since is None:
                    since = us
                    out.append([us, "pending", v])
                last = v
            else:
                if firing:
                    out.append([us, "resolved", v])
                since, last, firing = None, None, False
        fire(upto)
        return [since, last, firing], out, since + span if since is not None and not firing else None

    return in_order(s.withColumn(value, F.col(value).cast("double")), key, [value], "us BIGINT, status STRING, value DOUBLE", step, [None, None, False], delay, tie, gone_after)


def intake(s: DataFrame, id_col: str, payload: str, ttl: float, delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Idempotent intake: the first row of an id is ``accepted`` and answers for the id for ``ttl`` seconds; a row of that time with the
    same payload is a repetition and gives nothing, one with another payload is a ``conflict``. After that the id is free again, and its
    state is dropped."""
    span = int(ttl * 1e6)

    def step(kept, rows, upto):
        out = []
        for us, n, p in rows:
            if kept is None or us > kept[0] + span:
                kept = [us, p]
                out.append([us, n, "accepted", p])
            elif p != kept[1]:
                out.append([us, n, "conflict", p])
        return kept, out, None

    kind = dict(s.dtypes)[tie]
    return in_order(s.withColumn(payload, F.col(payload).cast("string")), id_col, [payload], f"us BIGINT, {tie} {kind}, status STRING, {payload} STRING", step, None, delay, tie, ttl)
