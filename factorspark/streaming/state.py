"""Custom keyed state: change detection, drawdown, alerts, timeouts, trailing exits.

State is a few numbers per key. A key's rows of one micro-batch arrive together, so the micro-batch size
(files or bytes per trigger) bounds what one call sees; rows are put in event-time order inside the call.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_TIME = GroupStateTimeout.EventTimeTimeout
NO_TIMEOUT = GroupStateTimeout.NoTimeout
# Rows of a key that are Python values at a time.
STEP_ROWS = 10_000


def _rows(batches: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)


def _sec(ts) -> float:
    return pd.Timestamp(ts).timestamp()


def detect_changes(s: DataFrame, key: str, cols: list[str], gone_after: float, delay: str = "10 minutes", tie: str = "event_id", tol: float = 0.0) -> DataFrame:
    """Emit a row when a keyed record differs from the last one seen, and a ``close`` row when the key has been
    silent for ``gone_after`` seconds of event time. Numbers differ when they move by more than ``tol`` of the last."""
    types = dict(s.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in cols)
    out = f"{key} {types[key]}, us BIGINT, change STRING, {fields}"
    span = int(gone_after * 1e6)
    numeric = {c for c in cols if types[c] in ("double", "float", "bigint", "int")}

    def same(a, b, c):
        if a is None or b is None or (isinstance(a, float) and np.isnan(a)):
            return a is b
        return abs(b - a) <= tol * abs(a) if c in numeric else a == b

    def fn(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield pd.DataFrame([[k[0], last[0], "close", *last[1:]]], columns=[key, "us", "change", *cols])
            return
        pdf = _rows(batches, ["us", tie])
        last = state.get if state.exists else None
        rows = []
        for t, *vals in pdf[["us", *cols]].itertuples(index=False, name=None):
            if last is not None and t - last[0] > span:
                rows.append([k[0], last[0], "close", *last[1:]])
                last = None
            if last is None:
                rows.append([k[0], t, "open", *vals])
                last = (t, *vals)
            elif not all(same(a, b, c) for a, b, c in zip(last[1:], vals, cols)):
                rows.append([k[0], t, "update", *vals])
                last = (t, *vals)
            else:
                last = (max(last[0], t), *last[1:])
        state.update(last)
        state.setTimeoutTimestamp(max((last[0] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, "us", "change", *cols])

    d = s.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("us"), tie, *[c for c in cols if c not in (key, tie)])
    st = "seen BIGINT, " + ", ".join(f"_{c} {types[c]}" for c in cols)
    out_df = d.groupBy(key).applyInPandasWithState(fn, out, st, "append", EVENT_TIME)
    return out_df.select(key, F.timestamp_micros("us").alias("ts"), "change", *cols)


def balance_changes(s: DataFrame, tol: float = 1e-4, key: str = "account", delay: str = "10 minutes", gone_after: float = 86400.0) -> DataFrame:
    """Balance updates that move by more than a relative tolerance, with margin usage."""
    c = detect_changes(s, key, ["balance", "used"], gone_after, delay, tol=tol)
    return c.withColumn("margin_usage", F.try_divide("used", "balance"))


def margin_monitor(s: DataFrame, thresholds=(0.5, 0.7, 0.85), key: str = "account", delay: str = "10 minutes") -> DataFrame:
    """Emit when the margin level of an account changes."""
    u = F.try_divide("used", "balance")
    level = F.when(u >= thresholds[2], "critical").when(u >= thresholds[1], "danger").when(u >= thresholds[0], "warning").otherwise("normal")
    return detect_changes(s.withColumn("level", level), key, ["level"], 86400.0 * 365, delay)


def drawdown_monitor(s: DataFrame, limit: float, key: str = "account", value: str = "equity", delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Running peak and drawdown of every update with a level against the limit (warning 60%, danger 80%, critical 100% of it)."""
    types = dict(s.dtypes)
    out = f"{key} {types[key]}, {tie} {types[tie]}, ts TIMESTAMP, peak DOUBLE, drawdown DOUBLE"

    def fn(k, batches, state):
        pdf = _rows(batches, ["ts", tie])
        start = state.get[0] if state.exists else -np.inf
        v = pdf[value].to_numpy(dtype=float)
        peak = np.maximum.accumulate(np.maximum(v, start))
        state.update((float(peak[-1]),))
        dd = np.divide(peak - v, peak, out=np.zeros_like(v), where=peak > 0)
        yield pd.DataFrame({key: k[0], tie: pdf[tie], "ts": pdf["ts"], "peak": peak, "drawdown": dd})

    d = s.withWatermark("ts", delay).select(key, tie, "ts", value).groupBy(key).applyInPandasWithState(fn, out, "peak DOUBLE", "append", NO_TIMEOUT)
    r = F.col("drawdown") / limit
    return d.withColumn("level", F.when(r >= 1, "critical").when(r >= 0.8, "danger").when(r >= 0.6, "warning").otherwise("normal"))


def alert_state(s: DataFrame, threshold: float, hold: float, key: str = "metric", value: str = "value", delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Alert life cycle per key: pending when over the threshold, firing after ``hold`` seconds over it, resolved when back under it."""
    types = dict(s.dtypes)
    out = f"{key} {types[key]}, ts TIMESTAMP, status STRING, value DOUBLE"

    def fn(k, batches, state):
        # three numbers a row: a key may bring most of a micro-batch
        pdf = _rows((b[["ts", tie, value]] for b in batches), ["ts", tie])
        since, firing = state.get if state.exists else (-1.0, False)
        for i in range(0, len(pdf), STEP_ROWS):
            rows = []
            for ts, v in zip(pdf["ts"].iloc[i:i + STEP_ROWS], pdf[value].iloc[i:i + STEP_ROWS]):
                t = _sec(ts)
                if v > threshold:
                    if since < 0:
                        since = t
                        if hold > 0:
                            rows.append([k[0], ts, "pending", v])
                    if not firing and t - since >= hold:
                        firing = True
                        rows.append([k[0], ts, "firing", v])
                else:
                    if firing:
                        rows.append([k[0], ts, "resolved", v])
                    since, firing = -1.0, False
            yield pd.DataFrame(rows, columns=[key, "ts", "status", "value"])
        state.update((since, firing))

    d = s.withWatermark("ts", delay).select(key, "ts", tie, F.col(value).cast("double").alias(value))
    return d.groupBy(key).applyInPandasWithState(fn, out, "since DOUBLE, firing BOOLEAN", "append", NO_TIMEOUT)


def timeouts(s: DataFrame, id_col: str, after: float, done: str = "done", delay: str = "10 minutes") -> DataFrame:
    """An ``expired`` row for each id that was opened and not completed within ``after`` seconds of event time."""
    types = dict(s.dtypes)
    out = f"{id_col} {types[id_col]}, opened BIGINT, expired BIGINT"
    span = int(after * 1e6)
    never = 1 << 62

    def fn(k, batches, state):
        opened, closed = state.get if state.exists else (never, never)
        if state.hasTimedOut:
            state.remove()
            if opened < never and closed > opened + span:
                yield pd.DataFrame({id_col: [k[0]], "opened": [opened], "expired": [opened + span]})
            return
        pdf = _rows(batches, ["us"])
        is_done = pdf[done].astype(bool)
        opened = min(opened, int(pdf["us"][~is_done].min()) if (~is_done).any() else never)
        closed = min(closed, int(pdf["us"][is_done].min()) if is_done.any() else never)
        state.update((opened, closed))
        due = (opened if opened < never else closed) + span
        state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    d = s.withWatermark("ts", delay).select(id_col, "ts", F.unix_micros("ts").alias("us"), done)
    res = d.groupBy(id_col).applyInPandasWithState(fn, out, "opened BIGINT, closed BIGINT", "append", EVENT_TIME)
    return res.select(id_col, F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("expired").alias("expired"))


def trailing_exits(s: DataFrame, trail: float, key: str = "symbol", price: str = "price", delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """A row whenever the price falls ``trail`` below its highest value since the last exit; the mark then restarts."""
    types = dict(s.dtypes)
    out = f"{key} {types[key]}, ts TIMESTAMP, mark DOUBLE, price DOUBLE"

    def fn(k, batches, state):
        pdf = _rows(batches, ["ts", tie])
        mark = state.get[0] if state.exists else -np.inf
        rows = []
        for ts, p in zip(pdf["ts"], pdf[price]):
            mark = max(mark, p)
            if p <= mark * (1 - trail):
                rows.append([k[0], ts, mark, p])
                mark = -np.inf
        state.update((float(mark),))
        yield pd.DataFrame(rows, columns=[key, "ts", "mark", "price"])

    d = s.withWatermark("ts", delay).select(key, "ts", tie, price)
    return d.groupBy(key).applyInPandasWithState(fn, out, "mark DOUBLE", "append", NO_TIMEOUT)


def concentration(s: DataFrame, limit: float, account: str = "account", position: str = "position", value: str = "value", equity: str = "equity") -> DataFrame:
    """Share of each position in its account's equity, whenever a position goes over the limit, moves while over it, or comes back.

    Kept per account: the newest equity and the newest value of each position held, however long ago it came; an older row
    never replaces a newer one, so the last state of a key does not depend on how the rows fall into micro-batches. Of equal
    instants the larger value counts. A missing value changes nothing; a position of value 0 is closed (its instant stays, so an older row cannot open it again).
    Without positive equity there is no share. Runs in update mode: the row of a key's last micro-batch is its present state.
    """
    types = dict(s.dtypes)

    def newer(old, us, v):
        return old is None or (us, v) >= (old[0], old[1])

    def fn(k, batches: Iterable[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        wealth, held = (json.loads(st.get[0]) if st.exists else (None, {}))
        for rows in batches:
            best = rows.dropna(subset=["_equity"]).sort_values(["us", "_equity"]).tail(1)
            for us, v in zip(best["us"].tolist(), best["_equity"].tolist()):
                wealth = [us, v] if newer(wealth, us, v) else wealth
            best = rows.dropna(subset=["_position", "_value"]).sort_values(["us", "_value"]).groupby("_position", sort=True).tail(1)
            for name, us, v in zip(best["_position"].tolist(), best["us"].tolist(), best["_value"].tolist()):
                old = held.get(name)
                if newer(old, us, v):
                    held[name] = [us, v, old[2] if old else None]
        out = []
        for name, (us, v, told) in list(held.items()):
            share = v / wealth[1] if wealth and wealth[1] > 0 else None
            over = share is not None and share > limit
            if (over and share != told) or (not over and told is not None):
                out.append((k[0], name, share, over))
            held[name][2] = share if over else None
        st.update((json.dumps([wealth, held]),))
        yield pd.DataFrame(out, columns=["account", "position", "share", "breach"])

    d = s.select(F.col(account).alias("_account"), F.col(position).cast("string").alias("_position"), F.unix_micros("ts").alias("us"),
                 F.col(value).cast("double").alias("_value"), F.col(equity).cast("double").alias("_equity")).filter(F.col("us").isNotNull())
    out = f"account {types[account]}, position STRING, share DOUBLE, breach BOOLEAN"
    return d.groupBy("_account").applyInPandasWithState(fn, out, "kept STRING", "update", NO_TIMEOUT)
