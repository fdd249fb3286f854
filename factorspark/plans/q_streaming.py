"""Streaming queries: the given events read as a stream and run over everything available."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.operators.resample import liquidation_sums  # noqa: F401
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import CTE
from factorspark.plans.q_sources import books
from factorspark.plans.registry import query
from factorspark.session import scratch_path
from factorspark.sources import keyed
from factorspark.streaming import io, ordered, state
from factorspark.streaming import windows as sw

c = F.col
# A window is out once its end is not after the watermark (newest event minus delay).
WM = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def events(t):
    return io.read_event_stream(t.spark, f"{t.dir}/events*.parquet")


def ticks(t):
    return events(t).select(c("event_id").alias("trade_id"), c("event_type").alias("symbol"), "ts", c("value").alias("price"), F.lit(1.0).alias("quantity"))


@query("s19_event_stream", "SELECT event_id, ts, event_type, value FROM events", "", "value @ts")
def _(t):
    return io.drain(events(t).select("event_id", "ts", "event_type", "value"), "events")


@query("s20_stream_sink_idempotent", "SELECT user_id, count(*) > 0 AS stored FROM events GROUP BY 1")
def _(t):
    base = scratch_path(t.spark, "sink")
    io.write_idempotent(events(t).select("user_id"), f"{base}/table", f"{base}/checkpoint", ["user_id"], buckets=16, availableNow=True).awaitTermination()
    return keyed.read_inserted(t.spark, f"{base}/table").groupBy("user_id").agg((F.count("*") == 1).alias("stored"))


@query("s17_stream_upserts", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", "", "value")
def _(t):
    base = scratch_path(t.spark, "upserts")
    s = events(t).select("user_id", "value", F.struct("ts", "event_id").alias("at"))
    io.write_upserts(s, f"{base}/table", f"{base}/checkpoint", ["user_id"], "at", buckets=16, availableNow=True).awaitTermination()
    return keyed.read_upserted(t.spark, f"{base}/table").select("user_id", "value")


@query("t01_stream_bars", f"SELECT symbol, ts, open, high, low, close, CAST(trades AS DOUBLE) AS volume FROM th WHERE ts + INTERVAL 1 HOUR <= {WM}", "th", "open high low close volume @ts")
def _(t):
    return io.drain(sw.stream_bars(ticks(t), "1 hour", "10 minutes"), "bars")


@query("t02_sliding_stats",
       f"""WITH w AS (SELECT event_type AS symbol, value, date_trunc('hour', ts) - INTERVAL (k) HOUR AS ts FROM events, (SELECT unnest([0, 1]) AS k))
       SELECT symbol, ts, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM w WHERE ts + INTERVAL 2 HOUR <= {WM} GROUP BY 1, 2""", "", "mean std @ts")
def _(t):
    return io.drain(sw.sliding_stats(ticks(t), "2 hours", "1 hour", "10 minutes"), "sliding")


_GAPS = """g0 AS (SELECT user_id AS account, ts, event_id, event_type, lag(event_type) OVER w AS prev, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("t03_detect_changes",
       f"""WITH {_GAPS} SELECT account, event_type, CASE WHEN prev IS NULL OR gap > 172800 THEN 'open' ELSE 'update' END AS change, count(*) AS n FROM g0
       WHERE prev IS NULL OR gap > 172800 OR prev <> event_type GROUP BY 1, 2, 3""")
def _(t):
    s = events(t).withColumnRenamed("user_id", "account")
    d = io.drain(state.detect_changes(s, "account", ["event_type"], 172800.0), "changes")
    return d.filter("change <> 'close'").groupBy("account", "event_type", "change").agg(F.count("*").alias("n"))


@query("t03_closed_keys",
       f"""WITH {_GAPS}, l AS (SELECT user_id AS account, max(ts) AS last FROM events GROUP BY 1)
       SELECT account, count(*) AS n FROM (SELECT account FROM g0 WHERE gap > 172800 UNION ALL SELECT account FROM l WHERE last + INTERVAL 48 HOUR < {WM}) GROUP BY 1""")
def _(t):
    s = events(t).withColumnRenamed("user_id", "account")
    d = io.drain(state.detect_changes(s, "account", ["event_type"], 172800.0), "closed")
    return d.filter("change = 'close'").groupBy("account").agg(F.count("*").alias("n"))


def _balances(t):
    return events(t).select(c("user_id").alias("account"), "ts", "event_id", (c("value") * 10 + 5000).alias("balance"), (c("value") * 20).alias("used"))


@query("t04_balance_changes")
def _(t):
    return io.drain(state.balance_changes(_balances(t), 0.05), "balances")


_EQ = """SELECT user_id AS account, event_id, ts, max(value) OVER w AS peak, (max(value) OVER w - value) / max(value) OVER w AS drawdown FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("t05_drawdown_monitor",
       f"SELECT *, CASE WHEN drawdown / 0.5 >= 1 THEN 'critical' WHEN drawdown / 0.5 >= 0.8 THEN 'danger' WHEN drawdown / 0.5 >= 0.6 THEN 'warning' ELSE 'normal' END AS level FROM ({_EQ})", "", "peak drawdown @ts")
def _(t):
    s = events(t).select(c("user_id").alias("account"), "event_id", "ts", c("value").alias("equity"))
    return io.drain(state.drawdown_monitor(s, 0.5), "drawdown")


@query("t06_daily_loss",
       "SELECT user_id AS account, date_trunc('day', ts) AS day, sum(CASE WHEN value < 50 THEN 50 - value ELSE 0 END) AS loss, sum(value - 50) AS net, sum(CASE WHEN value < 50 THEN 50 - value ELSE 0 END) > 60 AS breached FROM events GROUP BY 1, 2", "", "loss net @day")
def _(t):
    s = events(t).select(c("user_id").alias("account"), "ts", (c("value") - 50).alias("pnl"))
    return io.drain(sw.daily_loss(s, 60.0), "loss", "update", ["account", "day"])


@query("t07_concentration_monitor",
       """WITH p AS (SELECT user_id AS account, event_type AS position, arg_max(value, ts) AS value FROM events GROUP BY 1, 2), e AS (SELECT user_id AS account, arg_max(value * 2 + 100, ts) AS equity FROM events GROUP BY 1)
       SELECT account, position, value / equity AS share FROM p JOIN e USING (account) WHERE value / equity > 0.5""", "", "share")
def _(t):
    s = events(t).select(c("user_id").alias("account"), c("event_type").alias("position"), "ts", "value", (c("value") * 2 + 100).alias("equity"))
    return io.drain(state.concentration(s, 0.5), "concentration", "update", ["account", "position"]).filter("breach").select("account", "position", "share")


@query("t08_alert_state")
def _(t):
    s = events(t).select(c("event_type").alias("metric"), "ts", "event_id", "value")
    return io.drain(state.alert_state(s, 20.0, 600.0), "alerts")


@query("t05_drawdown_ordered",
       f"SELECT account, ts, event_id, peak, drawdown, CASE WHEN drawdown / 0.5 >= 1 THEN 'critical' WHEN drawdown / 0.5 >= 0.8 THEN 'danger' WHEN drawdown / 0.5 >= 0.6 THEN 'warning' ELSE 'normal' END AS level FROM ({_EQ}) WHERE ts <= {WM}", "", "peak drawdown @ts")
def _(t):
    s = events(t).select(c("user_id").alias("account"), "event_id", "ts", c("value").alias("equity"))
    return io.drain(ordered.drawdown(s, 0.5), "drawdown_ordered")


# islands of values over the threshold; an island ends with the next row that is not over it
@query("t08_alert_timer",
       f"""WITH e AS (SELECT event_type AS metric, ts, event_id, value, value > 20 AS hot, lag(value > 20) OVER w AS was FROM events WHERE ts <= {WM} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       n AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY metric ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM e),
       s AS (SELECT metric, i, min(ts) FILTER (hot) AS since, min(ts) FILTER (NOT hot) AS back, min_by(value, (ts, event_id)) FILTER (hot) AS first_value, min_by(value, (ts, event_id)) FILTER (NOT hot) AS back_value FROM n WHERE i > 0 GROUP BY 1, 2),
       f AS (SELECT s.*, since + INTERVAL 600 SECOND AS due FROM s WHERE since + INTERVAL 600 SECOND <= coalesce(back, {WM}))
       SELECT metric, since AS ts, 'pending' AS status, first_value AS value FROM s
       UNION ALL SELECT f.metric, due, 'firing', (SELECT max_by(n.value, (n.ts, n.event_id)) FROM n WHERE n.metric = f.metric AND n.i = f.i AND n.hot AND n.ts < f.due) FROM f
       UNION ALL SELECT metric, back, 'resolved', back_value FROM f WHERE back IS NOT NULL""", "", "value @ts")
def _(t):
    s = events(t).select(c("event_type").alias("metric"), "ts", "event_id", "value")
    return io.drain(ordered.alerts(s, 20.0, 600.0), "alert_timer")


_RULES = [("click", 200.0), ("view", 250.0), ("error", 100.0)]


@query("t09_apply_rules",
       "SELECT event_type AS metric, event_id, value, threshold FROM events JOIN (VALUES ('click', 200.0), ('view', 250.0), ('error', 100.0)) AS r(m, threshold) ON event_type = m WHERE value > threshold", "", "value threshold")
def _(t):
    rules = t.spark.createDataFrame(_RULES, "metric STRING, threshold DOUBLE")
    s = events(t).select(c("event_type").alias("metric"), "event_id", "value")
    return io.drain(sw.apply_rules(s, rules), "rules")


@query("t10_margin_monitor",
       """WITH l AS (SELECT user_id AS account, ts, event_id, CASE WHEN u >= 0.85 THEN 'critical' WHEN u >= 0.7 THEN 'danger' WHEN u >= 0.5 THEN 'warning' ELSE 'normal' END AS level FROM (SELECT *, value * 20 / (value * 10 + 1000) AS u FROM events)),
       p AS (SELECT *, lag(level) OVER (PARTITION BY account ORDER BY ts, event_id) AS prev FROM l) SELECT account, ts, level FROM p WHERE prev IS NULL OR prev <> level""", "", "@ts")
def _(t):
    s = events(t).select(c("user_id").alias("account"), "ts", "event_id", (c("value") * 10 + 1000).alias("balance"), (c("value") * 20).alias("used"))
    return io.drain(state.margin_monitor(s), "margin").filter("change <> 'close'").select("account", "ts", "level")


@query("t10_margin_ordered",
       f"""WITH l AS (SELECT user_id AS account, ts, event_id, CASE WHEN u >= 0.85 THEN 'critical' WHEN u >= 0.7 THEN 'danger' WHEN u >= 0.5 THEN 'warning' ELSE 'normal' END AS level FROM (SELECT *, value * 20 / (value * 10 + 1000) AS u FROM events)),
       p AS (SELECT *, lag(level) OVER (PARTITION BY account ORDER BY ts, event_id) AS prev FROM l) SELECT account, ts, level FROM p WHERE (prev IS NULL OR prev <> level) AND ts <= {WM}""", "", "@ts")
def _(t):
    s = events(t).select(c("user_id").alias("account"), "ts", "event_id", (c("value") * 10 + 1000).alias("balance"), (c("value") * 20).alias("used"))
    return io.drain(ordered.margin_levels(s), "margin_ordered")


@query("t11_intake",
       f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, event_type FROM events WHERE ts <= {WM}),
       a AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT a.user_id, min(e.ts) FROM a JOIN e ON e.user_id = a.user_id AND e.ts > a.ts + INTERVAL 1 DAY GROUP BY a.user_id, a.ts),
       x AS (SELECT a.user_id, a.ts AS at, e.ts, e.event_id, e.event_type, first_value(e.event_type) OVER w AS kept, row_number() OVER w AS r FROM a JOIN e ON e.user_id = a.user_id AND e.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY
             WINDOW w AS (PARTITION BY a.user_id, a.ts ORDER BY e.ts, e.event_id))
       SELECT user_id, ts, event_id, CASE WHEN r = 1 THEN 'accepted' ELSE 'conflict' END AS status, event_type AS payload FROM x WHERE r = 1 OR event_type <> kept""", "", "@ts")
def _(t):
    s = events(t).select("user_id", "ts", "event_id", c("event_type").alias("payload"))
    return io.drain(ordered.intake(s, "user_id", "payload", 86400.0), "intake")


@query("t11_idempotent", "SELECT DISTINCT user_id FROM events")
def _(t):
    return io.drain(sw.idempotent(events(t).select("user_id", "ts"), "user_id", "1 hour"), "dedup").select("user_id")


@query("t11_conflicts",
       f"""SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING min(event_type) <> max(event_type) AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", "", "@ts")
def _(t):
    return io.drain(sw.conflicts(events(t), "user_id", c("event_type")), "conflicts")


@query("t12_timeouts",
       f"""WITH o AS (SELECT user_id, min(ts) FILTER (event_type <> 'purchase') AS opened, min(ts) FILTER (event_type = 'purchase') AS closed FROM events GROUP BY 1)
       SELECT user_id, opened, opened + INTERVAL 24 HOUR AS expired FROM o WHERE opened IS NOT NULL AND coalesce(closed > opened + INTERVAL 24 HOUR, true) AND opened + INTERVAL 24 HOUR < {WM}""", "", "@opened @expired")
def _(t):
    s = events(t).select("user_id", "ts", (c("event_type") == "purchase").alias("done"))
    return io.drain(state.timeouts(s, "user_id", 86400.0), "timeouts")


@query("t13_fill_progress",
       "SELECT user_id AS order_id, 3000.0 AS requested, sum(value) AS filled, sum(value * value) / sum(value) AS avg_price, sum(value) >= 3000 AS complete FROM events GROUP BY 1", "", "requested filled avg_price")
def _(t):
    s = events(t).select(c("user_id").alias("order_id"), "ts", c("value").alias("qty"), c("value").alias("price"), F.lit(3000.0).alias("requested"))
    return io.drain(sw.fill_progress(s), "fills", "update", ["order_id"])


@query("t14_trailing_exits")
def _(t):
    s = events(t).select(c("user_id").alias("symbol"), "ts", "event_id", c("value").alias("price"))
    return io.drain(state.trailing_exits(s, 0.5), "exits")


@query("t14_trailing_ordered")
def _(t):
    s = events(t).select(c("user_id").alias("symbol"), "ts", "event_id", c("value").alias("price"))
    return io.drain(ordered.trailing(s, 0.5), "exits_ordered")


CTE["rt"] = "rt AS (SELECT event_type AS symbol, ts, max(value) / 10000 AS funding_rate FROM events GROUP BY 1, 2)"


@query("t15_asof_stream",
       """SELECT event_id, symbol, ts, CASE WHEN ok THEN rate_ts END AS rate_ts, CASE WHEN ok THEN funding_rate END AS funding_rate FROM (
       SELECT e.event_id, e.event_type AS symbol, e.ts, r.ts AS rate_ts, r.funding_rate, epoch_us(e.ts) - epoch_us(r.ts) <= 1800000000 AS ok FROM events e ASOF LEFT JOIN rt r ON e.event_type = r.symbol AND r.ts <= e.ts)""",
       "rt", "funding_rate @ts @rate_ts", 9)
def _(t):
    base = scratch_path(t.spark, "asof")
    bars = events(t).select("event_id", c("event_type").alias("symbol"), "ts")
    rates = lambda spark: (t.events.groupBy(c("event_type").alias("symbol"), "ts").agg((F.max("value") / 10000).alias("funding_rate")))
    sw.asof_enrich(bars, rates, 1800, f"{base}/out", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").drop("batch")


@query("t16_book_features",
       """SELECT l_orderkey, (bids[1].price + asks[1].price) / 2 AS mid, asks[1].price - bids[1].price AS spread, list_sum(list_transform(bids[1:2], lambda x: x.qty)) AS bid_depth, list_sum(list_transform(asks[1:2], lambda x: x.qty)) AS ask_depth,
       (list_sum(list_transform(bids[1:2], lambda x: x.qty)) - list_sum(list_transform(asks[1:2], lambda x: x.qty))) / (list_sum(list_transform(bids[1:2], lambda x: x.qty)) + list_sum(list_transform(asks[1:2], lambda x: x.qty))) AS imbalance FROM bk""",
       "bk", "mid spread bid_depth ask_depth imbalance")
def _(t):
    path = scratch_path(t.spark, "books")
    b = books(t)
    b.write.parquet(path)
    s = t.spark.readStream.schema(b.schema).parquet(path)
    return io.drain(sw.book_features(s, 2), "book").select("l_orderkey", "mid", "spread", "bid_depth", "ask_depth", "imbalance")


@query("t17_session_stats",
       f"""WITH g AS (SELECT event_type AS symbol, ts, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) <= 900000000 THEN 0 ELSE 1 END AS n FROM events),
       s AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
       SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*) AS n, sum(value) AS total FROM s GROUP BY symbol, k HAVING max(ts) + INTERVAL 15 MINUTE <= {WM}""", "", "total @start")
def _(t):
    return io.drain(sw.session_stats(ticks(t), "15 minutes", "10 minutes"), "sessions")


@query("t18_live_counters",
       f"""SELECT family, ts, count(*) AS requests, count(*) FILTER (value >= 100) AS errors, avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM (SELECT event_type AS family, date_trunc('hour', ts) AS ts, value FROM events)
       WHERE ts + INTERVAL 1 HOUR <= {WM} GROUP BY 1, 2""", "", "pass_rate @ts")
def _(t):
    s = events(t).select(c("event_type").alias("family"), "ts", c("value").alias("latency"), (c("value") < 100).alias("ok"))
    return io.drain(sw.live_counters(s, "1 hour", "10 minutes"), "counters").drop("p95")


@query("t19_route", "SELECT event_id, value FROM events WHERE event_type = 'purchase'", "", "value")
def _(t):
    return io.drain(sw.route(events(t), "purchase").select("event_id", "value"), "route")


@query("t20_lateness", f"SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR", "", "@ts")
def _(t):
    """Hourly counts with two hours of allowed lateness."""
    s = io.with_lateness(events(t), "ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return io.drain(s.select(c("w.start").alias("ts"), "n"), "late")
