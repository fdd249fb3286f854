"""Windowed stream operators built from built-in aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions import book as bk
from factorspark.operators.asof import asof_join
from factorspark.operators.resample import order_key


def stream_bars(s: DataFrame, freq: str, delay: str, by: str = "symbol", price: str = "price", size: str = "quantity", tie: str = "trade_id") -> DataFrame:
    """Tumbling bars from ticks, emitted once their window is past the watermark."""
    d = s.withWatermark("ts", delay).withColumn("_at", order_key("ts", F.col(tie)))
    g = d.groupBy(F.window("ts", freq).alias("_w"), by).agg(
        F.min_by(price, "_at").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "_at").alias("close"), F.sum(size).alias("volume"))
    return g.select(by, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_stats(s: DataFrame, size: str, slide: str, delay: str, by: str = "symbol", price: str = "price") -> DataFrame:
    """Mean and spread of the price over overlapping windows."""
    g = s.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("_w"), by).agg(F.avg(price).alias("mean"), F.stddev_samp(price).alias("std"), F.count("*").alias("n"))
    return g.select(by, F.col("_w.start").alias("ts"), "mean", "std", "n")


def daily_loss(s: DataFrame, limit: float, delay: str = "1 hour", by: str = "account", pnl: str = "pnl") -> DataFrame:
    """Loss per account and day with a breach flag; a new day starts from zero."""
    loss = F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0.0))
    g = s.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("_w"), by).agg(loss.alias("loss"), F.sum(pnl).alias("net"))
    return g.select(by, F.col("_w.start").alias("day"), "loss", "net", (F.col("loss") > limit).alias("breached"))


def apply_rules(s: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream rows over the threshold of their metric's rule; the rule table has one row per metric."""
    return s.join(F.broadcast(rules), "metric").filter(F.col("value") > F.col("threshold"))


def idempotent(s: DataFrame, id_col: str, ttl: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First event per id within the time to live."""
    return s.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([id_col])


def conflicts(s: DataFrame, id_col: str, payload: Column, ttl: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Ids seen with more than one payload inside one window of the time to live."""
    d = s.withWatermark(ts, ttl).withColumn("_h", F.xxhash64(payload))
    g = d.groupBy(F.window(ts, ttl).alias("_w"), id_col).agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"), F.count("*").alias("n"))
    return g.filter(F.col("_a") != F.col("_b")).select(id_col, F.col("_w.start").alias(ts), "n")


def fill_progress(s: DataFrame, delay: str = "1 hour", by: str = "order_id") -> DataFrame:
    """Running filled quantity and average price per order (update mode). State is one row per order."""
    g = s.withWatermark("ts", delay).groupBy(by).agg(F.sum("qty").alias("filled"), F.sum(F.col("qty") * F.col("price")).alias("_v"), F.max("requested").alias("requested"))
    return g.select(by, "requested", "filled", (F.col("_v") / F.col("filled")).alias("avg_price"), (F.col("filled") >= F.col("requested")).alias("complete"))


def session_stats(s: DataFrame, gap: str, delay: str, by: str = "symbol", price: str = "price") -> DataFrame:
    """Bursts of activity separated by a quiet gap."""
    g = s.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("_w"), by).agg(F.count("*").alias("n"), F.sum(price).alias("total"))
    return g.select(by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


def live_counters(s: DataFrame, freq: str, delay: str, family: str = "family", latency: str = "latency", ok: Column | None = None) -> DataFrame:
    """Requests, errors, pass rate and a latency quantile per family and window."""
    ok = F.col("ok") if ok is None else ok
    g = s.withWatermark("ts", delay).groupBy(F.window("ts", freq).alias("_w"), family).agg(
        F.count("*").alias("requests"), F.count_if(~ok).alias("errors"), F.avg(ok.cast("double")).alias("pass_rate"), F.approx_percentile(latency, F.lit(0.95), F.lit(10000)).alias("p95"))
    return g.select(family, F.col("_w.start").alias("ts"), "requests", "errors", "pass_rate", "p95")


def route(s: DataFrame, kind: str, col: str = "event_type") -> DataFrame:
    """Events of one type; one query per type."""
    return s.filter(F.col(col) == kind)


def book_features(s: DataFrame, k: int, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Stateless order-book features of each snapshot."""
    b, a = F.col(bids), F.col(asks)
    return s.withColumns({"mid": bk.mid(bk.best(b), bk.best(a)), "spread": bk.spread(bk.best(b), bk.best(a)), "imbalance": bk.depth_imbalance(b, a, k),
                          "bid_depth": bk.depth_sum(b, k), "ask_depth": bk.depth_sum(a, k)})


def asof_enrich(s: DataFrame, rates: Callable[[SparkSession], DataFrame], max_gap: int, path: str, checkpoint: str, by: str = "symbol",
                rate: str = "funding_rate", chunk: str = "minute", **trigger):
    """Bars with the latest stored rate at most ``max_gap`` seconds older, micro-batch by micro-batch.

    A stream-stream range join would emit every rate inside the gap for every bar; here each batch runs one
    as-of join (union and carry forward) against the rates stored so far, cut to the batch's time range.
    A retried batch overwrites its own folder.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        lo, hi = batch.agg(F.min("ts"), F.max("ts")).first()
        if lo is not None:
            span = F.lit(max_gap).cast("int")
            near = rates(batch.sparkSession).filter((F.col("ts") >= F.lit(lo) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), span)) & (F.col("ts") <= F.lit(hi)))
            out = asof_join(batch, near.select(by, "ts", rate), by, right_ts="rate_ts", chunk=chunk)
            fresh = F.unix_micros("ts") - F.unix_micros("rate_ts") <= max_gap * 1000000
            out = out.withColumns({rate: F.when(fresh, F.col(rate)), "rate_ts": F.when(fresh, F.col("rate_ts"))})
            out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()
    w = s.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return w.trigger(**trigger).start() if trigger else w.start()
