"""Trial ledger, library, task and cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs
from factorspark.operators.performance import significance_threshold


def _capped(hi: float, c: Column) -> Column:
    return F.least(F.lit(float(hi)), c)


def overall_score(ic, ir, sharpe, oos_ic, consistency, degradation, hit_rate, stability, passed) -> Column:
    """Score 0-100 from factor metrics (40), walk-forward (30), IC series (20) and threshold (10)."""
    pos = lambda c: F.greatest(F.lit(0.0), c)
    parts = [_capped(15, F.abs(ic) * 300), _capped(15, ir * 7.5), _capped(10, pos(sharpe) * 5), _capped(10, F.abs(oos_ic) * 200), _capped(10, consistency * 10),
             _capped(10, pos(1 - degradation) * 10), _capped(10, hit_rate * 10), _capped(10, stability * 10), F.when(passed, 10.0).otherwise(0.0)]
    return _capped(100, sum(parts[1:], parts[0]))


def trial_thresholds(trials: DataFrame, order: str = "trial", base: float = 2.0, confidence: float = 0.95) -> DataFrame:
    """Running trial count and the Sharpe threshold each trial had to pass.

    The running count is a rank over the whole ledger, computed as a two-level prefix sum.
    """
    d = cs.ranked(trials, [], order, prefix="_t_")
    d = d.withColumn("n_trials", F.col("_t_before") + F.col("_t_ties")).drop("_t_before", "_t_ties", "_t_n")
    d = d.withColumn("threshold", significance_threshold(F.col("n_trials"), base, confidence))
    return d.withColumn("passed", F.col("sharpe") >= F.col("threshold"))


def ledger_stats(trials: DataFrame, value: str = "sharpe", family: str = "family") -> DataFrame:
    """Count, mean, population spread, extremes and median, by family and overall ('all')."""
    both = trials.select(F.explode(F.array(F.col(family), F.lit("all"))).alias("family"), F.col(value))
    med = cs.winsor_bounds(both, ["family"], value, [0.5]).withColumnRenamed("q0", "median")
    v = F.col(value)
    g = both.groupBy("family").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"))
    return g.join(med, "family")


def pattern_stats(df: DataFrame, top: int = 3) -> DataFrame:
    """Per family: successes, failures, success rate, most common failure reasons, best successful IC."""
    ok = F.col("pattern_type") == "success"
    n_ok, n_bad = F.count_if(ok), F.count_if(F.col("pattern_type") == "failure")
    g = df.groupBy("family").agg(n_ok.alias("successes"), n_bad.alias("failures"), (n_ok / F.greatest(n_ok + n_bad, F.lit(1))).alias("success_rate"),
                                 F.max(F.when(ok, F.greatest(F.col("ic"), F.lit(0.0)))).alias("best_ic"))
    reasons = df.filter(F.col("pattern_type") == "failure").select("family", F.explode("failure_reasons").alias("reason")).groupBy("family", "reason").agg(F.count("*").alias("c"))
    best = cs.top_n(reasons, ["family"], "c", top, "reason")
    joined = best.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda e: e["reason"]), ",").alias("common_failures"))
    return g.join(joined, "family", "left")


def cost_report(traces: DataFrame) -> DataFrame:
    """Cost, tokens, requests and cache hit rate in total, by agent, by model and by hour: one pass over the rows, four grouping sets."""
    dims = F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("string").alias("key")) for k, v in (
        ("total", F.lit("all")), ("agent", F.col("agent")), ("model", F.col("model")), ("hour", F.date_format("ts", "yyyy-MM-dd HH")))])
    d = traces.select("cost", "tokens", "cached", F.explode(dims).alias("_d")).select("cost", "tokens", "cached", "_d.*")
    return d.groupBy("dim", "key").agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.count("*").alias("requests"),
                                       F.avg(F.col("cached").cast("double")).alias("hit_rate"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows and share per status."""
    g = df.groupBy(status).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_t"))  # one row
    return g.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def request_stats(df: DataFrame, latency: str = "latency", ok: str = "ok") -> DataFrame:
    """Success rate, latency mean and tails (exact, from ranks), requests per active hour, tokens, cost."""
    tails = cs.winsor_bounds(df.select(latency), [], latency, [0.95, 0.99]).toDF("p95", "p99")
    hours = df.groupBy(F.date_trunc("hour", "ts").alias("_h")).agg(F.count("*").alias("_c")).agg(F.avg("_c").alias("requests_per_hour"))
    g = df.agg(F.count("*").alias("requests"), (F.avg(F.col(ok).cast("double")) * 100).alias("success_rate"), F.avg(latency).alias("mean_latency"),
               F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return g.join(F.broadcast(tails)).join(F.broadcast(hours))  # one row each


def library_stats(factors: DataFrame) -> DataFrame:
    """Factors per family tag with mean IC and Sharpe and the best one."""
    d = factors.select(F.explode("families").alias("family"), "name", "ic", "sharpe")
    return d.groupBy("family").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), F.avg("sharpe").alias("mean_sharpe"),
                                   F.max_by("name", F.struct("sharpe", "name")).alias("best"))


def backtest_stats(df: DataFrame, today: Column) -> DataFrame:
    """Totals, running, completed on the given day, mean and best Sharpe of finished runs."""
    done = F.col("status") == "completed"
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "running").alias("running"),
                  F.count_if(done & (F.date_trunc("day", "ts") == today)).alias("completed_today"), F.avg(F.when(done, F.col("sharpe"))).alias("mean_sharpe"),
                  F.max(F.when(done, F.col("sharpe"))).alias("best_sharpe"), F.max_by("id", F.when(done, F.struct("sharpe", "id"))).alias("best_id"))


def trial_budget(trials: DataFrame, per_id: int = 20, total: int = 1000, cooldown_minutes: float = 30.0, ts: str = "ts", tiebreak: str = "trial") -> DataFrame:
    """Per trial: earlier trials of its hypothesis, earlier trials in total, minutes since its last one, and the verdict.

    Counts are two-level ranks and the previous trial comes from a chunked lag, so neither the ledger nor
    a hypothesis tried very often is ever one window group.
    """
    from factorspark.operators.quality import chunked_lag
    hid = F.substring(F.md5(F.lower(F.concat_ws(":", "family", "hypothesis"))), 1, 12)
    d = trials.withColumn("hypothesis_id", hid).withColumn("_sec", F.unix_timestamp(ts))
    d = cs.ranked(d, [], "_sec", tiebreak, prefix="_b_").withColumn("total_before", F.col("_b_pos") - 1)
    d = d.drop("_b_before", "_b_ties", "_b_n", "_b_pos")
    d = cs.ranked(d, ["hypothesis_id"], "_sec", tiebreak, prefix="_h_").withColumn("id_before", F.col("_h_pos") - 1)
    d = d.drop("_h_before", "_h_ties", "_h_n", "_h_pos")
    d = chunked_lag(d, "hypothesis_id", ts, tiebreak, "_sec", "_prev_sec", "month")
    d = d.withColumn("minutes_since", (F.col("_sec") - F.col("_prev_sec")) / 60)
    verdict = (F.when(F.col("total_before") >= total, "total limit").when(F.col("id_before") >= per_id, "hypothesis limit")
               .when(F.col("minutes_since") < cooldown_minutes, "cooldown").otherwise("ok"))
    return d.withColumn("verdict", verdict).drop("_sec", "_prev_sec")
