"""Limits, breaches, account checks and order fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.math import div

# Metric limits and what a breach counts for.
LIMITS = {"max_drawdown": (0.15, "high"), "current_drawdown": (0.03, "critical"), "volatility": (0.25, "medium"), "var_95": (0.05, "high"),
          "max_position": (0.1, "medium"), "turnover": (0.5, "low")}


def breach_join(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows (key columns, metric, value) over the threshold of their rule; rules have one row per metric name."""
    return metrics.join(F.broadcast(rules), "metric").filter(F.col("value") > F.col("threshold"))


def risk_scorecard(df: DataFrame, concentration: str = "concentration", limits=LIMITS) -> DataFrame:
    """Breached limits, weighted score, level and approval status per row of metrics."""
    over = F.array_compact(F.array(*[F.when(F.col(m) > lim, F.lit(m)) for m, (lim, _) in limits.items()]))
    d = df.withColumn("_b", over)
    part = lambda m, w: F.least(F.col(m) / limits[m][0], F.lit(1.0)) * w
    score = (part("max_drawdown", 0.3) + part("volatility", 0.2) + part("var_95", 0.2) + F.col(concentration) * 0.15
             + F.least(F.size("_b") / F.lit(6.0), F.lit(1.0)) * 0.15)
    d = d.withColumns({"breached": F.array_join("_b", ","), "n_breached": F.size("_b"), "score": F.least(score, F.lit(1.0))})
    s = F.col("score")
    level = F.when(s < 0.25, "low").when(s < 0.5, "medium").when(s < 0.75, "high").otherwise("critical")
    status = (F.when(F.array_contains("_b", "current_drawdown"), "rejected").when((s < 0.5) & (F.size("_b") == 0), "approved")
              .when(s < 0.75, "conditional").otherwise("manual_review"))
    return d.withColumns({"level": level, "status": status}).drop("_b")


def concentration_breaches(pos: DataFrame, equity: DataFrame, key: str, limit: float) -> DataFrame:
    """Positions whose share of their account's equity is over the limit."""
    d = pos.join(equity, key).withColumn("share", div(F.col("value"), F.col("equity")))
    return d.filter(F.col("share") > limit)


def hard_limits(accounts: DataFrame, max_drawdown=0.15, max_position=0.3, max_leverage=3.0, max_daily_loss=0.05) -> DataFrame:
    """Violations of four hard limits per account and the strongest action they call for."""
    ok = F.col("equity") > 0
    dd = div(F.col("peak") - F.col("equity"), F.col("peak"))
    checks = [("max_drawdown", "emergency_close_all", dd > max_drawdown),
              ("position_concentration", "reduce_position", ok & (div(F.col("largest"), F.col("equity")) > max_position)),
              ("leverage", "reduce_leverage", ok & (div(F.col("exposure"), F.col("equity")) > max_leverage)),
              ("daily_loss", "emergency_close_all", ok & (F.col("daily_pnl") < 0) & (-div(F.col("daily_pnl"), F.col("equity")) > max_daily_loss))]
    d = accounts.withColumn("_v", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in checks])))
    has = lambda *n: F.arrays_overlap("_v", F.array(*[F.lit(x) for x in n]))
    action = (F.when(has("max_drawdown", "daily_loss"), "emergency_close_all").when(has("leverage"), "reduce_leverage")
              .when(has("position_concentration"), "reduce_position").otherwise("none"))
    return d.withColumns({"violations": F.array_join("_v", ","), "action": action}).drop("_v")


SEVERITY = {"critical": 3, "high": 2, "warning": 1}


def risk_actions(violations: DataFrame, key: str, max_concentration: float = 0.3) -> DataFrame:
    """Worst severity per key, the action of the worst violation, and how much of a concentrated position to close."""
    code = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    act = (F.when((F.col("severity") == "critical") & (F.col("rule") == "drawdown"), "close_all")
           .when((F.col("severity") == "critical") & (F.col("rule") == "concentration"), "reduce_position").otherwise("none"))
    prio = F.when(act == "close_all", 2).when(act == "reduce_position", 1).otherwise(0)
    cut = F.when(act == "reduce_position", (F.col("value") - max_concentration) / F.col("value"))
    g = violations.groupBy(key).agg(F.max(code).alias("_c"), F.max_by(act, prio).alias("action"), F.max(cut).alias("reduce_pct"), F.count("*").alias("n_violations"))
    level = F.when(F.col("_c") == 3, "critical").when(F.col("_c") == 2, "high").when(F.col("_c") == 1, "warning").otherwise("normal")
    return g.withColumn("level", level).drop("_c")


def account_risk(pos: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    """Risk level per account from margin usage and the largest margin share."""
    g = pos.groupBy(key).agg(F.sum("margin").alias("used"), F.max("margin").alias("largest"))
    d = accounts.join(g, key, "left").fillna(0.0, ["used", "largest"])
    use = F.when(F.col("equity") > 0, F.col("used") / F.col("equity") * 100).otherwise(0.0)
    conc = F.when(F.col("used") > 0, F.col("largest") / F.col("used") * 100).otherwise(0.0)
    d = d.withColumns({"usage": use, "concentration": conc})
    worst = F.greatest("usage", "concentration")
    return d.withColumn("level", F.when(worst > 80, "critical").when(worst > 60, "danger").when(worst > 40, "warning").otherwise("normal"))


def fill_summary(fills: DataFrame, orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Filled quantity, average price, remainder and completeness per order."""
    g = fills.groupBy(key).agg(F.sum("qty").alias("filled"), F.sum(F.col("qty") * F.col("price")).alias("_v"), F.count("*").alias("n_fills"))
    d = orders.join(g, key, "left").fillna(0, ["filled", "_v", "n_fills"])
    return d.select(key, "requested", "filled", "n_fills", div(F.col("_v"), F.col("filled")).alias("avg_price"),
                    F.greatest(F.col("requested") - F.col("filled"), F.lit(0.0)).alias("remaining"), (F.col("filled") >= F.col("requested")).alias("complete"))


def realized_pnl(trades: DataFrame, by: str = "symbol", pnl: str = "pnl") -> DataFrame:
    p = F.col(pnl)
    return trades.groupBy(by).agg(F.sum(p).alias("total"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("profit"), F.sum(F.when(p < 0, p).otherwise(0.0)).alias("loss"), F.count("*").alias("n"))


def portfolio_totals(pos: DataFrame, prices: DataFrame, by: str = "symbol", leverage: float = 10.0) -> DataFrame:
    """Unrealised profit, margin in use and market value at the latest price of each symbol."""
    last = prices.groupBy(by).agg(F.max_by("close", "ts").alias("_px"))
    d = pos.join(last, by)
    return d.agg(F.sum((F.col("_px") - F.col("entry")) * F.col("qty")).alias("unrealized"), (F.sum(F.col("_px") * F.col("qty")) / leverage).alias("margin_used"),
                 F.sum(F.col("_px") * F.col("qty")).alias("market_value"), F.count("*").alias("n_positions"))


def cluster_diversity(df: DataFrame, cluster: str) -> DataFrame:
    """Distinct clusters over clustered members."""
    return df.agg((F.count_distinct(cluster) / F.count(cluster)).alias("diversity"))
