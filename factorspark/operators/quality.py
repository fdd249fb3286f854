"""Data-quality rules, failure reasons, grades and table housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs


def field_coverage(df: DataFrame, fields: list[str], by: str = "symbol") -> DataFrame:
    """Present values per key and field; a field the table lacks counts zero. One aggregate, then long form."""
    g = df.groupBy(by).agg(*[(F.count(f) if f in df.columns else F.lit(0).cast("bigint")).alias(f) for f in fields])
    d = g.unpivot(by, fields, "field", "n_values")
    return d.withColumn("available", F.col("n_values") > 0)


def validate_bars(df: DataFrame) -> DataFrame:
    """Violations per rule, all counted in one pass."""
    need = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    missing = [c for c in need if c not in df.columns]
    have = lambda *c: all(x in df.columns for x in c)
    rules = {"high_below_low": F.count_if(F.col("high") < F.col("low")) if have("high", "low") else F.lit(0),
             "non_positive_price": F.count_if(F.least("open", "high", "low", "close") <= 0) if have("open", "high", "low", "close") else F.lit(0),
             "negative_volume": F.count_if(F.col("volume") < 0) if have("volume") else F.lit(0),
             "missing_value": F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in need if c in df.columns]) == 1),
             "missing_column": F.lit(len(missing)), "empty": F.when(F.count("*") == 0, 1).otherwise(0)}
    wide = df.agg(*[v.cast("bigint").alias(k) for k, v in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def is_significant(ic: Column, ir: Column, min_ic: float = 0.03, min_ir: float = 1.0) -> Column:
    return (F.abs(ic) >= min_ic) & (ir >= min_ir)


def classify_failures(df: DataFrame) -> DataFrame:
    """Reasons a factor fails, as a list in a fixed order."""
    c = F.col
    high_var = F.when(c("cv_mean") != 0, c("cv_std") > F.abs("cv_mean") * 0.5).otherwise(c("cv_std") > 0.5)
    rules = [("low_ic", c("ic") < 0.03), ("low_ir", c("ir") < 1.0), ("high_drawdown", c("max_drawdown") > 0.2), ("low_sharpe", c("sharpe") < 1.5),
             ("low_win_rate", c("win_rate") < 0.45), ("overfitting", high_var), ("lookahead_bias", c("biased")), ("instability", c("stability") < 0.6)]
    return df.withColumn("failure_reasons", F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules])))


def feedback_confidence(df: DataFrame) -> DataFrame:
    """Confidence in the evidence, and consistency of the fold Sharpes (array ``cv``)."""
    n = F.size("cv")
    conf = (F.lit(0.5) + F.when(n > 0, F.least(n / F.lit(5.0), F.lit(1.0)) * 0.1).otherwise(0.0) + F.when(F.col("stability").isNotNull(), 0.1).otherwise(0.0)
            + F.when(F.col("biased").isNotNull(), 0.1).otherwise(0.0) + F.least(F.size("failure_reasons"), F.lit(3)) * 0.05)
    add = lambda a, v: a + v
    mean = F.try_divide(F.aggregate("cv", F.lit(0.0), add), n)
    var = F.try_divide(F.aggregate(F.transform("cv", lambda v: (v - mean) * (v - mean)), F.lit(0.0), add), n)
    cons = F.when(n < 2, None).when(F.abs(mean) < 0.01, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.sqrt(var), F.abs(mean))))
    return df.withColumns({"confidence": F.least(conf, F.lit(1.0)), "cv_consistency": cons})


def grade(ic, ir, sharpe, win_rate, stability) -> Column:
    """Letter from a 100-point score."""
    score = (F.least(F.lit(30.0), F.abs(ic) * 500) + F.least(F.lit(30.0), ir * 15) + F.least(F.lit(20.0), F.greatest(F.lit(0.0), sharpe) * 10)
             + F.greatest(F.lit(0.0), win_rate - 0.5) * 100 + F.coalesce(stability * 10, F.lit(0.0)))
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("F")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in a total order; offset and limit stay inside one ordered limit."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def list_factors(df: DataFrame, family: str | None = None, status: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    if family is not None:
        df = df.filter(F.array_contains("families", family))
    if status is not None:
        df = df.filter(F.col("status") == status)
    return page(df, [F.col("name").asc()], number, size)


def best_row(df: DataFrame, by: str, tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), tiebreak).limit(1)


def top_n_global(df: DataFrame, by: Column, n: int, tiebreak: str) -> DataFrame:
    return df.orderBy(by.desc_nulls_last(), tiebreak).limit(n)


def priority_order(df: DataFrame, priority: str, created: str, tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(priority).desc(), F.col(created).asc(), tiebreak)


def universe(symbols: DataFrame, tickers: DataFrame, quote: str, n: int, excluded: list[str], search: str | None = None) -> DataFrame:
    """Trading symbols of one quote asset by volume, without excluded bases; top n with their rank."""
    d = symbols.filter((F.col("status") == "TRADING") & (F.col("quote") == quote) & ~F.col("base").isin(excluded)).join(tickers, "symbol")
    if search:
        d = d.filter(F.contains(F.upper("base"), F.lit(search.upper())) | F.contains(F.upper("symbol"), F.lit(search.upper())))
    top = d.orderBy(F.col("volume").desc(), "symbol").limit(n)  # n rows
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("volume").desc(), "symbol")))


def retain(df: DataFrame, ts: str, newest: Column, max_age_days: int, max_rows: int, tiebreak: str) -> DataFrame:
    """Drop rows older than the age limit, then keep the newest ``max_rows``."""
    d = df.filter(F.col(ts) >= newest - F.make_dt_interval(F.lit(max_age_days)))
    return d.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(max_rows)


def to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide with known column names, so no extra pass looks them up."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def to_long(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.unpivot(keys, [c for c in df.columns if c not in keys], "name", "value")


def label_splits(df: DataFrame, **labels: Column) -> DataFrame:
    """Split labels as columns; a cross product of splits is then one group-by on them."""
    return df.withColumns(labels)


def chunked_lag(df: DataFrame, by: str, ts: str, tiebreak: str, value: str, out: str, chunk: str = "day") -> DataFrame:
    """Previous value per key with the window split by time chunk; the first row of a chunk takes the last
    value of the key's previous chunk from a per-chunk table. No task holds a whole key."""
    from pyspark.sql import Window
    k = F.date_trunc(chunk, F.col(ts))
    d = df.withColumn("_k", k)
    last = d.groupBy(by, "_k").agg(F.max_by(value, F.struct(ts, tiebreak)).alias("_last"))
    last = last.withColumn("_prev", F.lag("_last").over(Window.partitionBy(by).orderBy("_k"))).select(by, "_k", "_prev")
    w = Window.partitionBy(by, "_k").orderBy(ts, tiebreak)
    d = d.join(last, [by, "_k"])
    first = F.row_number().over(w) == 1
    return d.withColumn(out, F.when(first, F.col("_prev")).otherwise(F.lag(value).over(w))).drop("_k", "_prev")
