"""Stability scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.math import cap_group
from factorspark.operators import cross_section as cs
from factorspark.operators import scoring as sc


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def stability_grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.6, "C").when(score >= 0.4, "D").otherwise("F")


def time_score(df: DataFrame) -> DataFrame:
    """Monthly ICs: strength of IR, consistency bonus, decay penalty."""
    m = cs.pearson(df.withColumn("period", F.date_trunc("month", "ts")), ["period"], "factor", "fwd", 5).filter(F.col("ic").isNotNull())
    m = m.withColumn("_i", F.row_number().over(Window.orderBy("period")) - 1)  # one row per month
    t = sc.trend(m, "_i", "ic").select("slope", "p_value", "r_value")
    s = m.agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"))
    d = s.join(F.broadcast(t))  # one row each
    ir = F.try_divide("m", "s")
    base = F.when(ir > 0, F.least(F.lit(1.0), F.abs(ir) / 2)).otherwise(0.0)
    bonus = F.when((F.col("s") > 0) & (F.col("m") != 0), F.greatest(F.lit(0.0), 1 - F.abs(F.try_divide("s", "m"))) * 0.3).otherwise(0.0)
    penalty = F.when((F.col("slope") < 0) & (F.col("p_value") < 0.1), F.abs("r_value") * 0.3).otherwise(0.0)
    return d.select(unit(base * 0.7 + bonus - penalty).alias("time_score"))


def market_score(df: DataFrame) -> DataFrame:
    """ICs per size group: same sign and small spread score high, a large difference is penalised."""
    g = cs.pearson(df.withColumn("grp", cap_group(F.col("cap"))).filter(F.col("grp").isNotNull()), ["grp"], "factor", "fwd", 5)
    a = g.agg(F.count("ic").alias("n"), F.stddev_pop("ic").alias("s"), F.min("ic").alias("lo"), F.max("ic").alias("hi"))
    same = (F.col("lo") > 0) | (F.col("hi") < 0) | ((F.col("lo") <= 0) & (F.col("hi") == 0)) | (F.col("lo") == 0)
    cons = F.when(F.col("n") < 2, 1.0).otherwise(F.when(same, 0.5).otherwise(0.25) + F.greatest(F.lit(0.0), 1 - F.col("s") * 5) * 0.5)
    return a.select(unit(cons - F.least(F.lit(0.5), (F.col("hi") - F.col("lo")) * 2)).alias("market_score"))


def regime_score(df: DataFrame, label: str = "label") -> DataFrame:
    """ICs per regime: low spread scores high, mixed signs lose 30 percent."""
    g = cs.pearson(df.filter(F.col(label).isNotNull()), [label], "factor", "fwd", 5)
    a = g.agg(F.count("ic").alias("n"), F.stddev_pop("ic").alias("s"), F.count_if(F.col("ic") > 0).alias("pos"), F.count_if(F.col("ic") < 0).alias("neg"))
    base = F.greatest(F.lit(0.0), 1 - F.when(F.col("n") < 2, 0.0).otherwise(F.col("s")) * 5)
    return a.select(unit(base * F.when((F.col("pos") > 0) & (F.col("neg") > 0), 0.7).otherwise(1.0)).alias("regime_score"))


def stability_report(df: DataFrame, weights=(0.4, 0.3, 0.3)) -> DataFrame:
    d = time_score(df).join(F.broadcast(market_score(df))).join(F.broadcast(regime_score(df)))  # one row each
    total = F.col("time_score") * weights[0] + F.col("market_score") * weights[1] + F.col("regime_score") * weights[2]
    return d.withColumn("overall", total).withColumn("grade", stability_grade(F.col("overall")))
