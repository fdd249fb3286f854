"""Cross-validation folds by date.

Folds are cut on the distinct dates, never on row numbers, so one date never straddles two folds. The
date table has one row per calendar date (times the folds), a bound the calendar proves, so it is indexed on
its own and joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_index(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct dates with a dense 0-based index ``_i`` and their number ``_n``."""
    d = df.select(ts).distinct()
    return d.select(ts, (F.row_number().over(Window.orderBy(ts)) - 1).alias("_i"),
                    F.count("*").over(Window.partitionBy(F.lit(0))).alias("_n"))


def fold_table(dates: DataFrame, scheme: str, ts: str = "ts", train=0.6, valid=0.2, window=24, step=12, n_splits=5, purge=2,
               embargo_pct=0.01, min_train=0.1) -> DataFrame:
    """(date, fold, role) for a scheme:

    ``sequential`` train / valid / test by ratio; ``rolling`` train and test inside windows moved by a step;
    ``walk`` a full training window followed by a test step; ``purged`` k-fold with a purge gap on both sides and
    an embargo before the test; ``forward`` expanding training before each test block.
    """
    i, n = F.col("_i"), F.col("_n")
    if scheme == "sequential":
        a = F.floor(n * train)
        b = a + F.floor(n * valid)
        role = F.when(i < a, "train").when(i < b, "valid").otherwise("test")
        return dates.select(ts, F.lit(0).cast("bigint").alias("fold"), role.alias("role"))
    if scheme in ("rolling", "walk"):
        count = F.greatest(F.ceil((n - window) / F.lit(step)), F.lit(0)) if scheme == "rolling" else \
            F.greatest(F.floor((n - window - 1) / F.lit(step)) + 1, F.lit(0))
        folds = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
        d = dates.withColumn("fold", F.explode(folds))
        s = F.col("fold") * step
        if scheme == "rolling":
            cut = s + int(window * train)
            role = F.when((i >= s) & (i < cut), "train").when((i >= cut) & (i < s + window), "test")
        else:
            role = F.when((i >= s) & (i < s + window), "train").when((i >= s + window) & (i < s + window + step), "test")
        return d.withColumn("role", role).filter(F.col("role").isNotNull()).select(ts, "fold", "role")
    d = dates.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_splits - 1).cast("bigint"))))
    f = F.col("fold")
    emb = F.floor(n * embargo_pct)
    if scheme == "purged":
        size = F.floor(n / n_splits)
        t0, t1 = f * size, F.when(f < n_splits - 1, (f + 1) * size).otherwise(n)
        role = (F.when((i >= t0) & (i < t1), "test").when(i < F.greatest(t0 - purge - emb, F.lit(0)), "train")
                .when(i >= t1 + purge, "train").otherwise("purge"))
    elif scheme == "forward":
        size = F.floor(n / (n_splits + 1))
        t0 = (f + 1) * size
        t1 = F.least(t0 + size, n)
        role = F.when((i >= t0) & (i < t1), "test").when(i < F.greatest(t0 - purge - emb, F.lit(0)), "train").when(i < t0, "purge")
    else:
        raise ValueError(scheme)
    d = d.withColumn("role", role).filter(F.col("role").isNotNull())
    n_train = F.count_if(F.col("role") == "train").over(Window.partitionBy("fold"))
    return d.withColumn("_t", n_train).filter(F.col("_t") >= F.greatest(F.lit(1), F.floor(n * min_train) if scheme == "purged" else F.lit(1))).select(ts, "fold", "role")


def assign_folds(df: DataFrame, scheme: str, ts: str = "ts", **kw) -> DataFrame:
    """Rows with their fold and role; a row appears once per fold that uses its date."""
    return df.join(F.broadcast(fold_table(date_index(df, ts), scheme, ts, **kw)), ts)


def regime_split(df: DataFrame, label: str, train=0.6, valid=0.2, ts: str = "ts") -> DataFrame:
    """Sequential split of the dates inside each regime label."""
    d = df.select(label, ts).distinct()
    w = Window.partitionBy(label)
    i, n = F.row_number().over(w.orderBy(ts)) - 1, F.count("*").over(w)
    d = d.select(label, ts, i.alias("_i"), n.alias("_n"))
    a = F.floor(F.col("_n") * train)
    role = F.when(F.col("_i") < a, "train").when(F.col("_i") < a + F.floor(F.col("_n") * valid), "valid").otherwise("test")
    return df.join(d.select(label, ts, role.alias("role")), [label, ts])


def validate_folds(folds: DataFrame, ts: str = "ts") -> DataFrame:
    """Per fold: dates in each role, dates in both train and test, and whether the fold is sound."""
    per = folds.groupBy("fold", ts).agg(F.max((F.col("role") == "train").cast("int")).alias("_tr"), F.max((F.col("role") == "test").cast("int")).alias("_te"),
                                        F.max((F.col("role") == "purge").cast("int")).alias("_pu"))
    g = per.groupBy("fold").agg(F.sum("_tr").alias("n_train"), F.sum("_te").alias("n_test"), F.sum("_pu").alias("n_purged"),
                                F.sum(F.col("_tr") * F.col("_te")).alias("overlap"))
    return g.withColumn("valid", (F.col("overlap") == 0) & (F.col("n_train") > 0) & (F.col("n_test") > 0))


def walk_forward_folds(panel: DataFrame, scheme: str = "walk", x="factor", y="fwd", ppy: float = 12.0, **kw) -> DataFrame:
    """Per fold: rank IC of train and test rows and Sharpe of their long-short series."""
    from factorspark.operators import cross_section as cs
    from factorspark.operators import performance as pf
    from factorspark.operators import scoring as sc
    folds = fold_table(date_index(panel), scheme, **kw).filter(F.col("role").isin("train", "test"))
    folds = F.broadcast(folds)
    ic = cs.rank_corr(panel.select("ts", x, y).join(folds, "ts"), ["fold", "role"], x, y)
    ls = sc.long_short_returns(panel.select("symbol", "ts", x, y), x=x, y=y).join(folds, "ts")
    sh = ls.groupBy("fold", "role").agg(pf.sharpe(F.col("ls_ret"), ppy).alias("sharpe"))
    j = ic.join(sh, ["fold", "role"], "left")
    at = lambda c, r: F.max(F.when(F.col("role") == r, F.col(c)))
    return j.groupBy("fold").agg(at("rank_ic", "train").alias("train_ic"), at("rank_ic", "test").alias("test_ic"),
                                 at("sharpe", "train").alias("train_sharpe"), at("sharpe", "test").alias("test_sharpe"))


def walk_forward_summary(folds: DataFrame, max_degradation=0.5, min_oos_ic=0.02, min_consistency=0.6) -> DataFrame:
    """Mean in- and out-of-sample IC, degradation, IR, consistency, overfit ratio and verdict."""
    tr, te = F.avg("train_ic"), F.avg("test_ic")
    g = folds.agg(tr.alias("avg_train_ic"), te.alias("avg_oos_ic"), F.stddev_pop("test_ic").alias("oos_ic_std"), F.min("test_ic").alias("min_oos_ic"),
                  F.max("test_ic").alias("max_oos_ic"), F.avg((F.col("test_ic") > 0).cast("double")).alias("ic_consistency"),
                  F.avg("train_sharpe").alias("_trs"), F.avg("test_sharpe").alias("raw_sharpe"), F.count("*").alias("n_windows"))
    deg = F.when(F.abs("avg_train_ic") > 1e-6, 1 - F.col("avg_oos_ic") / F.col("avg_train_ic")).otherwise(1.0)
    g = g.withColumns({"ic_degradation": deg, "oos_ir": F.when(F.col("oos_ic_std") > 1e-6, F.col("avg_oos_ic") / F.col("oos_ic_std")).otherwise(0.0),
                       "overfit_ratio": F.try_divide("_trs", "raw_sharpe")}).drop("_trs")
    return g.withColumn("robust", (F.col("ic_degradation") <= max_degradation) & (F.col("avg_oos_ic") >= min_oos_ic) & (F.col("ic_consistency") >= min_consistency))


def cv_sharpe(df: DataFrame, ppy: float, ret: str = "ret", n_splits: int = 5) -> DataFrame:
    """Sharpe per test fold, then mean, spread, spread ratio, deflated mean and one-sided p-value."""
    from factorspark.functions.math import norm_cdf
    from factorspark.operators import performance as pf
    f = fold_table(date_index(df), "purged", n_splits=n_splits).filter("role = 'test'")
    per = df.join(F.broadcast(f), "ts").groupBy("fold").agg(pf.sharpe(F.col(ret), ppy).alias("s")).filter(F.col("s").isNotNull())
    g = per.agg(F.avg("s").alias("cv_mean"), F.stddev_samp("s").alias("cv_std"), F.count("*").alias("n_folds"))
    ratio = F.when(F.abs("cv_mean") >= 0.01, F.col("cv_std") / F.abs("cv_mean"))
    t = F.col("cv_mean") / (F.col("cv_std") / F.sqrt(F.col("n_folds").cast("double")))
    return g.withColumns({"cv_ratio": ratio, "deflated": F.coalesce(F.col("cv_mean") * F.greatest(F.lit(0.0), 1 - ratio), F.lit(0.0)),
                          "p_overfit": 1 - norm_cdf(t)})
