"""Combining factors with fitted models."""

from __future__ import annotations

import random
from itertools import product

from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs
from factorspark.operators import scoring as sc
from factorspark.session import broadcast_if_small


def fit_ic_linear(long_df: DataFrame, split: str | None = None) -> DataFrame:
    """Signed weight per factor: mean training IC over the sum of absolute ICs."""
    d = long_df.filter(split) if split else long_df
    m = sc.evaluate_library(d).select("name", "ic_mean")
    return m.select("name", F.try_divide("ic_mean", F.sum(F.abs("ic_mean")).over(Window.partitionBy(F.lit(0)))).alias("weight"))


def _time_split(df: DataFrame, train: float, valid: float) -> DataFrame:
    """Mark rows by date: 0 train, 1 validation, 2 test."""
    from factorspark.operators.folds import date_index
    d = date_index(df)
    part = F.when(F.col("_i") < F.floor(F.col("_n") * train), 0).when(F.col("_i") < F.floor(F.col("_n") * (train + valid)), 1).otherwise(2)
    return df.join(F.broadcast(d.select("ts", part.alias("part"))), "ts")  # one row per date


def _assemble(df: DataFrame, features: list[str], target: str) -> DataFrame:
    d = df.dropna(subset=[*features, target])
    return VectorAssembler(inputCols=features, outputCol="_x").transform(d)


def evaluate(pred: DataFrame, target: str, out: str = "prediction") -> DataFrame:
    """Test IC, rank IC and squared error of predictions."""
    err = F.col(out) - F.col(target)
    ric = cs.rank_corr(pred, [], out, target).select("rank_ic")
    ic = cs.pearson(pred, [], out, target).select("ic", "n")
    mse = pred.agg(F.avg(err * err).alias("mse"))
    return ic.join(F.broadcast(ric)).join(F.broadcast(mse))  # one row each


def fit_gbt(df: DataFrame, features: list[str], target: str = "fwd", train=0.6, valid=0.2, trees: int = 20, depth: int = 4, step: float = 0.1):
    """Boosted trees on the early dates, stopped on the validation dates; returns (model, test predictions, importances)."""
    d = _assemble(_time_split(df, train, valid), features, target)
    fit = d.filter("part < 2").withColumn("_valid", F.col("part") == 1)
    gbt = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=step, seed=7, validationIndicatorCol="_valid")
    model = gbt.fit(fit)
    imp = df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())], "feature STRING, importance DOUBLE")
    return model, model.transform(d.filter("part = 2")).drop("_x"), imp


def fit_linear(df: DataFrame, features: list[str], target: str = "fwd", train=0.6, valid=0.2, reg: float = 0.0):
    d = _assemble(_time_split(df, train, valid), features, target)
    model = LinearRegression(featuresCol="_x", labelCol=target, regParam=reg).fit(d.filter("part < 2"))
    return model, model.transform(d.filter("part = 2")).drop("_x")


def fit_ensemble(df: DataFrame, features: list[str], target: str = "fwd", train=0.6, valid=0.2) -> DataFrame:
    """Linear and boosted models of the training dates plus their average, weighted by |IC| on the validation dates; test dates only get
    predictions."""
    d = _assemble(_time_split(df, train, valid), features, target)
    fit = d.filter("part = 0")
    lin = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="p_linear").fit(fit)
    gbt = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="p_gbt", maxIter=10, maxDepth=3, seed=7).fit(fit)
    p, seen = (gbt.transform(lin.transform(d.filter(F.col("part") == k))).drop("_x") for k in (2, 1))
    w = seen.agg(*[F.abs(F.coalesce(_corr(c, target), F.lit(0.0))).alias(f"w_{c}") for c in ("p_linear", "p_gbt")])
    p = p.join(F.broadcast(w))  # one row
    total = F.col("w_p_linear") + F.col("w_p_gbt")
    mix = (F.col("p_linear") * F.col("w_p_linear") + F.col("p_gbt") * F.col("w_p_gbt")) / total
    return p.withColumn("prediction", F.when(total > 0, mix).otherwise((F.col("p_linear") + F.col("p_gbt")) / 2)).drop("w_p_linear", "w_p_gbt")


def _corr(a, b):
    from factorspark.functions.math import corr
    return corr(a, b)


def grid_search(df: DataFrame, features: list[str], grid: dict[str, list], target: str = "fwd", metric: str = "mse") -> DataFrame:
    """Every parameter combination of a boosted model scored on the validation dates by MSE or IC."""
    d = _assemble(_time_split(df, 0.6, 0.2), features, target).select("_x", target, "part").persist()
    rows = []
    for combo in product(*grid.values()):
        params = dict(zip(grid, combo))
        model = GBTRegressor(featuresCol="_x", labelCol=target, seed=7, **params).fit(d.filter("part = 0"))
        pred = model.transform(d.filter("part = 1"))
        score = RegressionEvaluator(labelCol=target, metricName="mse").evaluate(pred) if metric == "mse" else \
            pred.agg(_corr("prediction", target)).first()[0]
        rows.append((str(sorted(params.items())), None if score is None else float(score)))
    d.unpersist()
    out = df.sparkSession.createDataFrame(rows, f"params STRING, {metric} DOUBLE")
    return out.orderBy(F.col(metric).asc() if metric == "mse" else F.col(metric).desc())


class SignalEvaluator(Evaluator):
    """Score of predictions on held-out dates, larger is better: ``sharpe`` (annual, of the portfolio that holds each date's standardised
    predictions), ``ic`` (correlation over all rows), ``rank_ic`` or ``mse`` (negative). A score that is not defined counts as 0, for mse as
    minus infinity."""

    def __init__(self, metric: str = "sharpe", target: str = "fwd", by: str = "ts", ppy: float = 252):
        super().__init__()
        if metric not in ("sharpe", "ic", "rank_ic", "mse"):
            raise ValueError(f"unknown metric {metric}")
        self.metric, self.target, self.by, self.ppy = metric, target, by, ppy

    def _evaluate(self, dataset: DataFrame) -> float:
        p, y = F.col("prediction"), F.col(self.target)
        if self.metric == "mse":
            got = dataset.agg(-F.avg((p - y) * (p - y))).first()[0]
            return float("-inf") if got is None else float(got)
        if self.metric == "sharpe":
            got = sc.factor_sharpe(dataset, ["prediction"], self.target, (self.by,), self.ppy).select("sharpe").first()
        elif self.metric == "rank_ic":
            got = cs.rank_corr(dataset, [], "prediction", self.target).select("rank_ic").first()
        else:
            got = dataset.agg(_corr("prediction", self.target)).first()
        return float(got[0]) if got is not None and got[0] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def date_folds(df: DataFrame, folds: int, ts: str = "ts") -> DataFrame:
    """Add ``fold``: dates in ``folds`` consecutive stretches of equal length."""
    from factorspark.operators.folds import date_index
    d = date_index(df).select(ts, F.least(F.floor(F.col("_i") * folds / F.col("_n")), F.lit(folds - 1)).cast("int").alias("fold"))
    return df.join(broadcast_if_small(d), ts)


def parameter_sets(space: dict[str, list], n: int | None = None, seed: int = 7) -> list[dict]:
    """All combinations of a space or, with ``n``, that many different ones drawn with a seed (all of them when there are no more)."""
    size = 1
    for v in space.values():
        size *= len(v)
    picks = range(size) if n is None or n >= size else sorted(random.Random(seed).sample(range(size), n))
    out = []
    for i in picks:
        chosen = {}
        for k, v in reversed(space.items()):
            i, at = divmod(i, len(v))
            chosen[k] = v[at]
        out.append({k: chosen[k] for k in space})
    return out


def model_search(df: DataFrame, features: list[str], space: dict[str, list], estimator=None, target: str = "fwd", metric: str = "sharpe", folds: int = 3, n: int | None = None,
                 seed: int = 7, parallelism: int = 4, ts: str = "ts", top: int | None = None) -> DataFrame:
    """(params, score, std, rank) of every parameter set, best first: cross-validation over date folds, ``parallelism`` fits at a time.

    ``space`` maps a parameter of the estimator to its values; ``n`` asks for a seeded random search. Each fold of dates is held out once. Rows with a
    missing feature or target do not count. ``top`` keeps the best only.
    """
    estimator = (estimator or GBTRegressor(maxIter=10, maxDepth=3, seed=seed)).copy().setFeaturesCol("_x").setLabelCol(target)
    sets = parameter_sets(space, n, seed)
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in sets]
    d = date_folds(_assemble(df, features, target), folds, ts).select("_x", target, ts, "fold")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=SignalEvaluator(metric, target, ts), numFolds=folds, foldCol="fold", parallelism=parallelism)
    d = d.persist()
    try:
        fitted = cv.fit(d)
    finally:
        d.unpersist()
    order = sorted(range(len(sets)), key=lambda i: (-fitted.avgMetrics[i], i))
    rows = [(",".join(f"{k}={v}" for k, v in sets[i].items()), float(fitted.avgMetrics[i]), float(fitted.stdMetrics[i]), r + 1) for r, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows[:top], "params STRING, score DOUBLE, std DOUBLE, rank INT")
