"""Fitted models on data with a known answer."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from factorspark.operators import models as ml

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for d in range(40):
        for s in range(20):
            a, b = RNG.normal(size=2).tolist()
            rows.append((s, datetime(2024, 1, 1) + timedelta(days=d), a, b, 0.05 * a + float(RNG.normal(0, 0.01))))
    rows.append((99, datetime(2024, 1, 5), None, 1.0, 0.0))
    return spark.createDataFrame(rows, "symbol INT, ts TIMESTAMP, a DOUBLE, b DOUBLE, fwd DOUBLE").cache()


def test_parameter_sets():
    space = {"x": [1, 2, 3], "y": ["p", "q"]}
    every = ml.parameter_sets(space)
    assert len(every) == 6 and every[0] == {"x": 1, "y": "p"} and every[-1] == {"x": 3, "y": "q"}
    some = ml.parameter_sets(space, 4, seed=1)
    assert some == ml.parameter_sets(space, 4, seed=1) and len({tuple(s.items()) for s in some}) == 4
    assert all(s in every for s in some) and ml.parameter_sets(space, 10) == every


def test_date_folds(panel):
    got = ml.date_folds(panel, 3).groupBy("fold").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.countDistinct("ts").alias("n")).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [0, 1, 2] and sum(r["n"] for r in got) == 40
    assert all(x["hi"] < y["lo"] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("metric", ["mse", "sharpe", "ic", "rank_ic"])
def test_search_finds_the_best_of_a_known_grid(panel, metric):
    """The target is linear in one feature: no penalty is best, and the largest lasso penalty leaves a constant."""
    got = ml.model_search(panel, ["a", "b"], {"regParam": [10.0, 0.0], "elasticNetParam": [1.0]}, LinearRegression(), metric=metric).collect()
    assert [r["params"] for r in got] == ["regParam=0.0,elasticNetParam=1.0", "regParam=10.0,elasticNetParam=1.0"] and [r["rank"] for r in got] == [1, 2]
    if metric in ("ic", "rank_ic"):
        assert got[0]["score"] > 0.9 and got[1]["score"] == 0.0
    if metric == "mse":
        assert abs(-got[0]["score"] - 1e-4) < 2e-5


def test_random_search_and_bad_metric(panel):
    got = ml.model_search(panel, ["a"], {"regParam": [0.0, 0.1, 1.0]}, LinearRegression(), metric="ic", n=2, folds=2, top=1).collect()
    assert len(got) == 1 and got[0]["rank"] == 1
    with pytest.raises(ValueError):
        ml.SignalEvaluator("profit")


def test_boosted_trees_and_ensemble_learn_the_signal(panel):
    model, pred, imp = ml.fit_gbt(panel, ["a", "b"], trees=10, depth=3)
    r = ml.evaluate(pred, "fwd").first()
    top = imp.orderBy(F.desc("importance")).first()
    assert r["ic"] > 0.9 and r["rank_ic"] > 0.9 and r["mse"] < 1e-3 and top["feature"] == "a" and top["importance"] > 0.8
    assert pred.select("ts").distinct().count() == 8  # the last fifth of 40 dates
    e = ml.evaluate(ml.fit_ensemble(panel, ["a", "b"]), "fwd").first()
    assert e["ic"] > 0.9 and e["n"] == 160
