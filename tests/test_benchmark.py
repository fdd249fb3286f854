"""Library evaluation and vector search against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.factors import compute_factors
from factorspark.operators import benchmark as be
from factorspark.operators import scoring as sc
from factorspark.operators import vectors as ve
from factorspark.operators.rank_moments import rank_moments
from factorspark.session import scratch_path

RNG = np.random.default_rng(11)
NAMES = ["ROC5", "MA5", "STD5", "KMID", "CNTP5", "VMA5", "no_such_factor"]


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for s in range(12):
        close = (100 * np.exp(np.cumsum(RNG.normal(0, 0.02, 40)))).tolist()
        for d in range(40):
            if (s + d) % 17 == 0:
                continue
            o = close[d] * (1 + float(RNG.normal(0, 0.01)))
            rows.append((s, datetime(2024, 1, 1) + timedelta(days=d), o, max(o, close[d]) * 1.01, min(o, close[d]) * 0.99, close[d], float(RNG.integers(1, 50))))
    return spark.createDataFrame(rows, "symbol INT, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE").repartition(3).cache()


@pytest.fixture(scope="module")
def panel(bars):
    return be.library_panel(bars, NAMES, block=4)


def test_panel_is_the_factors_in_long_form(bars, panel):
    wide = compute_factors(bars, NAMES).toPandas().sort_values(["symbol", "ts"])
    close = bars.select("symbol", "ts", "close").toPandas().sort_values(["symbol", "ts"])
    close["fwd"] = close.groupby("symbol")["close"].shift(-1) / close["close"] - 1
    want = wide.melt(["symbol", "ts"], var_name="name", value_name="value").dropna(subset=["value"]).merge(close[["symbol", "ts", "fwd"]], on=["symbol", "ts"])
    got = panel.toPandas().merge(want, on=["symbol", "ts", "name"], suffixes=("", "_w"))
    assert len(got) == len(want) == panel.count()
    assert np.allclose(got["value"], got["value_w"]) and np.allclose(got["fwd"], got["fwd_w"], equal_nan=True)


def test_evaluation_equals_pandas(panel):
    got = sc.evaluate_library(panel).toPandas().set_index("name")
    d = panel.toPandas().dropna()
    out = {}
    for name, g in d.groupby("name"):
        ics, held = [], []
        for _, day in g.groupby("ts"):
            if len(day) < 3:
                continue
            rx, ry = day["value"].rank(), day["fwd"].rank()
            ics.append(rx.corr(ry) if rx.std() > 0 else np.nan)
            held.append(np.cov(rx, day["fwd"], ddof=0)[0, 1] / rx.std(ddof=0) if rx.std() > 0 else np.nan)
        ics, held = pd.Series(ics), pd.Series(held)
        out[name] = (ics.mean(), ics.mean() / ics.std(), ics.skew(), (ics.dropna() > 1e-9).mean(), ics.count(), held.mean() / held.std() * np.sqrt(252))
    want = pd.DataFrame(out, index=["ic_mean", "ir", "ic_skew", "hit_rate", "n", "sharpe"]).T.loc[got.index]
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float)), c
    order = want["ic_mean"].abs().sort_values(ascending=False).index
    assert list(got.sort_values("rank").index) == list(order)
    top = sc.evaluate_library(panel, top_n=2).toPandas().sort_values("rank")
    assert list(top["name"]) == list(order[:2])


def test_benchmark_run_and_ledger(spark, panel):
    scores = be.evaluate(panel)
    run = be.benchmark_run(scores, top=3).first()
    pdf = scores.toPandas().sort_values("rank")
    assert run["total"] == len(pdf) == 6 and run["top"] == ",".join(pdf["name"][:3])
    assert np.isclose(run["mean_ic"], pdf["ic_mean"].abs().mean()) and np.isclose(run["median_ic"], pdf["ic_mean"].abs().median())
    assert np.isclose(run["mean_sharpe"], pdf["sharpe"].mean()) and run["passed"] == (pdf["ic_mean"].abs() >= 0.03).sum()
    path = scratch_path(spark, "ledger-test")
    assert be.append_ledger(be.ledger_rows(scores, "a"), path) == 6
    assert be.append_ledger(be.ledger_rows(scores, "a"), path) == 0  # a retried run adds nothing
    assert be.append_ledger(be.ledger_rows(scores, "b"), path) == 6
    assert spark.read.parquet(path).select("trial").distinct().count() == 12
    none = be.benchmark_run(scores.limit(0)).first()
    assert none["total"] == 0 and none["mean_ic"] is None and none["top"] == ""


def test_benchmark_factor(panel):
    scores = be.evaluate(panel)
    r = be.benchmark_factor(scores, panel, "ROC5").first()
    w = panel.toPandas().pivot(index=["symbol", "ts"], columns="name", values="value")
    corr = {c: abs(w[["ROC5", c]].dropna().rank().corr().iloc[0, 1]) for c in w.columns if c != "ROC5"}
    best = max(corr, key=corr.get)
    pdf = scores.toPandas().set_index("name")
    assert r["closest"] == best and np.isclose(r["max_corr"], corr[best]) and r["novel"] == (corr[best] < 0.7)
    assert np.isclose(r["lib_ic"], pdf.drop("ROC5")["ic_mean"].mean()) and r["rank"] == pdf.loc["ROC5", "rank"]


def test_panel_without_any_factor(bars):
    with pytest.raises(ValueError):
        be.library_panel(bars, ["no_such_factor"])


@pytest.fixture(scope="module")
def cloud(spark):
    centres = RNG.normal(size=(12, 16)) * 3
    x = np.vstack([c + RNG.normal(size=(80, 16)) for c in centres])
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(5).cache()
    return df, x / np.linalg.norm(x, axis=1, keepdims=True)


def asked(df):
    return df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def nearest(u, q, k):
    return list(np.argsort(-(u[q] @ u.T), kind="stable")[:k])


@pytest.mark.parametrize("rows", [None, 7, 100])
def test_blocked_search_equals_brute_force(cloud, rows):
    df, u = cloud
    got = ve.blocked_knn(asked(df), df, 5, v_rows=rows).toPandas().sort_values(["query_id", "rank"])
    for q, g in got.groupby("query_id"):
        assert list(g["vec_id"]) == nearest(u, q, 5)
    assert got["query_id"].nunique() == 48


def test_blocked_search_edges(spark, cloud):
    df, _ = cloud
    odd = spark.createDataFrame([(-3, None), (-2, [0.0] * 16), (-1, [0.0] * 16)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    both = df.unionByName(odd)
    got = ve.blocked_knn(odd.withColumnRenamed("vec_id", "query_id"), both, 2).toPandas()
    assert set(got["query_id"]) == {-2, -1} and set(got["vec_id"]) == {-2, -1} and (got["score"] == 0).all()  # ties: smaller id
    assert ve.blocked_knn(asked(df).limit(0), df, 2).count() == 0
    assert ve.knn(asked(df).limit(0), df, 2).count() == 0
    assert ve.knn(asked(df), df.limit(0), 2).count() == 0


def test_index_recall(cloud):
    df, u = cloud
    index = ve.VectorIndex(df, cells=16, sample=400)
    assert index.table.count() == df.count()
    probes = index.probes_for(asked(df), 10, 0.95)
    assert probes < 16
    got = index.search(asked(df), 10, probes).toPandas()
    hits = sum(len(set(g["vec_id"]) & set(nearest(u, q, 10))) for q, g in got.groupby("query_id"))
    curve = {r["probes"]: r["recall"] for r in index.recall_curve(asked(df), 10).collect()}
    assert hits / 480 >= 0.95 and np.isclose(hits / 480, curve[probes])
    every = index.search(asked(df), 10, 16).toPandas()
    assert all(set(g["vec_id"]) == set(nearest(u, q, 10)) for q, g in every.groupby("query_id"))


def test_index_of_few_or_no_vectors(cloud):
    df, _ = cloud
    one = ve.VectorIndex(df.filter("vec_id = 20"))
    assert [r["vec_id"] for r in one.search(asked(df).filter("query_id = 40"), 3, 5).collect()] == [20]
    assert ve.VectorIndex(df.limit(0)).search(asked(df), 3, 5).count() == 0


def test_similarity_matrix_in_blocks(cloud):
    df, u = cloud
    got = ve.similarity_matrix(df.filter("vec_id < 50"), rows=8).toPandas()
    assert len(got) == 2500
    assert np.allclose(got["score"], [u[a] @ u[b] for a, b in zip(got["a"], got["b"])])


@pytest.fixture(scope="module")
def groups(spark):
    """Three groups far from each other in direction, of 30, 20 and 10 vectors."""
    rows, i = [], 0
    for g, size in enumerate((30, 20, 10)):
        for _ in range(size):
            v = RNG.normal(0, 0.05, 6)
            v[2 * g] += 5
            rows.append((i, g, v.tolist()))
            i += 1
    return spark.createDataFrame(rows, "vec_id BIGINT, g INT, embedding ARRAY<DOUBLE>").cache()


def test_kmeans_finds_planted_groups(groups):
    got = ve.kmeans(groups, 3).toPandas()
    assert sorted(got["size"]) == [10, 20, 30] and (got["mean_similarity"] > 0.99).all() and (got["silhouette"] > 0.9).all()
    pdf = groups.toPandas()
    x = np.stack(pdf["embedding"])
    for r in got.itertuples():
        g = pdf.loc[pdf["vec_id"] == r.representative, "g"].iloc[0]
        mine = (pdf["g"] == g).to_numpy()
        d = ((x[mine] - x[mine].mean(axis=0)) ** 2).sum(axis=1)
        assert mine.sum() == r.size and r.representative == pdf["vec_id"].to_numpy()[mine][d.argmin()]


def test_elbow_and_bisecting(groups):
    k, cost = ve.best_k(groups, 5)
    x = np.stack(groups.toPandas()["embedding"])
    assert np.isclose(cost[0], ((x - x.mean(axis=0)) ** 2).sum()) and cost == sorted(cost, reverse=True)
    second = [cost[i - 1] - 2 * cost[i] + cost[i + 1] for i in range(1, 4)]
    assert k == int(np.argmax(second)) + 2 and cost[2] < 0.01 * cost[0]
    b = ve.bisecting(groups, 3).join(groups.select("vec_id", "g"), "vec_id").toPandas()
    assert b.groupby("cluster")["g"].nunique().max() == 1 and b["cluster"].nunique() == 3


@pytest.mark.parametrize("rows", [1 << 20, 40, 7])
def test_rank_moments_in_pieces_equal_pandas(spark, rows):
    """Groups under and over the bound, ties, one very frequent value, NaN, a side that does not vary, NULL keys and values."""
    rng = np.random.default_rng(5)
    data = [("a", float(rng.integers(0, 6)), float(rng.normal())) for _ in range(120)] + [("b", float(rng.normal()), 0.0 if rng.random() < 0.8 else float(rng.normal())) for _ in range(90)]
    data += [("c", float("nan") if i % 4 == 0 else float(i % 7), float(i)) for i in range(30)] + [("d", 1.0, float(i)) for i in range(50)] + [(None, float(i), float(i)) for i in range(50)]
    df = spark.createDataFrame(data + [("a", None, 1.0), ("a", 1.0, None)], "g STRING, x DOUBLE, y DOUBLE").repartition(3)
    got = rank_moments(df, ["g"], "x", "y", rows=rows).toPandas().set_index("g")
    for g, d in pd.DataFrame(data, columns=["g", "x", "y"]).groupby("g"):
        rx, ry = d["x"].fillna(np.inf).rank(), d["y"].rank()
        assert got.loc[g, "n"] == len(d)
        if g == "d":
            assert pd.isna(got.loc[g, "rank_ic"]) and pd.isna(got.loc[g, "held"])
        else:
            assert np.isclose(got.loc[g, "rank_ic"], rx.corr(ry)) and np.isclose(got.loc[g, "held"], np.cov(rx, d["y"], ddof=0)[0, 1] / rx.std(ddof=0))
    assert got[got.index.isna()]["n"].tolist() == [50] and got[got.index.isna()]["rank_ic"].isna().all()


def test_own_values_beside_the_panel(bars, panel):
    """A panel that carries the factor's own values needs no join of long rows."""
    beside = be.library_panel(bars, NAMES, block=4, own="ROC5")
    scores = be.evaluate(beside)
    got, want = be.benchmark_factor(scores, beside, "ROC5"), be.benchmark_factor(scores, panel, "ROC5")
    assert np.allclose([got.first()["max_corr"], got.first()["ic"]], [want.first()["max_corr"], want.first()["ic"]]) and got.first()["closest"] == want.first()["closest"]


def test_a_task_of_the_index_holds_few_scores(spark, monkeypatch):
    """Scores of a batch against all centres come in blocks: 3,000 rows against 500 centres once made 12 MB at a time, and as much for their order."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=4)]) for i in range(3000)], "vec_id BIGINT, embedding ARRAY<FLOAT>").coalesce(1)
    index = ve.VectorIndex.__new__(ve.VectorIndex)
    index.id_col, index.vec, index.spark, index.cells = "vec_id", "embedding", spark, 500
    index.centres = ve._unit(rng.normal(size=(500, 4)))
    monkeypatch.setattr(ve, "SCORE_BYTES", 1 << 16)
    near = index._near(df, 500)
    assert "MapInArrow" in near._jdf.queryExecution().toString()
    got = near.filter("_place = 1").toPandas().sort_values("vec_id")["_cell"].to_numpy()
    x = ve._unit(df.toPandas().sort_values("vec_id")["embedding"])
    assert (got == np.argmax(x @ index.centres.T, axis=1)).all()
    assert (index._near(df, 1).toPandas().sort_values("vec_id")["_cell"].to_numpy() == got).all()
