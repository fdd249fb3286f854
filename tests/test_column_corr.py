import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import column_corr as cc
from factorspark.operators import scoring as sc
from factorspark.operators.rolling_ic import rolling_rank_ic, window_rank_corr

RNG = np.random.default_rng(11)


def frame(spark, x: pd.DataFrame):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in x.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` DOUBLE" for c in x.columns))


def same(got, want, cols):
    rows = got.collect()
    assert len(rows) == len(cols) * (len(cols) - 1) // 2
    for r in rows:
        w = want.loc[r["factor_a"], r["factor_b"]]
        assert (r["corr"] is None) == np.isnan(w) and (r["corr"] is None or r["corr"] == pytest.approx(w, abs=1e-9)), (r, w)


def spearman(x: pd.DataFrame) -> pd.DataFrame:
    pair = lambda a, b: x[[a, b]].dropna().rank().corr().iloc[0, 1] if len(x[[a, b]].dropna()) > 1 else np.nan
    return pd.DataFrame({b: {a: pair(a, b) for a in x.columns if a != b} for b in x.columns})


def test_columns_that_lack_rows_alike_and_unalike(spark):
    """Two groups of columns that start late, one column with its own gaps, ties, constants, and names with dots."""
    cols = [f"c.{i}" for i in range(12)]
    x = pd.DataFrame(RNG.normal(size=(300, 12)), columns=cols)
    x["c.1"] = x["c.0"] ** 3
    x.loc[:40, ["c.2", "c.3"]] = np.nan
    x.loc[:90, ["c.4", "c.5"]] = np.nan
    x.loc[RNG.random(300) < 0.3, "c.6"] = np.nan
    x["c.7"], x["c.8"], x["c.9"] = x["c.0"].round(0), 3.5, np.nan
    x["c.10"] += 1e7
    d = frame(spark, x.rename(columns=lambda c: c.replace(".", "_"))).repartition(7)
    x.columns = cols = d.columns
    same(sc.corr_matrix(d, cols), x.corr(), cols)
    same(sc.spearman_matrix(d, cols), spearman(x), cols)


def test_each_column_is_ranked_once_per_set_of_rows():
    """Columns without gaps and columns that lack the same rows need no ranking of their own pair."""
    full = np.full((50, 50), 900)
    assert len(cc._rankings(full)[0]) == 50
    late = full.copy()
    late[25:, :] = late[:, 25:] = 700
    wanted, use = cc._rankings(late)
    assert len(wanted) == 75 and use[30, 0] == 30 and use[0, 30] == use[0, 49] != 0


def test_infinities_and_nan_are_missing_and_few_rows_have_no_value(spark):
    d = spark.createDataFrame([(1.0, 2.0, float("nan")), (2.0, 1.0, 5.0), (3.0, float("inf"), 6.0), (4.0, 0.5, None)], "a DOUBLE, b DOUBLE, c DOUBLE")
    for f in (cc.pearson_pairs, cc.spearman_pairs):
        got = {(r["factor_a"], r["factor_b"]): r["corr"] for r in f(d, ["a", "b", "c"]).collect()}
        assert got["a", "b"] < -0.9 and got["a", "c"] == pytest.approx(1.0) and got["b", "c"] is None
        assert {r["corr"] for r in f(d, ["a", "b", "c"], 5).collect()} == {None}
        assert {r["corr"] for r in f(d.limit(0), ["a", "b", "c"]).collect()} == {None}


def test_small_blocks_add_up(spark, monkeypatch):
    monkeypatch.setattr(cc, "CELLS", 12)
    x = pd.DataFrame(RNG.normal(size=(60, 4)), columns=list("abcd"))
    x.loc[RNG.random(60) < 0.2, "b"] = np.nan
    d = frame(spark, x)
    same(cc.pearson_pairs(d, list("abcd")), x.corr(), list("abcd"))
    same(cc.spearman_pairs(d, list("abcd")), spearman(x), list("abcd"))


@pytest.mark.parametrize("n,size", [(2, 9), (3, 3), (5, 4), (7, 200), (20, 61), (50, 333)])
def test_window_ranks_with_ties_and_gaps(n, size):
    x, y = RNG.integers(0, 6, size).astype(float), RNG.normal(size=size)
    y[RNG.random(size) < 0.02] = np.nan
    got = window_rank_corr(x, y, n)
    assert len(got) == max(size - n + 1, 0)
    for t, g in enumerate(got):
        w = pd.DataFrame({"x": x[t:t + n], "y": y[t:t + n]})
        want = np.nan if w.isna().any().any() else w.rank().corr().iloc[0, 1]
        assert np.isnan(g) == np.isnan(want) and (np.isnan(g) or g == pytest.approx(want, abs=1e-12))


def test_rolling_rank_ic_over_stretches(spark, monkeypatch):
    """Series longer than a stretch, a short one, an empty table, and a big integer column that passes through."""
    monkeypatch.setattr("factorspark.operators.rolling_ic.STRETCH", 40)
    p = pd.concat([pd.DataFrame({"symbol": s, "ts": np.arange(k), "factor": RNG.integers(0, 9, k).astype(float), "fwd": RNG.normal(size=k)})
                   for s, k in (("a", 260), ("b", 81), ("c", 4), ("d", 5))])
    p["id"] = 2 ** 53 + 1 + p.ts
    d = spark.createDataFrame(p).withColumn("id", F.when(F.col("ts") % 2 == 0, F.col("id")))
    got = rolling_rank_ic(d, 5).toPandas().set_index(["symbol", "ts"])["rank_ic"]
    assert len(got) == 256 + 77 + 1
    for (s, ts), g in got.items():
        w = p[(p.symbol == s) & (p.ts > ts - 5) & (p.ts <= ts)][["factor", "fwd"]].rank().corr().iloc[0, 1]
        assert g == pytest.approx(w, abs=1e-12) or (np.isnan(w) and np.isnan(g))
    assert rolling_rank_ic(d, 5).filter("id % 2 = 0 AND id > 9007199254740992 AND id <> 9007199254740993 + ts").isEmpty()
    assert rolling_rank_ic(d.limit(0), 5).isEmpty()
    with pytest.raises(ValueError):
        rolling_rank_ic(d, 1)
