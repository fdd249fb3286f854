import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.factors import compute_factors, missing_factors, register_factor
from factorspark.factors.base import FACTORS, SETS
from factorspark.operators import asof as aj
from factorspark.operators import cross_section as cs
from factorspark.operators import folds as fo
from factorspark.operators import ledger as le
from factorspark.operators import performance as pf
from factorspark.operators import portfolio as po
from factorspark.operators import quality as qu
from factorspark.operators import scoring as sc
from factorspark.operators import selection as se
from factorspark.operators import vectors as ve
from factorspark.operators.windows import Roll, with_drawdown, with_streak

RNG = np.random.default_rng(7)
SCHEMA = "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


@pytest.fixture(scope="module")
def bars_pd():
    out = []
    for s in ("A", "B"):
        c = 100 * np.exp(np.cumsum(RNG.normal(0, 0.02, 120)))
        o = c * (1 + RNG.normal(0, 0.005, 120))
        out.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=120, freq="h"), "open": o, "high": np.maximum(o, c) * 1.01,
                                 "low": np.minimum(o, c) * 0.99, "close": c, "volume": RNG.uniform(10, 100, 120)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, bars_pd):
    return spark.createDataFrame(bars_pd, SCHEMA)


def collect(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_rolling_matches_pandas(bars, bars_pd):
    r = Roll()
    got = collect(r.number(bars).select("symbol", "ts", r.mean("close", 10).alias("mean"), r.std("close", 10).alias("std"), r.skew("close", 10).alias("skew"), r.kurt("close", 10).alias("kurt"),
                                        r.med("close", 10).alias("med"), r.quantile("close", 10, 0.8).alias("q"), r.ema("close", 5).alias("ema"), r.idxmax("close", 10).alias("imax"),
                                        r.wma("close", 4).alias("wma"), r.slope("close", 10).alias("slope"), r.mad("close", 10).alias("mad"), r.corr("close", "volume", 10).alias("corr")), "symbol", "ts")
    g = bars_pd.sort_values(["symbol", "ts"]).groupby("symbol")["close"]
    want = pd.DataFrame({
        "mean": g.transform(lambda x: x.rolling(10).mean()), "std": g.transform(lambda x: x.rolling(10).std()), "skew": g.transform(lambda x: x.rolling(10).skew()),
        "kurt": g.transform(lambda x: x.rolling(10).kurt()), "med": g.transform(lambda x: x.rolling(10).median()), "q": g.transform(lambda x: x.rolling(10).quantile(0.8)),
        "ema": g.transform(lambda x: x.ewm(span=5).mean()), "imax": g.transform(lambda x: x.rolling(10).apply(lambda a: np.argmax(a) + 1)),
        "wma": g.transform(lambda x: x.rolling(4).apply(lambda a: np.dot(a, [1, 2, 3, 4]) / 10)), "slope": g.transform(lambda x: x.rolling(10).apply(lambda a: np.polyfit(range(10), a, 1)[0])),
        "mad": g.transform(lambda x: x.rolling(10).apply(lambda a: np.abs(a - a.mean()).mean()))})
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].to_numpy(), rtol=1e-6, atol=1e-8, err_msg=c)
    corr = bars_pd.groupby("symbol").apply(lambda d: d["close"].rolling(10).corr(d["volume"]), include_groups=False).to_numpy().ravel()
    np.testing.assert_allclose(got["corr"].astype(float), corr, rtol=1e-6, atol=1e-8)


def test_negative_lag_is_refused(bars):
    with pytest.raises(ValueError):
        Roll().ref("close", -1)


def test_factors_never_read_ahead(bars, bars_pd, spark):
    """Values computed on a truncated history equal those on the full history."""
    names = [n for s in ("kline", "rolling", "ratio", "indicator", "builtin") for n in SETS[s] if s != "rolling" or n.endswith("20")]
    cut = pd.Timestamp("2024-01-04")
    full = collect(compute_factors(bars, names).filter(F.col("ts") < F.lit(cut)), "symbol", "ts")
    part = collect(compute_factors(spark.createDataFrame(bars_pd[bars_pd.ts < cut], SCHEMA), names), "symbol", "ts")
    for n in full.columns[2:]:
        np.testing.assert_allclose(full[n].astype(float), part[n].astype(float), rtol=1e-9, err_msg=n)


def test_library_sizes():
    assert {k: len(SETS[k]) for k in ("kline", "rolling", "ratio", "crypto", "funding", "open_interest", "long_short", "liquidation", "basis", "taker", "composite")} == {
        "kline": 9, "rolling": 145, "ratio": 19, "crypto": 15, "funding": 10, "open_interest": 9, "long_short": 7, "liquidation": 5, "basis": 5, "taker": 5, "composite": 4}


def test_whole_registry_has_distinct_columns(bars):
    cols = [c.lower() for c in compute_factors(bars).columns]
    assert len(cols) == len(set(cols)) and "builtin_rsi_14" in cols


def test_unknown_and_uncomputable_factors(bars):
    assert compute_factors(bars, ["KMID", "NOPE", "BASIS"]).columns == ["symbol", "ts", "KMID"]
    assert missing_factors(bars, ["KMID", "NOPE", "BASIS"]) == {"NOPE": "unknown", "BASIS": "missing columns: basis"}
    with pytest.raises(ValueError):
        register_factor("KMID", "x")(lambda r: F.lit(1.0))
    assert "KMID" in FACTORS


def test_one_exchange_for_many_factors(bars):
    plan = compute_factors(bars, SETS["rolling"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows and one value a third of them."""
    n = 3000
    v = np.where(RNG.uniform(size=n) < 0.33, 0.0, np.round(RNG.normal(0, 5, n), 2))
    v[::97] = np.nan
    return pd.DataFrame({"g": np.where(RNG.uniform(size=n) < 0.8, "hot", "cold"), "id": np.arange(n), "v": v, "w": RNG.normal(size=n)})


def _spark(spark, pdf):
    d = spark.createDataFrame(pdf)
    return d.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_distributed_rank(spark, skewed):
    d = cs.avg_rank(_spark(spark, skewed), ["g"], "v", "r", "n")
    d = cs.ranked(d, ["g"], "v", "id", prefix="_p_")
    got = collect(d, "id")
    want = skewed.groupby("g")["v"].rank()
    np.testing.assert_allclose(got["r"].astype(float), want.to_numpy())
    pos = skewed.dropna().sort_values(["g", "v", "id"]).assign(p=lambda x: x.groupby("g").cumcount() + 1).set_index("id")["p"]
    have = got.dropna(subset=["_p_pos"]).set_index("id")["_p_pos"].astype(int)
    pd.testing.assert_series_equal(have.sort_index(), pos.sort_index(), check_names=False, check_dtype=False)


def test_global_rank_and_quantiles(spark, skewed):
    d = _spark(spark, skewed)
    got = collect(cs.avg_rank(d, [], "v", "r"), "id")
    np.testing.assert_allclose(got["r"].astype(float), skewed["v"].rank().to_numpy())
    q = collect(cs.winsor_bounds(d, ["g"], "v", [0.01, 0.5, 0.99]), "g")
    want = skewed.groupby("g")["v"].quantile([0.01, 0.5, 0.99]).unstack().sort_index()
    np.testing.assert_allclose(q[["q0", "q1", "q2"]].to_numpy(), want.to_numpy())


def test_value_bucket_is_monotone(spark):
    x = np.sort(np.concatenate([RNG.normal(0, 10 ** e, 200) for e in (-6, -1, 0, 3, 9)] + [np.zeros(3)]))
    b = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i INT, v DOUBLE").orderBy("i").select(cs.value_bucket(F.col("v"))).collect()]
    assert all(p <= q for p, q in zip(b, b[1:]))


def test_spearman(spark, skewed):
    d = _spark(spark, skewed)
    got = {r["g"]: r["rank_ic"] for r in cs.rank_corr(d, ["g"], "v", "w").collect()}
    for g, part in skewed.dropna().groupby("g"):
        assert got[g] == pytest.approx(part["v"].rank().corr(part["w"].rank()), abs=1e-12)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_asof_matches_pandas(spark, direction, chunk):
    n = 400
    left = pd.DataFrame({"symbol": np.where(RNG.uniform(size=n) < 0.9, "hot", "cold"), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(RNG.integers(0, 5 * 86400, n), unit="s"), "id": np.arange(n)})
    right = pd.DataFrame({"symbol": ["hot"] * 20 + ["cold"] * 5, "ts": pd.to_datetime("2024-01-01 12:00") + pd.to_timedelta(np.concatenate([RNG.choice(4 * 86400, 20, False), RNG.choice(4 * 86400, 5, False)]), unit="s"), "v": np.arange(25.0)})
    got = collect(aj.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), direction=direction, chunk=chunk), "id")
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol", direction=direction).sort_values("id")
    np.testing.assert_allclose(got["v"].astype(float), want["v"].to_numpy())
    assert len(got) == n


def test_funding_alignment(spark):
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "B", "ts": pd.date_range("2024-01-01", periods=9, freq="h")}))
    f = spark.createDataFrame(pd.DataFrame({"symbol": "B", "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 08:00"]), "funding_rate": [0.0001, 0.0002]}))
    ff = collect(aj.align_ffill(bars, f, "funding_rate"), "ts")["funding_rate"]
    assert list(ff[:8]) == [0.0001] * 8 and ff[8] == 0.0002
    ip = collect(aj.align_interpolate(bars, f, "funding_rate"), "ts")["funding_rate"]
    assert ip[4] == pytest.approx(0.00015)
    ds = collect(aj.align_distribute(bars, f, "funding_rate"), "ts")["funding_rate"]
    assert ds[0] == pytest.approx(0.0001 / 8)


def test_range_join_equals_brute_force(spark):
    iv = pd.DataFrame({"symbol": "A", "k": range(20), "s": pd.to_datetime("2024-01-01") + pd.to_timedelta(RNG.integers(0, 10 ** 6, 20), unit="s")})
    iv["e"] = iv["s"] + pd.to_timedelta(RNG.integers(0, 300000, 20), unit="s")
    pt = pd.DataFrame({"symbol": "A", "p": pd.to_datetime("2024-01-01") + pd.to_timedelta(RNG.integers(0, 10 ** 6, 100), unit="s"), "j": range(100)})
    got = aj.range_join(spark.createDataFrame(iv), spark.createDataFrame(pt), "symbol", "s", "e", "p").select("k", "j").collect()
    want = {(k, j) for k, s, e in iv[["k", "s", "e"]].itertuples(index=False) for p, j in pt[["p", "j"]].itertuples(index=False) if s < p <= e}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_drawdown_and_streak(spark):
    d = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate([100, 110, 99, 104.5, 120, 60])], "symbol STRING, ts INT, equity DOUBLE")
    r = collect(with_drawdown(d), "ts")
    np.testing.assert_allclose(r["drawdown"], [0, 0, 0.1, 0.05, 0, 0.5])
    assert list(r["dd_length"]) == [0, 0, 1, 2, 0, 1]
    s = collect(with_streak(d, F.col("equity") > 100), "ts")
    assert list(s["streak"]) == [0, 1, 0, 1, 2, 0]


def test_turnover(spark):
    w = spark.createDataFrame([(1, "2024-01-01", 0.5), (2, "2024-01-01", 0.5), (2, "2024-01-02", 1.0), (3, "2024-01-03", 1.0)], "symbol INT, ts STRING, weight DOUBLE")
    assert {r["ts"]: r["turnover"] for r in sc.turnover(w).collect()} == {"2024-01-02": 0.5, "2024-01-03": 1.0}


@pytest.mark.parametrize("scheme", ["sequential", "rolling", "walk", "purged", "forward"])
def test_folds_never_overlap(spark, scheme):
    d = spark.createDataFrame(pd.DataFrame({"ts": np.repeat(pd.date_range("2020-01-01", periods=100), 3), "x": 1.0}))
    t = fo.fold_table(fo.date_index(d), scheme)
    v = fo.validate_folds(t).collect()
    assert v and all(r["overlap"] == 0 and r["n_test"] > 0 for r in v)
    if scheme == "purged":
        p = t.toPandas()
        idx = {x: i for i, x in enumerate(sorted(p.ts.unique()))}
        for _, f in p.groupby("fold"):
            tr, te = ({idx[x] for x in f[f.role == r].ts} for r in ("train", "test"))
            assert min(abs(a - b) for a in tr for b in te) > 2
    assert fo.assign_folds(d, scheme).groupBy("ts", "fold").agg(F.count_distinct("role").alias("n")).filter("n > 1").isEmpty()


def test_weights_sum_to_one(spark):
    m = spark.createDataFrame([("a", 0.05, 1.0), ("b", -0.02, -0.5), ("c", 0.01, 0.3)], "name STRING, ic DOUBLE, ir DOUBLE")
    for method in ("equal", "ic", "ir", "rank"):
        w = {r["name"]: r["weight"] for r in po.factor_weights(m, method, 0.0, 0.9).collect()}
        assert sum(w.values()) == pytest.approx(1.0) and max(w, key=w.get) == "a" or method == "equal"


def test_correlation_matrices_are_pairwise_complete(spark):
    """A column that starts late costs only its own pairs rows; ties, and a column without values."""
    cols = [f"c{i:02d}" for i in range(20)]
    x = pd.DataFrame(RNG.normal(size=(200, 20)), columns=cols)
    x.loc[:150, "c03"] = np.nan
    x.loc[RNG.random(200) < 0.2, "c07"] = np.nan
    x["c09"], x["c19"] = x["c09"].round(0), np.nan
    d = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()], ", ".join(f"{c} DOUBLE" for c in cols))
    spear = pd.DataFrame({b: {a: x[[a, b]].dropna().rank().corr().iloc[0, 1] for a in cols if a != b} for b in cols})
    for got, want in ((sc.corr_matrix(d, cols), x.corr()), (sc.spearman_matrix(d, cols), spear)):
        rows = got.collect()
        assert len(rows) == 190
        for r in rows:
            w = want.loc[r["factor_a"], r["factor_b"]]
            assert r["corr"] is None if np.isnan(w) else r["corr"] == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 5, 26])
def test_ema_sees_the_whole_history(spark, n):
    """Over many stretches, from a first value that outweighs the rest, with missing rows."""
    x = pd.Series(RNG.normal(size=4000))
    x[0] = 1e12
    x[RNG.random(4000) < 0.1] = np.nan
    r = Roll()
    d = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol STRING, ts INT, v DOUBLE")
    got = r.number(d).select("ts", r.ema("v", n).alias("e")).toPandas().sort_values("ts")["e"].to_numpy()
    np.testing.assert_allclose(got, x.ewm(span=n).mean().to_numpy(), rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("n", [1, 2, 12, 26])
def test_ema_over_long_gaps(spark, n):
    """Gaps longer than any fixed look-back, one after two present rows in sequence, and a value every 480 rows."""
    x = pd.Series(RNG.normal(100, 5, size=9000))
    x[:7] = np.nan
    x[130:2600] = np.nan
    x[2602:5400] = np.nan
    x[(x.index >= 5400) & (x.index % 480 != 0)] = np.nan
    r = Roll()
    d = spark.createDataFrame([(s, i, None if np.isnan(v) else float(v)) for s in "ab" for i, v in enumerate(x)], "symbol STRING, ts INT, v DOUBLE")
    got = r.number(d).select("symbol", "ts", r.ema("v", n).alias("e")).toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        np.testing.assert_allclose(g["e"].to_numpy(), x.ewm(span=n, ignore_na=False).mean().to_numpy(), rtol=1e-9)


def test_ml_feature_block(spark, bars, bars_pd):
    d = bars.withColumn("factor", F.col("close") - F.col("open"))
    got = po.ml_features(d).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for s, b in bars_pd.groupby("symbol"):
        f, c, v = b["close"] - b["open"], b["close"], b["volume"]
        m = f.rolling(60)
        want = {"factor_raw": f, "factor_zscore": (f - m.mean()) / m.std(), "factor_rank": m.rank(pct=True), "factor_ma_ratio": f / m.mean(), "factor_momentum": f.diff(5),
                "factor_momentum_10": f.diff(10), "return_1d": c.pct_change(), "return_5d": c.pct_change(5), "return_10d": c.pct_change(10),
                "volatility_20d": c.pct_change().rolling(20).std(), "ma_ratio_20": c / c.rolling(20).mean(), "ma_ratio_60": c / c.rolling(60).mean(),
                "volume_ma_ratio": v / v.rolling(20).mean()}
        for name, w in want.items():
            np.testing.assert_allclose(got.loc[got["symbol"] == s, name].to_numpy(float), w.to_numpy(), rtol=1e-7, atol=1e-9, err_msg=name)


def test_compare_factors(spark):
    p = pd.DataFrame(RNG.normal(size=(400, 4)), columns=["a", "b", "c", "fwd"])
    p["ts"], p["c"] = np.arange(400) // 20, p["a"] + 0.5 * p["c"]
    p["fwd"] += 0.3 * p["b"]
    p.loc[RNG.random(400) < 0.2, "b"] = np.nan
    p["d"] = np.where(p.index < 8, p["a"], np.nan)
    d = spark.createDataFrame(p).replace(float("nan"), None)
    got = sc.compare_factors(d, ["a", "b", "c", "d"]).toPandas()
    want = p[["a", "b", "c", "d"]].corr(method="spearman", min_periods=11)
    assert len(got) == 16
    for r in got.itertuples():
        w = 1.0 if r.factor == r.other else want.loc[r.factor, r.other]
        assert np.isnan(w) and np.isnan(r.corr) or r.corr == pytest.approx(w)
    sharpe = {}
    for k in "abcd":
        x = p.dropna(subset=[k]).groupby("ts").apply(lambda g: ((g[k] - g[k].mean()) / g[k].std(ddof=0) * g["fwd"]).mean(), include_groups=False)
        sharpe[k] = x.mean() / x.std() * 252 ** 0.5
    assert {r.factor: r.sharpe for r in got.itertuples()} == {k: pytest.approx(v, nan_ok=True) for k, v in sharpe.items()}
    order = sorted("abcd", key=lambda k: -np.nan_to_num(sharpe[k]))
    assert {r.factor: r.rank for r in got.itertuples()} == {k: i + 1 for i, k in enumerate(order)}


def test_greedy_selection(spark):
    names = [f"f{i}" for i in range(12)]
    ic = {n: float(v) for n, v in zip(names, RNG.permutation(np.linspace(0.01, 0.12, 12)))}
    pairs = [(a, b, float(RNG.uniform(-1, 1))) for i, a in enumerate(names) for b in names[i + 1:]]
    m = spark.createDataFrame([(n, ic[n], 1.0) for n in names], "name STRING, ic DOUBLE, ir DOUBLE")
    p = spark.createDataFrame(pairs, "factor_a STRING, factor_b STRING, corr DOUBLE")
    strong = {frozenset((a, b)) for a, b, c in pairs if abs(c) >= 0.5}
    keep = []
    for n in sorted(names, key=lambda n: -ic[n]):
        if not any(frozenset((n, k)) in strong for k in keep):
            keep.append(n)
    assert [r["name"] for r in se.select_uncorrelated(m, p, 4, 0.5).collect()] == keep[:4]


def test_redundant_groups(spark):
    m = spark.createDataFrame([(n, i / 100.0, 1.0) for i, n in enumerate("abcdef")], "name STRING, ic DOUBLE, ir DOUBLE")
    p = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("a", "c", 0.1), ("d", "e", 0.95), ("e", "f", 0.2)], "factor_a STRING, factor_b STRING, corr DOUBLE")
    got = {r["members"]: (r["best"], r["size"], r["mean_corr"]) for r in se.redundant_groups(m, p, 0.7).collect()}
    assert got["a,b,c"] == ("c", 3, pytest.approx(0.6)) and got["d,e"] == ("e", 2, 0.95) and got["f"] == ("f", 1, 1.0)


def test_long_component_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(n)], "name STRING")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n - 1) if i != 19], "a STRING, b STRING")
    got = {r["name"]: r["component"] for r in se.components(nodes, edges).collect()}
    assert set(got.values()) == {"n00", "n20"} and got["n19"] == "n00" and got["n39"] == "n20"


def test_performance_by_hand(spark):
    r = [0.1, -0.2, 0.05]
    d = spark.createDataFrame([("A", i, v) for i, v in enumerate(r)], "symbol STRING, ts INT, ret DOUBLE")
    p = pf.performance(d, 252).first()
    total = 1.1 * 0.8 * 1.05 - 1
    assert p["total_return"] == pytest.approx(total) and p["max_drawdown"] == pytest.approx(0.2) and p["win_rate"] == pytest.approx(2 / 3)
    assert p["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * 252 ** 0.5) and p["annual_return"] == pytest.approx((1 + total) ** (252 / 3) - 1)


def test_first_loss_counts_as_drawdown(spark):
    d = spark.createDataFrame([("A", 0, -0.3), ("A", 1, 0.1)], "symbol STRING, ts INT, ret DOUBLE")
    assert pf.performance(d, 252).first()["max_drawdown"] == pytest.approx(0.3)


def test_trial_thresholds(spark):
    t = spark.createDataFrame([(i, 2.5) for i in range(1, 51)], "trial INT, sharpe DOUBLE")
    got = collect(le.trial_thresholds(t), "trial")
    assert list(got["n_trials"]) == list(range(1, 51)) and got["threshold"].is_monotonic_increasing and got["threshold"][0] == 2.0
    assert got["threshold"][49] == pytest.approx(2 * (1 + (2 * np.log(50)) ** 0.5 * 0.15), rel=1e-3)


def test_chunked_lag(spark):
    n = 300
    pdf = pd.DataFrame({"k": np.where(RNG.uniform(size=n) < 0.7, "hot", "x"), "id": np.arange(n), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(RNG.integers(0, 20 * 86400, n), unit="s"), "v": RNG.normal(size=n)})
    got = collect(qu.chunked_lag(spark.createDataFrame(pdf), "k", "ts", "id", "v", "prev"), "id")
    want = pdf.sort_values(["ts", "id"]).groupby("k")["v"].shift(1).sort_index()
    np.testing.assert_allclose(got["prev"].astype(float), want.to_numpy())


@pytest.mark.parametrize("block", [1024, 4])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    """In one query block, and in several."""
    monkeypatch.setattr(ve, "BLOCK", block)
    x = RNG.normal(size=(200, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r], i % 3) for i, r in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").repartition(5)
    qs = v.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    got = ve.knn(qs, v, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:10] @ u.T
    for q in range(10):
        want = list(np.argsort(-s[q], kind="stable")[:4])
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_exit_rules(spark):
    t = spark.createDataFrame(pd.DataFrame({"symbol": ["A"], "trade_id": [1], "side": [1.0], "entry_ts": pd.to_datetime(["2024-01-01 00:00"]), "exit_ts": pd.to_datetime(["2024-01-01 06:00"]), "entry_price": [100.0]}))
    px = [100, 130, 120, 90, 75, 60, 60]
    b = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=7, freq="h"), "high": [float(p) for p in px], "low": [float(p) for p in px], "close": [float(p) for p in px]}))
    got = {r["rule"]: r["hit_ts"].hour for r in pf.exit_hits(t, b, max_hours=5).collect()}
    assert got == {"trailing_target": 3, "trailing_stop": 3, "stop": 4, "time": 5}


def test_rank_buckets_accept_infinities_and_nan(spark):
    from factorspark.operators.cross_section import value_bucket

    values = [float("-inf"), -1e300, -2.0, 0.0, 1e-300, 3.0, 1.7e308, float("inf"), float("nan")]
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, x DOUBLE").select("i", value_bucket(F.col("x")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in rows] == sorted({r["b"] for r in rows})


def test_group_stats_splits_a_hot_group(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        i = F.col("id")
        d = spark.range(0, 60000, numPartitions=8).select(i.alias("row"), F.when(i % 2 == 0, 0).otherwise(i % 97).alias("ts"), (i % 13).cast("double").alias("v"))
        z = cs.cs_zscore(d, ["ts"], "v", "z")
        assert z.count() == 60000
        z = cs.cs_zscore(d, ["ts"], "v", "z")
        got = z.toPandas()
        plan = z._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
        pdf = d.toPandas()
        g = pdf.groupby("ts")["v"]
        want = (pdf["v"] - g.transform("mean")) / g.transform("std")
        merged = got.merge(pdf.assign(w=want), on="row")
        assert np.allclose(merged["z"], merged["w"])
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_group_stats_null_keys_and_clashing_names(spark):
    d = spark.createDataFrame([(1, None, 1.0), (2, 1, 2.0), (3, 1, 4.0), (4, None, None)], "_gk INT, k INT, v DOUBLE")
    got = {r["_gk"]: r["m"] for r in cs.group_stats(d, ["k"], m=F.avg("v")).collect()}
    assert got == {1: None, 2: 3.0, 3: 3.0, 4: None}
    assert cs.group_stats(d.limit(0), ["k"], m=F.avg("v")).count() == 0
