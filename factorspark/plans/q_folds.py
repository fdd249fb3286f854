"""Fold, regime, stability and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.operators import fold_plan as fp
from factorspark.operators import folds as fo
from factorspark.operators import portfolio as po
from factorspark.operators import regimes as rg
from factorspark.operators import scoring as sc
from factorspark.operators import selection as se
from factorspark.operators import stability as st
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import R
from factorspark.plans.q_scoring import _LIB, _MIC, _COLS, _REG, _SM, pair_rank_corr
from factorspark.plans.registry import query

_DI = "di AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM sp))"
_FOLD = {
    "sequential": "SELECT ts, CAST(0 AS BIGINT) AS fold, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS role FROM di",
    "rolling": """SELECT ts, fold, CASE WHEN i >= fold * 12 AND i < fold * 12 + 14 THEN 'train' WHEN i >= fold * 12 + 14 AND i < fold * 12 + 24 THEN 'test' END AS role
        FROM di, (SELECT unnest(generate_series(0, 20)) AS fold) WHERE fold * 12 + 24 < n AND i >= fold * 12 AND i < fold * 12 + 24""",
    "walk": """SELECT ts, fold, CASE WHEN i < fold * 12 + 24 THEN 'train' ELSE 'test' END AS role
        FROM di, (SELECT unnest(generate_series(0, 20)) AS fold) WHERE fold * 12 + 24 + 1 <= n AND i >= fold * 12 AND i < fold * 12 + 36""",
    "purged": """SELECT ts, fold, CASE WHEN i >= fold * (n // 5) AND i < CASE WHEN fold < 4 THEN (fold + 1) * (n // 5) ELSE n END THEN 'test'
        WHEN i < fold * (n // 5) - 2 - floor(n * 0.01) THEN 'train' WHEN i >= CASE WHEN fold < 4 THEN (fold + 1) * (n // 5) ELSE n END + 2 THEN 'train' ELSE 'purge' END AS role
        FROM di, (SELECT unnest(generate_series(0, 4)) AS fold)""",
    "forward": """SELECT ts, fold, CASE WHEN i >= (fold + 1) * (n // 6) THEN 'test' WHEN i < (fold + 1) * (n // 6) - 2 - floor(n * 0.01) THEN 'train' ELSE 'purge' END AS role
        FROM di, (SELECT unnest(generate_series(0, 4)) AS fold) WHERE i < least((fold + 2) * (n // 6), n)""",
}


def _register_folds():
    for scheme, text in _FOLD.items():
        @query(f"w29_folds_{scheme}", f"WITH {_DI}, f AS ({text}) SELECT symbol, sp.ts, fold, role, factor FROM sp JOIN f ON sp.ts = f.ts", "sm sp", "factor @ts")
        def _(t, scheme=scheme):
            return fo.assign_folds(t.sp.select("symbol", "ts", "factor"), scheme)


_register_folds()


_DK = "dk AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, ts FROM sp))"
_PER_KEY = _FOLD["purged"].replace("SELECT ts,", "SELECT symbol, n, ts,").replace("FROM di", "FROM dk")


@query("u05_fold_plan",
       f"""WITH {_DK}, f AS ({_PER_KEY}), g AS (SELECT *, count(*) FILTER (role = 'train') OVER (PARTITION BY symbol, fold) AS n_train FROM f)
       SELECT symbol, ts, fold, role FROM g WHERE n_train >= greatest(1, floor(n * 0.1))""", "sm sp", "@ts")
def _(t):
    return fp.plans_by(t.sp, "symbol", "purged")


@query("w29_regime_stratified",
       f"""WITH d AS (SELECT DISTINCT label, ts FROM {_REG} WHERE label IS NOT NULL), k AS (SELECT label, ts, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM d)
       SELECT s.symbol, s.ts, s.label, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS role
       FROM {_REG} s JOIN k ON s.label = k.label AND s.ts = k.ts""", "sm sp", "@ts")
def _(t):
    return fo.regime_split(_labelled(t), "label").select("symbol", "ts", "label", "role")


def _labelled(t):
    r = F.col("ret")
    d = t.sp.withColumn("label", F.when(r > 0.05, "bull").when(r < -0.05, "bear").when(r.isNotNull(), "sideways"))
    return d.filter(F.col("label").isNotNull())


@query("w30_validate_folds",
       f"""WITH {_DI}, f AS ({_FOLD['purged']}), p AS (SELECT fold, ts, max(CAST(role = 'train' AS INT)) AS a, max(CAST(role = 'test' AS INT)) AS b, max(CAST(role = 'purge' AS INT)) AS c FROM f GROUP BY 1, 2)
       SELECT fold, CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test, CAST(sum(c) AS BIGINT) AS n_purged, CAST(sum(a * b) AS BIGINT) AS overlap,
       sum(a * b) = 0 AND sum(a) > 0 AND sum(b) > 0 AS valid FROM p GROUP BY 1""", "sm sp")
def _(t):
    return fo.validate_folds(fo.fold_table(fo.date_index(t.sp), "purged"))


_VOLC = f"CASE WHEN count(ret) OVER {q.w(20)} >= 20 THEN stddev_samp(ret) OVER {q.w(20)} END"


@query("w31_vol_regime",
       f"""WITH v AS (SELECT symbol, ts, {_VOLC} AS vol FROM hret) SELECT symbol, ts, vol, CASE WHEN vol >= 0 AND vol <= 0.02 THEN 'low_vol' WHEN vol <= 0.03 THEN 'medium_vol'
       WHEN vol <= 0.04 THEN 'high_vol' WHEN vol <= 10 THEN 'extreme_vol' END AS vol_regime FROM v""", "th hret", "vol @ts")
def _(t):
    return rg.vol_regime(t.hret, [0.0, 0.02, 0.03, 0.04, 10.0]).select("symbol", "ts", "vol", "vol_regime")


@query("w32_trend_regime",
       f"""SELECT symbol, ts, trend, CASE WHEN trend > 0.1 THEN 'bull' WHEN trend < -0.1 THEN 'bear' WHEN trend IS NOT NULL THEN 'sideways' END AS trend_regime
       FROM (SELECT symbol, ts, close / {q.lag('close', 20)} - 1 AS trend FROM th)""", "th", "trend @ts")
def _(t):
    return rg.trend_regime(t.th).select("symbol", "ts", "trend", "trend_regime")


@query("w33_vol_median_regime",
       f"""WITH v AS (SELECT symbol, ts, {_VOLC} AS vol FROM hret), m AS (SELECT symbol, quantile_cont(vol, 0.5) AS med FROM v GROUP BY 1)
       SELECT symbol, ts, CASE WHEN vol > med THEN 'high_vol' WHEN vol IS NOT NULL THEN 'low_vol' END AS regime FROM v JOIN m USING (symbol)""", "th hret", "@ts")
def _(t):
    return rg.vol_median_regime(t.hret).select("symbol", "ts", "regime")


_FZ = f"(funding_rate - ({q.mean('funding_rate', 30, 1)})) / NULLIF(({q.std('funding_rate', 30, 2)}), 0)"


@query("w34_combined_regime",
       f"""WITH f AS (SELECT d.symbol, d.ts, {_FZ} AS z, liquidation_long + liquidation_short AS liq FROM drv d), v AS (SELECT symbol, ts, {_VOLC} AS vol FROM hret),
       a AS (SELECT f.symbol, f.ts, CASE WHEN z > 2 THEN 'extreme_positive' WHEN z < -2 THEN 'extreme_negative' ELSE 'normal' END AS funding,
         CASE WHEN liq >= quantile_cont(liq, 0.8) OVER {q.w(30)} THEN 'high_liquidation' ELSE 'low_liquidation' END AS liquidation FROM f)
       SELECT a.symbol, a.ts, funding, liquidation, coalesce(CASE WHEN vol > 0.03 THEN 'high' WHEN vol IS NOT NULL THEN 'low' END, 'none') || '_' || funding AS combined
       FROM a JOIN v USING (symbol, ts)""", "th drv hret", "@ts")
def _(t):
    d = t.drv.select("symbol", "ts", "close", "funding_rate", (F.col("liquidation_long") + F.col("liquidation_short")).alias("liquidation_total"))
    from factorspark.functions.math import clip
    d = d.withColumn("ret", clip(R.pct_change("close", 1) / 100, -0.05, 0.05)).withColumn("vol", R.std("ret", 20))
    d = d.withColumns({"funding": rg.funding_regime(), "liquidation": rg.liq_regime()})
    vol = F.when(F.col("vol") > 0.03, "high").when(F.col("vol").isNotNull(), "low")
    return d.select("symbol", "ts", "funding", "liquidation", rg.combined_regime(vol, F.col("funding")).alias("combined"))


_MP = f"mp AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM ({q.pearson('(SELECT *, date_trunc(' + chr(39) + 'month' + chr(39) + ', ts) AS period FROM sp)', 'period', 'factor', 'fwd', 5)}))"


@query("a45_stability_report",
       f"""WITH {_MP}, t0 AS (SELECT avg(ic) AS m, stddev_samp(ic) AS s, regr_slope(ic, i) AS slope, corr(ic, i) AS r, regr_sxx(ic, i) AS sxx, regr_syy(ic, i) AS syy, count(*) AS n FROM mp),
       t1 AS (SELECT *, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS tt FROM t0),
       t2 AS (SELECT greatest(0, least(1, CASE WHEN m / s > 0 THEN least(1, abs(m / s) / 2) ELSE 0 END * 0.7 + greatest(0, 1 - abs(s / m)) * 0.3
         - CASE WHEN slope < 0 AND 2 * (1 - {q.norm_cdf('abs(tt)')}) < 0.1 THEN abs(r) * 0.3 ELSE 0 END)) AS time_score FROM t1),
       c AS ({q.pearson("(SELECT *, CASE WHEN cap >= 1e11 THEN 'large' WHEN cap >= 1e10 THEN 'mid' ELSE 'small' END AS grp FROM sp)", "grp", "factor", "fwd", 5)}),
       c1 AS (SELECT count(ic) AS n, stddev_pop(ic) AS s, min(ic) AS lo, max(ic) AS hi FROM c),
       c2 AS (SELECT greatest(0, least(1, CASE WHEN n < 2 THEN 1 ELSE CASE WHEN lo > 0 OR hi < 0 OR hi = 0 OR lo = 0 THEN 0.5 ELSE 0.25 END + greatest(0, 1 - s * 5) * 0.5 END
         - least(0.5, (hi - lo) * 2))) AS market_score FROM c1),
       g AS ({q.pearson(f"(SELECT * FROM {_REG} WHERE label IS NOT NULL)", "label", "factor", "fwd", 5)}),
       g1 AS (SELECT greatest(0, least(1, greatest(0, 1 - stddev_pop(ic) * 5) * CASE WHEN count(*) FILTER (ic > 0) > 0 AND count(*) FILTER (ic < 0) > 0 THEN 0.7 ELSE 1 END)) AS regime_score FROM g),
       o AS (SELECT *, time_score * 0.4 + market_score * 0.3 + regime_score * 0.3 AS overall FROM t2, c2, g1)
       SELECT *, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.75 THEN 'B' WHEN overall >= 0.6 THEN 'C' WHEN overall >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM o""",
       "sm sp", "time_score market_score regime_score overall")
def _(t):
    r = F.col("ret")
    return st.stability_report(t.sp.withColumn("label", F.when(r > 0.05, "bull").when(r < -0.05, "bear").when(r.isNotNull(), "sideways")))


_WFF = f"""{_DI}, f AS ({_FOLD['walk']}), pf AS (SELECT sp.symbol, sp.ts, factor, fwd, fold, role FROM sp JOIN f ON sp.ts = f.ts),
    ic AS ({q.spearman('pf', 'fold, role', 'factor', 'fwd')}),
    ps AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY factor, symbol) AS pos, count(*) OVER (PARTITION BY ts) AS n FROM sp WHERE factor IS NOT NULL AND fwd IS NOT NULL),
    ls AS (SELECT ts, avg(fwd) FILTER (pos > n - ceil(n * 0.2)) - avg(fwd) FILTER (pos <= ceil(n * 0.2) AND pos <= n - ceil(n * 0.2)) AS ls_ret FROM ps GROUP BY ts),
    sh AS (SELECT fold, role, avg(ls_ret) / stddev_samp(ls_ret) * sqrt(12) AS sharpe FROM ls JOIN f ON ls.ts = f.ts GROUP BY 1, 2),
    wf AS (SELECT ic.fold, max(rank_ic) FILTER (ic.role = 'train') AS train_ic, max(rank_ic) FILTER (ic.role = 'test') AS test_ic,
      max(sharpe) FILTER (ic.role = 'train') AS train_sharpe, max(sharpe) FILTER (ic.role = 'test') AS test_sharpe FROM ic JOIN sh ON ic.fold = sh.fold AND ic.role = sh.role GROUP BY 1)"""
_WFS = """ws AS (SELECT avg(train_ic) AS avg_train_ic, avg(test_ic) AS avg_oos_ic, stddev_pop(test_ic) AS oos_ic_std, min(test_ic) AS min_oos_ic, max(test_ic) AS max_oos_ic,
    avg(CASE WHEN test_ic > 0 THEN 1.0 ELSE 0.0 END) AS ic_consistency, avg(train_sharpe) AS trs, avg(test_sharpe) AS raw_sharpe, count(*) AS n_windows FROM wf),
    wz AS (SELECT * EXCLUDE (trs), 1 - avg_oos_ic / avg_train_ic AS ic_degradation, avg_oos_ic / oos_ic_std AS oos_ir, trs / raw_sharpe AS overfit_ratio FROM ws)"""


@query("a56_walk_forward_summary",
       f"WITH {_WFF}, {_WFS} SELECT *, ic_degradation <= 0.5 AND avg_oos_ic >= 0.02 AND ic_consistency >= 0.6 AS robust FROM wz", "sm sp",
       "avg_train_ic avg_oos_ic oos_ic_std min_oos_ic max_oos_ic ic_consistency raw_sharpe ic_degradation oos_ir overfit_ratio")
def _(t):
    return fo.walk_forward_summary(fo.walk_forward_folds(t.sp))


@query("a57_cv_sharpe",
       f"""WITH r AS (SELECT ts, ret FROM hret WHERE ret IS NOT NULL), di AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM r)),
       f AS ({_FOLD['purged']}), s AS (SELECT fold, avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM r JOIN f ON r.ts = f.ts WHERE role = 'test' GROUP BY 1),
       g AS (SELECT avg(s) AS cv_mean, stddev_samp(s) AS cv_std, count(*) AS n_folds FROM s)
       SELECT *, cv_std / abs(cv_mean) AS cv_ratio, cv_mean * greatest(0, 1 - cv_std / abs(cv_mean)) AS deflated, 1 - {q.norm_cdf('(cv_mean / (cv_std / sqrt(n_folds)))')} AS p_overfit FROM g""",
       "th hret", "cv_mean cv_std cv_ratio deflated p_overfit")
def _(t):
    return fo.cv_sharpe(t.hret.filter(F.col("ret").isNotNull()).select("ts", "ret"), 252)


@query("a59_overall_score",
       f"""WITH {_WFF}, {_WFS}, {_MIC}, d AS (SELECT avg(rank_ic) AS m, avg(rank_ic) / stddev_samp(rank_ic) AS ir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS hit,
         greatest(0, 1 - least(abs(stddev_pop(rank_ic) / avg(rank_ic)), 2) / 2) AS stab FROM mi)
       SELECT least(100, least(15, abs(m) * 300) + least(15, ir * 7.5) + least(10, greatest(0, raw_sharpe) * 5) + least(10, abs(avg_oos_ic) * 200) + least(10, ic_consistency * 10)
         + least(10, greatest(0, 1 - ic_degradation) * 10) + least(10, hit * 10) + least(10, stab * 10) + CASE WHEN abs(m) >= 0.03 THEN 10 ELSE 0 END) AS score FROM d, wz""",
       "sm sp", "score")
def _(t):
    from factorspark.operators.ledger import overall_score
    ics = sc.ic_by_period(t.sp, "month")
    s = ics.agg(F.avg("rank_ic").alias("ic_mean"), (F.avg("rank_ic") / F.stddev_samp("rank_ic")).alias("ir"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("hit_rate"),
                F.greatest(F.lit(0.0), 1 - F.least(F.abs(F.stddev_pop("rank_ic") / F.avg("rank_ic")), F.lit(2.0)) / 2).alias("ic_stability"))
    wf = fo.walk_forward_summary(fo.walk_forward_folds(t.sp))
    d = s.join(F.broadcast(wf))  # one row each
    return d.select(overall_score(F.col("ic_mean"), F.col("ir"), F.col("raw_sharpe"), F.col("avg_oos_ic"), F.col("ic_consistency"), F.col("ic_degradation"),
                                  F.col("hit_rate"), F.col("ic_stability"), F.abs("ic_mean") >= 0.03).alias("score"))


# --- weights, composites, positions
_W = f"""wg AS (SELECT name, abs(ic_mean) / sum(abs(ic_mean)) OVER () AS weight FROM p)"""


def _weights(t, method="ic", **kw):
    m = sc.evaluate_library(t.fl).select("name", F.col("ic_mean").alias("ic"), "ir")
    return po.factor_weights(m, method, **kw)


@query("w44_factor_weights",
       f"""{_LIB}, a AS (SELECT name, ic_mean AS ic, ir, 1.0 / count(*) OVER () AS w_equal, abs(ic_mean) / sum(abs(ic_mean)) OVER () AS w_ic,
         greatest(0, ir) / sum(greatest(0, ir)) OVER () AS w_ir, row_number() OVER (ORDER BY abs(ic_mean), name DESC) AS rk FROM p),
       b AS (SELECT *, greatest(0.1, least(0.6, rk / sum(rk) OVER ())) AS c FROM a)
       SELECT name, w_equal, w_ic, w_ir, c / sum(c) OVER () AS w_rank FROM b""", "ud fp fl", "w_equal w_ic w_ir w_rank")
def _(t):
    m = sc.evaluate_library(t.fl).select("name", F.col("ic_mean").alias("ic"), "ir")
    for method, kw in (("equal", {}), ("ic", {}), ("ir", {}), ("rank", {"lo": 0.1, "hi": 0.6})):
        m = po.factor_weights(m, method, **kw).withColumnRenamed("weight", f"w_{method}")
    return m.select("name", "w_equal", "w_ic", "w_ir", "w_rank")


_SIG = f"""zs AS (SELECT symbol, ts, name, (value - avg(value) OVER (PARTITION BY ts, name)) / NULLIF(stddev_samp(value) OVER (PARTITION BY ts, name), 0) AS z FROM fl WHERE value IS NOT NULL),
    sg AS (SELECT symbol, ts, sum(z * weight) AS signal FROM zs JOIN wg USING (name) GROUP BY 1, 2)"""


@query("w43_composite", f"{_LIB}, {_W}, {_SIG} SELECT * FROM sg", "ud fp fl", "signal @ts")
def _(t):
    return po.composite(t.fl, _weights(t))


@query("u06_user_strategy",
       f"""{_LIB}, {_W}, {_SIG}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY signal DESC, symbol DESC) AS r, count(*) OVER (PARTITION BY ts) AS n FROM sg WHERE signal IS NOT NULL)
       SELECT symbol, ts, 1.0 / least(n, 10) AS position FROM k WHERE r <= 10""", "ud fp fl", "position @ts")
def _(t):
    from factorspark.operators.strategy import Strategy
    return Strategy(weighting="ic", construction="top_n", top_n=10).positions(t.fl).filter("position > 0").select("symbol", "ts", "position")


_F = "(SELECT symbol, ts, factor AS signal FROM fp WHERE factor IS NOT NULL)"


@query("w45_positions",
       f"""SELECT symbol, ts, signal / max(abs(signal)) OVER d AS long_short, greatest(signal, 0) / NULLIF(sum(greatest(signal, 0)) OVER d, 0) AS long_only,
       CASE WHEN signal > 0.5 THEN 1.0 WHEN signal < -0.5 THEN -1.0 ELSE 0.0 END / NULLIF(count(*) FILTER (abs(signal) > 0.5) OVER d, 0) AS by_threshold FROM {_F} WINDOW d AS (PARTITION BY ts)""",
       "ud fp", "long_short long_only by_threshold @ts")
def _(t):
    d = t.fp.filter(F.col("factor").isNotNull()).select("symbol", "ts", F.col("factor").alias("signal"))
    for m in ("long_short", "long_only", "threshold"):
        d = po.positions(d, m, ["ts"]).withColumnRenamed("position", "by_threshold" if m == "threshold" else m)
    return d.select("symbol", "ts", "long_short", "long_only", "by_threshold")


@query("w46_topk_signal",
       f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY signal, symbol) AS pos, count(*) OVER (PARTITION BY ts) AS n FROM {_F})
       SELECT symbol, ts, CASE WHEN pos > n - least(5, n // 2) THEN 1.0 WHEN pos <= least(5, n // 2) THEN -1.0 ELSE 0.0 END AS signal FROM k""", "ud fp", "signal @ts")
def _(t):
    return po.topk_signal(t.fp.select("symbol", "ts", "factor"), ["ts"], 5).select("symbol", "ts", "signal")


@query("w47_portfolio_weights",
       f"""WITH r AS (SELECT symbol, ts, {q.avg_rank('signal', 'ts')} / count(*) OVER (PARTITION BY ts) - 0.5 AS w FROM {_F}) SELECT symbol, ts, w / sum(abs(w)) OVER (PARTITION BY ts) * 2 AS weight FROM r""",
       "ud fp", "weight @ts")
def _(t):
    return po.portfolio_weights(t.fp.select("symbol", "ts", "factor"), ["ts"], "rank", leverage=2.0).select("symbol", "ts", "weight")


@query("w47_portfolio_weights_long_only",
       f"""WITH r AS (SELECT symbol, ts, greatest(0, (signal - avg(signal) OVER d) / NULLIF(stddev_samp(signal) OVER d, 0)) AS w FROM {_F} WINDOW d AS (PARTITION BY ts))
       SELECT symbol, ts, w / NULLIF(sum(w) OVER (PARTITION BY ts), 0) AS weight FROM r""", "ud fp", "weight @ts")
def _(t):
    return po.portfolio_weights(t.fp.select("symbol", "ts", "factor"), ["ts"], "zscore", long_short=False).select("symbol", "ts", "weight")


@query("w48_ml_features",
       f"""SELECT symbol, ts, {q.lag('close', 1)} AS close_lag_1, {q.lag('close', 5)} AS close_lag_5, {q.lag('close', 20)} AS close_lag_20,
       {q.lag('volume', 1)} AS volume_lag_1, {q.lag('volume', 5)} AS volume_lag_5, {q.lag('volume', 20)} AS volume_lag_20 FROM th""", "th",
       "close_lag_1 close_lag_5 close_lag_20 volume_lag_1 volume_lag_5 volume_lag_20 @ts")
def _(t):
    return po.lagged(t.th, ["close", "volume"]).drop("open", "high", "low", "close", "volume", "trades")


@query("w48_ml_feature_block", None, "", "")
def _(t):
    d = t.th.withColumn("factor", R.pct_change("close", 3))
    return po.ml_features(d).drop("open", "high", "low", "close", "volume", "trades", "factor")


@query("a26_concentration",
       f"""WITH s AS (SELECT ts, signal AS weight, abs(signal) / sum(abs(signal)) OVER (PARTITION BY ts) AS sh FROM {_F})
       SELECT ts, sum(sh * sh) AS herfindahl, max(abs(weight)) AS max_position, avg(abs(weight)) AS mean_position FROM s GROUP BY 1""", "ud fp", "herfindahl max_position mean_position @ts")
def _(t):
    d = t.fp.filter(F.col("factor").isNotNull()).select("symbol", "ts", F.col("factor").alias("weight"))
    return po.concentration(d, ["ts"])


@query("m01_ic_linear",
       f"""{_LIB}, wg AS (SELECT name, ic_mean / sum(abs(ic_mean)) OVER () AS weight FROM p) SELECT name, weight FROM wg""", "ud fp fl", "weight")
def _(t):
    from factorspark.operators.models import fit_ic_linear
    return fit_ic_linear(t.fl)


@query("m04_ml_signal",
       f"""SELECT symbol, ts, greatest(-3, least(3, coalesce((signal - avg(signal) OVER d) / NULLIF(stddev_samp(signal) OVER d, 0), 0))) / 3 AS signal FROM {_F} WINDOW d AS (PARTITION BY ts)""",
       "ud fp", "signal @ts")
def _(t):
    d = t.fp.filter(F.col("factor").isNotNull()).select("symbol", "ts", F.col("factor").alias("prediction"))
    return po.ml_signal(d, ["ts"]).select("symbol", "ts", "signal")


# --- selection
@query("j12_factor_pairs", _SM, "ud fp", "corr")
def _(t):
    return sc.spearman_matrix(t.fp, _COLS)


@query("j13_nearest_factor",
       """WITH c AS (SELECT 'ret' AS factor, 'factor' AS existing, corr(ret, factor) AS corr FROM fp UNION ALL SELECT 'ret', 'factor2', corr(ret, factor2) FROM fp
       UNION ALL SELECT 'factor3', 'factor', corr(factor3, factor) FROM fp UNION ALL SELECT 'factor3', 'factor2', corr(factor3, factor2) FROM fp)
       SELECT factor, arg_max(existing, abs(corr)) AS existing, arg_max(corr, abs(corr)) AS corr FROM c GROUP BY 1""", "ud fp", "corr")
def _(t):
    return se.nearest_factor(t.fp, ["ret", "factor3"], ["factor", "factor2"])


@query("w49_select_uncorrelated", None, "", "ic ir")
def _(t):
    names = {"factor": "momentum", "factor2": "volume", "factor3": "range"}
    pairs = sc.spearman_matrix(t.fp, ["factor", "factor2", "factor3"])
    pairs = pairs.replace(names, subset=["factor_a", "factor_b"])
    m = sc.evaluate_library(t.fl).select("name", F.col("ic_mean").alias("ic"), "ir")
    return se.select_uncorrelated(m, pairs, 2, 0.1)


@query("w51_redundant_groups", None, "", "mean_corr")
def _(t):
    names = {"factor": "momentum", "factor2": "volume", "factor3": "range"}
    pairs = sc.spearman_matrix(t.fp, ["factor", "factor2", "factor3"]).replace(names, subset=["factor_a", "factor_b"])
    m = sc.evaluate_library(t.fl).select("name", F.col("ic_mean").alias("ic"), "ir")
    return se.redundant_groups(m, pairs, 0.1)


@query("a61_compare_factors",
       pair_rank_corr("factor", "ret"), "ud fp", "corr")
def _(t):
    return sc.spearman_matrix(t.fp, ["factor", "ret"])


@query("a61_compare_factor_list", None, "", "corr sharpe")
def _(t):
    return sc.compare_factors(t.fp, ["factor", "factor2", "factor3"])
