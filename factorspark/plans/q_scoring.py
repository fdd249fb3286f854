"""Factor-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.operators import benchmark as be
from factorspark.operators import cross_section as cs
from factorspark.operators import scoring as sc
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import R
from factorspark.plans.registry import query
from factorspark.session import scratch_path


@query("a05_ic_by_date", q.pearson("fp", "ts", "factor", "fwd"), "ud fp", "ic @ts")
def _(t):
    return sc.ic_by_date(t.fp)


@query("a06_rank_ic_by_date", q.spearman("fp", "ts", "factor", "fwd"), "ud fp", "rank_ic @ts")
def _(t):
    return sc.rank_ic_by_date(t.fp)


@query("a07_ic_by_period", q.spearman("(SELECT *, date_trunc('month', ts) AS period FROM sp)", "period", "factor", "fwd", 10), "sm sp", "rank_ic @period")
def _(t):
    return sc.ic_by_period(t.sp, "month")


_SUMMARY = """SELECT {by}avg({v}) AS ic_mean, stddev_samp({v}) AS ic_std,
    CASE WHEN count({v}) >= 3 THEN (sum(pow({v} - m, 3)) / count({v})) / pow(var_pop({v}), 1.5) * sqrt(count({v}) * (count({v}) - 1)) / (count({v}) - 2) END AS ic_skew,
    avg({v}) / stddev_samp({v}) AS ir, avg(CASE WHEN {v} > 0 THEN 1.0 WHEN {v} <= 0 THEN 0.0 END) AS hit_rate, count({v}) AS n FROM {src}"""


def _summary(src, v, by=""):
    part = f"PARTITION BY {by}" if by else ""
    return _SUMMARY.format(v=v, by=f"{by}, " if by else "", src=f"(SELECT *, avg({v}) OVER ({part}) AS m FROM {src})") + (f" GROUP BY {by}" if by else "")


@query("a08_ic_summary", f"WITH i AS ({q.spearman('fp', 'ts', 'factor', 'fwd')}) " + _summary("i", "rank_ic"), "ud fp", "ic_mean ic_std ic_skew ir hit_rate")
def _(t):
    return sc.ic_summary(sc.rank_ic_by_date(t.fp), "rank_ic")


_LEVELS = """lv AS (SELECT factor, fwd, 'month' AS level, date_trunc('month', ts) AS period FROM sp UNION ALL
    SELECT factor, fwd, 'quarter', date_trunc('quarter', ts) FROM sp UNION ALL SELECT factor, fwd, 'year', date_trunc('year', ts) FROM sp UNION ALL
    SELECT factor, fwd, 'all', TIMESTAMP '1970-01-01 00:00:00' FROM sp)"""


@query("a09_ic_rollup", f"WITH {_LEVELS} " + q.spearman("lv", "level, period", "factor", "fwd", 10), "sm sp", "rank_ic @period")
def _(t):
    return sc.ic_rollup(t.sp)


_CAP = f"c AS (SELECT *, {q.avg_rank('cap', '1')} / count(*) OVER () AS pct FROM sp)"


@query("a10_ic_by_cap_percentile",
       f"WITH {_CAP} " + q.spearman("(SELECT *, CASE WHEN pct >= 0.7 THEN 'large' WHEN pct < 0.3 THEN 'small' ELSE 'mid' END AS bucket FROM c)",
                                   "bucket", "factor", "fwd", 10), "sm sp", "rank_ic")
def _(t):
    return sc.ic_by_cap(t.sp)


@query("a10_ic_by_cap_absolute",
       q.pearson("(SELECT *, CASE WHEN cap >= 1e11 THEN 'large' WHEN cap >= 1e10 THEN 'mid' ELSE 'small' END AS bucket FROM sp)",
                 "bucket", "factor", "fwd", 10), "sm sp", "ic")
def _(t):
    return sc.ic_by_cap(t.sp, "absolute")


_VOL = f"""v0 AS (SELECT *, CASE WHEN count(ret) OVER {q.w(20)} >= 5 THEN stddev_samp(ret) OVER {q.w(20)} END AS vol FROM sp),
v1 AS (SELECT *, {q.avg_rank('vol', '1')} / count(*) OVER () AS pct FROM v0 WHERE vol IS NOT NULL),
v2 AS (SELECT *, CASE WHEN pct >= 0.7 THEN 'high_vol' ELSE 'low_vol' END AS bucket FROM v1)"""


@query("a11_ic_by_vol", f"WITH {_VOL} " + q.spearman("v2", "bucket", "factor", "fwd", 10), "sm sp", "rank_ic")
def _(t):
    return sc.ic_by_vol(t.sp)


_REG = "(SELECT *, CASE WHEN ret > 0.05 THEN 'bull' WHEN ret < -0.05 THEN 'bear' WHEN ret IS NOT NULL THEN 'sideways' END AS label FROM sp)"


def _regimes(t):
    r = F.col("ret")
    d = t.sp.withColumn("label", F.when(r > 0.05, "bull").when(r < -0.05, "bear").when(r.isNotNull(), "sideways"))
    return sc.ic_by_regime(d, "label")


@query("a12_ic_by_regime", q.spearman(f"(SELECT * FROM {_REG} WHERE label IS NOT NULL)", "label", "factor", "fwd", 30), "sm sp", "rank_ic")
def _(t):
    return _regimes(t)


@query("a12_regime_spread",
       f"""WITH i AS ({q.spearman(f"(SELECT * FROM {_REG} WHERE label IS NOT NULL)", "label", "factor", "fwd", 30)})
       SELECT avg(rank_ic) AS mean_ic, stddev_pop(rank_ic) AS std_ic, min(rank_ic) AS min_ic, max(rank_ic) AS max_ic, max(rank_ic) - min(rank_ic) AS ic_range
       FROM i WHERE rank_ic <> 0""", "sm sp", "mean_ic std_ic min_ic max_ic ic_range")
def _(t):
    return sc.regime_spread(_regimes(t))


_SPLIT = "CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'train' WHEN ts < TIMESTAMP '2000-07-01' THEN 'valid' ELSE 'test' END AS split"
_HZ = f"""hz AS (SELECT factor, 1 AS horizon, {_SPLIT}, lead(close, 1) OVER w / close - 1 AS f FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY ts) UNION ALL
    SELECT factor, 5, {_SPLIT}, lead(close, 5) OVER w / close - 1 FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY ts) UNION ALL
    SELECT factor, 10, {_SPLIT}, lead(close, 10) OVER w / close - 1 FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query("a13_ic_by_split", f"WITH {_HZ} " + q.spearman("hz", "split, horizon", "factor", "f"), "sm sp", "rank_ic")
def _(t):
    split = F.when(F.col("ts") < "1999-01-01", "train").when(F.col("ts") < "2000-07-01", "valid").otherwise("test")
    return sc.ic_by_split(t.sp, split)


_LAGS = "lg AS (" + " UNION ALL ".join(f"SELECT factor, {k} AS lag, lead(ret, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM fp" for k in range(6)) + ")"
_DECAY = f"WITH {_LAGS}, cv AS (SELECT lag, n, coalesce(rank_ic, 0) AS ic FROM ({q.spearman('lg', 'lag', 'factor', 'r', 30)}))"


@query("a14_ic_decay", f"{_DECAY} SELECT * FROM cv", "ud fp", "ic")
def _(t):
    return sc.ic_decay(t.fp)


@query("a14_decay_flags",
       f"""{_DECAY}, b AS (SELECT max(CASE WHEN lag = 0 THEN abs(ic) END) AS ic0, max(CASE WHEN lag = 1 THEN abs(ic) END) AS ic1 FROM cv)
       SELECT ic0, ic1, (SELECT min(lag) FROM cv, b WHERE abs(ic) <= ic0 / 2) AS half_life_lag, coalesce(ic1 > 0 AND ic0 / ic1 > 2, false) AS drops_sharply,
       ic0 > 0.3 AS unusually_high FROM b""", "ud fp", "ic0 ic1")
def _(t):
    return sc.decay_flags(sc.ic_decay(t.fp))


_MIC = f"mi AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM ({q.spearman('(SELECT *, date_trunc(' + chr(39) + 'month' + chr(39) + ', ts) AS period FROM sp)', 'period', 'factor', 'fwd', 10)}))"


def _monthly(t):
    from pyspark.sql import Window
    # one row per month: the calendar bounds this table
    return sc.ic_by_period(t.sp, "month").withColumn("i", F.row_number().over(Window.orderBy("period")) - 1)


@query("a15_ic_trend",
       f"""WITH {_MIC}, s AS (SELECT count(*) AS n, regr_slope(rank_ic, i) AS slope, regr_intercept(rank_ic, i) AS intercept, corr(rank_ic, i) AS r_value,
       regr_sxx(rank_ic, i) AS sxx, regr_syy(rank_ic, i) AS syy FROM mi),
       e AS (SELECT *, sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS std_err FROM s)
       SELECT n, slope, intercept, r_value, std_err, 2 * (1 - {q.norm_cdf('abs(slope / std_err)')}) AS p_value FROM e""",
       "sm sp", "slope intercept r_value std_err p_value")
def _(t):
    return sc.trend(_monthly(t), "i", "rank_ic")


@query("a16_ic_half_life",
       f"""WITH {_MIC}, s AS (SELECT count(*) AS n, regr_slope(ln(abs(rank_ic)), i) AS slope FROM mi WHERE abs(rank_ic) > 1e-6),
       r AS (SELECT n, CASE WHEN n >= 3 AND slope < 0 THEN -slope ELSE 0.0 END AS decay_rate FROM s)
       SELECT n, decay_rate, CASE WHEN decay_rate > 1e-6 THEN CAST(least(floor(ln(2) / decay_rate), 999) AS BIGINT) ELSE 999 END AS half_life FROM r""",
       "sm sp", "decay_rate")
def _(t):
    return sc.ic_half_life(_monthly(t), "i", "rank_ic")


@query("a17_t_test_halves",
       f"""WITH {_MIC}, m AS (SELECT max(i) AS k FROM mi), h AS (SELECT rank_ic AS v, i <= k / 2 AS g FROM mi, m),
       s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, avg(v) FILTER (g) AS m1, avg(v) FILTER (NOT g) AS m2,
       var_samp(v) FILTER (g) AS v1, var_samp(v) FILTER (NOT g) AS v2 FROM h),
       z AS (SELECT n1, n2, m1, m2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_pooled,
       (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t_welch FROM s)
       SELECT *, 2 * (1 - {q.norm_cdf('abs(t_pooled)')}) AS p_pooled, 2 * (1 - {q.norm_cdf('abs(t_welch)')}) AS p_welch FROM z""",
       "sm sp", "m1 m2 t_pooled t_welch p_pooled p_welch")
def _(t):
    m = _monthly(t)
    half = m.agg((F.max("i") / 2).alias("_k"))  # one row
    return sc.t_test(m.join(F.broadcast(half)), F.col("i") <= F.col("_k"), "rank_ic")


_POS = """ps AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY factor, symbol) AS pos, count(*) OVER (PARTITION BY ts) AS n
    FROM fp WHERE factor IS NOT NULL AND fwd IS NOT NULL)"""


@query("a18_long_short_returns",
       f"""WITH {_POS}, sd AS (SELECT *, CASE WHEN pos > n - ceil(n * 0.2) THEN 'top' WHEN pos <= ceil(n * 0.2) THEN 'bottom' END AS side FROM ps)
       SELECT ts, avg(fwd) FILTER (side = 'top') AS top_ret, avg(fwd) FILTER (side = 'bottom') AS bottom_ret,
       avg(fwd) FILTER (side = 'top') - avg(fwd) FILTER (side = 'bottom') AS ls_ret FROM sd WHERE side IS NOT NULL GROUP BY ts""",
       "ud fp", "top_ret bottom_ret ls_ret @ts")
def _(t):
    return sc.long_short_returns(t.fp.select("symbol", "ts", "factor", "fwd"))


_WT = "wt AS (SELECT symbol, ts, factor / sum(abs(factor)) OVER (PARTITION BY ts) AS weight FROM fp WHERE factor IS NOT NULL)"


@query("a19_turnover",
       f"""WITH {_WT}, d AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM wt)),
       a AS (SELECT wt.symbol, wt.ts, wt.weight, 0.0 AS pw FROM wt UNION ALL SELECT p.symbol, d.ts, 0.0, p.weight FROM wt p JOIN d ON p.ts = d.prev),
       g AS (SELECT symbol, ts, sum(weight) - sum(pw) AS dw FROM a GROUP BY 1, 2)
       SELECT g.ts, sum(abs(dw)) / 2 AS turnover FROM g JOIN d ON g.ts = d.ts WHERE d.prev IS NOT NULL GROUP BY 1""", "ud fp", "turnover @ts")
def _(t):
    w = cs.cs_scale(t.fp.filter(F.col("factor").isNotNull()).select("symbol", "ts", "factor"), ["ts"], "factor", "weight")
    return sc.turnover(w)


_COLS = ["factor", "factor2", "factor3", "ret"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]


@query("a42_corr_matrix",
       " UNION ALL ".join(f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, corr({a}, {b}) AS corr FROM fp" for a, b in _PAIRS), "ud fp", "corr")
def _(t):
    return sc.corr_matrix(t.fp, _COLS)


def pair_rank_corr(a: str, b: str) -> str:
    """Spearman of one pair, ranked over the rows that have both."""
    return f"""SELECT '{a}' AS factor_a, '{b}' AS factor_b, corr(ra, rb) AS corr FROM (
        SELECT {q.avg_rank(a, '1')} AS ra, {q.avg_rank(b, '1')} AS rb FROM fp WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_SM = " UNION ALL ".join(pair_rank_corr(a, b) for a, b in _PAIRS)


@query("a43_spearman_pairs", f"WITH m AS ({_SM}) SELECT * FROM m WHERE abs(corr) >= 0.05", "ud fp", "corr")
def _(t):
    return sc.spearman_pairs(t.fp, _COLS, 0.05)


@query("a44_heatmap",
       f"""WITH m AS ({_SM}), h AS (SELECT factor_a AS x, factor_b AS y, corr AS value FROM m UNION ALL SELECT factor_b, factor_a, corr FROM m
       UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest({_COLS}) AS c))
       SELECT x, y, value, CAST(list_position({_COLS}, x) - 1 AS BIGINT) AS x_pos, CAST(list_position({_COLS}, y) - 1 AS BIGINT) AS y_pos FROM h""", "ud fp", "value")
def _(t):
    return sc.heatmap(sc.spearman_matrix(t.fp, _COLS), _COLS)


@query("a46_factor_stability",
       f"""WITH l AS (SELECT factor, {q.lag('factor', 1)} AS l1, {q.lag('factor', 5)} AS l5, {q.lag('factor', 20)} AS l20 FROM sp), {_MIC}
       SELECT corr(factor, l1) AS autocorr_1, corr(factor, l5) AS autocorr_5, corr(factor, l20) AS autocorr_20,
       (SELECT greatest(0, 1 - least(abs(stddev_pop(rank_ic) / avg(rank_ic)), 2) / 2) FROM mi) AS ic_stability FROM l""",
       "sm sp", "autocorr_1 autocorr_5 autocorr_20 ic_stability")
def _(t):
    a = sc.autocorrelation(t.sp)
    m = sc.ic_by_period(t.sp, "month").agg(F.avg("rank_ic").alias("m"), F.stddev_pop("rank_ic").alias("s"))
    stab = F.when(F.abs("m") >= 1e-6, F.greatest(F.lit(0.0), 1 - F.least(F.abs(F.col("s") / F.col("m")), F.lit(2.0)) / 2)).otherwise(0.0)
    return a.join(F.broadcast(m.select(stab.alias("ic_stability"))))  # one row each


_LIB = f"""WITH i AS ({q.spearman('fl', 'name, ts', 'value', 'fwd')}),
    s AS ({_summary('i', 'rank_ic', 'name')}),
    p AS (SELECT *, 2 * (1 - {q.norm_cdf('abs(ic_mean / ic_std * sqrt(n))')}) AS p_value, CAST(row_number() OVER (ORDER BY abs(ic_mean) DESC, name) AS INTEGER) AS rank FROM s)"""


# The library of the benchmark: bar shape, price ratios, rolling families and ratio set over the daily panel, whose months have 30 days.
_LIB_WINDOWS = (5, 10, 20)


def _library_sql():
    from factorspark.plans.q_factors import H, _ALL, _KLINE, _RATIO, _RATIO0
    rolling = {k: e for k, e in _ALL.items() if any(k == k.rstrip("0123456789") + str(d) for d in _LIB_WINDOWS)}
    ratio = {k: e for k, e in _RATIO.items() if any(str(d) in k for d in _LIB_WINDOWS)}
    exprs = {**_KLINE, **{k: e for k, e in _RATIO0.items() if k != "VWAP0"}, **rolling, **ratio}
    wide = ", ".join(f"({e}) AS {k}" for k, e in exprs.items())
    sql = f"""{H.replace("FROM th", "FROM ud")}, lw AS (SELECT symbol, ts, {q.lag('close', -1)} / NULLIF(close, 0) - 1 AS fwd, {wide} FROM h),
    ll AS (SELECT symbol, ts, fwd, name, round(CAST(value AS DOUBLE), 9) AS value FROM (UNPIVOT lw ON COLUMNS(* EXCLUDE (symbol, ts, fwd)) INTO NAME name VALUE value))"""
    return list(exprs), sql


LIBRARY, _LW = _library_sql()
_EV = f"""WITH {_LW}, r AS (SELECT name, ts, fwd, {q.avg_rank('value', 'name, ts')} AS rx, {q.avg_rank('fwd', 'name, ts')} AS ry FROM ll WHERE fwd IS NOT NULL),
    g AS (SELECT name, ts, {q.moving_corr('rx', 'ry')} AS rank_ic, covar_pop(rx, fwd) / NULLIF(stddev_pop(rx), 0) AS r FROM r GROUP BY 1, 2 HAVING count(*) >= 3),
    sh AS (SELECT name, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(252) END AS sharpe,
        avg(CASE WHEN rank_ic > 1e-9 THEN 1.0 WHEN rank_ic <= 1e-9 THEN 0.0 END) AS hit FROM g GROUP BY 1),
    s AS ({_summary('g', 'rank_ic', 'name')}),
    p AS (SELECT s.* REPLACE (hit AS hit_rate), sharpe, 2 * (1 - {q.norm_cdf('abs(ic_mean / ic_std * sqrt(n))')}) AS p_value,
        CAST(row_number() OVER (ORDER BY round(abs(ic_mean), 9) DESC NULLS LAST, s.name) AS INTEGER) AS rank FROM s JOIN sh ON s.name = sh.name)"""


def _panel(t):
    return be.library_panel(t.ud, LIBRARY, digits=9)


@query("l20_evaluate_library", f"{_EV} SELECT * FROM p", "ud", "ic_mean ic_std ic_skew ir hit_rate sharpe p_value", digits=5)
def _(t):
    return sc.evaluate_library(_panel(t))


@query("l20_top_factors", f"{_EV} SELECT name, ic_mean, ir, sharpe, rank FROM p WHERE rank <= 20", "ud", "ic_mean ir sharpe", digits=5)
def _(t):
    return sc.evaluate_library(_panel(t), top_n=20).select("name", "ic_mean", "ir", "sharpe", "rank")


@query("a48_evaluation_summary",
       f"""{_EV} SELECT count(*) AS total, count(*) FILTER (abs(ic_mean) >= 0.02 AND abs(ir) >= 0.1) AS passed,
       avg(CASE WHEN abs(ic_mean) >= 0.02 AND abs(ir) >= 0.1 THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(ic_mean) AS avg_ic, avg(ir) AS avg_ir, avg(sharpe) AS avg_sharpe,
       min(name) FILTER (rank = 1) AS best FROM p""", "ud", "pass_rate avg_ic avg_ir avg_sharpe", digits=5)
def _(t):
    ok = (F.abs("ic_mean") >= 0.02) & (F.abs("ir") >= 0.1)
    return sc.evaluate_library(_panel(t)).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("pass_rate"), F.avg("ic_mean").alias("avg_ic"),
        F.avg("ir").alias("avg_ir"), F.avg("sharpe").alias("avg_sharpe"), F.min(F.when(F.col("rank") == 1, F.col("name"))).alias("best"))


@query("a66_benchmark_run",
       f"""{_EV} SELECT count(*) AS total, count(*) FILTER (abs(ic_mean) >= 0.03) AS passed, avg(abs(coalesce(ic_mean, 0))) AS mean_ic,
       quantile_cont(abs(coalesce(ic_mean, 0)), 0.5) AS median_ic, max(abs(coalesce(ic_mean, 0))) AS max_ic, avg(coalesce(ir, 0)) AS mean_ir, avg(coalesce(sharpe, 0)) AS mean_sharpe,
       avg(CASE WHEN abs(ic_mean) >= 0.03 THEN 1.0 ELSE 0.0 END) AS pass_rate, string_agg(name, ',' ORDER BY rank) FILTER (rank <= 10) AS top, count(*) AS recorded FROM p""",
       "ud", "mean_ic median_ic max_ic mean_ir mean_sharpe pass_rate", digits=5)
def _(t):
    scores = be.evaluate(_panel(t))
    path = scratch_path(t.spark, "ledger")
    be.append_ledger(be.ledger_rows(scores, "run"), path)
    recorded = t.spark.read.parquet(path).agg(F.count("*").alias("recorded"))
    return be.benchmark_run(scores).join(F.broadcast(recorded))  # one row each


_OWN = "CLOSE_MA5_RATIO"


@query("a47_benchmark_factor",
       f"""{_EV}, o AS (SELECT avg(ic_mean) AS lib_ic, avg(ir) AS lib_ir, avg(sharpe) AS lib_sharpe FROM p WHERE name <> '{_OWN}'),
       j AS (SELECT b.name, a.value AS x, b.value AS y FROM ll a JOIN ll b ON a.symbol = b.symbol AND a.ts = b.ts AND a.name = '{_OWN}' AND b.name <> '{_OWN}'),
       k AS (SELECT name, round(abs(rank_ic), 9) AS c FROM ({q.spearman('j', 'name', 'x', 'y', 20)}) WHERE rank_ic IS NOT NULL), c AS (SELECT max(c) AS max_corr, max(name) FILTER (c = (SELECT max(c) FROM k)) AS closest FROM k)
       SELECT ic_mean AS ic, ir, sharpe, lib_ic, lib_ir, lib_sharpe, abs(ic_mean) - abs(lib_ic) AS improvement, rank, max_corr, closest, max_corr < 0.7 AS novel FROM p, o, c WHERE name = '{_OWN}'""",
       "ud", "ic ir sharpe lib_ic lib_ir lib_sharpe improvement max_corr", digits=5)
def _(t):
    panel = be.library_panel(t.ud, LIBRARY, digits=9, own=_OWN)
    return be.benchmark_factor(be.evaluate(panel), panel, _OWN)


_RR = f"(SELECT symbol, ts, factor, fwd FROM fp WHERE factor IS NOT NULL AND fwd IS NOT NULL)"


@query("w28_rolling_rank_ic",
       f"""WITH p AS (SELECT symbol, ts, factor, fwd, row_number() OVER {q.wall()} AS rn FROM sp WHERE factor IS NOT NULL AND fwd IS NOT NULL),
       e AS (SELECT a.symbol, a.ts, b.factor, b.fwd FROM p a JOIN p b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20)
       SELECT symbol, ts, rank_ic FROM ({q.spearman('e', 'symbol, ts', 'factor', 'fwd', 20)})""", "sm sp", "rank_ic @ts")
def _(t):
    from factorspark.operators.rolling_ic import rolling_rank_ic
    d = t.sp.filter(F.col("factor").isNotNull() & F.col("fwd").isNotNull()).select("symbol", "ts", "factor", "fwd")
    return rolling_rank_ic(d, 20).select("symbol", "ts", "rank_ic")
