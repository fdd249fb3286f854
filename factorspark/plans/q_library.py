"""Library, ledger, risk, quality, text and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions import math as fm
from factorspark.functions import money as mo
from factorspark.functions import text as tx
from factorspark.operators import asof as aj
from factorspark.operators import cross_section as cs
from factorspark.operators import ledger as le
from factorspark.operators import quality as qu
from factorspark.operators import risk as rk
from factorspark.operators import selection as se
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import CTE, R
from factorspark.plans.registry import query

c = F.col

# factor library derived from part: one row per part
CTE["lib"] = """lib AS (SELECT p_partkey AS id, p_name AS name, p_brand AS family, [p_brand, p_type] AS families, p_type AS status, (p_size - 25) / 400.0 AS ic, p_retailprice / 800 AS ir,
    p_retailprice / 700 AS sharpe, p_size / 100.0 AS max_drawdown, (p_partkey % 100) / 100.0 AS win_rate, p_size / 50.0 AS stability, p_partkey % 7 = 0 AS biased,
    [p_retailprice / 1000, p_size / 20.0, (p_partkey % 10) / 5.0] AS cv FROM part)"""
# expression and hypothesis texts derived from part
CTE["ex"] = """ex AS (SELECT p_partkey AS id, 'Ref($close, ' || CAST(p_size - 10 AS VARCHAR) || ') / $close - Mean(Std($' || lower(p_type) || ', ' || CAST(p_size AS VARCHAR) || '), ' ||
    CAST(12 - p_size AS VARCHAR) || ')' || CASE WHEN p_partkey % 11 = 0 THEN ' + $fwd_return' WHEN p_partkey % 13 = 0 THEN ' + (Log($volume' ELSE '' END AS expr,
    'try ' || CASE WHEN p_size % 3 = 0 THEN 'RSI and ' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN 'volatility with ' ELSE '' END || 'moving average on ' || p_name AS hypothesis, p_brand AS family FROM part)"""


def lib(t):
    return t.part.select(
        c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_brand").alias("family"), F.array("p_brand", "p_type").alias("families"), c("p_type").alias("status"),
        ((c("p_size") - 25) / 400.0).alias("ic"), (c("p_retailprice") / 800).alias("ir"), (c("p_retailprice") / 700).alias("sharpe"), (c("p_size") / 100.0).alias("max_drawdown"),
        ((c("p_partkey") % 100) / 100.0).alias("win_rate"), (c("p_size") / 50.0).alias("stability"), (c("p_partkey") % 7 == 0).alias("biased"),
        F.array(c("p_retailprice") / 1000, c("p_size") / 20.0, (c("p_partkey") % 10) / 5.0).alias("cv"))


def ex(t):
    s = lambda x: x.cast("string")
    tail = F.when(c("p_partkey") % 11 == 0, " + $fwd_return").when(c("p_partkey") % 13 == 0, " + (Log($volume").otherwise("")
    e = F.concat(F.lit("Ref($close, "), s(c("p_size") - 10), F.lit(") / $close - Mean(Std($"), F.lower("p_type"), F.lit(", "), s(c("p_size")), F.lit("), "), s(12 - c("p_size")), F.lit(")"), tail)
    h = F.concat(F.lit("try "), F.when(c("p_size") % 3 == 0, "RSI and ").otherwise(""), F.when(c("p_size") % 2 == 0, "volatility with ").otherwise(""), F.lit("moving average on "), c("p_name"))
    return t.part.select(c("p_partkey").alias("id"), e.alias("expr"), h.alias("hypothesis"), c("p_brand").alias("family"))


@query("p07_filter_factors", "SELECT id, ic, ir FROM lib WHERE family = 'Brand#2' AND abs(ic) >= 0.01 AND ir >= 1.2 AND stability >= 0.2", "lib", "ic ir")
def _(t):
    return se.filter_factors(lib(t), "Brand#2", 0.01, 1.2, 0.2).select("id", "ic", "ir")


@query("p08_list_factors", "SELECT id, name FROM lib WHERE list_contains(families, 'Brand#2') AND status = 'ECONOMY' ORDER BY id LIMIT 10 OFFSET 5", "lib")
def _(t):
    d = lib(t).filter(F.array_contains("families", "Brand#2") & (c("status") == "ECONOMY"))
    return qu.page(d, [c("id").asc()], 2, 5).unionByName(qu.page(d, [c("id").asc()], 3, 5)).select("id", "name")


@query("p09_field_coverage",
       """SELECT symbol, 'close' AS field, count(close) AS n_values, count(close) > 0 AS available FROM drv GROUP BY 1 UNION ALL
       SELECT symbol, 'basis_rate', count(basis_rate), count(basis_rate) > 0 FROM drv GROUP BY 1 UNION ALL SELECT symbol, 'no_such', 0, false FROM drv GROUP BY 1""", "th drv")
def _(t):
    return qu.field_coverage(t.drv, ["close", "basis_rate", "no_such"])


@query("p10_validate_bars",
       """SELECT 'high_below_low' AS rule, count(*) FILTER (high < low) AS n FROM th UNION ALL SELECT 'non_positive_price', count(*) FILTER (least(open, high, low, close) <= 0) FROM th
       UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM th UNION ALL SELECT 'missing_value', 0 UNION ALL SELECT 'missing_column', 0 UNION ALL SELECT 'empty', 0""", "th")
def _(t):
    return qu.validate_bars(t.th)


@query("p12_significance", "SELECT id, abs(ic) >= 0.03 AND ir >= 1.0 AS significant FROM lib", "lib")
def _(t):
    return lib(t).select("id", qu.is_significant(c("ic"), c("ir")).alias("significant"))


_MET = "mt AS (SELECT *, list_avg(cv) AS cv_mean, sqrt((pow(cv[1] - list_avg(cv), 2) + pow(cv[2] - list_avg(cv), 2) + pow(cv[3] - list_avg(cv), 2)) / 3) AS cv_std FROM lib)"
_RULES = [("low_ic", "ic < 0.03"), ("low_ir", "ir < 1.0"), ("high_drawdown", "max_drawdown > 0.2"), ("low_sharpe", "sharpe < 1.5"), ("low_win_rate", "win_rate < 0.45"),
          ("overfitting", "CASE WHEN cv_mean <> 0 THEN cv_std > abs(cv_mean) * 0.5 ELSE cv_std > 0.5 END"), ("lookahead_bias", "biased"), ("instability", "stability < 0.6")]
_FAIL = "fl8 AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in _RULES) + "], lambda x: x IS NOT NULL) AS reasons FROM mt)"


def _failures(t):
    m = F.aggregate("cv", F.lit(0.0), lambda a, v: a + v) / 3
    s = F.sqrt(F.aggregate(F.transform("cv", lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v) / 3)
    return qu.classify_failures(lib(t).withColumns({"cv_mean": m, "cv_std": s}))


@query("p13_classify_failures", f"WITH {_MET}, {_FAIL} SELECT id, array_to_string(reasons, ',') AS reasons FROM fl8", "lib")
def _(t):
    return _failures(t).select("id", F.array_join("failure_reasons", ",").alias("reasons"))


@query("p14_feedback_confidence",
       f"""WITH {_MET}, {_FAIL} SELECT id, least(1, 0.5 + 0.1 * least(3 / 5.0, 1) + 0.1 + 0.1 + 0.05 * least(len(reasons), 3)) AS confidence,
       CASE WHEN abs(cv_mean) < 0.01 THEN 0 ELSE greatest(0, 1 - cv_std / abs(cv_mean)) END AS cv_consistency FROM fl8""", "lib", "confidence cv_consistency")
def _(t):
    return qu.feedback_confidence(_failures(t)).select("id", "confidence", "cv_consistency")


@query("p15_grade",
       """SELECT id, CASE WHEN s >= 80 THEN 'A' WHEN s >= 65 THEN 'B' WHEN s >= 50 THEN 'C' WHEN s >= 35 THEN 'D' ELSE 'F' END AS grade FROM (
       SELECT id, least(30, abs(ic) * 500) + least(30, ir * 15) + least(20, greatest(0, sharpe) * 10) + greatest(0, win_rate - 0.5) * 100 + stability * 10 + 1e-9 AS s FROM lib)""", "lib")
def _(t):
    return lib(t).select("id", qu.grade(c("ic"), c("ir"), c("sharpe"), c("win_rate"), c("stability") + 1e-10).alias("grade"))


@query("p16_if_expression", "SELECT symbol, ts, CASE WHEN close > open THEN high ELSE low END AS v FROM th", "th", "v @ts")
def _(t):
    return t.th.select("symbol", "ts", fm.if_(c("close") > c("open"), c("high"), c("low")).alias("v"))


@query("p17_comparisons_logic",
       """SELECT symbol, ts, close > open AS gt, close >= open AS ge, close < open AS lt, close <= open AS le, close = open AS eq, close <> open AS ne,
       close > open AND volume > 100 AS both_, close > open OR volume > 100 AS any_, NOT (close > open) AS not_ FROM th""", "th", "@ts")
def _(t):
    a, b, v = c("close"), c("open"), c("volume") > 100
    return t.th.select("symbol", "ts", (a > b).alias("gt"), (a >= b).alias("ge"), (a < b).alias("lt"), (a <= b).alias("le"), (a == b).alias("eq"), (a != b).alias("ne"),
                       ((a > b) & v).alias("both_"), ((a > b) | v).alias("any_"), (~(a > b)).alias("not_"))


@query("p18_mask", "SELECT symbol, ts, CASE WHEN volume > 100 THEN close END AS v FROM th", "th", "v @ts")
def _(t):
    return t.th.select("symbol", "ts", fm.mask(c("close"), c("volume") > 100).alias("v"))


@query("p19_audit_expressions",
       r"""WITH a AS (SELECT id, expr, unnest(generate_series(1, length(expr))) AS i FROM ex),
       b AS (SELECT id, expr, i, expr[i] AS ch, length(replace(left(expr, i), ')', '')) - length(replace(left(expr, i), '(', '')) AS d FROM a WHERE expr[i] IN ('(', ')')),
       m AS (SELECT *, max(CASE WHEN ch = '(' THEN i END) OVER (PARTITION BY id, CASE WHEN ch = '(' THEN d - 1 ELSE d END ORDER BY i) AS o FROM b),
       k AS (SELECT id, lower(regexp_extract(left(expr, o - 1), '(\w+)\s*$', 1)) AS name FROM m WHERE ch = ')' AND regexp_matches(left(expr, i - 1), ',\s*-\d+\s*$')),
       n AS (SELECT id, bool_or(name IN ('ref', 'shift', 'delay')) AS l, bool_or(name IN ('mean', 'std', 'sum', 'max', 'min', 'rolling', 'window')) AS w FROM k GROUP BY id),
       f AS (SELECT ex.id, coalesce(l, false) AS l, coalesce(w, false) AS w, regexp_matches(lower(expr), '\$(fwd|forward|future|next)') AS f FROM ex LEFT JOIN n ON ex.id = n.id)
       SELECT id, l AS negative_lag, w AS negative_window, f AS future_column, l OR w OR f AS biased FROM f""", "ex")
def _(t):
    return tx.audit_expressions(ex(t)).select("id", "negative_lag", "negative_window", "future_column", "biased")


# words and signs of an expression, each with the one after it
_EXPR_WORDS = r"""w AS (SELECT id, expr, regexp_extract_all(expr, '\w+|[^\w\s]') AS ws FROM ex),
       nb AS (SELECT id, expr, list_transform(generate_series(1, len(ws) - 1), lambda i: {'word': ws[i], 'next': ws[i + 1]}) AS nb FROM w),
       nf AS (SELECT id, expr, CAST(len(list_filter(nb, lambda x: x.next = '(' AND left(x.word, 1) BETWEEN 'A' AND 'Z')) AS INTEGER) AS n_operators,
         list_sort(list_distinct(list_transform(list_filter(nb, lambda x: x.word = '$' AND regexp_matches(x.next, '^[[:alpha:]_]')), lambda x: x.next))) AS names FROM nb)"""


@query("p20_expression_complexity",
       f"""WITH {_EXPR_WORDS}, a AS (SELECT id, n_operators, array_to_string(names, ',') AS fields, CAST(length(expr) AS INTEGER) AS length,
         list_transform(generate_series(1, length(expr)), lambda i: (length(replace(left(expr, i), ')', '')) - length(replace(left(expr, i), '(', '')))) AS d FROM nf),
       b AS (SELECT id, n_operators, fields, length, CAST(list_max(d) AS INTEGER) AS max_depth, list_min(d) >= 0 AND d[-1] = 0 AS balanced FROM a)
       SELECT *, 0.1 * (greatest(n_operators - 3, 0) + greatest(max_depth - 2, 0)) AS penalty, n_operators > 10 OR max_depth > 5 AS exceeds FROM b""", "ex", "penalty")
def _(t):
    return tx.expression_complexity(ex(t)).drop("expr", "hypothesis", "family")


@query("p21_unknown_fields",
       f"""WITH {_EXPR_WORDS} SELECT id, f AS field FROM (SELECT id, unnest(names) AS f FROM nf) WHERE f NOT IN ('close', 'open', 'volume', 'economy')""", "ex")
def _(t):
    reg = t.spark.createDataFrame([(f,) for f in ("close", "open", "volume", "economy")], "field STRING")
    return tx.unknown_fields(ex(t), reg, "id")


KEYWORDS = {"RSI": ("RSI", r"RSI\("), "STD": ("volatility", r"Std\("), "MA": ("moving average", r"Mean\(")}


@query("p22_indicator_coverage",
       r"""WITH a AS (SELECT id, list_filter([CASE WHEN hypothesis LIKE '%RSI%' THEN 'RSI' END, CASE WHEN hypothesis LIKE '%volatility%' THEN 'STD' END,
         CASE WHEN hypothesis LIKE '%moving average%' THEN 'MA' END], lambda x: x IS NOT NULL) AS a, ['STD', 'MA'] AS u FROM ex)
       SELECT id, CAST(len(a) AS INTEGER) AS requested, CAST(len(list_intersect(a, u)) AS INTEGER) AS implemented, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(u, x))), ',') AS missing,
       len(list_intersect(a, u)) / len(a) AS coverage FROM a""", "ex", "coverage")
def _(t):
    return tx.indicator_coverage(ex(t), KEYWORDS, "id")


def _pairs(table):
    return "(VALUES " + ", ".join(f"('{k}', '{a}')" for k, v in table.items() for a in v) + ")"


# Every name an expression calls, and every run of words of a hypothesis, against the alias tables.
@query("p22_indicator_aliases",
       r"""WITH hw AS (SELECT id, regexp_extract_all(lower(hypothesis), '\w+') AS ws, regexp_extract_all(lower(expr), '\w+|[^\w\s]') AS es FROM ex),
       al AS (SELECT * FROM """ + _pairs(tx.INDICATOR_ALIASES) + r""" AS x(indicator, alias)), cl AS (SELECT * FROM """ + _pairs(tx.INDICATOR_CALLS) + r""" AS x(indicator, name)),
       asked AS (SELECT DISTINCT id, indicator FROM hw, al WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || alias || ' ')),
       closed AS (SELECT id, es, i,
         list_min(list_transform(generate_series(i + 1, len(es)), lambda j: list_sum(list_transform(es[i + 1:j], lambda e: CASE e WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)))) AS lowest
         FROM hw, unnest(generate_series(1, len(es) - 1)) AS u(i) WHERE es[i + 1] = '('),
       used AS (SELECT DISTINCT id, indicator FROM closed JOIN cl ON es[i] = name WHERE lowest <= 0),
       m AS (SELECT ex.id, count(a.indicator) AS requested, count(u.indicator) AS implemented,
         coalesce(string_agg(a.indicator, ',' ORDER BY a.indicator) FILTER (u.indicator IS NULL AND a.indicator IS NOT NULL), '') AS missing
         FROM ex LEFT JOIN asked a ON a.id = ex.id LEFT JOIN used u ON u.id = ex.id AND u.indicator = a.indicator GROUP BY 1)
       SELECT *, CASE WHEN requested > 0 THEN implemented / requested ELSE 1.0 END AS coverage FROM m""", "ex", "coverage")
def _(t):
    return tx.indicator_aliases(ex(t), "id")


# --- ledger
@query("a33_trial_thresholds",
       """SELECT trial, sharpe, n_trials, th AS threshold, sharpe >= th AS passed FROM (SELECT trial, sharpe, n_trials,
       1.1 * (1 + CASE WHEN n_trials <= 1 THEN 0 ELSE sqrt(2 * ln(n_trials)) END * """ + f"({q.norm_ppf('0.95')} / 1.645 * 0.15)" + """) AS th FROM (SELECT *, row_number() OVER (ORDER BY trial) AS n_trials FROM trials))""",
       "trials", "sharpe threshold")
def _(t):
    return le.trial_thresholds(t.trials, base=1.1).select("trial", "sharpe", "n_trials", "threshold", "passed")


@query("a34_ledger_stats",
       """SELECT coalesce(family, 'all') AS family, count(sharpe) AS n, avg(sharpe) AS mean, stddev_pop(sharpe) AS std, max(sharpe) AS max, min(sharpe) AS min, quantile_cont(sharpe, 0.5) AS median
       FROM trials GROUP BY GROUPING SETS ((family), ())""", "trials", "mean std max min median")
def _(t):
    return le.ledger_stats(t.trials)


@query("a35_pattern_stats",
       f"""WITH {_MET}, {_FAIL}, g AS (SELECT family, count(*) FILTER (len(reasons) <= 4) AS successes, count(*) FILTER (len(reasons) > 4) AS failures,
         max(CASE WHEN len(reasons) <= 4 THEN greatest(ic, 0) END) AS best_ic FROM fl8 GROUP BY 1),
       r AS (SELECT family, reason, count(*) AS n FROM (SELECT family, unnest(reasons) AS reason FROM fl8 WHERE len(reasons) > 4) GROUP BY 1, 2),
       k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, reason) AS i FROM r)
       SELECT g.family, successes, failures, successes / greatest(successes + failures, 1) AS success_rate, best_ic, (SELECT string_agg(reason, ',' ORDER BY i) FROM k WHERE k.family = g.family AND i <= 3) AS common_failures FROM g""",
       "lib", "success_rate best_ic")
def _(t):
    d = _failures(t).withColumn("pattern_type", F.when(F.size("failure_reasons") <= 4, "success").otherwise("failure"))
    return le.pattern_stats(d)


@query("a36_status_counts", "SELECT o_orderstatus AS status, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1", "", "share")
def _(t):
    return le.status_counts(t.orders.select(c("o_orderstatus").alias("status")))


@query("a37_cost_report",
       """SELECT dim, key, sum(cost) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests, avg(CASE WHEN cached THEN 1.0 ELSE 0.0 END) AS hit_rate FROM (
       SELECT 'total' AS dim, 'all' AS key, * FROM traces UNION ALL SELECT 'agent', agent, * FROM traces UNION ALL SELECT 'model', CAST(model AS VARCHAR), * FROM traces
       UNION ALL SELECT 'hour', strftime(ts, '%Y-%m-%d %H'), * FROM traces) GROUP BY 1, 2""", "traces", "cost hit_rate")
def _(t):
    return le.cost_report(t.traces)


@query("a39_latest_ts", "SELECT symbol, max(ts) AS latest FROM fl WHERE value IS NOT NULL GROUP BY 1", "ud fp fl", "@latest")
def _(t):
    return t.fl.filter(c("value").isNotNull()).groupBy("symbol").agg(F.max("ts").alias("latest"))


@query("a60_library_stats",
       "SELECT family, count(*) AS n, avg(ic) AS mean_ic, avg(sharpe) AS mean_sharpe, arg_max(name, (sharpe, name)) AS best FROM (SELECT unnest(families) AS family, name, ic, sharpe FROM lib) GROUP BY 1",
       "lib", "mean_ic mean_sharpe")
def _(t):
    return le.library_stats(lib(t))


@query("a62_backtest_stats",
       """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F' AND date_trunc('day', o_orderdate) = TIMESTAMP '1997-06-01') AS completed_today,
       avg(o_totalprice / 1e5) FILTER (o_orderstatus = 'F') AS mean_sharpe, max(o_totalprice / 1e5) FILTER (o_orderstatus = 'F') AS best_sharpe,
       arg_max(o_orderkey, (o_totalprice / 1e5, o_orderkey)) FILTER (o_orderstatus = 'F') AS best_id FROM orders""", "", "mean_sharpe best_sharpe")
def _(t):
    d = t.orders.select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "running").otherwise("other").alias("status"),
                        (c("o_totalprice") / 1e5).alias("sharpe"), c("o_orderdate").alias("ts"))
    return le.backtest_stats(d, F.lit("1997-06-01").cast("timestamp"))


@query("a63_request_stats",
       """SELECT count(*) AS requests, avg(CASE WHEN agent <> 'error' THEN 1.0 ELSE 0.0 END) * 100 AS success_rate, avg(cost * 1000) AS mean_latency, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost,
       quantile_cont(cost * 1000, 0.95) AS p95, quantile_cont(cost * 1000, 0.99) AS p99, count(*) / count(DISTINCT date_trunc('hour', ts)) AS requests_per_hour FROM traces""",
       "traces", "success_rate mean_latency cost p95 p99 requests_per_hour")
def _(t):
    return le.request_stats(t.traces.withColumns({"latency": c("cost") * 1000, "ok": c("agent") != "error"}))


@query("w50_one_per_family", "SELECT family, id, ic FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs(ic) DESC, id) AS r FROM lib) WHERE r = 1", "lib", "ic")
def _(t):
    return se.one_per_family(lib(t), name="id").select("family", "id", "ic")


@query("w50_count_limits",
       "SELECT count(*) AS n_selected, CASE WHEN count(*) < 5 THEN 'too few' WHEN count(*) > 20 THEN 'too many' ELSE 'ok' END AS warning FROM (SELECT DISTINCT family FROM lib)", "lib")
def _(t):
    return se.count_warnings(se.one_per_family(lib(t), name="id"), 5, 20)


@query("w52_market_state",
       f"""WITH s AS (SELECT symbol, ts, close / {q.lag('close', 20)} - 1 AS ret20, ({q.std('ret', 20)}) * sqrt(365) AS ann_vol FROM hret)
       SELECT symbol, last(ret20 ORDER BY ts) AS ret20, last(ann_vol ORDER BY ts) AS ann_vol, last(ann_vol ORDER BY ts) > 0.5 AS high_vol FROM s GROUP BY 1""", "th hret", "ret20 ann_vol")
def _(t):
    d = t.hret.select("symbol", "ts", R.pct_change("close", 20).alias("ret20"), (R.std("ret", 20) * 365 ** 0.5).alias("ann_vol"))
    g = d.groupBy("symbol").agg(F.max_by("ret20", "ts").alias("ret20"), F.max_by("ann_vol", "ts").alias("ann_vol"))
    return g.withColumn("high_vol", c("ann_vol") > 0.5)


_TB = """tb AS (SELECT o_orderkey AS trial, o_orderpriority AS family, o_orderstatus AS hypothesis, o_orderdate AS ts, substr(md5(lower(o_orderpriority || ':' || o_orderstatus)), 1, 12) AS hypothesis_id FROM orders),
tc AS (SELECT *, row_number() OVER (ORDER BY ts, trial) - 1 AS total_before, row_number() OVER h - 1 AS id_before, (epoch(ts) - epoch(lag(ts) OVER h)) / 60 AS minutes_since FROM tb WINDOW h AS (PARTITION BY hypothesis_id ORDER BY ts, trial))"""


@query("w53_trial_budget",
       f"""WITH {_TB} SELECT trial, hypothesis_id, total_before, id_before, minutes_since, CASE WHEN total_before >= 12000 THEN 'total limit' WHEN id_before >= 800 THEN 'hypothesis limit'
       WHEN minutes_since < 30 THEN 'cooldown' ELSE 'ok' END AS verdict FROM tc""", "", "minutes_since")
def _(t):
    d = t.orders.select(c("o_orderkey").alias("trial"), c("o_orderpriority").alias("family"), c("o_orderstatus").alias("hypothesis"), c("o_orderdate").alias("ts"))
    return le.trial_budget(d, 800, 12000).select("trial", "hypothesis_id", "total_before", "id_before", "minutes_since", "verdict")


@query("j16_trials_with_factor", "SELECT t.trial, t.sharpe, l.name FROM trials t LEFT JOIN lib l ON t.trial = l.id AND l.ic > 0", "trials lib", "sharpe")
def _(t):
    return t.trials.select("trial", "sharpe").join(lib(t).filter(c("ic") > 0).select(c("id").alias("trial"), "name"), "trial", "left")


# --- risk
@query("j17_rule_breaches",
       """WITH m AS (SELECT symbol, 'max_close' AS metric, max(close) AS value FROM th GROUP BY 1 UNION ALL SELECT symbol, 'mean_volume', avg(volume) FROM th GROUP BY 1),
       r AS (SELECT * FROM (VALUES ('max_close', 300.0), ('mean_volume', 50.0)) AS x(metric, threshold)) SELECT metric, symbol, value, threshold FROM m JOIN r USING (metric) WHERE value > threshold""",
       "th", "value threshold")
def _(t):
    m = t.th.groupBy("symbol").agg(F.max("close").alias("max_close"), F.avg("volume").alias("mean_volume")).unpivot("symbol", ["max_close", "mean_volume"], "metric", "value")
    rules = t.spark.createDataFrame([("max_close", 300.0), ("mean_volume", 50.0)], "metric STRING, threshold DOUBLE")
    return rk.breach_join(m, rules)


_ACC = """ac AS (SELECT c_custkey AS account, (c_acctbal + 2000) * 50 AS equity, (c_acctbal + 2000) * (50 + c_custkey % 17) AS peak, c_acctbal * 10 - 20000 AS daily_pnl FROM customer),
po AS (SELECT o_custkey AS account, o_orderkey AS position, o_totalprice AS value, o_totalprice / 10 AS margin FROM orders),
ap AS (SELECT ac.*, coalesce(max(value), 0) AS largest, coalesce(sum(value), 0) AS exposure FROM ac LEFT JOIN po USING (account) GROUP BY ALL)"""


def _accounts(t):
    b = c("c_acctbal")
    return t.customer.select(c("c_custkey").alias("account"), ((b + 2000) * 50).alias("equity"), ((b + 2000) * (50 + c("c_custkey") % 17)).alias("peak"), (b * 10 - 20000).alias("daily_pnl"))


def _pos(t):
    return t.orders.select(c("o_custkey").alias("account"), c("o_orderkey").alias("position"), c("o_totalprice").alias("value"), (c("o_totalprice") / 10).alias("margin"))


@query("a27_concentration_breaches", f"WITH {_ACC} SELECT account, position, value / equity AS share FROM po JOIN ac USING (account) WHERE value / equity > 0.8", "", "share")
def _(t):
    return rk.concentration_breaches(_pos(t), _accounts(t), "account", 0.8).select("account", "position", "share")


_RM = """rm AS (SELECT p_partkey AS id, p_size / 200.0 AS max_drawdown, (p_partkey % 10) / 200.0 AS current_drawdown, p_retailprice / 5000 AS volatility, (p_partkey % 13) / 200.0 AS var_95,
    (p_partkey % 17) / 100.0 AS max_position, (p_partkey % 19) / 30.0 AS turnover, (p_size % 10) / 10.0 AS concentration FROM part)"""


@query("a28_risk_scorecard",
       f"""WITH {_RM}, b AS (SELECT *, list_filter([CASE WHEN max_drawdown > 0.15 THEN 'max_drawdown' END, CASE WHEN current_drawdown > 0.03 THEN 'current_drawdown' END, CASE WHEN volatility > 0.25 THEN 'volatility' END,
         CASE WHEN var_95 > 0.05 THEN 'var_95' END, CASE WHEN max_position > 0.1 THEN 'max_position' END, CASE WHEN turnover > 0.5 THEN 'turnover' END], lambda x: x IS NOT NULL) AS l FROM rm),
       s AS (SELECT id, array_to_string(l, ',') AS breached, CAST(len(l) AS INTEGER) AS n_breached, list_contains(l, 'current_drawdown') AS crit, least(1, least(max_drawdown / 0.15, 1) * 0.3 + least(volatility / 0.25, 1) * 0.2
         + least(var_95 / 0.05, 1) * 0.2 + concentration * 0.15 + least(len(l) / 6.0, 1) * 0.15) AS score FROM b)
       SELECT id, breached, n_breached, score, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'medium' WHEN score < 0.75 THEN 'high' ELSE 'critical' END AS level,
       CASE WHEN crit THEN 'rejected' WHEN score < 0.5 AND n_breached = 0 THEN 'approved' WHEN score < 0.75 THEN 'conditional' ELSE 'manual_review' END AS status FROM s""", "", "score")
def _(t):
    k = c("p_partkey")
    d = t.part.select(k.alias("id"), (c("p_size") / 200.0).alias("max_drawdown"), ((k % 10) / 200.0).alias("current_drawdown"), (c("p_retailprice") / 5000).alias("volatility"), ((k % 13) / 200.0).alias("var_95"),
                      ((k % 17) / 100.0).alias("max_position"), ((k % 19) / 30.0).alias("turnover"), ((c("p_size") % 10) / 10.0).alias("concentration"))
    return rk.risk_scorecard(d).select("id", "breached", "n_breached", "score", "level", "status")


@query("a29_hard_limits",
       f"""WITH {_ACC}, v AS (SELECT *, (peak - equity) / peak > 0.15 AS dd, equity > 0 AND largest / equity > 0.3 AS cc, equity > 0 AND exposure / equity > 3 AS lv,
         equity > 0 AND daily_pnl < 0 AND -daily_pnl / equity > 0.05 AS dl FROM ap)
       SELECT account, array_to_string(list_filter([CASE WHEN dd THEN 'max_drawdown' END, CASE WHEN cc THEN 'position_concentration' END, CASE WHEN lv THEN 'leverage' END, CASE WHEN dl THEN 'daily_loss' END], lambda x: x IS NOT NULL), ',') AS violations,
       CASE WHEN dd OR dl THEN 'emergency_close_all' WHEN lv THEN 'reduce_leverage' WHEN cc THEN 'reduce_position' ELSE 'none' END AS action FROM v""")
def _(t):
    g = _pos(t).groupBy("account").agg(F.max("value").alias("largest"), F.sum("value").alias("exposure"))
    return rk.hard_limits(_accounts(t).join(g, "account", "left").fillna(0.0, ["largest", "exposure"])).select("account", "violations", "action")


@query("a64_account_risk",
       f"""WITH {_ACC}, g AS (SELECT ac.account, equity, coalesce(sum(margin), 0) AS used, coalesce(max(margin), 0) AS largest FROM ac LEFT JOIN po USING (account) GROUP BY 1, 2),
       u AS (SELECT account, CASE WHEN equity > 0 THEN used / equity * 100 ELSE 0 END AS usage, CASE WHEN used > 0 THEN largest / used * 100 ELSE 0 END AS concentration FROM g)
       SELECT *, CASE WHEN greatest(usage, concentration) > 80 THEN 'critical' WHEN greatest(usage, concentration) > 60 THEN 'danger' WHEN greatest(usage, concentration) > 40 THEN 'warning' ELSE 'normal' END AS level FROM u""",
       "", "usage concentration")
def _(t):
    return rk.account_risk(_pos(t), _accounts(t), "account").select("account", "usage", "concentration", "level")


_VIO = """vi AS (SELECT o_custkey AS account, CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'high' ELSE 'warning' END AS severity,
    CASE WHEN o_orderstatus = 'F' THEN 'drawdown' ELSE 'concentration' END AS rule, o_totalprice / 5e5 + 0.3 AS value FROM orders)"""


@query("a65_risk_actions",
       f"""WITH {_VIO}, a AS (SELECT *, CASE WHEN severity = 'critical' AND rule = 'drawdown' THEN 2 WHEN severity = 'critical' THEN 1 ELSE 0 END AS pr FROM vi)
       SELECT account, CASE max(pr) WHEN 2 THEN 'close_all' WHEN 1 THEN 'reduce_position' ELSE 'none' END AS action, max(CASE WHEN pr = 1 THEN (value - 0.3) / value END) AS reduce_pct, count(*) AS n_violations,
       CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' ELSE 'warning' END AS level FROM a GROUP BY 1""", "", "reduce_pct")
def _(t):
    d = t.orders.select(c("o_custkey").alias("account"), F.when(c("o_orderpriority").startswith("1"), "critical").when(c("o_orderpriority").startswith("2"), "high").otherwise("warning").alias("severity"),
                        F.when(c("o_orderstatus") == "F", "drawdown").otherwise("concentration").alias("rule"), (c("o_totalprice") / 5e5 + 0.3).alias("value"))
    return rk.risk_actions(d, "account")


@query("a50_fill_summary",
       """WITH o AS (SELECT o_orderkey AS order_id, CAST(o_orderkey % 7 * 40 AS DOUBLE) AS requested FROM orders), f AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS q, sum(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT order_id, requested, coalesce(q, 0) AS filled, coalesce(n, 0) AS n_fills, v / q AS avg_price, greatest(requested - coalesce(q, 0), 0) AS remaining, coalesce(q, 0) >= requested AS complete FROM o LEFT JOIN f USING (order_id)""",
       "", "requested filled avg_price remaining")
def _(t):
    o = t.orders.select(c("o_orderkey").alias("order_id"), (c("o_orderkey") % 7 * 40).cast("double").alias("requested"))
    f = t.lineitem.select(c("l_orderkey").alias("order_id"), c("l_quantity").alias("qty"), (c("l_extendedprice") / c("l_quantity")).alias("price"))
    return rk.fill_summary(f, o)


_RP = "rp AS (SELECT l_suppkey AS symbol, l_orderkey, l_linenumber, l_extendedprice * (l_discount - 0.05) AS pnl FROM lineitem)"


@query("a51_realized_pnl",
       f"WITH {_RP} SELECT symbol, sum(pnl) AS total, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS profit, sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS loss, count(*) AS n FROM rp GROUP BY 1", "", "total profit loss", 4)
def _(t):
    return rk.realized_pnl(t.lineitem.select(c("l_suppkey").alias("symbol"), (c("l_extendedprice") * (c("l_discount") - 0.05)).alias("pnl")))


@query("a51_pnl_history_top",
       f"WITH {_RP} SELECT symbol, l_orderkey, l_linenumber, pnl FROM rp ORDER BY abs(pnl) DESC, l_orderkey, l_linenumber LIMIT 20", "", "pnl")
def _(t):
    d = t.lineitem.select(c("l_suppkey").alias("symbol"), "l_orderkey", "l_linenumber", (c("l_extendedprice") * (c("l_discount") - 0.05)).alias("pnl"))
    return d.orderBy(F.abs("pnl").desc(), "l_orderkey", "l_linenumber").limit(20)


@query("a52_portfolio_totals",
       """WITH p AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS qty, sum(l_extendedprice) / sum(l_quantity) AS entry FROM lineitem GROUP BY 1), x AS (SELECT symbol, last(close ORDER BY ts) AS px FROM sm GROUP BY 1)
       SELECT sum((px - entry) * qty) AS unrealized, sum(px * qty) / 10 AS margin_used, sum(px * qty) AS market_value, count(*) AS n_positions FROM p JOIN x USING (symbol)""", "sm", "unrealized margin_used market_value", 2)
def _(t):
    p = t.lineitem.groupBy(c("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").alias("qty"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("entry"))
    return rk.portfolio_totals(p, t.sm)


@query("a54_cluster_diversity", "SELECT count(DISTINCT label) / count(label) AS diversity FROM embeddings", "", "diversity")
def _(t):
    return rk.cluster_diversity(t.embeddings, "label")


@query("a55_approximate_variants")
def _(t):
    """Sketches with a stated error: distinct users and value quantiles per event type."""
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.approx_percentile("value", [0.5, 0.95], 10000).alias("quantiles"))


_LEV = "CASE l_linenumber % 5 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 20 WHEN 3 THEN 50 ELSE 100 END"
_MMR = "CASE l_linenumber % 5 WHEN 0 THEN 100 WHEN 1 THEN 250 WHEN 2 THEN 400 WHEN 3 THEN 500 ELSE 600 END"


@query("f_money_margin",
       f"""WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS HUGEINT) AS qty, CAST(round(l_extendedprice * 100) AS HUGEINT) AS pc, CAST({_LEV} AS HUGEINT) AS lev, CAST({_MMR} AS HUGEINT) AS r, l_returnflag = 'R' AS short FROM lineitem)
       SELECT l_orderkey, l_linenumber, CAST((qty * pc * 1000000 + lev - 1) // lev AS BIGINT) AS initial_e8, CAST(qty * pc * r * 100 AS BIGINT) AS maintenance_e8,
       CAST(CASE WHEN NOT short THEN (pc * (lev * (10000 + r) - 10000)) // (lev * 10000) ELSE (pc * (lev * (10000 - r) + 10000) + lev * 10000 - 1) // (lev * 10000) END AS BIGINT) AS liquidation_cents,
       CAST((100000 * 100 * lev * 1000) // pc AS BIGINT) AS max_size_e3 FROM m""")
def _(t):
    lev = F.element_at(F.array(*[F.lit(x) for x in (3, 7, 20, 50, 100)]), c("l_linenumber") % 5 + 1)
    qty, px = c("l_quantity").cast("decimal(12,2)"), c("l_extendedprice").cast("decimal(12,2)")
    side = F.when(c("l_returnflag") == "R", "short").otherwise("long")
    rate = mo.maintenance_rate(lev)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (mo.initial_margin(qty, px, lev) * 100000000).cast("bigint").alias("initial_e8"),
        (mo.maintenance_margin(qty, px, rate) * 100000000).cast("bigint").alias("maintenance_e8"),
        (mo.liquidation_price(px, lev, rate, side) * 100).cast("bigint").alias("liquidation_cents"),
        (mo.max_size(F.lit(100000), px, lev) * 1000).cast("bigint").alias("max_size_e3"))


@query("f_money_margin_status",
       f"""WITH {_ACC}, g AS (SELECT ac.account, equity AS balance, coalesce(sum(margin), 0) AS mm FROM ac LEFT JOIN po USING (account) GROUP BY 1, 2),
       r AS (SELECT account, CASE WHEN balance <= 0 THEN 1.0 ELSE ceil(round(mm / balance * 1e4, 4)) / 1e4 END AS ratio FROM g)
       SELECT account, ratio, CASE WHEN ratio >= 1 THEN 'liquidation' WHEN ratio >= 0.9 THEN 'critical' WHEN ratio >= 0.7 THEN 'danger' WHEN ratio >= 0.5 THEN 'warning' ELSE 'healthy' END AS status FROM r""", "", "ratio", 4)
def _(t):
    g = _accounts(t).join(_pos(t).groupBy("account").agg(F.sum("margin").alias("mm")), "account", "left").fillna(0.0, ["mm"])
    r = mo.margin_ratio(F.round("mm", 6).cast("decimal(18,6)"), F.round("equity", 6).cast("decimal(18,6)"))
    return g.select("account", r.alias("ratio")).withColumn("status", mo.margin_status(c("ratio")))


@query("f_pnl",
       """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN (b - a) * l_quantity ELSE (a - b) * l_quantity END AS pnl, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE -1 END * (b - a) / a * 100 AS ret_pct, b * l_quantity AS notional
       FROM (SELECT *, l_extendedprice / l_quantity AS a, l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS b FROM lineitem)""", "", "pnl ret_pct notional", 4)
def _(t):
    a = c("l_extendedprice") / c("l_quantity")
    b = a * (1 + c("l_tax") - c("l_discount"))
    side = F.when(c("l_returnflag") != "R", "long").otherwise("short")
    return t.lineitem.select("l_orderkey", "l_linenumber", mo.unrealized_pnl(c("l_quantity"), a, b, side).alias("pnl"), mo.return_pct(a, b, side).alias("ret_pct"), (b * c("l_quantity")).alias("notional"))


@query("f_math_functions",
       """SELECT event_id, abs(value - 50) AS a, sign(value - 50) AS s, ln(value) AS l, ln(value + 1) AS l1, exp(value / 100) AS e, pow(value, 0.5) AS p, sqrt(value) AS r, greatest(value, 50) AS g, least(value, 50) AS m,
       value / (event_id % 5 + 1e-10) AS sd, CASE WHEN event_id % 5 <> 0 THEN value / (event_id % 5) END AS d, greatest(10, least(90, value)) AS cl, round(value, 1) AS ro FROM events""", "", "a s l l1 e p r g m d cl")
def _(t):
    v = c("value")
    k = (c("event_id") % 5).cast("double")
    return t.events.select("event_id", F.abs(v - 50).alias("a"), fm.sign(v - 50).alias("s"), fm.log(v).alias("l"), fm.log1p(v).alias("l1"), F.exp(v / 100).alias("e"), F.pow(v, F.lit(0.5)).alias("p"), F.sqrt(v).alias("r"),
                           fm.greater(v, 50.0).alias("g"), fm.less(v, 50.0).alias("m"), fm.safe_div(v, k).alias("sd"), fm.div(v, k).alias("d"), fm.clip(v, 10.0, 90.0).alias("cl"), F.round(v, 1).alias("ro"))


@query("f_bin_functions",
       """SELECT event_id, CASE WHEN value >= 0 AND value <= 20 THEN 'low' WHEN value <= 60 THEN 'mid' WHEN value <= 500 THEN 'high' END AS bin, CASE WHEN value >= 100 THEN 'large' WHEN value >= 10 THEN 'mid' ELSE 'small' END AS cap,
       CASE WHEN value / 100 >= 1 THEN 'critical' WHEN value / 100 >= 0.8 THEN 'danger' WHEN value / 100 >= 0.6 THEN 'warning' ELSE 'normal' END AS alert FROM events""")
def _(t):
    v = c("value")
    return t.events.select("event_id", fm.cut(v, [0, 20, 60, 500], ["low", "mid", "high"]).alias("bin"), fm.cap_group(v, 100, 10).alias("cap"), fm.alert_level(v, 100.0).alias("alert"))


@query("f_str_functions",
       r"""SELECT id, upper(family) AS up, replace(family, '#', '_') AS rep, hypothesis LIKE '%RSI%' AS has, substr(md5(lower(family || ':' || hypothesis)), 1, 12) AS hid, sha256(expr) AS sha,
       array_to_string(list_transform(regexp_extract_all(expr, '\b[A-Z]\w*\s*\('), lambda x: rtrim(x, '( ')), ',') AS ops FROM ex""", "ex")
def _(t):
    return ex(t).select("id", F.upper("family").alias("up"), F.replace("family", F.lit("#"), F.lit("_")).alias("rep"), F.contains("hypothesis", F.lit("RSI")).alias("has"),
                        tx.hash_id(c("family"), c("hypothesis")).alias("hid"), F.sha2("expr", 256).alias("sha"), F.array_join(tx.operators(c("expr")), ",").alias("ops"))


@query("f_map_json",
       """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value * 2 ELSE 0.0 END AS metric, 1 AS n_left FROM events""", "", "metric")
def _(t):
    v = c("value")
    m = F.when(c("event_id") % 3 == 0, F.create_map(F.lit("ic_mean"), v, F.lit("x"), v)).when(c("event_id") % 3 == 1, F.create_map(F.lit("ic"), v * 2, F.lit("x"), v)).otherwise(F.create_map(F.lit("x"), v, F.lit("y"), v))
    d = t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), m.alias("m"))
    left = F.size(F.from_json(F.to_json(tx.without_keys(c("m"), "ic_mean", "ic", "y")), "MAP<STRING, DOUBLE>"))
    return d.select("event_id", "k", tx.metric_lookup(c("m"), "ic_mean", "ic", "mean_ic").alias("metric"), left.alias("n_left"))


@query("f_null_functions",
       """SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS missing, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0 ELSE value END AS filled, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 4 AS DOUBLE) END AS nz FROM events""", "", "filled nz")
def _(t):
    x = F.when(c("event_id") % 3 == 0, F.lit(float("nan"))).when(c("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(c("value"))
    d = t.events.withColumn("x", fm.finite(x))
    return d.select("event_id", c("x").isNull().alias("missing"), fm.fill(c("x")).alias("filled"), fm.zero_to_null((c("event_id") % 4).cast("double")).alias("nz"))


# --- sorts and sets
@query("o01_sort_bars", "SELECT symbol, ts, close FROM th ORDER BY symbol, ts", "th", "close @ts")
def _(t):
    return t.th.select("symbol", "ts", "close").orderBy("symbol", "ts")


@query("o02_sort_library", "SELECT id, ic FROM lib ORDER BY abs(ic) DESC, id", "lib", "ic")
def _(t):
    return lib(t).select("id", "ic").orderBy(F.abs("ic").desc(), "id")


@query("o03_top_n_global", "SELECT id, sharpe FROM lib ORDER BY sharpe DESC, id LIMIT 15", "lib", "sharpe")
def _(t):
    return qu.top_n_global(lib(t).select("id", "sharpe"), c("sharpe"), 15, "id")


@query("o04_best_row", "SELECT id, v FROM (SELECT id, CASE WHEN sharpe < 1.5 THEN sharpe END AS v FROM lib) ORDER BY v DESC NULLS LAST, id LIMIT 1", "lib", "v")
def _(t):
    return qu.best_row(lib(t).select("id", F.when(c("sharpe") < 1.5, c("sharpe")).alias("v")), "v", "id")


@query("o05_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    total = t.orders.agg(F.count("*").alias("total"))  # one row
    return qu.page(t.orders, [c("o_orderdate").desc(), c("o_orderkey").asc()], 3, 20).select("o_orderkey").join(F.broadcast(total))


@query("o06_head_tail",
       """SELECT symbol, ts, CASE WHEN pos > n - ceil(n * 0.1) THEN 'top' ELSE 'bottom' END AS side FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY volume, symbol) AS pos, count(*) OVER (PARTITION BY ts) AS n FROM ud)
       WHERE pos > n - ceil(n * 0.1) OR pos <= ceil(n * 0.1)""", "ud", "@ts")
def _(t):
    return cs.head_tail(t.ud.select("symbol", "ts", "volume"), ["ts"], "volume", 0.1, "symbol").select("symbol", "ts", "side")


@query("o07_universe",
       """WITH s AS (SELECT 'S' || p_partkey AS symbol, p_name AS base, CASE WHEN p_partkey % 2 = 0 THEN 'USDT' ELSE 'BTC' END AS quote, CASE WHEN p_size > 5 THEN 'TRADING' ELSE 'BREAK' END AS status FROM part),
       v AS (SELECT 'S' || l_partkey AS symbol, sum(l_extendedprice) AS volume FROM lineitem GROUP BY 1)
       SELECT symbol, base, volume, CAST(row_number() OVER (ORDER BY volume DESC, symbol) AS INTEGER) AS rank FROM s JOIN v USING (symbol) WHERE status = 'TRADING' AND quote = 'USDT' AND base <> 'small ring' AND upper(base) LIKE '%RED%'
       ORDER BY volume DESC, symbol LIMIT 30""", "", "volume", 2)
def _(t):
    k = c("p_partkey")
    s = t.part.select(F.concat(F.lit("S"), k.cast("string")).alias("symbol"), c("p_name").alias("base"), F.when(k % 2 == 0, "USDT").otherwise("BTC").alias("quote"), F.when(c("p_size") > 5, "TRADING").otherwise("BREAK").alias("status"))
    v = t.lineitem.groupBy(F.concat(F.lit("S"), c("l_partkey").cast("string")).alias("symbol")).agg(F.sum("l_extendedprice").alias("volume"))
    return qu.universe(s, v, "USDT", 30, ["small ring"], "red").select("symbol", "base", "volume", "rank")


@query("o08_priority_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey")
def _(t):
    return qu.priority_order(t.orders, "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("u_1_union_all", "SELECT symbol, ts, open_interest, NULL AS funding_rate FROM oi UNION ALL SELECT symbol, ts, NULL, funding_rate FROM fund8", "oi fund8", "open_interest funding_rate @ts")
def _(t):
    return aj.union_all(t.oi, t.fund8)


@query("u_2_merge_calendars", "SELECT ts FROM th UNION SELECT ts FROM oi", "th oi", "@ts")
def _(t):
    return t.th.select("ts").union(t.oi.select("ts")).distinct()


@query("u_3_common_times", "SELECT ts FROM th INTERSECT SELECT ts FROM fund8", "th fund8", "@ts")
def _(t):
    return t.th.select("ts").intersect(t.fund8.select("ts"))


@query("u_4_missing_times", "SELECT ts FROM th EXCEPT SELECT ts FROM fund8", "th fund8", "@ts")
def _(t):
    return t.th.select("ts").subtract(t.fund8.select("ts"))


@query("u_5_dedupe", "SELECT DISTINCT symbol, date_trunc('day', ts) AS ts FROM th", "th", "@ts")
def _(t):
    return t.th.select("symbol", F.date_trunc("day", "ts").alias("ts")).dropDuplicates(["symbol", "ts"])


@query("u_6_label_splits",
       """SELECT market, half, regime, count(*) AS n, avg(close) AS mean_close FROM (SELECT CASE WHEN symbol IN ('click', 'view') THEN 'large' ELSE 'small' END AS market, CASE WHEN day(ts) <= 15 THEN 'h1' ELSE 'h2' END AS half,
       CASE WHEN close > open THEN 'up' ELSE 'down' END AS regime, close FROM th) GROUP BY 1, 2, 3""", "th", "mean_close")
def _(t):
    d = qu.label_splits(t.th, market=F.when(c("symbol").isin("click", "view"), "large").otherwise("small"), half=F.when(F.dayofmonth("ts") <= 15, "h1").otherwise("h2"),
                        regime=F.when(c("close") > c("open"), "up").otherwise("down"))
    return d.groupBy("market", "half", "regime").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close"))


@query("u_7_long_to_wide",
       "SELECT symbol, ts, max(value) FILTER (name = 'momentum') AS momentum, max(value) FILTER (name = 'volume') AS volume, max(value) FILTER (name = 'range') AS range FROM fl GROUP BY 1, 2", "ud fp fl", "momentum volume range @ts")
def _(t):
    return qu.to_wide(t.fl, ["symbol", "ts"], "name", "value", ["momentum", "volume", "range"])


@query("u_7_wide_to_long", "UNPIVOT (SELECT symbol, ts, open, close FROM th) ON open, close INTO NAME name VALUE value", "th", "value @ts")
def _(t):
    return qu.to_long(t.th.select("symbol", "ts", "open", "close"), ["symbol", "ts"])


@query("u_8_retention",
       "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 500", "", "@ts")
def _(t):
    newest = t.events.agg(F.max("ts").alias("_n"))  # one row
    d = t.events.select("event_id", "ts").join(F.broadcast(newest))
    return qu.retain(d, "ts", c("_n"), 10, 500, "event_id").select("event_id", "ts")
