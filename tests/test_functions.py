from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factorspark.functions import book as bk
from factorspark.functions import dates as dt
from factorspark.functions import math as fm
from factorspark.functions import money as mo
from factorspark.functions import text as tx
from factorspark.functions import vectors as fv


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_quotes(spark):
    b, a, bs, az = F.lit(40000.0), F.lit(40010.0), F.lit(6.0), F.lit(4.0)
    r = one(spark, bk.mid(b, a), bk.spread(b, a), bk.spread(b, a, "bps"), bk.imbalance(bs, az), bk.imbalance(F.lit(0.0), F.lit(0.0)))
    assert r[0] == 40005 and r[1] == 10 and r[2] == pytest.approx(2.4997, abs=1e-4) and r[3] == pytest.approx(0.2) and r[4] is None


def test_levels(spark):
    lv = lambda rows: F.array(*[F.struct(F.lit(p).alias("price"), F.lit(q).alias("qty")) for p, q in rows])
    bids, asks = lv([(100.0, 50.0), (99.0, 100.0), (98.0, 7.0)]), lv([(101.0, 31.25), (102.0, 93.75), (103.0, 9.0)])
    r = one(spark, bk.depth_sum(bids, 2), bk.depth_sum(asks, 2), bk.depth_imbalance(bids, asks, 2), bk.depth_vwap(bids, 2), bk.depth_vwap(asks, 2), bk.best(bids))
    assert r[0] == 150 and r[1] == 125 and r[2] == pytest.approx(25 / 275) and r[3] == pytest.approx(99.3333, abs=1e-4) and r[4] == pytest.approx(101.75) and r[5] == 100


def test_margin_rounding(spark):
    d = lambda x: F.lit(x).cast("decimal(18,6)")
    r = one(spark, mo.initial_margin(d("1"), d("100"), F.lit(3)), mo.maintenance_margin(d("1"), d("100"), mo.maintenance_rate(F.lit(10))),
            mo.liquidation_price(d("50000"), F.lit(10), mo.maintenance_rate(F.lit(10)), F.lit("long")), mo.liquidation_price(d("50000"), F.lit(10), mo.maintenance_rate(F.lit(10)), F.lit("short")),
            mo.max_size(d("1000"), d("30000"), F.lit(10)), mo.margin_ratio(d("1"), d("3")), mo.margin_ratio(d("1"), d("0")))
    assert r[0] == Decimal("33.33333334")  # rounded up
    assert r[1] == Decimal("2.50000000")
    assert r[2] == Decimal("46250.00") and r[3] == Decimal("53750.00")
    assert r[4] == Decimal("0.333")  # rounded down
    assert r[5] == Decimal("0.3334") and r[6] == Decimal("1.0000")


@pytest.mark.parametrize("ratio,status", [(0.49, "healthy"), (0.5, "warning"), (0.7, "danger"), (0.9, "critical"), (1.0, "liquidation")])
def test_margin_status(spark, ratio, status):
    assert one(spark, mo.margin_status(F.lit(ratio)))[0] == status


def test_settlements(spark):
    ts = F.lit(datetime(2024, 1, 1, 9, 30)).cast("timestamp")
    r = one(spark, dt.prev_settlement(ts), dt.next_settlement(ts), dt.settlements_between(ts, F.lit(datetime(2024, 1, 2, 8, 0))), dt.prev_settlement(F.lit(datetime(2024, 1, 1, 8, 0))))
    assert r[0].hour == 8 and r[1].hour == 16 and [x.hour for x in r[2]] == [16, 0, 8] and r[3].hour == 8


def test_timeframes(spark):
    assert [one(spark, dt.timeframe_seconds(F.lit(t)))[0] for t in ("1m", "4h", "1d", "x")] == [60, 14400, 86400, None]


def test_normal(spark):
    r = one(spark, fm.norm_cdf(F.lit(1.96)), fm.norm_cdf(F.lit(-1.96)), fm.norm_ppf(F.lit(0.975)), fm.norm_ppf(F.lit(0.5)), fm.norm_ppf(F.lit(1.0)))
    assert r[0] == pytest.approx(0.975, abs=1e-4) and r[1] == pytest.approx(0.025, abs=1e-4) and r[2] == pytest.approx(1.96, abs=1e-3) and r[3] == 0 and r[4] is None
    assert fm.norm_ppf_value(0.95) == pytest.approx(1.645, abs=1e-3)


def test_missing_values(spark):
    r = one(spark, fm.finite(F.lit(float("nan"))), fm.finite(F.lit(float("-inf"))), fm.div(1, 0), fm.greater(F.lit(None).cast("double"), 1.0), fm.clip(F.lit(None).cast("double"), 0, 1), fm.fill(F.lit(float("inf"))))
    assert list(r) == [None, None, None, None, None, 0.0]


def test_corr_of_a_constant_is_missing(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x DOUBLE, y DOUBLE")
    assert d.agg(fm.corr("x", "y")).first()[0] is None


def test_cut_edges(spark):
    lab = lambda v: one(spark, fm.cut(F.lit(v), [0, 1, 2], ["a", "b"]))[0]
    assert [lab(v) for v in (0.0, 1.0, 1.5, 2.0, 2.5)] == ["a", "a", "b", "b", None]


@pytest.mark.parametrize("expr,biased", [("Ref($close, -1)", True), ("Ref($close, 5) / $close", False), ("Mean($close, -3)", True), ("$fwd_return", True), ("Mean($close, 20)", False)])
def test_audit(spark, expr, biased):
    assert tx.audit_expressions(spark.createDataFrame([(expr,)], "expr STRING")).first()["biased"] is biased


@pytest.mark.parametrize("expr,depth,ok", [("Mean(Std($close, 5), 3)", 2, True), ("Mean(($close", 2, False), (")(", 0, False), ("$close", 0, True)])
def test_brackets(spark, expr, depth, ok):
    r = tx.expression_complexity(spark.createDataFrame([(expr,)], "expr STRING")).first()
    assert r["max_depth"] == depth and r["balanced"] is ok


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, fv.cosine(v(1, 0), v(1, 1)), fv.cosine(v(0, 0), v(1, 1)), fv.dot(v(1, 2), v(3, 4)))
    assert r[0] == pytest.approx(0.70710678) and r[1] is None and r[2] == 11


@pytest.mark.parametrize("expr, lag, window", [
    ("Mean(Std($x, 5), -3)", False, True), ("Ref(Corr($a, $b, 5), -1)", True, False), ("Ref($x, Mean($y, -2))", False, True),
    ("Sum($x, 5) - Max($y, 3)", False, False), ("Other(Ref($x, 2), -1)", False, False), ("ref ( ($x + 1) , - 7 )", True, False),
    ("Ref($x, -1", False, False), (")Ref($x, -1)", True, False), ("Ref(-1)", False, False), ("", False, False)])
def test_audit_reads_nested_calls(spark, expr, lag, window):
    r = tx.audit_expressions(spark.createDataFrame([(expr,)], "expr STRING")).first()
    assert (r["negative_lag"], r["negative_window"]) == (lag, window)


@pytest.mark.parametrize("expr, ops, names", [
    ("Mean($close, 5) + Std ($open, 3)", ["Mean", "Std"], ["close", "open"]),
    ("mean($close) * _F(1) + 3(2)", [], ["close"]),
    ("Ref(Ref($a_1, 1), 2) / $a_1", ["Ref", "Ref"], ["a_1"]),
    ("$1x + $ + close$", [], []), ("", [], []), (None, None, None)])
def test_operators_and_fields_come_from_the_words(spark, expr, ops, names):
    r = spark.createDataFrame([(expr,)], "expr STRING").select(tx.operators(F.col("expr")).alias("o"), tx.fields(F.col("expr")).alias("f")).first()
    assert (r["o"], r["f"]) == (ops, names)


def test_indicator_aliases(spark):
    rows = [(1, "Use RSI, then the Moving-Average (20)!", "Mean($close, 20) / $close", 2, 1, "RSI", 0.5),
            (2, "relative strength index when oversold", "RSI($close, 14)", 1, 1, "", 1.0),
            (3, "strength of the index", "RSI($close, 14)", 0, 0, "", 1.0), (4, None, None, 0, 0, "", 1.0), (5, "", "", 0, 0, "", 1.0),
            (6, "volatility; VOLATILITY and momentums", "Sum(Std($close, 5), 3)", 1, 1, "", 1.0),
            (7, "atr of prices", "stdev($atr) + ATR", 1, 0, "ATR", 0.0)]
    d = spark.createDataFrame([r[:3] for r in rows], "id INT, hypothesis STRING, expr STRING")
    got = {r["id"]: tuple(r)[1:] for r in tx.indicator_aliases(d, "id").collect()}
    assert got == {r[0]: r[3:] for r in rows}
    assert tx.indicator_aliases(d.limit(0), "id").count() == 0


def test_every_catalogue_indicator_has_an_alias():
    from factorspark.factors.indicators import CATALOGUE
    stems = {k.replace("_UPPER", "").replace("_LOWER", "") for k in CATALOGUE}
    assert stems <= set(tx.INDICATOR_ALIASES), stems - set(tx.INDICATOR_ALIASES)
    assert set(tx.INDICATOR_ALIASES) == set(tx.INDICATOR_CALLS)
