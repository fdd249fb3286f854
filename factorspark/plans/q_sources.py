"""Source, sink, book, vector, model and user-function queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.factors import register_factor
from factorspark.factors.base import FACTORS, compute_factors
from factorspark.functions import book as bk
from factorspark.functions import vectors as fv
from factorspark.functions.math import div
from factorspark.operators import models as ml
from factorspark.operators import udf
from factorspark.operators import vectors as ve
from factorspark.plans import sqltext as q
from factorspark.plans.inputs import CTE, R
from factorspark.plans.registry import query
from factorspark.session import scratch_path
from factorspark.sources import bars as sb
from factorspark.sources import database as db
from factorspark.sources import landing as la
from factorspark.sources import store as st

c = F.col


@query("s01_read_bars_csv", "SELECT symbol, ts, open, high, low, close, volume FROM th", "th", "open high low close volume @ts")
def _(t):
    path = scratch_path(t.spark, "csv")
    d = t.th.select(c("symbol").alias("Symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), c("open").alias("OPEN"), c("high").alias("High"), c("low").alias("Low"), c("close").alias("Close"), c("volume").alias("Volume"))
    d.write.option("header", True).csv(path)
    return sb.read_bars_csv(t.spark, path)


@query("s02_read_bars_parquet", "SELECT symbol, ts, close FROM ud", "ud", "close @ts")
def _(t):
    path = scratch_path(t.spark, "bars")
    t.ud.write.parquet(path)
    return sb.read_bars_parquet(t.spark, path).select("symbol", "ts", "close")


def _stored(t, d, name):
    """A stored market table, here as Parquet; a database table goes through the same scan."""
    path = scratch_path(t.spark, name)
    d.withColumnRenamed("ts", "timestamp").withColumns({"exchange": F.lit("binance"), "timeframe": F.lit("1h"), "market_type": F.lit("futures")}).write.parquet(path)
    return t.spark.read.parquet(path)


_RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"


@query("s03_read_bars", f"SELECT symbol, ts, open, high, low, close, volume FROM th WHERE symbol = 'view' AND {_RANGE}", "th", "open high low close volume @ts")
def _(t):
    return db.read_bars_jdbc(_stored(t, t.th, "ohlcv"), "2024-01-05", "2024-01-20", "view", "1h", "binance", "futures")


@query("s04_read_funding", f"SELECT symbol, ts, funding_rate FROM fund8 WHERE {_RANGE}", "fund8", "funding_rate @ts")
def _(t):
    return db.read_funding(_stored(t, t.fund8, "funding"), "2024-01-05", "2024-01-20")


@query("s05_read_open_interest", "SELECT symbol, ts, open_interest FROM oi WHERE symbol = 'click'", "oi", "open_interest @ts")
def _(t):
    return db.read_open_interest(_stored(t, t.oi, "oi"), symbol="click")


@query("s06_read_ls_ratio", f"SELECT symbol, ts, 'global' AS ratio_type, long_short_ratio FROM ls WHERE {_RANGE}", "ls", "long_short_ratio @ts")
def _(t):
    both = t.ls.withColumn("ratio_type", F.explode(F.array(F.lit("global"), F.lit("top"))))
    return db.read_ls_ratio(_stored(t, both, "ls"), "2024-01-05", "2024-01-20", ratio_type="global")


@query("s07_read_liquidations",
       f"""SELECT symbol, ts, side, quantity, price, value_usd, CASE WHEN side = 'sell' THEN value_usd ELSE 0 END AS liquidation_long, CASE WHEN side = 'buy' THEN value_usd ELSE 0 END AS liquidation_short
       FROM liq WHERE {_RANGE}""", "liq", "quantity price value_usd liquidation_long liquidation_short @ts")
def _(t):
    return db.read_liquidations(_stored(t, t.liq, "liq"), "2024-01-05", "2024-01-20")


@query("s08_json_ledger", "SELECT trial, family, sharpe, sharpe >= 1.2 AS passed, CAST(trial AS VARCHAR) AS note FROM trials", "trials", "sharpe")
def _(t):
    path = scratch_path(t.spark, "ledger")
    d = t.trials.select("trial", "family", "sharpe", (c("sharpe") >= 1.2).alias("passed"), F.create_map(F.lit("note"), c("trial").cast("string")).alias("metadata"))
    st.write_trials_json(d, path)
    return st.read_trials_json(t.spark, path).select("trial", "family", "sharpe", "passed", c("metadata")["note"].alias("note"))


def _payload(t, kind):
    e = t.events.withColumn("ms", F.unix_millis(F.date_trunc("second", "ts"))).withColumn("symbol", c("event_type"))
    s = lambda x: x.cast("string")
    if kind == "ticks":
        item = F.struct(c("event_id").alias("id"), s(c("value")).alias("price"), s(F.lit(2.0)).alias("qty"), c("ms").alias("time"), (c("event_id") % 2 == 0).alias("isBuyerMaker"))
    elif kind == "agg_trades":
        item = F.struct(c("event_id").alias("a"), s(c("value")).alias("p"), s(F.lit(2.0)).alias("q"), c("event_id").alias("f"), (c("event_id") + 1).alias("l"), c("ms").alias("T"), (c("event_id") % 2 == 0).alias("m"))
    elif kind == "funding":
        item = F.struct(c("ms").alias("fundingTime"), s(c("value") / 10000).alias("fundingRate"), s(c("value")).alias("markPrice"))
    else:
        item = F.struct(c("ms").alias("time"), F.when(c("event_id") % 2 == 0, "SELL").otherwise("BUY").alias("side"), s(c("value")).alias("price"), s(F.when(c("event_id") % 3 == 0, 0.0).otherwise(c("value"))).alias("avgPrice"),
                        s(F.lit(2.0)).alias("origQty"), s(F.lit(0.0)).alias("executedQty"))
    # one payload per event, as a page of one
    return e.select("symbol", F.to_json(F.array(item)).alias("payload"))


@query("s09_landing_ticks",
       "SELECT event_type AS symbol, date_trunc('second', ts) AS ts, event_id AS trade_id, value AS price, 2.0 AS quantity, value * 2 AS quote_quantity, event_id % 2 = 0 AS is_buyer_maker FROM events", "", "price quantity quote_quantity @ts")
def _(t):
    return la.parse_landing(_payload(t, "ticks"), "ticks")


@query("s09_landing_agg_trades",
       "SELECT event_type AS symbol, date_trunc('second', ts) AS ts, event_id AS agg_trade_id, value AS price, 2.0 AS quantity, event_id AS first_trade_id, event_id + 1 AS last_trade_id, event_id % 2 = 0 AS is_buyer_maker FROM events", "", "price quantity @ts")
def _(t):
    return la.parse_landing(_payload(t, "agg_trades"), "agg_trades")


@query("s09_landing_funding", "SELECT event_type AS symbol, date_trunc('second', ts) AS ts, value / 10000 AS funding_rate, value AS mark_price FROM events", "", "funding_rate mark_price @ts")
def _(t):
    return la.parse_landing(_payload(t, "funding"), "funding")


@query("s09_landing_liquidations",
       "SELECT event_type AS symbol, date_trunc('second', ts) AS ts, CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, 2.0 AS quantity, value AS price, value * 2 AS value_usd FROM events", "", "quantity price value_usd @ts")
def _(t):
    return la.parse_landing(_payload(t, "liquidations"), "liquidations")


@query("s09_landing_bars", "SELECT symbol, ts, open, high, low, close, volume FROM th", "th", "open high low close volume @ts")
def _(t):
    d = t.th.select("symbol", F.to_json(F.array(F.array(F.unix_millis("ts").cast("double"), "open", "high", "low", "close", "volume"))).alias("payload"))
    return la.parse_landing(d, "bars")


# levels per order: returned lines bid, accepted lines ask
CTE["bk"] = """lv AS (SELECT l_orderkey, l_returnflag AS f, l_extendedprice / l_quantity AS p, l_quantity AS q FROM lineitem WHERE l_returnflag IN ('R', 'A')),
bk AS (SELECT l_orderkey, list({'price': p, 'qty': q} ORDER BY p DESC, q DESC) FILTER (f = 'R') AS bids, list({'price': p, 'qty': q} ORDER BY p, q) FILTER (f = 'A') AS asks FROM lv GROUP BY 1
    HAVING count(*) FILTER (f = 'R') > 0 AND count(*) FILTER (f = 'A') > 0)"""


def books(t):
    """Level arrays per order; an order has at most seven lines."""
    lv = F.struct((c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").alias("qty"))
    g = (t.lineitem.filter(c("l_returnflag").isin("R", "A")).groupBy("l_orderkey")
         .agg(F.collect_list(F.when(c("l_returnflag") == "R", lv)).alias("b"), F.collect_list(F.when(c("l_returnflag") == "A", lv)).alias("a")))
    g = g.filter((F.size("a") > 0) & (F.size("b") > 0))
    return g.select("l_orderkey", bk.sort_levels(c("b"), "bid").alias("bids"), bk.sort_levels(c("a"), "ask").alias("asks"))


@query("s09_landing_depth",
       """SELECT l_orderkey AS symbol, list_sum(list_transform(bids, lambda x: x.qty)) AS bid_depth, list_sum(list_transform(asks, lambda x: x.qty)) AS ask_depth, asks[1].price - bids[1].price AS spread,
       (asks[1].price + bids[1].price) / 2 AS mid_price FROM bk""", "bk", "bid_depth ask_depth spread mid_price", 4)
def _(t):
    pair = lambda side: F.transform(side, lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string")))
    d = books(t).select(c("l_orderkey").alias("symbol"), F.lit(None).cast("timestamp").alias("ts"), F.to_json(F.struct(F.lit(1).cast("bigint").alias("lastUpdateId"), pair("bids").alias("bids"), pair("asks").alias("asks"))).alias("payload"))
    return la.parse_landing(d, "depth").select("symbol", "bid_depth", "ask_depth", "spread", "mid_price")


@query("s10_normalize_exchange",
       "SELECT symbol, ts, open, high, low, close, volume, close AS mark_price, 'okx' AS source FROM th UNION ALL SELECT symbol, ts, open, high, low, close, volume, NULL, 'bybit' FROM th", "th", "open high low close volume mark_price @ts")
def _(t):
    okx = t.th.select("ts", c("symbol").alias("instId"), c("open").alias("o"), c("high").alias("h"), c("low").alias("l"), c("close").alias("c"), c("volume").cast("string").alias("vol"), c("close").alias("markPx"))
    byb = t.th.select(c("ts").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume", (c("volume") * c("close")).alias("turnover"))
    a = la.normalize_exchange(okx).withColumn("source", F.lit("okx"))
    b = la.normalize_exchange(byb).withColumn("source", F.lit("bybit"))
    return a.unionByName(b, allowMissingColumns=True).drop("quote_volume")


@query("s11_detect_exchange", "SELECT 'okx' AS exchange, count(*) AS n FROM th", "th")
def _(t):
    okx = t.th.select("ts", c("symbol").alias("instId"), c("open").alias("o"), c("close").alias("c"))
    return okx.agg(F.count("*").alias("n")).withColumn("exchange", F.lit(la.detect_exchange(okx)))


def _values(t, path):
    d = t.fl.select(c("name").alias("factor_id"), c("symbol").cast("string").alias("symbol"), "value", F.lit("1d").alias("timeframe"), "ts")
    st.write_factor_values(d, path)


@query("s12_write_factor_values", "SELECT name AS factor_id, count(*) AS n, sum(value) AS total FROM fl WHERE value IS NOT NULL GROUP BY 1", "ud fp fl", "total")
def _(t):
    path = scratch_path(t.spark, "values")
    _values(t, path)
    return t.spark.read.parquet(path).groupBy("factor_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("s13_read_factor_values",
       "SELECT CAST(symbol AS VARCHAR) AS symbol, ts, value FROM fl WHERE name = 'range' AND value IS NOT NULL AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, CAST(symbol AS VARCHAR) LIMIT 50", "ud fp fl", "value @ts")
def _(t):
    path = scratch_path(t.spark, "values")
    _values(t, path)
    return st.read_factor_values(t.spark, path, "range", end="2024-01-20", limit=50).select("symbol", "ts", "value")


@query("s14_drop_factor", "SELECT name AS factor_id, count(*) AS n FROM fl WHERE value IS NOT NULL AND name <> 'volume' GROUP BY 1", "ud fp fl")
def _(t):
    path = scratch_path(t.spark, "values")
    _values(t, path)
    st.drop_factor(t.spark, path, "volume")
    return t.spark.read.schema("symbol STRING, value DOUBLE, factor_id STRING").parquet(path).groupBy("factor_id").agg(F.count("*").alias("n"))


@query("s15_export_field_store",
       "SELECT 'close' AS field, symbol, count(*) AS n, min(ts) AS start, max(ts) AS end_ts, sum(CAST(CAST(close AS FLOAT) AS DOUBLE)) AS total, (SELECT count(DISTINCT ts) FROM th) AS n_calendar FROM th GROUP BY symbol", "th", "total @start @end_ts", 3)
def _(t):
    path = scratch_path(t.spark, "fields")
    st.export_field_store(t.th, path, ["open", "close"], 4)
    f = t.spark.read.parquet(f"{path}/features").filter("field = 'close'").groupBy("field", "symbol").agg(F.count("*").alias("n"), F.sum(c("value").cast("double")).alias("total"))
    i = t.spark.read.parquet(f"{path}/instruments").withColumnRenamed("end", "end_ts")
    n = t.spark.read.parquet(f"{path}/calendar").agg(F.count("*").alias("n_calendar"))  # one row
    return f.join(i, "symbol").join(F.broadcast(n))


@query("s16_append_new", "SELECT event_id, value FROM events WHERE event_type IN ('purchase', 'error')", "", "value")
def _(t):
    e = t.events.select("event_id", "event_type", "value")
    new = e.filter(c("event_type").isin("view", "purchase", "error"))
    return st.append_new(e.filter(c("event_type").isin("click", "view", "signup")), new.unionByName(new), ["event_id"]).select("event_id", "value")


@query("s17_upsert", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", "", "value")
def _(t):
    e = t.events.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("v"))
    stored = c("event_type").isin("click", "view")
    return st.upsert(e.filter(stored), e.filter(~stored), ["user_id"], "v").select("user_id", "value")


# --- books
@query("f_book_quotes",
       """SELECT symbol, ts, (low + high) / 2 AS mid, high - low AS spread, (high - low) / NULLIF((low + high) / 2, 0) * 100 AS spread_pct, (high - low) / NULLIF((low + high) / 2, 0) * 10000 AS spread_bps,
       (open - close) / NULLIF(open + close, 0) AS imbalance, (low * close + high * open) / NULLIF(open + close, 0) AS micro, abs(close - (low + high) / 2) * 2 AS effective FROM th""", "th",
       "mid spread spread_pct spread_bps imbalance micro effective @ts")
def _(t):
    b, a, bs, az = c("low"), c("high"), c("open"), c("close")
    return t.th.select("symbol", "ts", bk.mid(b, a).alias("mid"), bk.spread(b, a).alias("spread"), bk.spread(b, a, "percent").alias("spread_pct"), bk.spread(b, a, "bps").alias("spread_bps"),
                       bk.imbalance(bs, az).alias("imbalance"), bk.microprice(b, a, bs, az).alias("micro"), bk.effective_spread(az, b, a).alias("effective"))


@query("f_arr_levels",
       """SELECT l_orderkey, bids[1].price AS best_bid, asks[1].price AS best_ask, list_sum(list_transform(bids[1:2], lambda x: x.qty)) AS bid2, list_sum(list_transform(asks[1:2], lambda x: x.qty)) AS ask2,
       list_sum(list_transform(bids[1:2], lambda x: x.price * x.qty)) / list_sum(list_transform(bids[1:2], lambda x: x.qty)) AS bid_vwap,
       (list_sum(list_transform(bids[1:2], lambda x: x.qty)) - list_sum(list_transform(asks[1:2], lambda x: x.qty))) / (list_sum(list_transform(bids[1:2], lambda x: x.qty)) + list_sum(list_transform(asks[1:2], lambda x: x.qty))) AS imbalance FROM bk""",
       "bk", "best_bid best_ask bid2 ask2 bid_vwap imbalance")
def _(t):
    b, a = c("bids"), c("asks")
    return books(t).select("l_orderkey", bk.best(b).alias("best_bid"), bk.best(a).alias("best_ask"), bk.depth_sum(b, 2).alias("bid2"), bk.depth_sum(a, 2).alias("ask2"), bk.depth_vwap(b, 2).alias("bid_vwap"),
                           bk.depth_imbalance(b, a, 2).alias("imbalance"))


@query("f_basis",
       f"""SELECT symbol, ts, mark_price - index_price AS basis, (mark_price - index_price) / NULLIF(index_price, 0) * 100 AS basis_pct, (mark_price - index_price) / NULLIF(index_price, 0) * 1095 AS basis_ann,
       open_interest - {q.lag('open_interest')} AS oi_chg, open_interest / {q.lag('open_interest')} - 1 AS oi_pct, open_interest * mark_price AS oi_value FROM drv""", "th drv", "basis basis_pct basis_ann oi_chg oi_pct oi_value @ts")
def _(t):
    m, i = c("mark_price"), c("index_price")
    return t.drv.select("symbol", "ts", bk.basis(m, i).alias("basis"), bk.basis_pct(m, i).alias("basis_pct"), bk.basis_annualized(m, i).alias("basis_ann"), R.delta("open_interest", 1).alias("oi_chg"),
                        R.pct_change("open_interest", 1).alias("oi_pct"), (c("open_interest") * m).alias("oi_value"))


# --- vectors
CTE["cen"] = """pe AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
cen AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(v) AS m FROM pe GROUP BY 1, 2) GROUP BY 1),
sims AS (SELECT query_id, vec_id, label, list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM cen, embeddings)"""


def _cen(t):
    return ve.centroids(t.embeddings.select("label", "embedding"), "label").withColumnRenamed("label", "query_id")


@query("f_vec_functions",
       """SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q) AS dot, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm,
       list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS cosine FROM embeddings JOIN cen ON label = query_id""", "cen", "dot norm cosine")
def _(t):
    d = t.embeddings.join(_cen(t).select(c("query_id").alias("label"), c("embedding").alias("q")), "label")
    e, v = c("embedding"), c("q")
    return d.select("vec_id", "label", fv.dot(e, v).alias("dot"), fv.norm(e).alias("norm"), fv.cosine(e, v).alias("cosine"))


@query("v01_knn", "SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims) WHERE r <= 5", "cen", "score")
def _(t):
    return ve.knn(_cen(t), t.embeddings, 5)


@query("v01_knn_family", "SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims WHERE label = 3 AND score >= 0.1) WHERE r <= 5", "cen", "score")
def _(t):
    return ve.knn(_cen(t), t.embeddings, 5, 0.1, family=3)


# every stored vector whose id is divisible by 20 against all, itself included
CTE["own"] = """own AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / NULLIF(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


def _asked(t):
    return t.embeddings.filter(c("vec_id") % 20 == 0).select(c("vec_id").alias("query_id"), "embedding")


@query("v01_knn_blocked", "SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM own) WHERE r <= 10", "own", "score")
def _(t):
    return ve.blocked_knn(_asked(t), t.embeddings, 10)


@query("v01_knn_index")
def _(t):
    index = ve.VectorIndex(t.embeddings.select("vec_id", "embedding"))
    return index.search(_asked(t), 10, index.probes_for(_asked(t), 10, 0.95))


# searching every cell is the exact answer
@query("v02_duplicates_index", "SELECT query_id, vec_id, score FROM own WHERE score >= 0.3 AND query_id <> vec_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1", "own", "score")
def _(t):
    index = ve.VectorIndex(t.embeddings.select("vec_id", "embedding"))
    found = index.search(_asked(t), 2, index.cells, 0.3).filter(c("query_id") != c("vec_id"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("_r", best).filter(c("_r") == 1).select("query_id", "vec_id", "score")


@query("v03_similarity_all", "SELECT query_id AS a, vec_id AS b, score FROM own WHERE vec_id % 20 = 0", "own", "score")
def _(t):
    return ve.similarity_matrix(_asked(t), id_col="query_id")


@query("v02_near_duplicates", "SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims) WHERE r = 1 AND score >= 0.25", "cen", "score")
def _(t):
    return ve.near_duplicates(_cen(t), t.embeddings, 0.25)


@query("v03_similarity_matrix", "SELECT a.query_id AS a, b.query_id AS b, list_dot_product(a.q, b.q) / sqrt(list_dot_product(a.q, a.q) * list_dot_product(b.q, b.q)) AS score FROM cen a, cen b", "cen", "score")
def _(t):
    return ve.similarity_matrix(_cen(t), id_col="query_id")


@query("v04_by_family", "SELECT vec_id, label FROM embeddings WHERE label = 4 ORDER BY vec_id LIMIT 25")
def _(t):
    return ve.by_family(t.embeddings.select("vec_id", "label"), 4, 25)


@query("v05_kmeans")
def _(t):
    return ve.kmeans(t.embeddings, 10)


@query("v06_best_k")
def _(t):
    k, cost = ve.best_k(t.embeddings, 6)
    rows = [(i + 1, x, i + 1 == k) for i, x in enumerate(cost)]
    return t.spark.createDataFrame(rows, "k INT, cost DOUBLE, chosen BOOLEAN")


@query("v07_cluster_summary", "SELECT label, count(*) AS size, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1")
def _(t):
    return ve.cluster_summary(t.embeddings, "label")


@query("v08_bisecting")
def _(t):
    return ve.bisecting(t.embeddings, 8)


# --- models
_X = ["factor", "factor2", "factor3"]


@query("m02_gbt")
def _(t):
    _, pred, _ = ml.fit_gbt(t.fp.select("symbol", "ts", *_X, "fwd"), _X, trees=5, depth=3)
    return ml.evaluate(pred, "fwd")


@query("m03_ensemble")
def _(t):
    return ml.evaluate(ml.fit_ensemble(t.fp.select("symbol", "ts", *_X, "fwd"), _X), "fwd")


@query("m05_grid_search")
def _(t):
    return ml.grid_search(t.fp.select("symbol", "ts", *_X, "fwd"), _X, {"maxDepth": [2, 3], "maxIter": [3]})


@query("m05_model_search")
def _(t):
    from pyspark.ml.regression import LinearRegression
    space = {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}
    return ml.model_search(t.fp.select("symbol", "ts", *_X, "fwd"), _X, space, LinearRegression(), metric="sharpe", n=6)


# --- user functions
if "USER_GAP" not in FACTORS:
    @register_factor("USER_GAP", "user", ("open", "close"))
    def _gap(r):
        """Open against the previous close."""
        return div(c("open"), r.ref("close", 1)) - 1


@query("u01_register_factor", f"SELECT symbol, ts, open / {q.lag('close')} - 1 AS USER_GAP FROM th", "th", "USER_GAP @ts")
def _(t):
    return compute_factors(t.th, ["USER_GAP"])


@query("u02_python_factor", f"SELECT symbol, ts, avg(close) OVER {q.w(5)} - {q.lag('close')} AS factor FROM th", "th", "factor @ts")
def _(t):
    def f(pdf: pd.DataFrame) -> pd.Series:
        return pdf["close"].rolling(5, min_periods=1).mean() - pdf["close"].shift(1)
    return udf.python_factor(t.th.select("symbol", "ts", "close"), f)


@query("u03_rolling_apply", f"SELECT symbol, ts, CASE WHEN len(a) = 10 THEN list_max(a) - list_min(a) END AS spread FROM (SELECT symbol, ts, list(close) OVER {q.w(10)} AS a FROM th)", "th", "spread @ts")
def _(t):
    return t.th.select("symbol", "ts", udf.rolling_apply(R, "close", 10, lambda a, x: F.array_max(a) - F.array_min(a)).alias("spread"))


@query("u04_grouped_apply", "SELECT symbol, sum(abs(close - open)) / sum(close) AS v FROM th GROUP BY 1", "th", "v")
def _(t):
    agg = udf.grouped_apply(lambda a, b: (a - b).abs().sum() / a.sum())
    return t.th.groupBy("symbol").agg(agg("close", "open").alias("v"))
