"""Explicit schemas of stored tables and of the given input tables."""

from __future__ import annotations

# Input tables whose time columns are read as instants (UTC).
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
              "o_orderpriority STRING",
}

# Stored market tables (section "data model" of the blueprint).
BARS = "symbol STRING, exchange STRING, ts TIMESTAMP, timeframe STRING, market_type STRING, open DOUBLE, high DOUBLE, " \
       "low DOUBLE, close DOUBLE, volume DOUBLE"
FUNDING = "symbol STRING, exchange STRING, ts TIMESTAMP, funding_rate DECIMAL(20,10), mark_price DOUBLE, index_price DOUBLE"
OPEN_INTEREST = "symbol STRING, exchange STRING, ts TIMESTAMP, open_interest DOUBLE, open_interest_value DOUBLE, contract_type STRING"
LS_RATIO = "symbol STRING, exchange STRING, ts TIMESTAMP, ratio_type STRING, long_ratio DOUBLE, short_ratio DOUBLE, long_short_ratio DOUBLE"
LIQUIDATIONS = "symbol STRING, exchange STRING, ts TIMESTAMP, side STRING, quantity DOUBLE, price DOUBLE, value_usd DOUBLE"
MARK_PRICES = "symbol STRING, exchange STRING, ts TIMESTAMP, mark_price DOUBLE, index_price DOUBLE, last_price DOUBLE, basis DOUBLE, basis_rate DOUBLE"
TAKER = "symbol STRING, exchange STRING, ts TIMESTAMP, timeframe STRING, buy_volume DOUBLE, sell_volume DOUBLE, buy_value DOUBLE, " \
        "sell_value DOUBLE, buy_sell_ratio DOUBLE, net_volume DOUBLE"
AGG_TRADES = "symbol STRING, exchange STRING, ts TIMESTAMP, agg_trade_id BIGINT, price DOUBLE, quantity DOUBLE, first_trade_id BIGINT, " \
             "last_trade_id BIGINT, is_buyer_maker BOOLEAN"
TICKS = "symbol STRING, exchange STRING, ts TIMESTAMP, trade_id BIGINT, price DOUBLE, quantity DOUBLE, quote_quantity DOUBLE, is_buyer_maker BOOLEAN"
BOOKS = "symbol STRING, exchange STRING, ts TIMESTAMP, bids ARRAY<STRUCT<price:DOUBLE, qty:DOUBLE>>, asks ARRAY<STRUCT<price:DOUBLE, qty:DOUBLE>>, " \
        "bid_depth DOUBLE, ask_depth DOUBLE, spread DOUBLE, mid_price DOUBLE"
FACTOR_VALUES = "factor_id STRING, symbol STRING, value DOUBLE, timeframe STRING, ts TIMESTAMP"
TRIALS = "trial BIGINT, factor_name STRING, family STRING, sharpe DOUBLE, ic DOUBLE, ir DOUBLE, threshold DOUBLE, passed BOOLEAN, " \
         "metadata MAP<STRING, STRING>, ts TIMESTAMP"
EVENTS = TABLES["events"]
