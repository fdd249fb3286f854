"""Registered queries against their SQL. By default one query of each family on the smallest tables; ``FULL=1`` runs all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
CORE = ["a01_bar_resample", "a06_rank_ic_by_date", "a08_ic_summary", "a18_long_short_returns", "a19_turnover", "a20_performance", "a33_trial_thresholds", "a37_cost_report", "a40_missing_times",
        "f_arr_levels", "f_money_margin", "j01_asof_backward", "j02_asof_forward", "j06_merge_market", "l01_kline_shape", "l03_rolling_balance", "l07_indicators", "l10_funding_factors", "l20_evaluate_library",
        "m04_ml_signal", "o06_head_tail", "p13_classify_failures", "p20_expression_complexity", "s09_landing_ticks", "s16_append_new", "t01_stream_bars", "t05_drawdown_monitor", "u_7_long_to_wide",
        "v01_knn", "w10_rolling_median_quantile", "w15_rolling_slope", "w23_normalizers", "w29_folds_purged", "w39_trades_from_positions", "w42_exit_hits", "w53_trial_budget"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("FULL") else CORE)
def test_query_matches_sql(spark, con, name):
    res = compare(entry.queries()[name](spark, SF), con, SQL[name])
    assert res in (None, "empty"), res


def test_entry_has_rows(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
