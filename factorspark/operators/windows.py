"""Rolling-window Column builders over one series per key.

These run on *bars*. A bar table holds at most one row per (symbol, time bucket), so after the
map-side aggregation that makes bars no series is longer than the calendar has buckets, however
unevenly the ticks were spread; one series fits one task. Raw ticks are never windowed here: they are
aggregated first (``resample``) or go through the chunked scan in ``series``.

All builders share one (partition, order), so a select with hundreds of them costs one exchange and
one sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from factorspark.functions.math import corr, div, safe_div

RN = "_rn"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Roll:
    """Rolling builders bound to a partition key and an order (the last order column is unique)."""

    def __init__(self, by="symbol", order="ts"):
        self.by = [by] if isinstance(by, str) else list(by)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def all(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def cum(self):
        return self.all.rowsBetween(Window.unboundedPreceding, 0)

    def frame(self, n: int):
        return self.all.rowsBetween(-(n - 1), 0)

    def number(self, df: DataFrame) -> DataFrame:
        """Add the row number that slope, residual, weighted average and index builders read."""
        return df.withColumn(RN, F.row_number().over(self.all))

    def _full(self, n: int, value: Column, *inputs: Column, min_periods: int | None = None) -> Column:
        need = n if min_periods is None else min_periods
        ok = [F.count(_col(x)).over(self.frame(n)) >= need for x in inputs]
        return F.when(reduce(lambda a, b: a & b, ok), value)

    # one value back
    def ref(self, x, n: int) -> Column:
        if n < 0:
            raise ValueError("a negative lag reads the future; use lead in labels only")
        return F.lag(_col(x), n).over(self.all) if n else _col(x)

    def lead(self, x, n: int) -> Column:
        return F.lead(_col(x), n).over(self.all)

    def delta(self, x, n: int) -> Column:
        return _col(x) - self.ref(x, n)

    def pct_change(self, x, n: int = 1) -> Column:
        return div(_col(x), self.ref(x, n)) - 1

    # moments
    def mean(self, x, n, min_periods=None) -> Column:
        return self._full(n, F.avg(_col(x)).over(self.frame(n)), x, min_periods=min_periods)

    def sum(self, x, n, min_periods=None) -> Column:
        return self._full(n, F.sum(_col(x)).over(self.frame(n)), x, min_periods=min_periods)

    def count(self, x, n) -> Column:
        return F.count(_col(x)).over(self.frame(n))

    def std(self, x, n, min_periods=None) -> Column:
        need = n if min_periods is None else max(min_periods, 2)
        return self._full(n, F.stddev_samp(_col(x)).over(self.frame(n)), x, min_periods=need)

    def var(self, x, n) -> Column:
        return self._full(n, F.var_samp(_col(x)).over(self.frame(n)), x)

    def skew(self, x, n) -> Column:
        """Bias-corrected skew; NULL for a flat window."""
        f = self.frame(n)
        k = (n * (n - 1)) ** 0.5 / (n - 2)
        return self._full(n, F.when(F.var_pop(_col(x)).over(f) > 1e-18, F.skewness(_col(x)).over(f) * k), x)

    def kurt(self, x, n) -> Column:
        """Bias-corrected excess kurtosis; NULL for a flat window."""
        f = self.frame(n)
        g2 = F.kurtosis(_col(x)).over(f)
        adj = (g2 * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
        return self._full(n, F.when(F.var_pop(_col(x)).over(f) > 1e-18, adj), x)

    def zscore(self, x, n, eps: float = 1e-10, min_periods=None) -> Column:
        return safe_div(_col(x) - self.mean(x, n, min_periods), self.std(x, n, min_periods), eps)

    # order statistics
    def max(self, x, n, min_periods=None) -> Column:
        return self._full(n, F.max(_col(x)).over(self.frame(n)), x, min_periods=min_periods)

    def min(self, x, n, min_periods=None) -> Column:
        return self._full(n, F.min(_col(x)).over(self.frame(n)), x, min_periods=min_periods)

    def idxmax(self, x, n) -> Column:
        """1-based position of the window maximum, oldest first; the latest wins a tie."""
        best = F.max(F.when(_col(x).isNotNull(), F.struct(_col(x).alias("v"), F.col(RN).alias("i")))).over(self.frame(n))
        return self._full(n, (best["i"] - F.col(RN) + n).cast("double"), x)

    def idxmin(self, x, n) -> Column:
        best = F.min(F.when(_col(x).isNotNull(), F.struct(_col(x).alias("v"), (-F.col(RN)).alias("i")))).over(self.frame(n))
        return self._full(n, (-best["i"] - F.col(RN) + n).cast("double"), x)

    def quantile(self, x, n, q: float, min_periods=None) -> Column:
        return self._full(n, F.percentile(_col(x), F.lit(q)).over(self.frame(n)), x, min_periods=min_periods)

    def med(self, x, n) -> Column:
        return self.quantile(x, n, 0.5)

    def values(self, x, n) -> Column:
        """Non-missing window values as an array; a row holds up to n values while it is computed."""
        return F.collect_list(_col(x)).over(self.frame(n))

    def mad(self, x, n) -> Column:
        """Mean absolute deviation from the window mean."""
        m = F.avg(_col(x)).over(self.frame(n))
        dev = F.aggregate(F.transform(self.values(x, n), lambda v: F.abs(v - m)), F.lit(0.0), lambda a, v: a + v)
        return self._full(n, dev / n, x)

    def ts_rank(self, x, n) -> Column:
        """Share of the window at or below the current value."""
        a, cur = self.values(x, n), _col(x)
        return self._full(n, F.size(F.filter(a, lambda v: v <= cur)) / F.size(a), x)

    def rank_percentile(self, x, n) -> Column:
        a, cur = self.values(x, n), _col(x)
        below, equal = F.size(F.filter(a, lambda v: v < cur)), F.size(F.filter(a, lambda v: v == cur))
        return self._full(n, (below + equal * 0.5) / F.size(a) * 100, x)

    # regressions on the row number
    def slope(self, x, n) -> Column:
        return self._full(n, F.regr_slope(_col(x), F.col(RN)).over(self.frame(n)), x)

    def rsquare(self, x, n) -> Column:
        f = self.frame(n)
        return self._full(n, F.when(F.var_pop(_col(x)).over(f) > 1e-18, F.regr_r2(_col(x), F.col(RN)).over(f)), x)

    def resi(self, x, n) -> Column:
        f, rn = self.frame(n), F.col(RN)
        fit = F.regr_slope(_col(x), rn).over(f) * rn + F.regr_intercept(_col(x), rn).over(f)
        return self._full(n, _col(x) - fit, x)

    def wma(self, x, n) -> Column:
        """Weights 1..n, newest heaviest, from two window sums."""
        f, rn = self.frame(n), F.col(RN)
        s, sr = F.sum(_col(x)).over(f), F.sum(_col(x) * rn).over(f)
        return self._full(n, (sr - (rn - n) * s) / (n * (n + 1) / 2), x)

    def ema(self, x, n: int) -> Column:
        """Exponential average over all earlier rows, alpha = 2/(n+1), normalised weights.

        A missing value has no weight of its own but ages the rows before it, and gets the average of the last row that has one,
        however long ago. Both sums are carried from row to row, so no gap and no length of the history loses or overflows them.
        """
        if n == 1:
            return self.ffill(x)
        return InternalFunction.ewm(_col(x).cast("double"), 2.0 / (n + 1), False).over(self.all)

    # two inputs
    def corr(self, x, y, n) -> Column:
        return self._full(n, corr(x, y, self.frame(n)), x, y)

    def cov(self, x, y, n) -> Column:
        return self._full(n, F.covar_samp(_col(x), _col(y)).over(self.frame(n)), x, y)

    # running
    def cum_sum(self, x) -> Column:
        return F.sum(_col(x)).over(self.cum)

    def cum_max(self, x) -> Column:
        return F.max(_col(x)).over(self.cum)

    def ffill(self, x) -> Column:
        return F.last(_col(x), ignorenulls=True).over(self.cum)

    def equity(self, r) -> Column:
        """Compounded growth of a return column; missing returns count as zero."""
        r = F.coalesce(_col(r), F.lit(0.0))
        return F.exp(F.sum(F.ln(F.when(r > -1, r + 1))).over(self.cum))


def with_drawdown(df: DataFrame, equity: str = "equity", roll: Roll | None = None) -> DataFrame:
    """Running peak, drawdown as a positive fraction, and rows since the last peak."""
    roll = roll or Roll()
    df = df.withColumn("peak", roll.cum_max(equity))
    df = df.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col(equity)) / F.col("peak")))
    under = (F.col(equity) < F.col("peak")).cast("int")
    df = df.withColumn("_spell", F.sum(1 - under).over(roll.cum)).withColumn("_under", under)
    spell = Window.partitionBy(*roll.by, "_spell").orderBy(*roll.order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("dd_length", F.sum("_under").over(spell)).drop("_spell", "_under")


def with_streak(df: DataFrame, cond: Column, name: str = "streak", roll: Roll | None = None) -> DataFrame:
    """Length of the current run of true values of ``cond``, 0 outside a run."""
    roll = roll or Roll()
    hit = F.coalesce(cond, F.lit(False)).cast("int")
    df = df.withColumn("_hit", hit).withColumn("_run", F.sum(1 - F.col("_hit")).over(roll.cum))
    run = Window.partitionBy(*roll.by, "_run").orderBy(*roll.order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("_hit").over(run)).drop("_hit", "_run")


def with_island(df: DataFrame, x: str, name: str = "island", roll: Roll | None = None) -> DataFrame:
    """Number the stretches of equal consecutive values."""
    roll = roll or Roll()
    changed = F.when(F.lag(F.col(x)).over(roll.all).eqNullSafe(F.col(x)) &
                     F.lag(F.lit(1)).over(roll.all).isNotNull(), 0).otherwise(1)
    return (df.withColumn("_chg", changed)
            .withColumn(name, F.sum("_chg").over(roll.cum)).drop("_chg"))
