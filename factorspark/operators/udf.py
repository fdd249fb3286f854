"""User functions: Python over one symbol's bars, rolling and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def python_factor(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], by: str = "symbol", ts: str = "ts", name: str = "factor") -> DataFrame:
    """Apply a Python factor to each symbol's bars (a bar series is bounded by the calendar).

    A result of another length fails the job; a series without any value gives missing values, at every length.
    """
    key_type = dict(df.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        out = pd.Series(np.asarray(fn(pdf.copy()), dtype=float))
        if len(out) != len(pdf):
            raise ValueError(f"factor returned {len(out)} values for {len(pdf)} rows")
        return pd.DataFrame({by: pdf[by].to_numpy(), ts: pdf[ts].to_numpy(), name: out.to_numpy()})

    d = df.groupBy(by).applyInPandas(run, f"{by} {key_type}, {ts} TIMESTAMP, {name} DOUBLE")
    return d.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def rolling_apply(roll, x: str, n: int, fn) -> Column:
    """Custom rolling function of the window's values as an array expression: ``fn(array, current) -> Column``."""
    return roll._full(n, fn(roll.values(x, n), F.col(x)), x)


def grouped_apply(fn: Callable[[pd.Series, pd.Series], float]):
    """A user aggregate of two columns per group as a vectorised UDF.

    The whole group reaches one Python worker, so it is for groups with a proven small size.
    """
    def agg(a: pd.Series, b: pd.Series) -> float:
        return float(fn(a, b))
    return F.pandas_udf(agg, "double")
