"""Fold plans as a table function: one plan per partition of a table of dates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"train": 0.6, "valid": 0.2, "window": 24, "step": 12, "n_splits": 5, "purge": 2, "embargo_pct": 0.01, "min_train": 0.1}


def fold_ranges(n: int, scheme: str, **kw) -> Iterator[tuple[int, str, int, int]]:
    """(fold, role, first, end) over ``n`` dates, for the schemes of ``folds.fold_table``."""
    o = DEFAULTS | kw
    if scheme == "sequential":
        a = math.floor(n * o["train"])
        b = min(a + math.floor(n * o["valid"]), n)
        yield from ((0, "train", 0, a), (0, "valid", a, b), (0, "test", b, n))
    elif scheme in ("rolling", "walk"):
        window, step = o["window"], o["step"]
        count = math.ceil((n - window) / step) if scheme == "rolling" else math.floor((n - window - 1) / step) + 1
        for f in range(max(count, 0)):
            s = f * step
            cut, end = (s + int(window * o["train"]), s + window) if scheme == "rolling" else (s + window, s + window + step)
            yield f, "train", s, min(cut, n)
            yield f, "test", min(cut, n), min(end, n)
    elif scheme in ("purged", "forward"):
        k, purge = o["n_splits"], o["purge"]
        gap = purge + math.floor(n * o["embargo_pct"])
        size = n // (k if scheme == "purged" else k + 1)
        for f in range(k):
            if scheme == "purged":
                t0, t1 = f * size, (f + 1) * size if f < k - 1 else n
                after, least = min(t1 + purge, n), max(1, math.floor(n * o["min_train"]))
            else:
                t0 = (f + 1) * size
                t1, least = min(t0 + size, n), 1
                after = n
            before = max(t0 - gap, 0)
            if before + n - after >= least:
                yield from ((f, "train", 0, before), (f, "purge", before, t0), (f, "test", t0, t1))
                if scheme == "purged":
                    yield from ((f, "purge", t1, after), (f, "train", after, n))
    else:
        raise ValueError(scheme)


class FoldPlan:
    """``fold_plan(TABLE(dates) PARTITION BY (key) ORDER BY (ts), scheme)``: (key, ts, fold, role) of each partition's dates.

    The table holds the partition's key and the date, in this order; repeated and NULL dates do not count. A partition holds its distinct
    dates, which the calendar bounds.
    """

    def __init__(self) -> None:
        self.key: str | None = None
        self.scheme = ""
        self.dates: list[datetime] = []

    def eval(self, row: Row, scheme: str) -> None:
        self.key, self.scheme = row[0], scheme
        if row[1] is not None and (not self.dates or self.dates[-1] != row[1]):
            self.dates.append(row[1])

    def terminate(self) -> Iterator[tuple[str | None, datetime, int, str]]:
        if self.dates:
            for fold, role, first, end in fold_ranges(len(self.dates), self.scheme):
                for ts in self.dates[first:end]:
                    yield self.key, ts, fold, role


def register_fold_plan(spark: SparkSession, key_type: str = "STRING", name: str = "fold_plan") -> None:
    """Make the table function known to SQL under ``name``."""
    spark.udtf.register(name, F.udtf(FoldPlan, returnType=f"key {key_type}, ts TIMESTAMP, fold BIGINT, role STRING"))


def plans_by(df: DataFrame, key: str, scheme: str, ts: str = "ts") -> DataFrame:
    """(key, ts, fold, role): each key's own dates cut into folds, however late it starts."""
    plan = F.udtf(FoldPlan, returnType=f"`{key}` {dict(df.dtypes)[key]}, `{ts}` TIMESTAMP, fold BIGINT, role STRING")
    return plan(df.select(key, ts).distinct().asTable().partitionBy(key).orderBy(ts), F.lit(scheme))
