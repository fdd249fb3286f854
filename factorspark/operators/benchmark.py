"""Evaluation of a whole factor library: wide factors in column blocks, one ranking job, summary and ledger rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.factors.base import CHUNK, FACTORS, SETS, compute_factors
from factorspark.functions.math import div
from factorspark.operators import scoring as sc
from factorspark.operators.rank_moments import rank_moments
from factorspark.operators.windows import Roll
from factorspark.session import scratch_path

# Factor columns computed and written by one job: two selects' worth of windows over one exchange and one sort.
BLOCK = 2 * CHUNK
IC_THRESHOLD = 0.03


def library_panel(bars: DataFrame, names: list[str] | None = None, set_name: str = "all", horizon: int = 1, price: str = "close", keys=("symbol", "ts"),
                  digits: int | None = None, block: int = BLOCK, own: str | None = None) -> DataFrame:
    """Long panel (symbol, ts, fwd, name, value) of every factor of the list that the bars allow, without missing values.

    Factors are computed ``block`` columns at a time; each block is one exchange and one sort over the bars and is written once to the
    shared folder, so that the ranking, which reads its input several times, never computes a window twice. With ``digits`` values are
    rounded, so that sums taken in another order count as ties. With ``own`` every row also has that factor's value of its bar, as ``own``.
    """
    spark = bars.sparkSession
    roll = Roll(*keys)
    pool = list(names) if names is not None else (list(FACTORS) if set_name == "all" else list(SETS[set_name]))
    have = set(bars.columns)
    pool = [n for n in dict.fromkeys(pool) if n in FACTORS and set(FACTORS[n].inputs) <= have]
    if not pool:
        raise ValueError("none of the factors can be computed on these bars")
    if own is not None and own not in pool:
        raise ValueError(f"factor {own} cannot be computed on these bars")
    need = sorted({c for n in pool for c in FACTORS[n].inputs} | {price})
    base = bars.select(*keys, *need, (div(roll.lead(price, horizon), F.col(price)) - 1).alias("fwd"))
    if len(pool) > block:
        base = _written(base, "library-bars")
    parts = []
    for i in range(0, len(pool), block):
        names = pool[i:i + block]
        extra = own is not None and own not in names
        wide = _written(compute_factors(base, [*names, *([own] if extra else [])], keys=keys, roll=roll, keep=("fwd",)), "library-block")
        values = [c for c in wide.columns if c not in (*keys, "fwd") and not (extra and c == own)]
        beside = ["fwd"] if own is None else ["fwd", "own"]
        wide = wide if own is None else wide.withColumn("own", F.col(own))
        parts.append(wide.unpivot([*keys, *beside], values, "name", "value"))
    long = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())
    rounded = ["value"] if own is None else ["value", "own"]
    return long.withColumns({c: F.round(c, digits) for c in rounded}) if digits is not None else long


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def benchmark_run(evaluation: DataFrame, threshold: float = IC_THRESHOLD, top: int = 10) -> DataFrame:
    """One row: factors, passed, mean / median / largest |IC|, mean IR and Sharpe, pass rate, the ``top`` names by |IC|.

    ``evaluation`` has one row per factor name. A factor without IR or Sharpe counts as 0 there; without factors the means are NULL.
    """
    ic = F.abs(F.coalesce("ic_mean", F.lit(0.0)))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "name"))))
    return evaluation.agg(
        F.count("*").alias("total"), F.count_if(ic >= threshold).alias("passed"), F.avg(ic).alias("mean_ic"), F.percentile(ic, F.lit(0.5)).alias("median_ic"),
        F.max(ic).alias("max_ic"), F.avg(F.coalesce("ir", F.lit(0.0))).alias("mean_ir"), F.avg(F.coalesce("sharpe", F.lit(0.0))).alias("mean_sharpe"),
        F.avg((ic >= threshold).cast("double")).alias("pass_rate"), F.array_join(F.transform(best, lambda e: e["name"]), ",").alias("top"))


def ledger_rows(evaluation: DataFrame, run_id: str, family: str = "benchmark", threshold: float = IC_THRESHOLD) -> DataFrame:
    """Ledger rows of a run, one per factor. The trial id is a hash of run and factor, so a repeated append adds nothing."""
    return evaluation.select(F.sha2(F.concat_ws("|", F.lit(run_id), F.lit(family), "name"), 256).alias("trial"), F.lit(run_id).alias("run_id"), F.lit(family).alias("family"),
                             F.col("name").alias("factor"), "sharpe", "ic_mean", "ir", (F.abs("ic_mean") >= threshold).alias("passed"), F.lit(threshold).alias("ic_threshold"))


def append_ledger(rows: DataFrame, path: str) -> int:
    """Append the trials that the ledger does not hold yet; returns how many. Runs have folders of their own, so an append reads one run."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        runs = [r[0] for r in rows.select("run_id").distinct().limit(2).collect()]
        known = spark.read.schema(rows.schema).parquet(path)
        known = known.filter(F.col("run_id") == runs[0]) if len(runs) == 1 else known
        rows = rows.join(known.select("trial"), "trial", "left_anti")
    rows = _written(rows.dropDuplicates(["trial"]), "ledger-rows")
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("run_id").parquet(path)
    return n


def benchmark_factor(evaluation: DataFrame, panel: DataFrame, name: str, novelty: float = 0.7, by=("symbol", "ts"), min_n: int = 20) -> DataFrame:
    """One row: the factor's IC, IR and Sharpe, the means of all others, improvement in |IC|, rank by |IC|, largest absolute rank correlation with
    any other factor over the rows that have both (at least ``min_n``), its name, and whether it is novel.

    A panel with the column ``own`` (``library_panel``) has the factor's value on every row; otherwise its values meet the panel in one equi join.
    """
    pairs = panel.filter(F.col("name") != name)
    if "own" in panel.columns:
        for k in by:
            pairs = pairs.filter(F.col(k).isNotNull())
        pairs = pairs.select("name", F.col("own").alias("_own"), "value")
    else:
        own = panel.filter(F.col("name") == name).select(*by, F.col("value").alias("_own"))
        pairs = pairs.select("name", *by, "value").join(own, list(by))
    corr = rank_moments(pairs, ["name"], "_own", "value").filter((F.col("n") >= min_n) & F.col("rank_ic").isNotNull())
    size = F.round(F.abs("rank_ic"), 9)
    closest = corr.agg(F.max(size).alias("max_corr"), F.max_by("name", F.struct(size, "name")).alias("closest"))
    others = evaluation.filter(F.col("name") != name).agg(F.avg("ic_mean").alias("lib_ic"), F.avg("ir").alias("lib_ir"), F.avg("sharpe").alias("lib_sharpe"))
    d = evaluation.filter(F.col("name") == name).join(F.broadcast(others)).join(F.broadcast(closest))  # one row each
    return d.select(F.col("ic_mean").alias("ic"), "ir", "sharpe", "lib_ic", "lib_ir", "lib_sharpe", (F.abs("ic_mean") - F.abs("lib_ic")).alias("improvement"), "rank", "max_corr",
                    "closest", (F.coalesce("max_corr", F.lit(0.0)) < novelty).alias("novel"))


def evaluate(panel: DataFrame, top_n: int | None = None) -> DataFrame:
    """``scoring.evaluate_library`` of a library panel, written once so that reports on it do not rank again."""
    return _written(sc.evaluate_library(panel, top_n=top_n), "library-scores")
