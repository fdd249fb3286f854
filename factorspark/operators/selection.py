"""Choosing among factors. Tables here hold one row per factor or per factor pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.operators import cross_section as cs
from factorspark.session import cut_lineage


def filter_factors(df, family=None, min_ic=None, min_ir=None, min_stability=None) -> DataFrame:
    if family is not None:
        df = df.filter(F.col("family") == family)
    if min_ic is not None:
        df = df.filter(F.abs("ic") >= min_ic)
    if min_ir is not None:
        df = df.filter(F.col("ir") >= min_ir)
    if min_stability is not None:
        df = df.filter(F.col("stability") >= min_stability)
    return df


def one_per_family(metrics: DataFrame, n: int | None = None, name="name") -> DataFrame:
    """Best |IC| of each family; ``n`` keeps the best n families."""
    d = cs.top_n(metrics.withColumn("_a", F.abs("ic")), ["family"], "_a", 1, name)
    d = d.orderBy(F.col("_a").desc(), name)
    return (d.limit(n) if n else d).drop("_a", "rank")


def select_by_name(metrics: DataFrame, names: list[str], name="name") -> DataFrame:
    return metrics.filter(F.col(name).isin(list(names)))


def count_warnings(selected: DataFrame, lo: int, hi: int) -> DataFrame:
    n = F.count("*")
    return selected.agg(n.alias("n_selected"), F.when(n < lo, "too few").when(n > hi, "too many").otherwise("ok").alias("warning"))


def select_uncorrelated(metrics: DataFrame, pairs: DataFrame, n: int, threshold: float = 0.7, name="name") -> DataFrame:
    """Greedy: keep the best remaining factor, drop what correlates with it, until n are kept.

    Greedy order is resolved in rounds: every factor that beats all its remaining correlated neighbours
    is settled at once, so the number of rounds is the longest chain of ever better neighbours, not the
    number of factors. Each round is cut from the last by a reliable checkpoint.
    """
    strong = pairs.filter(F.abs("corr") >= threshold).select(F.col("factor_a").alias("a"), F.col("factor_b").alias("b"))
    edges = cut_lineage(strong.unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    left = cut_lineage(metrics.select(name, F.struct(F.abs("ic").alias("s"), F.lit("").alias("_"), F.col(name).alias("k")).alias("_s"), F.lit(None).cast("boolean").alias("kept")))
    while True:
        open_ = left.filter(F.col("kept").isNull())
        if open_.isEmpty():
            break
        s1 = open_.select(F.col(name).alias("a"), F.col("_s").alias("_sa"))
        s2 = open_.select(F.col(name).alias("b"), F.col("_s").alias("_sb"))
        beaten = edges.join(s1, "a").join(s2, "b").filter(F.col("_sb") > F.col("_sa")).select(F.col("a").alias(name)).distinct()
        winners = open_.join(beaten, name, "left_anti").select(name)
        losers = edges.join(winners.select(F.col(name).alias("a")), "a").select(F.col("b").alias(name)).distinct()
        state = (left.join(winners.withColumn("_w", F.lit(True)), name, "left").join(losers.withColumn("_l", F.lit(True)), name, "left")
                 .withColumn("kept", F.coalesce("kept", F.when(F.col("_w"), True).when(F.col("_l"), False))).drop("_w", "_l"))
        left = cut_lineage(state)
    kept = left.filter("kept").select(name)
    return metrics.join(kept, name).orderBy(F.abs("ic").desc(), name).limit(n)


def components(nodes: DataFrame, edges: DataFrame, name="name") -> DataFrame:
    """Connected components by repeated minimum labels: ``(name, component)``; labels jump through their own label each round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both)
    lab = cut_lineage(nodes.select(F.col(name).alias("a"), F.col(name).alias("lab")))
    while True:
        near = both.join(lab.select(F.col("a").alias("b"), F.col("lab").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        new = lab.join(near, "a", "left").select("a", F.least("lab", F.coalesce("nl", "lab")).alias("l1"))
        hop = lab.select(F.col("a").alias("l1"), F.col("lab").alias("l2"))
        new = new.join(hop, "l1", "left").select("a", F.least("l1", F.coalesce("l2", "l1")).alias("lab"))
        new = cut_lineage(new)
        changed = new.join(lab.withColumnRenamed("lab", "old"), "a").filter(F.col("lab") != F.col("old"))
        lab, done = new, changed.isEmpty()
        if done:
            return lab.select(F.col("a").alias(name), F.col("lab").alias("component"))


def redundant_groups(metrics: DataFrame, pairs: DataFrame, threshold: float = 0.7, by: str = "ic", name="name") -> DataFrame:
    """Single-linkage groups at the threshold: members, best member by a metric, mean in-group |correlation|."""
    strong = pairs.filter(F.abs("corr") >= threshold).select(F.col("factor_a").alias("a"), F.col("factor_b").alias("b"))
    comp = components(metrics.select(name), strong, name)
    score = {"ic": F.abs("ic"), "ir": F.abs("ir"), "combined": F.abs("ic") * 0.5 + F.abs("ir") * 0.5}[by]
    m = metrics.join(comp, name)
    g = m.groupBy("component").agg(F.count("*").alias("size"), F.max_by(name, F.struct(score, F.col(name))).alias("best"),
                                   F.array_join(F.array_sort(F.collect_set(name)), ",").alias("members"))
    ca, cb = (comp.select(F.col(name).alias(f), F.col("component").alias(c)) for f, c in (("factor_a", "component"), ("factor_b", "_cb")))
    inside = pairs.join(ca, "factor_a").join(cb, "factor_b").filter(F.col("component") == F.col("_cb"))
    avg = inside.groupBy("component").agg(F.avg(F.abs("corr")).alias("mean_corr"))
    return g.join(avg, "component", "left").withColumn("mean_corr", F.coalesce("mean_corr", F.lit(1.0)))


def nearest_factor(df: DataFrame, new: list[str], existing: list[str]) -> DataFrame:
    """For each new factor column the existing one it correlates with most; one aggregate over the panel."""
    from factorspark.functions.math import corr
    wide = df.agg(*[corr(a, b).alias(f"_p{i}_{j}") for i, a in enumerate(new) for j, b in enumerate(existing)])
    arr = F.array(*[F.struct(F.lit(a).alias("factor"), F.lit(b).alias("existing"), F.col(f"_p{i}_{j}").alias("corr"))
                    for i, a in enumerate(new) for j, b in enumerate(existing)])
    long = wide.select(F.explode(arr).alias("_e")).select("_e.*")
    return long.groupBy("factor").agg(F.max_by("existing", F.abs("corr")).alias("existing"), F.max_by("corr", F.abs("corr")).alias("corr"))
