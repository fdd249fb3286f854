"""Connected components of an edge table: contraction inside tasks, then alternating stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.session import cut_lineage


#: A task contracts about so many edges at once.
TASK_EDGES = 200_000


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (node, least node of its component among the edges of its task): at most one per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above.setdefault(y, y)
            return x

        kinds = None
        for b in batches:
            kinds = b.schema.types
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        if above:
            nodes = [x for x in above if top(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kinds[0]), pa.array([top(x) for x in nodes], kinds[1])], names=["a", "b"])

    return edges.coalesce(parts).mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the least node of the component.

    Tasks first contract the edges they hold; up to TASK_EDGES edges that is all. Each further round is two aggregates that are combined before their shuffle and two joins; a node with very many edges is a skewed
    join key against one row. Rounds grow with the logarithm of the longest path.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = max(1, -(-edges.count() // TASK_EDGES))
    edges = cut_lineage(_contracted(edges, parts))
    if parts == 1:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours move to the least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut_lineage(large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state
