"""Vector similarity and clustering.

Up to ``BLOCK`` queries against stored vectors are a scan: the query block (size checked) is shipped to every task,
each task multiplies it with its batches and keeps only its best k per query, and a final top-k merges them.
More queries meet the vectors in blocks of both sides, in one job (``blocked_knn``). No pair list is ever built.
An index (``VectorIndex``) puts every vector in the cell of its nearest centre; a query is then compared exactly,
but only with the cells nearest to it.

Vectors that are NULL match nothing; a vector of length zero has cosine 0 with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorspark.functions import vectors as fv
from factorspark.operators import cross_section as cs
from factorspark.session import broadcast_if_small, cut_lineage, scratch_path

# Largest query block sent to tasks at once: 1024 vectors of 1024 floats are 8 MB, and a block times one Arrow
# batch of 10,000 rows is 80 MB of scores.
BLOCK = 1024


def centroids(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group: exploded positions averaged map-side, put back in order."""
    e = df.select(by, F.posexplode(vec).alias("_i", "_v"))
    m = e.groupBy(by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return m.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias(vec))


def _scan_block(vectors: DataFrame, ids: list, mat: np.ndarray, k: int, min_score: float | None, id_col: str, vec: str, qtype: str) -> DataFrame:
    """Best k stored vectors per query and task."""
    bc = vectors.sparkSession.sparkContext.broadcast((ids, mat))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = bc.value
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            s = q @ np.divide(x, n, out=np.zeros_like(x), where=n > 0).T
            floor = np.full(len(qid), -np.inf if min_score is None else min_score)
            if s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
            r, c = np.nonzero(s >= floor[:, None])
            got = pd.DataFrame({"q": r, id_col: pdf[id_col].to_numpy()[c], "score": s[r, c]})
            # equal scores: the smaller id wins, as in the final merge
            both = got if best is None else pd.concat([best, got])
            best = both.sort_values(["q", "score", id_col], ascending=[True, False, True]).groupby("q", sort=False).head(k)
        if best is None:
            return
        yield pd.DataFrame({"query_id": [qid[int(i)] for i in best["q"]], id_col: best[id_col].astype(np.int64), "score": best["score"].astype(float)})

    return vectors.select(id_col, vec).mapInPandas(scan, f"query_id {qtype}, {id_col} BIGINT, score DOUBLE")


# Largest vector block of one group in memory, as doubles, and largest block of scores that a task holds.
BLOCK_BYTES = 8 << 20
SCORE_BYTES = 8 << 20


def _unit(col) -> np.ndarray:
    if isinstance(col, pa.Array):  # a list column without NULLs: its values are one flat array
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(len(col), len(x) // max(len(col), 1))
    else:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in col])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _column(t: pa.Table, c: str) -> pa.Array:
    got = t[c].combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def _meet(queries: DataFrame, vectors: DataFrame, score, schema: str, cell: str, query_id: str, id_col: str, vec: str, v_rows: int | None = None) -> DataFrame:
    """Every vector block of a cell with every query block of the same cell, one group each.

    A cell is cut into as many blocks as its rows need, so neither a large cell nor a popular one makes a large group; vectors are
    repeated per query block and queries per vector block. The table of blocks has one row per cell that is asked for.
    """
    rows = F.lit(v_rows) if v_rows else F.greatest(F.floor(F.lit(BLOCK_BYTES) / F.greatest(F.col("_dim") * 8, F.lit(8))), F.lit(1))
    have = vectors.groupBy(cell).agg(F.count("*").alias("_n"), F.max(F.size(vec)).alias("_dim"))
    asked = queries.groupBy(cell).agg(F.count("*").alias("_m"))
    shape = have.join(asked, cell).select(cell, F.ceil(F.col("_n") / rows).alias("_vbs"), F.ceil(F.col("_m") / F.lit(v_rows or BLOCK)).alias("_qbs"))
    shape = broadcast_if_small(cut_lineage(shape))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    v = vectors.join(shape, cell).select(cell, id_col, vec, F.pmod(F.xxhash64(id_col), "_vbs").alias("_vb"), upto("_qbs").alias("_qb"))
    q = queries.join(shape, cell).select(F.col(cell).alias("_qc"), query_id, F.col(vec).alias("_q"), F.pmod(F.xxhash64(query_id), "_qbs").alias("_qb"), upto("_vbs").alias("_vb"))
    return v.groupBy(cell, "_vb", "_qb").cogroup(q.groupBy("_qc", "_vb", "_qb")).applyInArrow(score, schema)


def blocked_knn(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, query_id: str = "query_id", id_col: str = "vec_id", vec: str = "embedding",
                cell: str | None = None, v_rows: int | None = None) -> DataFrame:
    """k nearest vectors of any number of queries, best first, in one job over blocks of both sides.

    With ``cell`` a query row is compared only with vectors of the same cell; a query may come with several cells, a vector with one.
    Equal scores: the smaller id wins.
    """
    at = cell or "_cell"
    one = lambda d: d if cell else d.withColumn(at, F.lit(0))
    queries, vectors = one(queries.filter(F.col(vec).isNotNull())), one(vectors.filter(F.col(vec).isNotNull()))
    types = dict(vectors.dtypes) | {"_q": dict(queries.dtypes)[query_id]}

    def score(v, q):
        v = v.take(pc.sort_indices(v[id_col]))
        ids, asked = _column(v, id_col), _column(q, query_id)
        kinds = pa.schema([pa.field("query_id", asked.type), pa.field(id_col, ids.type), pa.field("score", pa.float64())])
        if not len(v) or not len(q):
            return kinds.empty_table()
        x, y, out = _unit(_column(v, vec)), _unit(_column(q, "_q")), []
        step = max(SCORE_BYTES // (8 * len(x)), 1)
        for i in range(0, len(y), step):
            s = y[i:i + step] @ x.T
            floor = np.full(len(s), -np.inf if min_score is None else min_score)
            if s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
            r, c = np.nonzero(s >= floor[:, None])
            best = np.lexsort((c, -s[r, c], r))  # equal scores: the smaller id
            r, c = r[best], c[best]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c = r[place < k], c[place < k]
            out.append(pa.table([asked.take(pa.array(i + r)), ids.take(pa.array(c)), pa.array(s[r, c])], schema=kinds))
        return pa.concat_tables(out)

    found = _meet(queries, vectors, score, f"query_id {types['_q']}, `{id_col}` {types[id_col]}, score DOUBLE", at, query_id, id_col, vec, v_rows)
    return cs.top_n(found, ["query_id"], "score", k, id_col)


def knn(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, query_id: str = "query_id", id_col: str = "vec_id", vec: str = "embedding",
        family: str | None = None, family_col: str = "label") -> DataFrame:
    """k nearest stored vectors by cosine for each query, best first; an optional family filter and score floor.

    The query count is checked: up to ``BLOCK`` queries are one broadcast and one scan without a shuffle, more go through ``blocked_knn``.
    """
    if family is not None:
        vectors = vectors.filter(F.col(family_col) == family)
    queries, vectors = queries.filter(F.col(vec).isNotNull()), vectors.filter(F.col(vec).isNotNull())
    rows = queries.select(query_id, vec).limit(BLOCK + 1).toPandas()
    if not len(rows) or len(rows) > BLOCK:
        return blocked_knn(queries, vectors, k, min_score, query_id, id_col, vec)
    ids = [x.item() if hasattr(x, "item") else x for x in rows[query_id]]
    found = _scan_block(vectors, ids, _unit(rows[vec]), k, min_score, id_col, vec, dict(queries.dtypes)[query_id])
    return cs.top_n(found, ["query_id"], "score", k, id_col)


class VectorIndex:
    """Inverted file over unit vectors: centres of a bounded sample, and the cell of its nearest centre for every vector.

    ``sample`` bounds the rows the centres are fitted on (expected number, taken by a hash of the id); every row is indexed. The centres
    travel to the tasks: at most ``MAX_CELLS`` of them. The table of cells is written once to the shared folder.
    """

    SAMPLE = 50_000
    MAX_CELLS = 4096

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vec: str = "embedding", seed: int = 7):
        self.id_col, self.vec = id_col, vec
        v = vectors.filter(F.col(vec).isNotNull())
        n = v.select(F.lit(1)).count()
        self.cells = max(1, min(self.MAX_CELLS, cells or math.isqrt(max(n, 1)), max(1, n)))
        share = min(1.0, sample / max(n, 1))
        some = v.filter(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        some = _features(some, vec, unit=True).select("_x")
        fitted = KMeans(k=self.cells, seed=seed, featuresCol="_x").fit(some).clusterCenters() if self.cells > 1 and n else []
        self.centres = _unit(fitted) if len(fitted) else None
        self.spark = vectors.sparkSession
        path = scratch_path(self.spark, "vector-index")
        self._near(v, 1).write.parquet(path)
        self.table = self.spark.read.parquet(path)

    def _near(self, df: DataFrame, cells: int) -> DataFrame:
        """Add ``_cell``: one row per vector and each of its nearest ``cells`` centres, with ``_place`` from 1."""
        if self.centres is None:
            return df.withColumns({"_cell": F.lit(0), "_place": F.lit(1)})
        bc, at = self.spark.sparkContext.broadcast(self.centres), df.columns.index(self.vec)
        cells, names = min(cells, len(self.centres)), [*df.columns, "_near"]
        step = max(SCORE_BYTES // (8 * len(self.centres)), 1)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = bc.value
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    s = _unit(part.column(at)) @ c.T
                    best = np.argmax(s, axis=1)[:, None] if cells == 1 else np.argsort(-s, axis=1, kind="stable")[:, :cells]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, cells, dtype=np.int32)), pa.array(best.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=names)

        d = df.mapInArrow(near, T.StructType([*df.schema.fields, T.StructField("_near", T.ArrayType(T.IntegerType()))]))
        return d.select(*df.columns, F.posexplode("_near").alias("_place", "_cell")).withColumn("_place", F.col("_place") + 1)

    def search(self, queries: DataFrame, k: int, probes: int, min_score: float | None = None, query_id: str = "query_id") -> DataFrame:
        """k nearest vectors of the ``probes`` cells nearest to each query, scored exactly; all cells give the exact answer."""
        q = self._near(queries.filter(F.col(self.vec).isNotNull()).select(query_id, self.vec), probes).select(query_id, self.vec, "_cell")
        return blocked_knn(q, self.table.select(self.id_col, self.vec, "_cell"), k, min_score, query_id, self.id_col, self.vec, cell="_cell")

    def recall_curve(self, queries: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
        """(probes, recall) for every number of probes, from one exact search: a true neighbour is found once its cell is among those probed."""
        queries = queries.filter(F.col(self.vec).isNotNull())
        true = knn(queries.select(query_id, self.vec), self.table, k, query_id=query_id, id_col=self.id_col, vec=self.vec).select("query_id", self.id_col)
        place = self._near(queries.select(F.col(query_id).alias("query_id"), self.vec), self.cells).select("query_id", "_cell", "_place")
        found = true.join(self.table.select(self.id_col, "_cell"), self.id_col).join(place, ["query_id", "_cell"])
        at = found.groupBy("_place").agg(F.count("*").alias("_c"))  # one row per cell at most
        whole = Window.partitionBy(F.lit(0))
        upto = whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return at.select(F.col("_place").alias("probes"), (F.sum("_c").over(upto) / F.sum("_c").over(whole)).alias("recall"))

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, query_id: str = "query_id") -> int:
        """Fewest probes that reach the recall on these queries, which the caller bounds."""
        best = self.recall_curve(queries, k, query_id).filter(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
        return int(best) if best is not None else self.cells


def near_duplicates(queries: DataFrame, vectors: DataFrame, threshold: float, **kw) -> DataFrame:
    """Best match of each query at or over the threshold."""
    return knn(queries, vectors, 1, threshold, **kw).drop("rank")


def similarity_matrix(df: DataFrame, ids: list | None = None, id_col: str = "vec_id", vec: str = "embedding", rows: int = 1000) -> DataFrame:
    """Cosine of every ordered pair of the listed vectors: (a, b, score). The result has the square of the list's length by definition;
    it is made in blocks of about ``rows`` times ``rows``, whatever the length."""
    d = (df if ids is None else df.filter(F.col(id_col).isin(list(ids)))).filter(F.col(vec).isNotNull()).select(id_col, vec, F.lit(0).alias("_cell"))
    t = dict(df.dtypes)[id_col]

    def score(v, q):
        ids, asked = _column(v, id_col), _column(q, "_a")
        kinds = pa.schema([pa.field("a", asked.type), pa.field("b", ids.type), pa.field("score", pa.float64())])
        if not len(v) or not len(q):
            return kinds.empty_table()
        s = _unit(_column(q, "_q")) @ _unit(_column(v, vec)).T
        return pa.table([asked.take(pa.array(np.repeat(np.arange(len(q)), len(v)))), ids.take(pa.array(np.tile(np.arange(len(v)), len(q)))), pa.array(s.ravel())], schema=kinds)

    return _meet(d.withColumnRenamed(id_col, "_a"), d, score, f"a {t}, b {t}, score DOUBLE", "_cell", "_a", id_col, vec, v_rows=rows)


def by_family(df: DataFrame, family, n: int, family_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    return df.filter(F.col(family_col) == family).orderBy(id_col).limit(n)


def _features(df: DataFrame, vec: str, unit: bool = False) -> DataFrame:
    a = F.transform(vec, lambda v: v.cast("double"))
    if unit:
        n = fv.norm(F.col(vec))
        a = F.transform(vec, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(0.0))
    return df.withColumn("_x", array_to_vector(a))


def kmeans(df: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", seed: int = 7) -> DataFrame:
    """Per cluster: size, the member nearest its centre, mean cosine to the centre; silhouette of the whole clustering."""
    d = _features(df, vec)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(d)
    p = model.transform(d)
    sil = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(p)
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])  # k vectors
    a, c = vector_to_array("_x"), F.element_at(centers, F.col("cluster") + 1)
    diff = F.zip_with(a, c, lambda x, y: x - y)
    p = p.withColumns({"_d": fv.dot(diff, diff), "_s": fv.cosine(a, c)})
    return p.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by(id_col, F.struct("_d", id_col)).alias("representative"),
                                    F.avg("_s").alias("mean_similarity")).withColumn("silhouette", F.lit(float(sil)))


def best_k(df: DataFrame, max_k: int, vec: str = "embedding", seed: int = 7) -> tuple[int, list[float]]:
    """Elbow of the training cost: the k with the largest second difference, and the costs for k = 1 .. max_k."""
    d = _features(df, vec).select("_x").persist()
    cost = []
    for k in range(1, max_k + 1):
        if k == 1:
            from pyspark.ml.stat import Summarizer
            m = d.agg(Summarizer.metrics("variance", "count").summary(F.col("_x")).alias("s")).select("s.variance", "s.count").first()
            cost.append(float(sum(m[0].toArray()) * (m[1] - 1)))
        else:
            cost.append(float(KMeans(k=k, seed=seed, featuresCol="_x").fit(d).summary.trainingCost))
    d.unpersist()
    second = [cost[i - 1] - 2 * cost[i] + cost[i + 1] for i in range(1, len(cost) - 1)]
    return (second.index(max(second)) + 2 if second else 1), cost


def bisecting(df: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", seed: int = 7) -> DataFrame:
    """Hierarchical clusters by repeated splitting on cosine distance (not average linkage): (id, cluster)."""
    d = _features(df, vec, unit=True)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", distanceMeasure="cosine").fit(d)
    return model.transform(d).select(id_col, "cluster")


def cluster_summary(df: DataFrame, cluster: str, id_col: str = "vec_id") -> DataFrame:
    n = F.count("*")
    return df.groupBy(cluster).agg(n.alias("size"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
