"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a score quantile.

Style measures of a whole text (lengths, shares of character classes, repeated words and lines) are binned on the training sample;
every pair (good, bad) of labelled texts contributes the logistic loss of its feature difference. The cut is the quantile of the
training scores at the share of bad texts, moved to the best balanced accuracy nearby; scores map to 0..1 so that the cut is 0.7.

Training uses every labelled row: bin edges, means and spreads are aggregates over all of them; rows are dealt into buckets by a hash of
the id, and in its bucket each row meets ``PARTNERS`` rows of the other class at least (a bucket without one of the classes gives no pairs);
each Newton step sums gradient and curvature over the buckets; the cut comes from counts of all training scores. Null and empty texts are
texts of length 0. Without labelled rows of both classes every score is 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read, remainder
from factorspark.llm.text import Words, slices, totals
from factorspark.session import broadcast_if_small, scratch_path

BINS = 8
#: Rows of the other class that a row is paired with, labelled rows of a bucket (expected), and steps of the training scores' counts.
PARTNERS, BUCKET_ROWS, STEPS = 4, 4096, 20_000
#: The score at the cut.
CUT = 0.7
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _HIGH, _STOP, _BAR, _SYMBOL, _OTHER = range(10)
CLASSES = np.full(256, _OTHER, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
CLASSES[[32, 9, 11, 12, 13]], CLASSES[10], CLASSES[[44, 46, 58, 59, 63]] = _SPACE, _LINE, _STOP
CLASSES[[124, 60, 62, 123, 125, 91, 93, 95, 92, 126, 94]], CLASSES[[33, 35, 36, 37, 38, 42, 43, 61, 64]] = _BAR, _SYMBOL


def measures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of measures per text."""
    size = np.diff(offs)
    n = np.maximum(size, 1)
    kinds = CLASSES[buf]
    share = np.stack([totals(kinds == k, offs) for k in range(10)], axis=1)
    words = Words(buf, offs)
    n_words = np.diff(words.first)
    length = words.end - words.start
    w = np.maximum(n_words, 1)
    text = words.text_of()
    order = np.lexsort((words.hash, text))
    h, t = words.hash[order], text[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    repeated = np.bincount(t[same], minlength=len(n))
    again = np.zeros(len(text), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    ends = np.union1d(np.flatnonzero(buf == 10) + 1, offs[1:])
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    full = ends > begins
    begins, ends = begins[full], ends[full]
    line_text = np.searchsorted(offs, begins, "right") - 1
    hashes = words.rolling.hash(begins, np.where(buf[np.maximum(ends - 1, 0)] == 10, ends - 1, ends)) if len(ends) else np.zeros(0, np.uint64)
    lo = np.lexsort((hashes, line_text))
    lh, lt = hashes[lo], line_text[lo]
    ls = np.zeros(len(lh), bool)
    ls[1:] = (lh[1:] == lh[:-1]) & (lt[1:] == lt[:-1])
    lines = np.bincount(line_text, minlength=len(n))
    letters = np.maximum(share[:, _UPPER] + share[:, _LOWER] + share[:, _HIGH], 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), share[:, _UPPER] / letters, share[:, _DIGIT] / n, share[:, _SPACE] / n, share[:, _HIGH] / n, share[:, _STOP] / w,
        share[:, _BAR] / w, share[:, _SYMBOL] / w, share[:, _OTHER] / w, share[:, _LINE] / w, totals(length, words.first) / w, totals(length > 12, words.first) / w,
        repeated / w, np.bincount(text[again], minlength=len(n)) / w, np.bincount(lt[ls], minlength=len(n)) / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)),
        n_words == 0,
    ]).astype(float)


@dataclass
class Model:
    """``edges``: bin edges per measure; ``weights`` of the measures' bins and scaled values; score = sigmoid(scale * (s - cut) + logit(CUT))."""

    edges: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -4, 4)
        bins = [(x[:, [j]] > self.edges[j][None, :]).astype(float) for j in range(x.shape[1])]
        return np.concatenate([z, *bins], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pairs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) row numbers: every row with ``PARTNERS`` of the other class, going round the smaller one."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    n = max(len(good), len(bad))
    k = min(PARTNERS, len(good), len(bad))
    i = np.arange(n)
    return np.concatenate([good[i % len(good)]] * k), np.concatenate([bad[(i + i // len(bad) + j) % len(bad)] if len(bad) < n else bad[(i + j) % n] for j in range(k)])


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(measures, labels) of a bucket, in an order that does not depend on arrival."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in t["x"].chunks]
    x, y = np.concatenate(flat).reshape(t.num_rows, -1), t["label"].to_numpy()
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def _summed(rows: DataFrame) -> np.ndarray:
    """Sum of the arrays ``v``, in two levels so that the driver gets one."""

    def add(key, t):
        v = np.sum([c.as_py() for c in t["v"]], axis=0) if t.num_rows else np.zeros(0)
        return pa.table({"v": pa.array([v], pa.list_(pa.float64()))})

    for n in (64, 1):
        rows = rows.groupBy(F.pmod(F.xxhash64("v"), F.lit(n))).applyInArrow(add, "v array<double>")
    got = rows.first()
    return np.array(got[0]) if got else np.zeros(0)


def bradley_terry(stored: DataFrame, model: Model, l2: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Weights that make good rows score above the bad rows they are paired with, by Newton steps on the logistic loss of the differences;
    ``stored`` has (bucket, x, label)."""
    size = len(model.centre) + model.edges.size
    w = np.zeros(size)
    for _ in range(rounds):

        def sums(key, t):
            x, y = _rows(t)
            x = model.expand(x)
            good, bad = pairs(y)
            g, h = np.zeros(size), np.zeros((size, size))
            for i in range(0, len(good), 8192):
                d = x[good[i:i + 8192]] - x[bad[i:i + 8192]]
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                g += d.T @ p
                h += (d * (p * (1 - p))[:, None]).T @ d
            return pa.table({"v": pa.array([np.concatenate([[len(good)], g, h.ravel()])], pa.list_(pa.float64()))})

        got = _summed(stored.groupBy("bucket").applyInArrow(sums, "v array<double>"))
        if not len(got) or not got[0]:
            break
        penalty = l2 * got[0] / 2000
        step = np.linalg.solve(got[1 + size:].reshape(size, size) + penalty * np.eye(size), got[1:1 + size] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return w


def train(stored: DataFrame, sizes: dict[int, int]) -> Model:
    """Fit on all rows (bucket, x, label) of measures; ``sizes``: rows per label."""
    at = stored.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.percentile_approx("v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 100_000).alias("edges"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("j").collect()
    model = Model(np.array([r["edges"] for r in at]), np.array([r["m"] for r in at]), np.maximum([r["s"] for r in at], 1e-6), np.zeros(0), 0.0, 1.0)
    model.weights = bradley_terry(stored, model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1)
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), y], names=["s", "label"])

    scored = stored.select("x", "label").mapInArrow(raw, "s double, label bigint")
    lo, hi = scored.agg(F.min("s"), F.max("s")).first()
    step = max(hi - lo, 1e-9) / STEPS
    place = F.floor((F.col("s") - lo) / step)
    # at most STEPS + 1 rows: all training scores, counted
    counts = scored.groupBy(place.alias("at")).agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("at").collect()
    bad, good = (np.array([r[c] for r in counts], float) / sizes[k] for c, k in (("bad", 0), ("good", 1)))
    share_bad = sizes[0] / (sizes[0] + sizes[1])
    below = np.cumsum(bad * share_bad + good * (1 - share_bad))
    near = np.abs(below - share_bad) <= max(0.5 * share_bad, 0.02)
    near[np.argmin(np.abs(below - share_bad))] = True
    # balanced accuracy of cutting above each place
    best = int(np.argmax(np.where(near, np.cumsum(bad - good), -np.inf)))
    model.cut = float((counts[best]["hi"] + counts[min(best + 1, len(counts) - 1)]["lo"]) / 2) if best + 1 < len(counts) else float(counts[best]["hi"])
    return model


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learn from all rows of ``labels`` (one per id) that satisfy ``learn``; None without both classes."""
    known = labels.where(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("bigint")).alias("_label"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(broadcast_if_small(known), "_id").select(F.xxhash64("_id").alias("_h"), "_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in slices(b.column(1)):
                x = measures(buf, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(x)), flat, b.column(2).slice(row, len(x))], names=["h", "x", "label"])

    spark = df.sparkSession
    path = scratch_path(spark, "quality-measures")
    rows.mapInArrow(run, "h bigint, x array<double>, label bigint").write.parquet(path)  # a few numbers per labelled text, read by every step
    found = spark.read.parquet(path)
    sizes = {r[0]: r[1] for r in found.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    buckets = max(1, round(sum(sizes.values()) / BUCKET_ROWS))
    return train(found.select(F.pmod("h", F.lit(buckets)).alias("bucket"), "x", "label"), sizes)


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, 0.5)
            for row, buf, offs in slices(b.column(1)) if model else ():
                out[row:row + len(offs) - 1] = model.score(measures(buf, offs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
