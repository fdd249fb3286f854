"""Toxicity by weak supervision: many small voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicon words and word beginnings (3 to 9 bytes) that separate toxic from other labelled texts, and a few writing
patterns. Each fires or abstains. The label model is a two-class mixture over the vote matrix: expectation-maximisation
estimates how often each voter fires in either class (its accuracy) with the gold label as one more, noisy, voter; residual
correlations inside the classes then discount voters that repeat each other. A logistic regression on vote features is fitted
to the posteriors, and scores every whole text.

Training uses a bounded sample of labelled rows (``max_rows`` per class, chosen by a hash of the id). Null and empty texts have
no votes and get the score of a text without evidence. Without any labelled row of either class the score is the prior 0.0 for
every row. Repeated rows get equal scores. A null label is no label. Column names of the input do not matter beyond the two given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import bounded_sample, read, remainder
from factorspark.llm.text import Words, member, mix, release, slices, totals

#: Bytes of the word beginnings that can be voters.
BEGINNINGS = (3, 4, 5, 6, 7, 9)
#: Bounds of the training sample per class and of the number of lexicon voters.
MAX_ROWS, MAX_VOTERS = 8_000, 384
#: A lexicon voter occurs in so many toxic training texts at least, and so many times as often (by share) as in other texts.
MIN_TEXTS, MIN_LIFT = 3, 8.0
#: Writing patterns: share of upper-case letters, of exclamation marks, and of symbols.
PATTERNS = 3


@dataclass
class Model:
    """``keys``: sorted hashes of the lexicon voters; ``weights``: of the features, the intercept last."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray | None = None


def word_features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) of whole words, then of the beginnings of longer words."""
    salt = np.uint64(0xA24BAED4963EE407)
    yield np.arange(len(words.start)), mix(words.hash + salt)
    length = words.end - words.start
    for n in BEGINNINGS:
        at = np.flatnonzero(length > n)
        yield at, words.rolling.hash(words.start[at], words.start[at] + n)


def votes(buf: np.ndarray, offs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, voter index) of every place where a lexicon voter fires; pattern votes per text; words per text."""
    words = Words(buf, offs)
    text, docs, voters = words.text_of(), [], []
    for at, h in word_features(words):
        found = member(keys, h)
        hit = found >= 0
        docs.append(text[at[hit]])
        voters.append(found[hit])
    n_words = np.diff(words.first)
    letters = np.maximum(totals(((buf | 32) >= 97) & ((buf | 32) <= 122), offs), 1)
    patterns = np.stack([totals((buf >= 65) & (buf <= 90), offs) > 0.5 * letters, totals(buf == 33, offs) > 0.02 * letters + 2,
                         totals((buf == 35) | (buf == 36) | (buf == 37) | (buf == 38) | (buf == 42), offs) > 0.05 * letters + 2], axis=1)
    return np.concatenate(docs), np.concatenate(voters), patterns.astype(float), n_words


def features(buf: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """Per text: fired voters (0/1), patterns, number of different voters, hits per word, summed evidence."""
    docs, voters, patterns, n_words = votes(buf, offs, model.keys)
    n, m = len(offs) - 1, len(model.keys)
    counts = np.bincount(docs * m + voters, minlength=n * m).reshape(n, m) if m else np.zeros((n, 0))
    fired = (counts > 0).astype(float)
    different = fired.sum(1)
    hits = counts.sum(1)
    return np.column_stack([fired, patterns, np.minimum(different, 4), np.sqrt(hits / np.maximum(n_words, 1)), np.tanh(fired @ model.evidence / 4)])


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts with it, other texts with it) of one task; input (text, label)."""
    for b in batches:
        label = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
        for row, buf, offs in slices(b.column(0)):
            words = Words(buf, offs)
            text = words.text_of()
            seen = [_pairs(h, text[at]) for at, h in word_features(words)]
            keys = np.concatenate([k for k, _ in seen])
            toxic = label[row + np.concatenate([t for _, t in seen])]
            keys, inverse = np.unique(keys, return_inverse=True)
            yes = np.bincount(inverse, toxic, minlength=len(keys)).astype(np.int64)
            all_ = np.bincount(inverse, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(all_ - yes)], names=["feature", "yes", "no"])


def _pairs(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def lexicon(sample: DataFrame, n_toxic: int, n_other: int, max_voters: int = MAX_VOTERS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log-odds) of the voters with the most evidence; ``sample`` has (text, label)."""
    lift = (F.col("yes") + 0.5) / (n_toxic + 1.0) / ((F.col("no") + 0.5) / (n_other + 1.0))
    rows = (sample.mapInArrow(_mined, "feature bigint, yes bigint, no bigint").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
            .where(F.col("yes") >= MIN_TEXTS).withColumn("lift", lift).where(F.col("lift") >= MIN_LIFT)
            .withColumn("score", F.log("lift") * F.sqrt("yes")).orderBy(F.desc("score"), "feature").limit(max_voters).select("feature", "lift").collect())
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log(np.array([r[1] for r in rows], float))[order] if rows else np.zeros(0)


def label_model(fired: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of class 1 per row, weight per voter after the discount for correlated voters)."""
    prior = np.array([max((gold == 0).mean(), 1e-3), max((gold == 1).mean(), 1e-3)])
    post = np.where(gold == 1, 0.9, 0.1)
    discount = np.ones(fired.shape[1])
    for step in range(rounds):
        rate = [(fired * q[:, None]).sum(0) + 0.1 for q in (1 - post, post)]
        rate = [np.clip(r / (q.sum() + 1), 1e-4, 1 - 1e-4) for r, q in zip(rate, (1 - post, post), strict=True)]
        right = [np.clip(((1 - post) * (gold == 0)).sum() / max((1 - post).sum(), 1), 0.6, 0.98), np.clip((post * (gold == 1)).sum() / max(post.sum(), 1), 0.6, 0.98)]
        if step == 2:  # residual correlation inside the classes
            r0 = fired - np.where(post[:, None] > 0.5, rate[1], rate[0])
            c = r0.T @ r0 / len(fired)
            s = np.sqrt(np.maximum(np.diag(c), 1e-9))
            c = np.clip(c / s / s[:, None], 0, 1)
            discount = 1 / np.maximum(c.sum(1), 1)
        w = (np.log(rate[1] / rate[0]) - np.log((1 - rate[1]) / (1 - rate[0]))) * discount
        base = (np.log((1 - rate[1]) / (1 - rate[0])) * discount).sum()
        gold_vote = np.where(gold == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        z = np.clip(fired @ w + base + gold_vote + np.log(prior[1] / prior[0]), -30, 30)
        post = 1 / (1 + np.exp(-z))
    return post, w


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) of a logistic regression on soft labels, both classes weighing the same, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (balance * (p - y)) + penalty * w
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS, max_voters: int = MAX_VOTERS) -> Model:
    """Learn from rows of ``labels`` (one per id) that satisfy ``learn`` (a condition on the id)."""
    known = labels.where(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("bigint")).alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    # at most about 2 x max_rows ids and labels: small enough to broadcast, whatever the corpus
    few = [bounded_sample(known.where(F.col("_label") == k), F.col("_id"), max_rows, sizes[k]) for k in (0, 1)]
    sample = (df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
              .join(F.broadcast(few[0].unionAll(few[1])), "_id").select("_text", "_label"))
    got = {k: min(sizes[k], max_rows) for k in (0, 1)}
    keys, evidence = lexicon(sample, got[1], got[0], max_voters)
    model = Model(keys, evidence)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for row, buf, offs in slices(b.column(0)):
                x = features(buf, offs, model).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), pa.array(label[row:row + len(x)])], names=["x", "label"])

    rows = sample.mapInArrow(seen, "x binary, label bigint").collect()  # 2 x max_rows rows of a few hundred bytes
    if not rows:
        return Model()
    order = sorted(range(len(rows)), key=lambda i: bytes(rows[i][0]) + bytes([rows[i][1]]))  # the sum does not depend on arrival
    x = np.stack([np.frombuffer(rows[i][0], np.float32) for i in order]).astype(float)
    gold = np.array([rows[i][1] for i in order])
    post, _ = label_model(x[:, :len(keys) + PATTERNS], gold)
    model.weights = logistic(x, post)
    return model


def scores(column: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(column))
    if model.weights is None:
        return out
    for row, buf, offs in slices(column):
        z = features(buf, offs, model) @ model.weights[:-1] + model.weights[-1]
        out[row:row + len(z)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), model))], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), model) < threshold))
        release()

    return df.mapInArrow(run, df.schema)


def learnable(id_col: str = "doc_id") -> Column:
    return remainder(F.col(id_col), 5) != 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), learnable())
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
