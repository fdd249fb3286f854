"""Language of a text as a mixture: proportions by expectation-maximisation over n-gram likelihoods.

A language is a table of log-probabilities of byte 2-grams and hashed byte 4-grams (A-Z as a-z), learned from labelled texts. A text
is cut into segments of 64 bytes, each drawn from one language; EM estimates the proportions of the languages in the text. The set of
languages is chosen by penalised likelihood: best one, two, three, ... up to all learned languages by proportion, each further one costs
``penalty * log(segments + 1)``. The predicted language has the largest proportion in the chosen set; the score is its mean posterior.

Training uses a bounded sample of labelled texts (``max_rows`` per language, chosen by a hash of the id). ``und`` with score 0 for null
or empty texts, for texts without a letter, and for every text when nothing could be learned. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read, remainder
from factorspark.llm.text import LOWER, slices

MAX_ROWS = 3_000
BITS = 17
SEGMENT = 64
UNKNOWN = "und"


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte position: code of the 2-gram and of the hashed 4-gram that start there; grams that leave their text are 0."""
    low = LOWER[buf].astype(np.uint32)
    n = len(low)
    two, four = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if n > 1:
        two[:-1] = low[:-1] << 8 | low[1:]
    if n > 3:
        four[:-3] = ((two[:-3] << np.uint32(16) | two[2:-1]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    for k, codes in ((1, two), (2, four), (3, four), (1, four)):
        at = offs[1:] - k
        at = at[(at >= 0) & (at < n)]
        codes[at] = 0
    return two, four


def letters(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_ = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(ascii_, out=sums[1:])
    has = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
        has[i] = any(c.isalpha() for c in bytes(buf[offs[i]:offs[i + 1]]).decode("utf-8", "replace"))
    return has


@dataclass
class Model:
    languages: list[str]
    two: np.ndarray
    four: np.ndarray

    def segments(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first segment of each text and the end, log-likelihood per segment and language)."""
        two, four = grams(buf, offs)
        size = np.diff(offs)
        count = -(-size // SEGMENT)
        first = np.concatenate([[0], np.cumsum(count)])
        begin = np.repeat(offs[:-1] - first[:-1] * SEGMENT, count) + np.arange(first[-1]) * SEGMENT
        out = np.zeros((first[-1], len(self.languages)))
        if len(begin):
            for k in range(len(self.languages)):
                out[:, k] = np.add.reduceat(self.two[k][two] + self.four[k][four], begin)
        return first, out * 0.5


def proportions(ll: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, mean posterior, log-likelihood) per text, over the allowed languages of each text."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    ll = np.where(allowed[text], ll, -np.inf)
    top = ll.max(1, keepdims=True, initial=-1e300)
    e = np.exp(np.maximum(ll - top, -700))
    e[~allowed[text]] = 0
    theta = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    count = np.maximum(np.diff(first), 1)[:, None]
    post = theta
    for _ in range(rounds):
        q = e * theta[text]
        norm = np.maximum(q.sum(1, keepdims=True), 1e-300)
        q /= norm
        sums = np.zeros((len(q) + 1, q.shape[1]))
        np.cumsum(q, axis=0, out=sums[1:])
        post = (sums[first[1:]] - sums[first[:-1]]) / count
        theta = (post * count + 0.01 * allowed) / (count + 0.01 * allowed.sum(1, keepdims=True))
    like = np.log(np.maximum((e * theta[text]).sum(1), 1e-300)) + top[:, 0]
    return theta, post, np.bincount(text, like, minlength=n)


def predict(model: Model, buf: np.ndarray, offs: np.ndarray, penalty: float = 4.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, score, number of languages in the chosen set) per text."""
    first, ll = model.segments(buf, offs)
    n, k = len(first) - 1, len(model.languages)
    has = letters(buf, offs)
    theta, _, _ = proportions(ll, first, np.ones((n, k), bool), rounds)
    order = np.argsort(-theta, axis=1, kind="stable")
    best, chosen, size = np.full(n, -np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
    segments = np.diff(first)
    text = np.repeat(np.arange(n), segments)
    # no set has more than the sum of each segment's best language: a text is left out once no larger set can win
    most = np.bincount(text, ll.max(1, initial=-np.inf), minlength=n)
    left = np.arange(n)
    for m in range(1, k + 1):
        cost = penalty * (m - 1) * np.log(segments + 1)
        left = left[most[left] - cost[left] > best[left]]
        if not len(left):
            break
        mine = np.zeros(n, bool)
        mine[left] = True
        allowed = np.zeros((len(left), k), bool)
        np.put_along_axis(allowed, order[left, :m], True, axis=1)
        _, post, like = proportions(ll[mine[text]], np.concatenate([[0], np.cumsum(segments[left])]), allowed, rounds if m > 1 else 1)
        value = like - cost[left]
        better = value > best[left]
        at = left[better]
        best[at], chosen[at], size[at] = value[better], post[better], m
    lang = chosen.argmax(1)
    # confidence in the language: share of the text, times its posterior against all languages over the whole text
    whole = np.zeros((len(ll) + 1, k))
    np.cumsum(ll, axis=0, out=whole[1:])
    whole = whole[first[1:]] - whole[first[:-1]]
    odds = np.exp(np.maximum(whole - whole.max(1, keepdims=True), -700))
    odds /= odds.sum(1, keepdims=True)
    score = np.clip(chosen[np.arange(n), lang] * np.where(size > 1, 1.0, odds[np.arange(n), lang]), 0, 1)
    has &= size > 0
    return np.where(has, lang, -1), np.where(has, score, 0.0), np.where(has, size, 0)


def fit(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model | None:
    """Learn from texts that satisfy ``learn`` and have a language; None when there is none."""
    known = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    sizes = {r[0]: r[1] for r in known.groupBy("_lang").count().collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    rate = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(int(1_000_003 * min(1.0, max_rows / sizes[k])) + (sizes[k] <= max_rows)))])
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < rate[F.col("_lang")]).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for k in sorted(set(langs.tolist())):
                total = sums.setdefault(k, np.zeros((1 << 16) + (1 << BITS), np.int64))
                for _, buf, offs in slices(b.column(1).filter(pa.array(langs == k))):
                    two, four = grams(buf, offs)
                    total += np.concatenate([np.bincount(two, minlength=1 << 16), np.bincount(four, minlength=1 << BITS)])
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at), pa.array(v[at])], names=["lang", "gram", "n"])

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((1 << 16) + (1 << BITS), np.int64)
        v[rows["gram"].to_numpy()] = rows["n"].to_numpy()
        return pd.DataFrame({"lang": [key[0]], "counts": [v.tobytes()]})

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # one bounded table (under 2 MB) per language
    got = {r[0]: np.frombuffer(r[1], np.int64).astype(float) for r in counted.groupBy("lang").applyInPandas(table, "lang string, counts binary").collect()}
    names = [k for k in names if k in got]
    if not names:
        return None
    parts = []
    for cut in (slice(0, 1 << 16), slice(1 << 16, None)):
        c = np.stack([got[k][cut] for k in names]) + 0.2
        c[:, 0] = 1.0  # code 0 stands for no gram
        p = np.log(c / c.sum(1, keepdims=True))
        p[:, 0] = 0.0
        parts.append(p.astype(np.float32))
    return Model(names, *parts)


def detect(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_languages) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a bounded table per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*(m.languages if m else []), UNKNOWN], object)
        for b in batches:
            lang, score, size = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for row, buf, offs in slices(b.column(1)) if m else ():
                end = row + len(offs) - 1
                lang[row:end], score[row:end], size[row:end] = predict(m, buf, offs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(size)], names=[id_col, "lang_pred", "score", "n_languages"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, n_languages bigint")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, remainder(F.col("doc_id"), 5) != 0)
    return detect(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "n_languages")
