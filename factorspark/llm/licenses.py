"""License scan: exact phrases, and an exact set-similarity join of text blocks with license notices.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. A block is a line, or a window of ``WINDOW`` words
(every ``STEP`` words) of a longer line. A template is a set of words; a block meets it when it holds at least ``threshold`` of them.
Notices are also wrapped over lines, or longer than a block: a template of k words is looked for in every window of 2 k consecutive words
of the whole text, across newlines and from every start, and met there by the same threshold.
The template words are ordered by how many blocks of the whole corpus hold them (rare first). A block can only meet a template of n
words when it holds one of the n - ceil(threshold * n) + 1 rarest ones (prefix), has enough different words (length), and enough
template words can still follow the first shared one in the order (position); what is left is compared exactly. The windows of the whole
text use the same prefix, and count their different words exactly by one pass over the places of template words.

Null and empty texts: no words, no labels, score 0. Repeated rows get equal results. ``score`` is 1 where a phrase occurs, else the
best containment found.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.llm.text import Words, member, slices, word_hashes

WINDOW, STEP = 48, 24
THRESHOLD = 0.85
# Phrases with their labels, and license notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the Apache License Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License you may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)


def blocks(words: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of every block, in order."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(buf == 10)
    line_first = np.unique(np.concatenate([words.first[:-1], np.searchsorted(words.start, breaks)]))
    line_first = line_first[line_first < n]
    line_end = np.append(line_first[1:], n)
    size = line_end - line_first
    count = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
    base = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(line_first, count) + (np.arange(base[-1]) - np.repeat(base[:-1], count)) * STEP
    return first, np.minimum(first + WINDOW, np.repeat(line_end, count))


class Plan:
    """Phrases and templates as word hashes; after ``order`` the template words by rising frequency."""

    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]], threshold: float):
        self.phrases = [(word_hashes(p), label) for p, label in phrases.items()]
        self.labels = [label for label, _ in templates]
        hashes = [word_hashes(t) for _, t in templates]
        self.sets = [np.unique(h) for h in hashes]
        self.reach = [2 * len(h) for h in hashes]
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        self.need = [ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.rank = np.arange(len(self.words))

    def order(self, frequency: Mapping[int, int]) -> None:
        by = sorted(range(len(self.words)), key=lambda i: (frequency.get(i, 0), int(self.words[i])))
        self.rank[by] = np.arange(len(by))
        #: per template: indices of its words, rare first; the prefix of each
        self.sorted = [sorted(np.searchsorted(self.words, s).tolist(), key=lambda i: self.rank[i]) for s in self.sets]
        self.prefix = [s[:len(s) - need + 1] for s, need in zip(self.sorted, self.need, strict=True)]


def places(found: np.ndarray, words: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, template word) of every distinct template word in every block; found: index of the template word of each word or -1."""
    first, end = blocks(words, buf)
    at = np.flatnonzero(found >= 0)
    # a word lies in up to ceil(WINDOW / STEP) blocks; blocks are sorted by their first word and by their end
    hi = np.searchsorted(first, at, "right")
    lo = np.searchsorted(end, at, "right")
    count = np.maximum(hi - lo, 0)
    block = np.repeat(lo, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    code = np.unique(block * (1 << 20) + np.repeat(found[at], count))
    return code >> 20, code & ((1 << 20) - 1)


def meets(plan: Plan, words: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of the block, template, containment) of every block that meets a template."""
    block, word = places(member(plan.words, words.hash), words, buf)
    if not len(block):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first, end = blocks(words, buf)
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    stop = np.append(begin[1:], len(block))
    bounds = dict(zip(block[begin].tolist(), zip(begin.tolist(), stop.tolist(), strict=True), strict=True))
    out: list[tuple[int, int, float]] = []
    for t, (whole, prefix, need) in enumerate(zip(plan.sorted, plan.prefix, plan.need, strict=True)):
        keys = np.zeros(len(plan.words), bool)
        keys[prefix] = True
        candidates = np.unique(block[keys[word]])
        candidates = candidates[end[candidates] - first[candidates] >= need]  # length
        place = {w: i for i, w in enumerate(whole)}
        for c in candidates.tolist():
            a, z = bounds[c]
            shared = [place[w] for w in word[a:z].tolist() if w in place]
            if len(whole) - min(shared) < need or len(shared) < need:  # position, then the exact count
                continue
            out.append((int(first[c]), t, len(shared) / len(whole)))
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out])


def wrapped(plan: Plan, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, template, best containment) of every stretch of overlapping windows of the whole texts that meet a template.

    A window may start at a template word only: one that starts elsewhere holds no more than the one from its first template word. A
    word counts for the starts after its last occurrence, so the different words of all windows come from one sum over differences.
    """
    found = member(plan.words, words.hash)
    at = np.flatnonzero(found >= 0)
    word, text = found[at], np.searchsorted(words.first, at, "right") - 1
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for t, (whole, prefix, need, reach) in enumerate(zip(plan.sorted, plan.prefix, plan.need, plan.reach, strict=True)):
        keys = np.zeros((2, len(plan.words)), bool)
        keys[0, whole], keys[1, prefix] = True, True
        rare = at[keys[1][word]]
        if not len(rare):
            continue
        mine = np.flatnonzero(keys[0][word])
        p = at[mine]  # only places that can share a window with a word of the prefix
        mine = mine[np.searchsorted(rare, p + reach) > np.searchsorted(rare, p - reach, "right")]
        p, w, d = at[mine], word[mine], text[mine]
        n = len(p)
        order = np.argsort(w, kind="stable")
        last = np.full(n, -1)
        same = np.flatnonzero(w[order[1:]] == w[order[:-1]])
        last[order[same + 1]] = order[same]
        lowest = np.maximum(np.searchsorted(p, p - reach, "right"), np.searchsorted(d, d))
        steps = np.bincount(np.maximum(last + 1, lowest), minlength=n + 1) - np.bincount(np.arange(n) + 1, minlength=n + 1)
        held = np.cumsum(steps[:n])
        hit = np.flatnonzero(held >= max(need, 1))
        if not len(hit):
            continue
        new = np.append(True, (d[hit[1:]] != d[hit[:-1]]) | (p[hit[1:]] >= p[hit[:-1]] + reach))
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(hit)) - 1
        end = np.minimum(p[hit[stop]] + reach, words.first[d[hit[stop]] + 1])
        out.append((p[hit[begin]], end, np.full(len(begin), t), np.maximum.reduceat(held[hit], begin) / len(whole)))
    first, end, template, share = (np.concatenate(x) for x in zip(*out, strict=True))
    return first, end, template, share


def apart(words: Words, buf: np.ndarray, first: np.ndarray, template: np.ndarray, a: np.ndarray, z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether each stretch (words a to z, template t) touches none of the line blocks (first, template) that meet its template."""
    out = np.ones(len(a), bool)
    if len(first) and len(a):
        begin, end = blocks(words, buf)
        for k in np.unique(t).tolist():
            b, s = np.sort(first[template == k]), np.flatnonzero(t == k)
            if len(b):
                before = np.searchsorted(b, z[s]) - 1
                out[s] = (before < 0) | (end[np.searchsorted(begin, b[np.maximum(before, 0)])] <= a[s])
    return out


def frequencies(df: DataFrame, plan: Plan, text_col: str = "text") -> dict[int, int]:
    """Blocks of all texts that hold each template word; as many rows as template words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plan.words), np.int64)
        for b in batches:
            for _, buf, offs in slices(b.column(0)):
                words = Words(buf, offs)
                _, word = places(member(plan.words, words.hash), words, buf)
                total += np.bincount(word, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n"))
    return {r[0]: r[1] for r in rows.collect()}


def scan(df: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks) of every row; n_blocks counts the
    blocks that meet a template, and the stretches of windows over the whole text that do where no block does."""
    plan = Plan(phrases, templates, threshold)
    plan.order(frequencies(df, plan, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            n_words, n_base, n_blocks = (np.zeros(n, np.int64) for _ in range(3))
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            best = np.zeros(n)
            base: list[set] = [set() for _ in range(n)]
            more: list[set] = [set() for _ in range(n)]
            for row, buf, offs in slices(b.column(1)):
                words = Words(buf, offs)
                size = np.diff(words.first)
                n_words[row:row + len(size)] = size
                h, text = words.hash, words.text_of()
                for keys, label in plan.phrases:
                    k = len(keys)
                    at = np.flatnonzero(h[:max(len(h) - k + 1, 0)] == keys[0])
                    for j in range(1, k):
                        at = at[h[at + j] == keys[j]]
                    at = at[text[at] == text[at + k - 1]]
                    docs = text[at]
                    np.add.at(n_base, row + docs, 1)
                    np.minimum.at(low, row + docs, at - words.first[docs])
                    np.maximum.at(high, row + docs, at - words.first[docs])
                    for d in np.unique(docs).tolist():
                        base[row + d].add(label)
                first, template, share = meets(plan, words, buf)
                a, z, t, held = wrapped(plan, words)
                alone = apart(words, buf, first, template, a, z, t)
                np.add.at(n_blocks, row + text[np.concatenate([first, a[alone]])], 1)
                docs = text[np.concatenate([first, a])]
                np.maximum.at(best, row + docs, np.concatenate([share, held]))
                for d, t in set(zip(docs.tolist(), np.concatenate([template, t]).tolist(), strict=True)):
                    more[row + d].add(plan.labels[t])
            hit = n_base > 0
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n_words), pa.array(n_base), pa.array(np.where(hit, low, 0), mask=~hit), pa.array(np.where(hit, high, 0), mask=~hit),
                pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], pa.string()),
                pa.array(np.where(hit, 1.0, best)), pa.array(n_blocks)], names=names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_blocks bigint"
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
