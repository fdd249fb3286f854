"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

Texts are compared by characters, lower-cased, with runs of white space as one space. A text is contaminated by an item when some
``WINDOW`` characters of the item (all of a shorter one) occur in it with at most ``RATE`` times that many edits. By the q-gram lemma
such a place shares at least w + 1 - q (e + 1) q-grams with the item window, on diagonals that differ by no more than e. Shared q-grams
are counted in bands of diagonals that overlap by e, inside stretches of the window's length; of stretches that reach the bound every
window that can hold one of their shared q-grams is aligned by edit distance within the band, until one is found.

The benchmark is a stated query set: it goes to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one pass over the texts
each, so memory does not grow with it. Items of fewer than ``MIN_CHARS`` characters and null items match nothing; null and empty texts
hold nothing. Repeated items and rows are reported each. Positions count characters of the compared form of the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.llm.text import member, mix, powers, release, slices

Q, WINDOW, RATE, MIN_CHARS = 8, 80, 0.08, 20
BLOCK_CHARS = 2_000_000
HITS = 1_000_000  # shared q-grams that are held at once
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


def _table() -> np.ndarray:
    """Lower case of the characters below 65,536, white space as a space."""
    t = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        if not 0xD800 <= i < 0xE000 and len(c := chr(i).lower()) == 1:
            t[i] = ord(c)
    t[_SPACES] = 32
    return t


_lower: list[np.ndarray] = []


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters in the compared form, offsets of the texts)."""
    if not _lower:
        _lower.append(_table())
    c = np.frombuffer(bytes(buf).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    at = lead[offs]
    c = np.where(c < 65536, _lower[0][np.minimum(c, 65535)], c)
    again = np.zeros(len(c), bool)
    again[1:] = (c[1:] == 32) & (c[:-1] == 32)
    starts = at[:-1][at[:-1] < len(c)]
    again[starts] = False
    kept = np.zeros(len(c) + 1, np.int64)
    np.cumsum(~again, out=kept[1:])
    return c[~again], kept[at]


def grams(c: np.ndarray) -> np.ndarray:
    """Hash of the q characters from each position; the last q - 1 positions have none."""
    n = len(c)
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    m = max(n - Q + 1, 0)
    return mix((sums[Q:Q + m] - sums[:m]) * inverse[:m])


@dataclass
class Index:
    """q-grams of a block of items: ``keys`` sorted, their places ``first[i]:first[i + 1]`` in (item, position)."""

    ids: list
    chars: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    position: np.ndarray
    window: np.ndarray
    edits: np.ndarray

    @staticmethod
    def build(items: Sequence[tuple[object, str]], rate: float = RATE, window: int = WINDOW) -> Index:
        ids, chars, hashes, owner, place = [], [], [], [], []
        for key, text in items:
            raw = np.frombuffer((text or "").strip().encode(), np.uint8)
            c, _ = characters(raw, np.array([0, len(raw)]))
            if len(c) < MIN_CHARS:
                continue
            h = grams(c)
            hashes.append(h)
            owner.append(np.full(len(h), len(ids)))
            place.append(np.arange(len(h)))
            ids.append(key)
            chars.append(c)
        size = np.array([len(c) for c in chars], np.int64)
        w = np.minimum(size, window)
        e = np.minimum((rate * w + 1e-9).astype(np.int64), (w - Q) // Q)
        if not ids:
            return Index([], [], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), w, e)
        h, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        keys, counts = np.unique(h[order], return_counts=True)
        return Index(ids, chars, keys, np.concatenate([[0], np.cumsum(counts)]), owner[order], place[order], w, e)


def stretches(index: Index, c: np.ndarray, offs: np.ndarray, settled: set[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, band start, first item position, last item position) of every stretch that meets the lemma's bound.

    Places of the text are taken in groups of at most ``HITS`` shared q-grams, each group with the places one window on, which any set of
    hits that reaches the bound fits in; so a character repeated over a long text and a long item costs no more memory than other text.
    Pairs in ``settled`` are left out of the groups that follow.
    """
    found = member(index.keys, grams(c))
    pos = np.flatnonzero(found >= 0)
    if not len(pos):
        return
    doc = np.searchsorted(offs, pos, "right") - 1
    inside = pos + Q <= offs[doc + 1]
    pos, doc = pos[inside], doc[inside]
    key = found[pos]
    count = index.first[key + 1] - index.first[key]
    group = (np.cumsum(count) - count) // HITS
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    reach = int((index.window + index.edits).max())
    for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(pos)], strict=True):
        z = z if z == len(pos) else int(np.searchsorted(pos, pos[z - 1] + reach, "right"))
        skip = np.array([d * len(index.ids) + m for d, m in settled or ()], np.int64)
        yield from _group_stretches(index, pos[a:z], doc[a:z], key[a:z], count[a:z], skip)


def _group_stretches(index: Index, pos: np.ndarray, doc: np.ndarray, key: np.ndarray, count: np.ndarray, skip: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    at = np.repeat(index.first[key], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    i, doc = np.repeat(pos, count), np.repeat(doc, count)
    item, j = index.item[at], index.position[at]
    if len(skip):
        left = ~np.isin(doc * len(index.ids) + item, skip)
        i, doc, item, j = i[left], doc[left], item[left], j[left]
    width = np.int64(1 << int(max(index.edits.max(initial=0), 1)).bit_length())
    shift = i - j + (1 << 40)
    band, over = shift // width, shift % width
    more = np.flatnonzero(over < index.edits[item])  # bands overlap by e
    band = np.concatenate([band, band[more] - 1])
    i, doc, item, j = (np.concatenate([x, x[more]]) for x in (i, doc, item, j))
    need = index.window + 1 - Q * (index.edits + 1)
    # a group with too few hits cannot reach the bound: dropped before the sort
    code = mix(item.astype(np.uint64) << np.uint64(44) ^ band.astype(np.uint64) ^ doc.astype(np.uint64) << np.uint64(24))
    slot = (code >> np.uint64(46)).astype(np.int64)
    go = np.bincount(slot, minlength=1 << 18)[slot] >= need[item]
    band, i, doc, item, j = band[go], i[go], doc[go], item[go], j[go]
    order = np.lexsort((i, band, item, doc))
    band, i, doc, item, j = band[order], i[order], doc[order], item[order], j[order]
    ahead = np.arange(len(i)) + need[item] - 1
    ok = ahead < len(i)
    ahead = np.minimum(ahead, max(len(i) - 1, 0))
    ok &= (band[ahead] == band) & (item[ahead] == item) & (doc[ahead] == doc) & (i[ahead] - i <= index.window[item] + index.edits[item] - Q)
    hit = np.flatnonzero(ok)
    if not len(hit):
        return
    # neighbours share hits, as two or more are needed: they form one run
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (band[hit[1:]] != band[hit[:-1]]) | (item[hit[1:]] != item[hit[:-1]]) | (doc[hit[1:]] != doc[hit[:-1]])
    start = hit[new]
    end = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    span = np.column_stack([start, end + need[item[end]]]).ravel()
    low = np.minimum.reduceat(np.append(j, np.iinfo(j.dtype).max), span)[::2]
    high = np.maximum.reduceat(np.append(j, -1), span)[::2]
    last = (-1, -1, -1)
    run: list[int] = []
    for k, lo, hi in zip(start.tolist(), low.tolist(), high.tolist(), strict=True):
        group = (int(doc[k]), int(item[k]), int(band[k]))
        if group == last and run and int(j[k:k + int(need[item[k]])].min()) <= run[4]:
            run[3], run[4] = min(run[3], lo), max(run[4], hi + Q)
        else:
            if run:
                yield tuple(run)
            run = [group[0], group[1], int(band[k] * width - (1 << 40)), lo, hi + Q]
        last = group
    yield tuple(run)


def aligned(pattern: np.ndarray, text: np.ndarray, start: int, low: int, high: int) -> tuple[int, int]:
    """(least edits of the whole pattern against a place of the text, end of that place); the pattern's first character lies on
    the diagonals start + low .. start + high of the text."""
    offset = np.arange(low, high + 1)
    n = len(text)
    row = np.zeros(len(offset), np.int64)
    far = 1 << 30
    for r, ch in enumerate(pattern.tolist()):
        at = start + r + offset
        valid = (at >= 0) & (at < n)
        same = np.zeros(len(offset), bool)
        same[valid] = text[at[valid]] == ch
        new = np.where(valid, row + ~same, far)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new[-1] = min(new[-1], far)
        row = np.minimum.accumulate(new - offset) + offset
    best = int(row.argmin())
    return int(row[best]), int(start + len(pattern) + offset[best])


def all_aligned(p: np.ndarray, w: int, first: int, last: int, text: np.ndarray, base: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """``aligned`` for each window p[j:j + w], first <= j <= last, at base + j, at once: (edits, ends)."""
    n, size = last + 1 - first, high + 1 - low
    offset = np.arange(low, high + 1, dtype=np.int32)
    begin = base + first + low  # place of the text that the first window's lowest diagonal starts from
    near = np.full(n + w + size - 1, -1, np.int64)
    a, z = max(begin, 0), min(begin + len(near), len(text))
    if a < z:
        near[a - begin:z - begin] = text[a:z]
    # row j, column k: near[j + k]
    near = np.lib.stride_tricks.sliding_window_view(near, size)
    row = np.zeros((n, size), np.int32)
    far = 1 << 30
    for r in range(w):
        at = near[r:r + n]
        new = row + (at != p[first + r:first + r + n, None])
        new[at < 0] = far
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new -= offset
        row = np.minimum(np.minimum.accumulate(new, axis=1) + offset, far)
    best = row.argmin(1)
    j = np.arange(n)
    return row[j, best], base + first + j + w + offset[best]


def matches(index: Index, c: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the best verified window of every contaminated (text, item)."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    width = 1 << int(max(index.edits.max(initial=0), 1)).bit_length()
    settled: set[tuple[int, int]] = set()
    failed: dict[int, tuple[int, int, int, bytes]] = {}  # each item's last place that held no window of it
    for doc, item, band, first, last in stretches(index, c, offs, settled):
        if (doc, item) in settled:
            continue
        w, e, p = int(index.window[item]), int(index.edits[item]), index.chars[item]
        text, base = c[offs[doc]:offs[doc + 1]], int(offs[doc])
        lo = max(0, min(first, len(p) - w))
        # a window of the item that holds a shared q-gram starts from first - (w - q) to last - q
        low, high = max(0, min(first - (w - Q), len(p) - w)), max(0, min(last - Q, len(p) - w))
        a, z = band - base + min(lo, low) - e, band - base + max(lo, high) + w + width + 2 * e
        place = (first, last, max(a, 0) - a, text[max(a, 0):max(z, 0)].tobytes())
        if failed.get(item) == place:  # the same characters on the same diagonals, as in repeated ones
            continue
        edits, end = aligned(p[lo:lo + w], text, band - base + lo, -e, width + 2 * e)
        if edits > e:
            every, ends = all_aligned(p, w, low, high, text, band - base, -e, width + 2 * e)
            good = np.flatnonzero(every <= e)
            if not len(good):
                failed[item] = place
                continue
            k = good[np.argmin(np.abs(good + low - lo))]
            edits, end = int(every[k]), int(ends[k])
        best[doc, item] = min(best.get((doc, item), (1 << 30, 0, 0)), (edits, max(end - w, 0), end))
        if edits == 0:
            settled.add((doc, item))
    for (doc, item), (edits, start, end) in sorted(best.items()):
        yield doc, item, start, end, edits


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark in blocks of about block_chars characters."""
    size = benchmark.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)) == k).select(id_col, F.col(text_col).cast("string")).collect()
        yield Index.build(sorted(((r[0], r[1]) for r in rows if r[1] is not None), key=str))


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, start, end, edits): every contaminated text with each item found in it and its best window."""
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind.simpleString(), pa.string())
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind.simpleString() if item_arrow != pa.string() else 'string'}, start bigint, end bigint, edits bigint"
    out = None
    for index in index_blocks(benchmark, item_col, text_col, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for row, buf, offs in slices(b.column(1)):
                    hits = list(matches(index, *characters(buf, offs)))
                    if hits:
                        d, k, s, e, x = (list(v) for v in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([row + v for v in d])), pa.array([index.ids[v] for v in k], item_arrow),
                                                          pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(x, pa.int64())], names=[id_col, item_col, "start", "end", "edits"])
            release()

        found = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    at = df.columns.index(text_col)
    schema = df.schema
    for index in index_blocks(benchmark, item_col, text_col, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, buf, offs in slices(b.column(at)):
                    for hit in matches(shared.value, *characters(buf, offs)):
                        keep[row + hit[0]] = False
                yield b.filter(pa.array(keep))
            release()

        df = df.mapInArrow(run, schema)
    return df


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
