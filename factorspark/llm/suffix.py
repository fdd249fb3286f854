"""Repeated byte strings by suffix arrays: every ``LENGTH``-byte string that also starts in a text with a smaller id is removed.

Shards. Texts that share most of their content land in one shard of about ``SHARD_BYTES`` bytes (by the least hash of their 16-byte
strings); content of more bytes than that is spread over as many shards as it needs.

Anchors. The anchor of a string is the least hash of the ``GRAM``-byte strings inside it, so equal strings have equal anchors. A stretch is a
run of neighbouring strings with one anchor. Only strings whose anchor has two stretches can repeat.

Inside a shard: a suffix array of the text under repeated anchors by Larsson-Sadakane refinement in numpy (sort by 8 bytes, then double
the compared length over the groups that are still tied, up to ``LENGTH`` bytes), and Kasai's common prefixes of neighbours, computed in
text order where the neighbour changes and carried on, less one, where it does not. Groups of suffixes with a common prefix of
``LENGTH`` bytes give the strings that a smaller id of the same shard holds.

Across shards: anchors are compared first. Stretches that are still there and whose anchor occurs in another shard go with their text,
as runs sorted by anchor and cut at the bucket borders by binary search, to merge buckets. There equal stretches are settled whole, and
the strings of the different stretches of one anchor one by one; the places of greater ids go back. An anchor of ``HOT_SHARDS`` or more
shards is cut into single strings that are spread by their own hash, so no bucket grows with a frequent phrase.
Text is shuffled once, and the exchange is used three times.

Strings are judged on the input; overlaps count; nothing crosses texts. Null counts as empty. Texts shorter than ``LENGTH`` stay whole.
Rows with equal ids do not remove each other's bytes; a null id counts as greater than all others. Repeated rows have a result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.llm.text import Rolling, buffers, mix, slices
from factorspark.session import scratch_path

#: Anchors are strings of GRAM bytes, a multiple of 8. Shorter ones repeat by chance, longer ones are more.
LENGTH, GRAM, BLOCK = 50, 24, 1 << 15
SHARD_BYTES, BUCKET_BYTES, MIN_BUCKETS = 2 << 20, 16 << 20, 48
#: From so many shards on, the strings of an anchor are spread one by one. A partition of texts holds about PARTITION_BYTES.
#: A merge bucket compares about SETTLE_BYTES strings at a time.
HOT_SHARDS, PARTITION_BYTES, SETTLE_BYTES = 512, 128 << 20, 1 << 20
#: Shards of split content are joined by broadcast up to so many rows.
BROADCAST_ROWS = 100_000
STRIDE = 1024
#: Least words with 1..8 leading bytes of ones.
_LEADING = np.array([2 ** 64 - 2 ** (64 - 8 * k) for k in range(1, 9)], np.uint64)
_LAST = np.iinfo(np.int64).max


def grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, texts ignored."""
    n = max(len(buf) - GRAM + 1, 0)
    words = np.ndarray((max(len(buf) - 7, 0),), "<u8", np.ascontiguousarray(buf), strides=(1,))
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out += words[k:k + n] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    return mix(out)


def anchors(buf: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place with ``length`` bytes after it (texts ignored): the least hash of the ``GRAM``-byte strings of that string."""
    n, span = max(len(buf) - length + 1, 0), length - GRAM + 1
    out = np.zeros(n, np.uint64)
    # blocks that stay in the cache
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        h, have = grams(buf[at:stop + length - 1]), 1
        while have < span:
            step = min(have, span - have)
            h = np.minimum(h[:-step], h[step:])
            have += step
        out[at:stop] = h
    return out


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that sorts like the bytes; zeros after the end. A view; index it to get values."""
    return np.ndarray((len(buf),), ">u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def stretches(a: np.ndarray, left: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of strings of one text with one anchor."""
    valid = left[:len(a)] >= length
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = valid[1:] & valid[:-1] & (a[1:] == a[:-1]) if len(a) else False
    return np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:]) + 1


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Places 0..n-1 inside one of the ranges."""
    step = np.bincount(first, minlength=n + 1)[:n + 1] - np.bincount(np.minimum(last, n), minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def suffix_array(buf: np.ndarray, left: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the ranges whose first ``length / 2`` or more bytes are not unique, sorted by exactly their first ``length`` bytes
    (8 at least). Each place must have ``length`` bytes left. Ranks are made only for the bytes that these strings cover."""
    at = np.flatnonzero((left >= 8) & covered(first, last + length - 8, len(buf)))
    key = words8(buf)[at].astype(np.uint64)
    order = np.argsort(key)
    sa, key = at[order], key[order]
    rank = np.zeros(len(buf), np.int64)
    new = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank[sa] = start
    depth = 8
    while depth < length:
        # the last step overlaps the one before, so that no byte after ``length`` counts
        step = min(depth, length - depth)
        # a group of one is done; a place with too few bytes left takes no further part
        size = np.diff(np.append(np.flatnonzero(new), len(sa)))
        go = (np.repeat(size, size) > 1) & (left[sa] >= depth + step)
        if depth + step == length:
            go &= covered(first, last, len(buf))[sa]
        sa, start = sa[go], start[go]
        if not len(sa):
            return sa
        second = rank[sa + step]
        order = np.argsort(start.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))
        sa, start, second = sa[order], start[order], second[order]
        changed = np.append(True, start[1:] != start[:-1])
        new = changed | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(sa))
        start = start + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(changed, place, 0))
        rank[sa] = start
        depth += step
    # ties by place: then neighbours move along together in the text
    return sa[np.argsort(start.astype(np.uint64) << np.uint64(32) | sa.astype(np.uint64))]


def common_prefixes(buf: np.ndarray, sa: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix of ``sa`` with the one before it (0 for the first), inside their texts; exact up to ``length``, and
    at least ``length`` where it is longer."""
    before = np.full(len(buf) + 1, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.sort(sa[1:])
    partner = before[at]
    place = np.arange(len(at))
    # bytes are compared where the partner does not move along, and anew every STRIDE places so that all comparisons are short
    fresh = place % STRIDE == 0
    fresh[1:] |= (at[1:] != at[:-1] + 1) | (partner[1:] != partner[:-1] + 1)
    start = np.flatnonzero(fresh)
    i, j = at[start], partner[start]
    words = words8(buf)
    limit = np.minimum(np.minimum(left[i], left[j]), np.diff(np.append(start, len(at))) + length)
    got = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        differ = words[a].astype(np.uint64) ^ words[b].astype(np.uint64)
        # equal leading bytes: the first byte is the highest one of the word
        got[live] += np.searchsorted(_LEADING, ~differ, side="right")
        live = live[(differ == 0) & (got[live] < limit[live])]
    got = np.minimum(got, limit)
    # where the partner moves along, the common prefix is one less
    value = got[np.cumsum(fresh) - 1] - (place - np.maximum.accumulate(np.where(fresh, place, 0)))
    out = np.zeros(len(buf) + 1, np.int64)
    out[at] = np.minimum(value, np.minimum(left[at], left[partner]))
    lcp = out[sa]
    lcp[:1] = 0
    return lcp


class Shard:
    """The texts of one shard, in an order that does not depend on arrival."""

    def __init__(self, table: pa.Table):
        ids, column = table["id"].combine_chunks(), table["text"].combine_chunks()
        raw, offs = buffers(column)
        value = np.where(np.asarray(ids.is_null()), _LAST, ids.fill_null(0).to_numpy(zero_copy_only=False))
        digest = Rolling(raw, raw=True).hash(offs[:-1], offs[1:]) if len(offs) > 1 else np.zeros(0, np.uint64)
        order = np.lexsort((digest, value))
        size = np.diff(offs)[order]
        self.ids = ids.take(pa.array(order))
        self.offs = np.concatenate([[0], np.cumsum(size)])
        self.buf = raw[np.repeat(offs[:-1][order] - self.offs[:-1], size) + np.arange(self.offs[-1])]
        doc = np.repeat(np.arange(len(size)), size)
        self.left = self.offs[1:][doc] - np.arange(self.offs[-1])
        self.doc = value[order][doc]


def fingerprints(buf: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the strings of ``length`` bytes from ``at``."""
    words = words8(buf)
    first = Rolling(buf, raw=True).hash(at, at + length)
    second = np.zeros(len(at), np.uint64)
    for k, off in enumerate([*range(0, length - 8, 8), length - 8]):
        second = mix(second + words[at + off].astype(np.uint64) * np.uint64(2 * (k + 1) * 0x2545F4914F6CDD1D % 2 ** 64 | 1))
    return first, second


def _pack6(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Places that cut sorted 64-bit values into equal ranges, by binary search."""
    borders = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(values, borders), [len(values)]])


def _runs(places: np.ndarray) -> np.ndarray:
    """Sorted places as (first, last + 1) of their runs."""
    if not len(places):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.append(True, places[1:] != places[:-1] + 1))
    return np.stack([places[new], np.append(places[new[1:] - 1], places[-1]) + 1], axis=1)


def repeated_inside(s: Shard, a: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the shard whose string also starts in a text of the shard with a smaller id."""
    gone = np.zeros(len(s.buf), bool)
    first, last = stretches(a, s.left, length)
    _, which, count = np.unique(a[first], return_inverse=True, return_counts=True)
    again = count[which] > 1
    sa = suffix_array(s.buf, s.left, first[again], last[again], length)
    if len(sa):
        begin = np.flatnonzero(common_prefixes(s.buf, sa, s.left, length) < length)
        least = np.minimum.reduceat(s.doc[sa], begin)
        gone[sa[s.doc[sa] > np.repeat(least, np.diff(np.append(begin, len(sa))))]] = True
    return gone


def _in(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), bool)


def text_sizes(size: np.ndarray, length: int) -> np.ndarray:
    """Bytes of the stretches' texts; a single string of a hot anchor carries none."""
    return np.where(size > 0, size + length - 1, 0)


def still_there(s: Shard, a: np.ndarray, gone: np.ndarray, known: np.ndarray, hot: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Stretches with a string that is not gone and an anchor of ``known``, and single strings with one of ``hot``, sorted by anchor
    (of a single string: its own hash). The text of a stretch has ``size + length - 1`` bytes; a single string has size 0 and no text."""
    first, last = stretches(a, s.left, length)
    stays = np.concatenate([[0], np.cumsum(~gone)])
    open_ = stays[last] > stays[first]
    first, last = first[open_], last[open_]
    anchor = mix(a[first])
    low = anchor & np.uint64((1 << 48) - 1)
    whole, single = _in(known, low), np.flatnonzero(covered(*(x[_in(hot, low)] for x in (first, last)), len(s.buf)) & ~gone)
    one, two = fingerprints(s.buf, single, length) if len(single) else (np.zeros(0, np.uint64),) * 2
    digest = Rolling(s.buf, raw=True).hash(first[whole], last[whole] + length - 1)
    begin = np.concatenate([first[whole], single])
    size = np.concatenate([last[whole] - first[whole], np.zeros(len(single), np.int64)])
    anchor, digest = np.concatenate([anchor[whole], one]), np.concatenate([digest, two])
    order = np.argsort(anchor, kind="stable")
    begin, size = begin[order], size[order]
    span = text_sizes(size, length)
    text = s.buf[np.repeat(begin - np.cumsum(span) + span, span) + np.arange(span.sum())]
    return {"anchor": anchor[order], "hash": digest[order], "doc": s.doc[begin], "place": begin.astype("<u4"), "size": size.astype("<u4"), "text": text}


def settle(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, size: np.ndarray, text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first, last + 1): the strings of each stretch that a smaller id holds, as ranges inside the stretch.

    Works through the anchors in order, about ``SETTLE_BYTES`` bytes of stretches at a time."""
    offs = np.concatenate([[0], np.cumsum(text_sizes(size, length))])
    order = np.argsort(anchor, kind="stable")
    volume = np.cumsum(size[order]) // SETTLE_BYTES
    new = np.append(True, anchor[order][1:] != anchor[order][:-1])
    # a part ends at the last stretch of an anchor
    part = np.maximum.accumulate(np.where(new, volume, 0))
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    found = [_settle(order[x:y], anchor, digest, doc, size, offs, text, length) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else [()] * 3))


def _settle(rows: np.ndarray, anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, size: np.ndarray, offs: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = rows[np.lexsort((doc[rows], size[rows], digest[rows], anchor[rows]))]
    a, same = anchor[order], np.zeros(len(order), bool)
    same[1:] = (a[1:] == a[:-1]) & (digest[order][1:] == digest[order][:-1]) & (size[order][1:] == size[order][:-1])
    begin = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    greater = doc[order] > doc[order][begin][group]
    done = order[greater]
    # an anchor with several different stretches: compare their strings
    several = np.zeros(len(begin), bool)
    several[1:] = a[begin][1:] == a[begin][:-1]
    several[:-1] |= several[1:]
    rest = order[several[group] & ~greater]
    if not size[rest].any():
        return done, np.zeros(len(done), np.int64), np.maximum(size[done], 1)
    record = np.repeat(rest, size[rest])
    inner = np.arange(len(record)) - np.repeat(np.cumsum(size[rest]) - size[rest], size[rest])
    # only the text of this part is hashed
    span = text_sizes(size[rest], length)
    base = np.cumsum(span) - span
    own = text[np.repeat(offs[rest] - base, span) + np.arange(span.sum())]
    one, two = fingerprints(own, np.repeat(base, size[rest]) + inner, length)
    order = np.lexsort((two, one))
    one, two, d = one[order], two[order], doc[record][order]
    begin = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    hit = np.sort(order[d > np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(d))))])
    new = np.append(True, (record[hit][1:] != record[hit][:-1]) | (inner[hit][1:] != inner[hit][:-1] + 1))[:len(hit)]
    starts = hit[new]
    ends = np.append(np.flatnonzero(new)[1:], len(hit))[:len(starts)] - 1
    return np.concatenate([done, record[starts]]), np.concatenate([np.zeros(len(done), np.int64), inner[starts]]), np.concatenate([np.maximum(size[done], 1), inner[hit[ends]] + 1])


def _keyed(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(id, text, key, size): the least hash of its ``GRAM``-byte strings; a text without one gets a hash of its place in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in slices(b.column(1)):
                n = len(offs) - 1
                key = mix(np.arange(row, row + n, dtype=np.uint64))
                long = np.flatnonzero(np.diff(offs) >= length)
                if len(long):
                    edges = np.stack([offs[long], offs[long + 1] - GRAM + 1], axis=1).reshape(-1)
                    hashes = np.append(grams(buf), np.uint64(2 ** 64 - 1))
                    key[long] = np.minimum.reduceat(hashes, edges)[::2]
                ids = b.column(0).slice(row, n)
                yield pa.RecordBatch.from_arrays([ids, b.column(1).slice(row, n), pa.array(key.view(np.int64)), pa.array(np.diff(offs))], names=["id", "text", "key", "size"])

    rows = df.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return rows.mapInArrow(run, "id bigint, text binary, key bigint, size bigint")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """(id, n_bytes, kept binary, starts, ends): the bytes that stay and the removed runs of every row."""
    spark = df.sparkSession
    keyed = _keyed(df, id_col, text_col, length)
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    path = scratch_path(spark, "repeats-heavy")
    sizes = keyed.groupBy("key").agg(F.sum("size").alias("bytes"))
    sizes.where(F.col("bytes") > shard_bytes // 2).select("key", F.ceil(F.col("bytes") / (shard_bytes // 2)).alias("parts")).write.parquet(path)
    heavy = spark.read.parquet(path)
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    n_shards = max(1, -(-total // shard_bytes))
    n_buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    part = F.pmod(F.xxhash64("id", "size"), F.coalesce("parts", F.lit(1)))
    texts = keyed.join(heavy, "key", "left").select(F.pmod(F.xxhash64("key", part), F.lit(n_shards)).cast("int").alias("shard"), "id", "text").repartition(n_parts, "shard")

    def anchored(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        s = Shard(table)
        a = anchors(s.buf, length)
        a = np.unique(mix(a[stretches(a, s.left, length)[0]]))
        cut = _cuts(a, n_buckets)
        rows = [(k, shard, _pack6(a[x:y])) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        runs = [_unpack6(x.as_py()) for x in table["data"]]
        values, count = np.unique(np.concatenate(runs), return_counts=True)
        out: dict[str, list] = {"shard": [], "hot": [], "data": []}
        for hot, chosen in ((False, values[(count > 1) & (count < hot_shards)]), (True, values[count >= hot_shards])):
            for shard, run in zip(table["shard"].to_pylist() if len(chosen) else [], runs, strict=False):
                hit = run[chosen[np.minimum(np.searchsorted(chosen, run), len(chosen) - 1)] == run]
                if len(hit):
                    out["shard"].append(shard)
                    out["hot"].append(hot)
                    out["data"].append(_pack6(hit))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "hot": pa.array(out["hot"], pa.bool_()), "data": pa.array(out["data"], pa.binary())})

    def inside(table: pa.Table, known: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in _ASKED}
        if table.num_rows:
            shard = table["shard"][0].as_py()
            s = Shard(table)
            a = anchors(s.buf, length)
            gone = repeated_inside(s, a, length)
            for k, v in {"dest": -1 - shard, "shard": shard, "place": _runs(np.flatnonzero(gone)).astype("<i8").tobytes()}.items():
                out[k].append(v)
            for k in ("anchor", "hash", "doc", "size", "text"):
                out[k].append(b"")
            wanted = [[_unpack6(x) for x, h in zip(known["data"].to_pylist(), known["hot"].to_pylist(), strict=True) if h == hot] for hot in (False, True)] if known.num_rows else [[], []]
            sent = still_there(s, a, gone, *[np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in wanted], length)
            first = np.concatenate([[0], np.cumsum(text_sizes(sent["size"].astype(np.int64), length))])
            cut = _cuts(sent["anchor"], n_buckets)
            for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    out["dest"].append(k)
                    out["shard"].append(shard)
                    out["text"].append(sent["text"][first[x]:first[y]].tobytes())
                    for name in ("anchor", "hash", "doc", "place", "size"):
                        out[name].append(sent[name][x:y].tobytes())
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(_ASKED.items(), out.values(), strict=True)})

    def merged(table: pa.Table) -> pa.Table:
        if table["dest"][0].as_py() < 0:
            return pa.table({"shard": table["shard"], "runs": table["place"]})
        shards = table["shard"].to_pylist()
        anchor, digest, doc, place, size = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table[k]]) for k, t in (("anchor", np.uint64), ("hash", np.uint64), ("doc", np.int64), ("place", "<u4"), ("size", "<u4")))
        owner = np.repeat(np.arange(len(shards)), [len(x.as_py()) // 8 for x in table["anchor"]])
        text = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["text"]])
        record, begin, end = settle(anchor, digest, doc, size.astype(np.int64), text, length)
        place = place.astype(np.int64)[record]
        rows = [(k, np.stack([place[mine] + begin[mine], place[mine] + end[mine]], axis=1).astype("<i8").tobytes()) for k, mine in ((shards[o], owner[record] == o) for o in np.unique(owner[record]))]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "runs": pa.array([r[1] for r in rows], pa.binary())})

    def cut_out(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _RESULT.items()})
        s = Shard(table)
        n = len(s.buf)
        delta = np.zeros(n + length + 1, np.int64)
        for x in found["runs"]:
            run = np.frombuffer(x.as_py(), "<i8").reshape(-1, 2)
            np.add.at(delta, run[:, 0], 1)
            np.add.at(delta, run[:, 1] + length - 1, -1)
        gone = np.cumsum(delta)[:n] > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        tail = gone.copy()
        tail[:-1] &= ~gone[1:]
        inner = s.offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        edge[inner] = gone[inner]
        tail[inner - 1] = gone[inner - 1]
        starts, ends = np.flatnonzero(edge), np.flatnonzero(tail) + 1
        where = np.searchsorted(starts, s.offs)
        base = np.repeat(s.offs[:-1], np.diff(where))
        lists = [pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(x - base)) for x in (starts, ends)]
        kept = [s.buf[a:z][~gone[a:z]].tobytes() for a, z in zip(s.offs[:-1], s.offs[1:], strict=True)]
        return pa.table({"id": s.ids, "n_bytes": pa.array(np.diff(s.offs)), "kept": pa.array(kept, pa.binary()), "starts": lists[0], "ends": lists[1]})

    by_bucket = texts.groupBy("shard").applyInArrow(anchored, "bucket int, shard int, data binary")
    elsewhere = by_bucket.groupBy("bucket").applyInArrow(shared, "shard int, hot boolean, data binary")
    asked = texts.groupBy("shard").cogroup(elsewhere.groupBy("shard")).applyInArrow(inside, "dest int, shard int, anchor binary, hash binary, doc binary, place binary, size binary, text binary")
    places = asked.groupBy("dest").applyInArrow(merged, "shard int, runs binary")
    return texts.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(cut_out, "id bigint, n_bytes bigint, kept binary, starts array<bigint>, ends array<bigint>")


_ASKED = {"dest": pa.int32(), "shard": pa.int32(), "anchor": pa.binary(), "hash": pa.binary(), "doc": pa.binary(), "place": pa.binary(), "size": pa.binary(), "text": pa.binary()}
_RESULT = {"id": pa.int64(), "n_bytes": pa.int64(), "kept": pa.binary(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
