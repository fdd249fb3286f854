"""The text operators against brute force, on small fixtures and on the edge cases they name."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorspark.llm import bpe, decontam, exact, language, licenses, neardup, quality, suffix, toxicity, urls
from factorspark.llm.graph import components
from factorspark.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
EDGE = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a"), (4, "a"), (5, "Ünï 世界 🙂 naïve"), (6, "x" * 9000), (7, "the same words here again " * 500), (8, "the same words here again " * 500), (9, None), (None, "a")]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"key": F.lit(1), "name": F.lit("x"), "size": F.lit(2), "_id": F.lit(3)}) if extra else df


def documents(n=None):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1" + (f" LIMIT {n}" if n else "")).fetchall()


def tiny_ranks():
    """All bytes and a few merges, as a rank file."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaaa", b" a", b" ab", b"cab", b"xa", b"xab"]
    return tokens, b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))


def slow_bpe(raw, ranks):
    parts = [raw[i:i + 1] for i in range(len(raw))]
    if raw in ranks:
        return [ranks[raw]]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_merge_against_brute_force():
    tokens, file = tiny_ranks()
    e, ranks = bpe.Encoder(file), {t: i for i, t in enumerate(tokens)}
    rng = random.Random(1)
    for _ in range(500):
        raw = "".join(rng.choice("aabbcx ") for _ in range(rng.randint(1, 80))).encode()
        ids = e[raw.decode()]
        assert list(memoryview(ids).cast("I")) == slow_bpe(raw, ranks)
        assert e.decode(ids) == raw


def test_bpe_query_as_the_library_does(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.Encoder(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = documents(40) + EDGE
    got = bpe.tokenize(table(spark, rows, True), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    want = Counter((k, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t in rows)
    assert Counter((r[0], tuple(memoryview(bytes(r["ids"])).cast("I")), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)


def test_exact_groups_against_sql_and_with_hash_collisions(spark):
    rows = EDGE + [(10, "a  b"), (11, "a b"), (12, "a\r\nb"), (13, "y" * 9000), (14, "x" * 8999 + "y")]
    want = defaultdict(list)
    for k, t in rows:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    for block, hashed in ((4096, F.xxhash64), (4, lambda b: F.length(b).cast("bigint")), (4096, lambda b: F.lit(1).cast("bigint"))):
        got = exact.groups(table(spark, rows, True), block=block, block_hash=hashed).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = next(v for t, v in want.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            assert r["group_size"] == len(ids) and r["keep_id"] == min((x for x in ids if x is not None), default=None)
        assert sum(r["kept"] for r in got) == len(want)
    kept = exact.drop_duplicates(table(spark, rows, True))
    assert kept.columns == table(spark, rows, True).columns and kept.count() == len(want)
    assert exact.groups(table(spark, [])).count() == 0


def slow_repeats(rows, n=50):
    out, seen = {}, {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            seen[b[i:i + n]] = min(seen.get(b[i:i + n], k), k)
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] < k:
                gone[i:i + n] = True
        out[k] = (len(b), bytes(np.frombuffer(b, np.uint8)[~gone]), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))
    return out


@pytest.mark.parametrize("shard_bytes, hot_shards", [(3_000, 512), (1_000, 2), (1 << 21, 512)])
def test_repeats_against_brute_force(spark, shard_bytes, hot_shards):
    rng = random.Random(5)
    part = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(part) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "z" * 500), (63, "z" * 120), (64, "q" * 49), (65, "q" * 49)]
    got = suffix.repeats(table(spark, rows, True), shard_bytes=shard_bytes, hot_shards=hot_shards).collect()
    want = slow_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], bytes(r["kept"]), len(r["starts"])) == want[r["id"]]
    assert suffix.repeats(table(spark, [])).count() == 0
    again = suffix.repeats(table(spark, [(1, "w" * 80), (1, "w" * 80), (None, "w" * 80)])).collect()
    assert sorted((r["id"] or -1, len(r["kept"])) for r in again) == [(-1, 0), (1, 80), (1, 80)]


def test_suffix_array_keeps_equal_strings_together_at_text_ends():
    """Strings that end with their text lie beside equal ones that go on, whatever follows and whatever is out of the ranges."""
    rng = random.Random(9)
    stem = bytes(rng.choice(b"ab") for _ in range(50))
    texts = [stem, stem[:48] + b"zz" + stem, stem + b"more", stem[:49] + b"!" + b"q" * 70, b"xy" + stem + b"aa"] * 3
    tab = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary())})
    s = suffix.Shard(tab)
    got = suffix.repeated_inside(s, suffix.anchors(s.buf))
    at = [(i, k) for i, b in enumerate(texts) for k in range(len(b) - 49)]
    least = {}
    for i, k in at:
        least.setdefault(texts[i][k:k + 50], i)
    start = {i: int(s.offs[i]) for i in range(len(texts))}
    assert set(np.flatnonzero(got)) == {start[i] + k for i, k in at if least[texts[i][k:k + 50]] < i}


def bag(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def slow_classes(rows):
    bags = {k: bag(t) for k, t in rows if k is not None}
    root = {k: k for k in bags}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in bags}


def near_rows():
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randint(0, 40)) for _ in range(120)]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(w)))
    common = " ".join("shared%d" % i for i in range(60))
    return rows + [(1000 + i, common + " " + " ".join(f"own{i}x{j}" for j in range(40))) for i in range(30)] + [(2000, None), (2001, ""), (2002, "!!!"), (2003, "one two"), (2004, "One, two."), (2005, "r s " * 300), (2006, "r s " * 290)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    df = table(spark, rows, True)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert got == slow_classes(rows)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(got.values()))
    assert neardup.classes(table(spark, [])).count() == 0
    assert neardup.classes(table(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).count() == 2


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(20):
        n = int(rng.integers(20, 200))
        h = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        a = rng.integers(0, 6, n)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 40, n))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = neardup.signatures(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1024)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.03


@pytest.mark.parametrize("edges_a_task", [2, 200_000])
def test_components(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr("factorspark.llm.graph.TASK_EDGES", edges_a_task)
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (33, 31), (40, 41)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 33: 30, 40: 40, 41: 40}


def test_decontamination(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall() + [(900, None), (901, ""), (902, "short")]
    rng = random.Random(2)
    rows = [(i, "Lorem ipsum dolor " * 5 + t + " sit amet" * 9) for i, t in items[:10]]
    for i, t in items[10:20]:
        x = list(t)
        for _ in range(int(len(x) * 0.04)):
            x[rng.randrange(len(x))] = rng.choice(["", "z", "qq"])
        rows.append((i, ("Before. " + "".join(x) + " after.").upper().replace(" ", "\n ")))
    clean = [(1000 + i, "Nothing of that kind is said here, whatever one may think of it. " * 3) for i in range(5)] + [(2000, None), (2001, ""), (2002, "short")]
    df, bench = table(spark, rows + clean, True), spark.createDataFrame(items, "item_id bigint, text string")
    for chars in (2_000, decontam.BLOCK_CHARS):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find(df, bench, block_chars=chars).collect()}
        assert {(k, k) for k, _ in rows} <= got and {d for d, _ in got} == {k for k, _ in rows}
    assert sorted(r[0] for r in decontam.drop_contaminated(df, bench).collect()) == sorted(k for k, _ in clean)
    assert decontam.find(table(spark, []), bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0


def test_decontamination_of_short_passages_in_every_phase():
    """Passages of 80 to 85 characters with 5 to 7 edits, against all windows of all items at all places of the text."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    item = "".join(rng.choice(letters) for _ in range(230)).replace("  ", " x").strip()
    texts = []
    for k in range(300):
        size, at = 80 + k % 6, rng.randrange(0, len(item) - 85)
        x = list(item[at:at + size])
        where = [1, *rng.sample(range(8, size), 4 + k % 3)] if k % 2 else rng.sample(range(size), 5 + k % 3)
        for i in where:
            x[i] = rng.choice(["#", "#", "", x[i] + "#"]) if k % 3 else "#"
        texts.append(("9 8 " * rng.randrange(6) if k % 4 else "") + "".join(x) + ("7 6 " * rng.randrange(6)).rstrip())
    index = decontam.Index.build([(1, item)])
    raw = [t.encode() for t in texts]
    c, offs = decontam.characters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    p, w, e = index.chars[0], 80, 6
    want, starts = set(), np.arange(len(p) - w + 1)
    for d in range(len(texts)):
        t = c[offs[d]:offs[d + 1]]
        row, at = np.zeros((len(starts), len(t) + 1), int), np.arange(len(t) + 1)
        for r in range(w):
            new = row + 1
            new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (t != p[starts + r][:, None]))
            row = np.minimum.accumulate(new - at, axis=1) + at
        if row.min() <= e:
            want.add(d)
    got = list(decontam.matches(index, c, offs))
    assert {x[0] for x in got} == want and 100 < len(want) < 300
    assert all(x[4] <= e for x in got)


def test_alignment_of_all_windows_is_that_of_each():
    rng = random.Random(9)
    for _ in range(60):
        p, t = (np.array([ord(rng.choice("ab")) for _ in range(n)], np.uint32) for n in (12, 20))
        every, ends = decontam.all_aligned(p, 7, 0, 5, t, 2, -5, 9)
        assert list(zip(every.tolist(), ends.tolist(), strict=True)) == [decontam.aligned(p[j:j + 7], t, 2 + j, -5, 9) for j in range(6)]


def test_banded_alignment_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        p, t = ([ord(rng.choice("ab")) for _ in range(n)] for n in (12, 20))
        d = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(t):
                new.append(min(d[j] + (c != x), d[j + 1] + 1, new[j] + 1))
            d = new
        got, _ = decontam.aligned(np.array(p, np.uint32), np.array(t, np.uint32), 0, -14, 24)
        assert got == min(d)


def test_toxicity_and_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = {r[0]: (r[1], r[2]) for r in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{d}/labels.parquet'").fetchall()}
    for name, label, fold, least in (("op3_toxicity", 1, (5, 0), 0.9), ("op5_quality", 0, (4, 2), 0.95)):
        rows = QUERIES[name](spark, d).collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) for r in rows)
        held = [(r["predicted"], labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert sum(a == b for a, b in held) >= least * len(held)


def test_learned_operators_on_edge_cases(spark):
    df, none = table(spark, EDGE, True), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for known in (none, labels):
        model = toxicity.fit(df, known, F.lit(True))
        assert toxicity.score(df, model).count() == len(EDGE)
        assert toxicity.drop_toxic(df, model).columns == df.columns
        assert quality.score(df, quality.fit(df, known, F.lit(True))).count() == len(EDGE)
    assert toxicity.score(table(spark, []), toxicity.Model()).count() == 0
    langs = table(spark, EDGE).withColumn("lang", F.when(F.col("doc_id") > 5, "en"))
    got = language.detect(df, language.fit(langs, F.lit(True))).collect()
    assert len(got) == len(EDGE) and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for r, (_, t) in zip(sorted(got, key=str), sorted(EDGE, key=str), strict=True) if r[0] not in (4,) and r[0] is not None and r[0] in dict(EDGE) and dict(EDGE)[r[0]] == t)
    assert {r["lang_pred"] for r in language.detect(df, language.fit(langs.where("lang = 'zz'"), F.lit(True))).collect()} == {"und"}


def test_language_mixture_and_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{d}/documents.parquet'").fetchall())
    rows = QUERIES["op10_language"](spark, d).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall())
    fr = max((k for k in truth if truth[k] == "fr"), key=lambda k: len(text[k]))
    de = max((k for k in truth if truth[k] == "de"), key=lambda k: len(text[k]))
    model = language.fit(spark.read.parquet(f"{d}/documents.parquet"), F.lit(True))
    (r,) = language.detect(table(spark, [(1, text[fr][:3000] + "\n" + text[de][:2000])]), model).collect()
    assert r["lang_pred"] == "fr" and r["n_languages"] == 2 and 0.4 < r["score"] < 0.8


def test_language_mixture_of_more_than_four(spark):
    rng = random.Random(10)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(40)] for k in "pqrstuv"}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    known = spark.createDataFrame([(i, say(k, 200), k) for i, k in enumerate("pqrstuv" * 12)], "doc_id bigint, text string, lang string")
    model = language.fit(known, F.lit(True))
    rows = [(m, "\n".join(say(k, 150 + 20 * (k == "p")) for k in "pqrstuv"[:m])) for m in range(1, 8)]
    got = {r[0]: r for r in language.detect(table(spark, rows), model).collect()}
    assert [got[m]["n_languages"] for m in range(1, 8)] == list(range(1, 8))
    assert all(got[m]["lang_pred"] == "p" and abs(got[m]["score"] - 170 / (170 + 150 * (m - 1))) < 0.05 for m in range(1, 8))


def test_licenses_against_brute_force(spark):
    rows = documents() + EDGE + [(800, "Released under the MIT licence. Under the MIT License, under the mit license"), (801, "x " * 300 + "Apache License, Version 2.0 " + "y " * 300),
                                 (802, "you may obtain a copy of the License at www.apache.org/licenses/LICENSE-2.0 and you may not use this file except in compliance with the License")]
    got = licenses.scan(table(spark, rows, True)).collect()
    assert len(got) == len(rows)
    want = []
    for k, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        want.append((k, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in got)
    by = {r[0]: r for r in got}
    assert by[802]["labels"] == "apache-2" and by[802]["score"] >= 0.85


def test_similarity_join_is_exact():
    plan = licenses.Plan({}, licenses.TEMPLATES, 0.6)
    rng = random.Random(6)
    vocabulary = " ".join(t for _, t in licenses.TEMPLATES).split() + ["noise%d" % i for i in range(20)]
    text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150))) for _ in range(200)).encode()
    buf = np.frombuffer(text, np.uint8)
    words = licenses.Words(buf, np.array([0, len(buf)]))
    plan.order({i: rng.randint(0, 9) for i in range(len(plan.words))})
    first, template, _ = licenses.meets(plan, words, buf)
    a, z = licenses.blocks(words, buf)
    want = {(int(x), t) for x, y in zip(a, z, strict=True) for t, s in enumerate(plan.sets) if len(set(words.hash[x:y].tolist()) & set(s.tolist())) >= plan.need[t]}
    assert set(zip(first.tolist(), template.tolist(), strict=True)) == want and want


def test_license_windows_are_exact():
    long = ("bsd", " ".join("w%d" % i for i in range(64)))
    plan = licenses.Plan({}, (*licenses.TEMPLATES, long), 0.7)
    rng = random.Random(7)
    vocabulary = " ".join(t for _, t in licenses.TEMPLATES).split() + ["noise%d" % i for i in range(20)]
    texts = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    notices = [t for _, t in (*licenses.TEMPLATES, long)]
    for _ in range(40):
        source = rng.choice(notices).split()
        spread = [x for w in source if rng.random() < 0.85 for x in [w, *(["noise1"] if rng.random() < 0.5 else [])]]
        texts.append("\n".join(["a b c d e f g"] * rng.randint(0, 3) + [" ".join(spread[i:i + 4]) for i in range(0, len(spread), 4)] + [rng.choice(notices)]))
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    words = licenses.Words(buf, offs)
    plan.order({i: rng.randint(0, 9) for i in range(len(plan.words))})
    want = {}
    for d in range(len(texts)):
        h = words.hash[words.first[d]:words.first[d + 1]].tolist()
        for t, s in enumerate(plan.sets):
            best = max((len(set(h[i:i + plan.reach[t]]) & set(s.tolist())) for i in range(len(h))), default=0)
            if best >= plan.need[t]:
                want[d, t] = best / len(s)
    first, end, template, share = licenses.wrapped(plan, words)
    got = defaultdict(float)
    for d, t, x in zip(words.text_of()[first].tolist(), template.tolist(), share.tolist(), strict=True):
        got[d, t] = max(got[d, t], x)
    assert got == want and len(want) > 40 and (end > first).all()


def test_wrapped_and_long_license_notices(spark):
    rows = [(1, "# This work is licensed under the GNU General Public\n# License, version 3"),
            (2, " * Permission is hereby granted, free of charge,\n * to any person obtaining a copy\n * of this software and associated\n * documentation files"),
            (3, "Redistribution and use in source and binary\nforms, with or without modification,\nare permitted provided that\nthe following conditions are met"),
            (4, "you may not use this file except in compliance\nwith the License. You may obtain a copy of\nthe License at www.apache.org/licenses/LICENSE-2.0"),
            (5, "This work is licensed under the GNU General Public License, version 3"), (6, "This work is\n" + "other\n" * 60 + "licensed under the GNU General Public\n" + "other " * 60 + "License, version 3")]
    got = {r[0]: r for r in licenses.scan(table(spark, rows)).collect()}
    assert [got[k]["labels"] for k in range(1, 7)] == ["gpl-3", "mit", "bsd", "apache-2", "gpl-3", ""]
    assert all(got[k]["score"] >= 0.85 and got[k]["n_blocks"] == 1 for k in range(1, 6)) and got[6]["n_blocks"] == 0
    names = ["w%d" % i for i in range(70)]
    rows = [(1, "\n".join(names)), (2, " ".join(names)), (3, " ".join(names[:55]))]
    got = {r[0]: (r["labels"], r["score"]) for r in licenses.scan(table(spark, rows), {}, [("own", " ".join(names))]).collect()}
    assert got == {1: ("own", 1.0), 2: ("own", 1.0), 3: ("", 0.0)}


def test_urls_against_brute_force(spark):
    rules = [*urls.RULES, ("allow", "b.example.net", "/"), ("block", "b.example.net", "/x"), ("block", "com", "/"), ("allow", "localhost", "/"), ("block", "a.b.c.d.org", "/fr/x")]
    hosts = ["example.net", "A.b.Example.NET", "b.example.net", "bexample.net", "net", "com", "localhost", "x.localhost", "a.b.c.d.org", "z.a.b.c.d.org", "d.org", "", "example.com"]
    rows = [(i, f"{s}{h}{p}") for i, (s, h, p) in enumerate((s, h, p) for s in ("http://", "x") for h in hosts for p in ("", "/", "/en/1?q=/fr/", "/fr/x/y#z", "/de/", "?a", "/x"))] + [(-1, None), (-2, ""), (-2, "://")]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("q")), urls.rule_table(spark, rules)).collect()
    assert len(got) == len(rows)
    want = []
    for k, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((k, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"))
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = c.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    got = QUERIES[name](spark, SMALL).select(names).collect()
    rows = want.fetchall()
    assert rows and Counter(map(tuple, got)) == Counter(rows)


def test_repeats_query_against_brute_force(spark):
    want = slow_repeats(documents())
    got = QUERIES["op2_repeats"](spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        n, kept, spans = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_near_duplicate_query_against_brute_force(spark):
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op4_neardup"](spark, SMALL).collect()} == slow_classes(documents())


def test_text_helpers_on_sliced_arrow_columns():
    from factorspark.llm.text import buffers

    column = pa.array(["ab", None, "é", "", "x"])[1:4]
    buf, offs = buffers(column)
    assert bytes(buf) == "é".encode() and offs.tolist() == [0, 0, 2, 2]


def test_quality_learns_from_every_labelled_row(spark):
    """20,000 labelled texts: the means of the model are those of all of them, not of 8,000 per class."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 1 + CAST(pmod(id * 31, 50) AS INT)) AS text")
    labels = df.selectExpr("doc_id", "CAST(pmod(doc_id * 31, 50) >= 25 AS BIGINT) AS quality")
    model = quality.fit(df, labels, F.lit(True))
    size = df.selectExpr("avg(log1p(length(text)))").first()[0]
    assert np.isclose(model.centre[0], size, rtol=1e-9)
    got = quality.score(df, model).join(labels, "doc_id").selectExpr("avg(CAST((score >= 0.7) = (quality = 1) AS INT))").first()[0]
    assert got > 0.97
