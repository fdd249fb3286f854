"""Token alignment, collocations and SimHash against brute force, on small fixtures and on the edge cases they name."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.llm import alignment, collocations, simhash

SMALL = "/root/testdata/sf0.001"
EDGE = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a"), (4, "a"), (5, "Ünï 世界 🙂 naïve"), (6, "x" * 9000), (7, "the same words here again " * 500), (8, "the same words here again " * 500), (9, None), (None, "a"),
        (10, "<|endoftext|> <s> <unk> <0x41>"), (11, "a▁b"), (12, "  two  blanks "), (13, "\x00\x01 control \x1f"), (14, "-" * 300_000), (15, "word " * 60_000)]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"sha": F.lit(1), "key": F.lit(1), "fp": F.lit("x"), "block": F.lit(2), "copies": F.lit(3), "id": F.lit(4), "root": F.lit(5)}) if extra else df


def documents(n=None):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1" + (f" LIMIT {n}" if n else "")).fetchall()


# token alignment


def slow_alignment(rows):
    """Measures of every row and the pair counts, token by token."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found, counts = [], Counter()
    for key, text in rows:
        x, y = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        xb = [ranks[i] for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = b" " + (text or "").encode()
        if not text or b"".join(xb) != raw or b"".join(yb) != raw:
            found.append((key, [], [], [], []))
            continue
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        links, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            step = (xe[i] <= ye[j], ye[j] <= xe[i])
            i, j = i + step[0], j + step[1]
        ends = sorted(set(xe) & set(ye))
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(t) for t, q in zip(x, xe) if low < q <= e) + "|" + ",".join(str(t) for t, q in zip(y, ye) if low < q <= e)) if len(x) < 3000 else None
            low = e
        counts.update(links)
        found.append((key, x, y, links, groups))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for key, x, y, links, groups in found:
        out.append((key, len(x), len(y), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups) if groups and None not in groups else None))
    return out, counts, best


@pytest.mark.parametrize("block_bytes", [2_000, 8 << 20])
def test_alignment_against_brute_force(spark, block_bytes):
    import public_tokenizers as P

    rows = documents(40) + EDGE + documents(5)
    want, counts, best = slow_alignment(rows)
    got, pairs = alignment.align(table(spark, rows, True), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN if block_bytes > 2_000 else None, block_bytes=block_bytes)
    got = got.collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"]) for r in got) == Counter(w[:6] for w in want)
    groups = {(w[0], w[1], w[2]): w[6] for w in want if w[6] is not None}
    for r in got:
        if (r["doc_id"], r["n_a"], r["n_b"]) in groups:
            assert r["groups"] == groups[r["doc_id"], r["n_a"], r["n_b"]]
        assert r["n_groups"] == r["groups"].count("|")
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_alignment_digests_empty_table_and_texts_without_tokens(spark):
    import public_tokenizers as P

    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert alignment.align(table(spark, []), *files)[0].count() == 0
    got = {r["doc_id"]: r for r in alignment.align(table(spark, EDGE[:8]), *files, with_groups=False)[0].collect()}
    assert [got[1][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")] == [0] * 6 + [""]
    full = {r["doc_id"]: r["groups"] for r in alignment.align(table(spark, EDGE[:8]), *files)[0].collect()}
    assert got[5]["groups"] == hashlib.sha256(full[5].encode()).hexdigest()


# collocations


def slow_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = [p for p, a in c.items() if len(p) > 1 and a >= least]
        inner = defaultdict(int)
        for p in candidates:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i:i + m]] = max(inner[p[i:i + m]], c[p])
        ranked = []
        for p in candidates:
            if 100 * inner[p] >= 100 * c[p]:
                continue
            score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def spoken(rng, n):
    words = ["the", "The", "of", "in", "new", "york", "is", "a", "big", "city", "Ünï", "世界", "x\x1fy", "a" * 300]
    phrases = ["new york city", "in spite of", "a a a a", "is  a\tbig", "x.y", "end\nof line", "one;two"]
    return [(rng.choice(["en", "en", "en", "de", None]), " ".join(rng.choice(words + phrases) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("block_words, bits", [(1 << 20, 64), (50, 64), (400, 9)])
def test_collocations_against_brute_force(spark, block_words, bits):
    rows = spoken(random.Random(5), 400) + [(None, None), ("de", ""), ("en", " , . "), ("en", "x" * 100_000), ("fr", "loin de tout " * 3000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"f": F.lit(1), "n": F.lit(2), "phrase": F.lit("x"), "block": F.lit(3)}).repartition(3)
    got = collocations.collocations(df, min_count=20, top=60, block_words=block_words, bits=bits).collect()
    want = slow_collocations(rows, 20, 60)
    assert len(want) > 60 and sorted(tuple(r) for r in got) == want


def test_collocations_top_in_parts_and_empty_table(spark):
    rows = spoken(random.Random(6), 300)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(df, min_count=3, top=2).collect()  # more than 100 x top candidates: ranked in parts first
    assert sorted(tuple(r) for r in got) == slow_collocations(rows, 3, 2)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", "a b", 2, 3 * 10 ** 12), ("en", "a", 1, 7 * 10 ** 12), ("en", "b", 1, 5 * 10 ** 12)], "lang string, phrase string, size int, f bigint")
    row = collocations.scored(counted, spark.createDataFrame([("en", 10 ** 17 + 1)], "lang string, n bigint")).first()
    assert row["score"] == 1000 * 3 * 10 ** 12 * (10 ** 17 + 1) // (35 * 10 ** 24)


# SimHash


def slow_fingerprint(text):
    import xxhash

    words = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Least key that can be reached from each print over three bits or fewer."""
    fps = sorted(set(prints))
    above = {f: f for f in fps}

    def top(f):
        while above[f] != f:
            f = above[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                above[top(f)] = top(g)
    return {f: top(f) for f in fps}


def test_golay_keys_reach_every_fingerprint_within_three_bits():
    assert (simhash.ERRORS >= 0).all() and (np.bitwise_count(simhash.ERRORS) <= 3).all()
    rng = random.Random(3)
    for errors in (0, 1, 2, 3):
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), errors):
                b ^= 1 << bit
            x, y = (set(simhash.keys(np.array([v], np.uint64))[1].tolist()) for v in (a, b))
            assert x & y


@pytest.mark.parametrize("many", [1, 40])
def test_simhash_clusters_against_brute_force(spark, many):
    """Random fingerprints, chains at three bits, and dense clusters whose members share nearly all keys."""
    rng = random.Random(many)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(30):  # a chain
            for bit in rng.sample(range(64), rng.choice([3, 3, 4])):
                f ^= 1 << bit
            fps.append(f)
        centre = rng.getrandbits(64)
        for _ in range(10 * many):
            g = centre
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
                g ^= 1 << bit
            fps.append(g)
    want = slow_components(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in want}
    got = {r["fp"]: r["root"] for r in simhash.clusters(spark.createDataFrame([(v,) for v in signed.values()], "fp bigint")).collect()}
    together = defaultdict(set)
    for f in want:
        together[want[f]].add(f)
    for members in together.values():
        if len(members) == 1:
            assert signed[next(iter(members))] not in got
        else:
            assert {got[signed[f]] for f in members} == {min(signed[f] for f in members)}


def test_simhash_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "Delta"]) + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(8)]
    near = []
    for t in base:
        words = t.split()
        for _ in range(6):
            words[rng.randrange(200)] = "other"
            near.append(" \n".join(words))
    rows = documents() + EDGE + [(5000 + i, t) for i, t in enumerate(base + near + base)] + [(None, "only null ids here"), (None, "only null ids here")]
    prints = {t: slow_fingerprint(t) for _, t in rows}
    roots, least = slow_components(list(prints.values())), {}
    for k, t in rows:
        if k is not None:
            r = roots[prints[t]]
            least[r] = min(least.get(r, k), k)
    want = Counter((k, prints[t], least.get(roots[prints[t]])) for k, t in rows)
    got = simhash.near_duplicates(table(spark, rows, True)).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert sum(n > 1 for n in Counter(x[2] for x in want).values()) > 5
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert {r["doc_id"]: r["fp"] for r in got}[1] == 0
