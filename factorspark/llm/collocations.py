r"""Collocations: phrases of two to five words that are more frequent than their parts let expect, per language.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?``, line feed, vertical tab, form feed and carriage return, and pieces into
words at space and tab. Counts are per language; a null language is ``und``. n counts all words, f(phrase) all places of a phrase inside
pieces, overlapping ones too. Candidates have two to five words and f >= ``MIN_COUNT``. A cut after the first k words gives
floor(1000 f n / (f(first) f(rest))), exactly; the lowest cut counts (then the smallest k). A candidate goes when its words lie in a
longer candidate that is as frequent. It is enough to look at candidates of one word more: what lies between two phrases of equal count
has that count too.

Blocks. A task cuts its texts into words and writes blocks of about ``BLOCK_WORDS`` words of one language: the block's vocabulary and the
word numbers in order, 0 at the ends of pieces. A long text is cut into blocks at the ends of pieces only.

Counting. Rabin-Karp: prefix sums of word hashes times powers of a base give the fingerprint of every n-gram of a block by one
subtraction. Per level n = 1 .. 5 each block sends its different fingerprints with their number and a pointer (block and place of one
occurrence); sums over the blocks say which reach the threshold, and their pointers go back to their blocks. A longer n-gram is only as
frequent as its first and its last n - 1 words, so it is sent only where both are frequent; nothing that may reach the threshold is left out.

Collisions. Inside a block occurrences under one fingerprint are compared word by word with the first one, and different ones are sent
apart. Across blocks a fingerprint can only bring too much together; each row therefore carries 32 bits of a second fingerprint, over
other word hashes. Where all rows of a frequent fingerprint agree in them, the text at the least pointer stands for all; where they do
not, the text at every pointer is taken, and the counts are summed again by the text itself.

Null and empty texts have no words. Repeated rows count each. Only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.llm.text import Rolling, mix, powers, release
from factorspark.session import broadcast_if_small, cut_lineage, scratch_path

WORDS, MIN_COUNT, TOP, SCALE = 5, 100, 2000, 1000
BLOCK_WORDS = 1 << 20
#: Words of all languages that a task holds at most before it writes its largest block.
HELD_WORDS = 2 << 20
_ENDS = bytes(46 if chr(i) in ".,;:!?\n\v\f\r" else i for i in range(256))
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Number of each word (bytes) in order of appearance; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pieces(text: str) -> list[bytes]:
    """Words of a text in order, ``.`` at the end of each piece and of the text."""
    return text.encode().lower().translate(_ENDS).replace(b".", b" . ").split() + [b"."]


def blocks(df: DataFrame, lang_col: str = "lang", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, n_words, words, ids) of every block: the vocabulary joined by line feeds and the word numbers (their lowest bytes,
    then their next ones, ...), both compressed, as they travel once a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor().compress
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        size: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, parts = held.pop(lang)
            del size[lang]
            ids = np.concatenate(parts)
            made += 1
            values = [base | made, lang, int(np.count_nonzero(ids)), pack(b"\n".join(words)), pack(ids.view(np.uint8).reshape(-1, 4).T.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if not text:
                    continue
                lang = b.column(0)[i].as_py()
                lang = "und" if lang is None else lang
                words = pieces(text)
                at = 0
                while at < len(words):
                    end = len(words) if len(words) - at <= block_words else words.index(b".", at + block_words - 1) + 1
                    part, at = words[at:end], end
                    vocabulary, parts = held.setdefault(lang, (Vocabulary(), []))
                    parts.append(np.fromiter(map(vocabulary.__getitem__, part), np.int32, len(part)))
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= block_words:
                        yield block(lang)
                    elif sum(size.values()) >= HELD_WORDS:
                        yield block(max(size, key=size.get))
        for lang in list(held):
            yield block(lang)
        release()

    names, kinds = ["block", "lang", "n_words", "words", "ids"], [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    rows = df.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "block bigint, lang string, n_words bigint, words binary, ids binary")


class Block:
    """Fingerprints of a block's n-grams."""

    def __init__(self, lang: str, words: bytes, ids: bytes, bits: int = 64):
        from xxhash import xxh3_64_intdigest
        from zstandard import ZstdDecompressor

        words, ids = map(ZstdDecompressor().decompress, (words, ids))
        self.mask = np.uint64((1 << bits) - 1)
        self.words = words.split(b"\n")
        self.ids = np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)
        size = np.array([len(w) for w in self.words], np.int64)
        start = np.cumsum(size + 1) - size - 1
        # the language goes into the fingerprint, so that equal phrases of two languages are counted apart
        salt = np.frombuffer(lang.encode(), np.uint8)
        self.salt = Rolling(salt, raw=True).hash(np.array([0]), np.array([len(salt)]))[0]
        value = Rolling(np.frombuffer(words, np.uint8), raw=True).hash(start, start + size)
        other = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        p, self.inverse = powers(len(self.ids) + 1)
        self.sums, self.others = np.zeros(len(self.ids) + 1, np.uint64), np.zeros(len(self.ids) + 1, np.uint64)
        np.cumsum(value[self.ids] * p[:len(self.ids)], out=self.sums[1:])
        np.cumsum(other[self.ids] * p[:len(self.ids)], out=self.others[1:])
        self.end = np.flatnonzero(self.ids == 0)

    def starts(self, n: int) -> np.ndarray:
        """Places of all n-grams that lie inside a piece."""
        at = np.flatnonzero(self.ids != 0)
        return at[self.end[np.searchsorted(self.end, at)] - at >= n] if len(at) else at

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.inverse[at] + self.salt + np.uint64(n) * _LEVEL) & self.mask

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """32 bits of a second fingerprint."""
        return (mix((self.others[at + n] - self.others[at]) * self.inverse[at]) >> np.uint64(32)).astype(np.int64)

    def grams(self, n: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, place of the first occurrence, number) of the block's different n-grams; of those whose first and last n - 1
        words have one of the ``frequent`` places' fingerprints, if given."""
        at = self.starts(n)
        if frequent is not None and len(at):
            known = np.unique(self.prints(frequent, n - 1))
            if not len(known):
                return np.zeros(0, np.uint64), at[:0], at[:0]
            for shift in (0, 1):
                f = self.prints(at + shift, n - 1)
                at = at[known[np.minimum(np.searchsorted(known, f), len(known) - 1)] == f]
        if not len(at):
            return np.zeros(0, np.uint64), at, at
        f = self.prints(at, n)
        order = np.argsort(f, kind="stable")
        f, at = f[order], at[order]
        new = np.append(True, f[1:] != f[:-1])
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        same = np.ones(len(at), bool)
        for k in range(n):
            same &= self.ids[at + k] == self.ids[first + k]
        if not same.all():  # different n-grams under one fingerprint: in the order of their words, each group by itself
            order = np.lexsort([*(self.ids[at + k] for k in range(n)), f])
            f, at = f[order], at[order]
            new = np.append(True, f[1:] != f[:-1])
            for k in range(n):
                new[1:] |= self.ids[at[1:] + k] != self.ids[at[:-1] + k]
        head = np.flatnonzero(new)
        return f[head], at[head], np.diff(np.append(head, len(at)))

    def text(self, at: int, n: int) -> str:
        return b" ".join([self.words[i] for i in self.ids[at:at + n].tolist()]).decode()


def _level(made: DataFrame, n: int, marks: DataFrame | None, bits: int) -> DataFrame:
    """(fp, place, block, n) of the blocks' n-grams; the place has 32 bits of the second fingerprint above it. ``bits`` below 64 shortens
    the first one (for tests of collisions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, lang, words, ids, frequent = (b.column(k)[i] for k in range(5))
                here = Block(lang.as_py(), words.as_py(), ids.as_py(), bits)
                fp, at, count = here.grams(n, None if n == 1 else frequent.values.to_numpy())
                place = here.checks(at, n) << 32 | at
                for k in range(0, len(fp), 1 << 16):
                    cut = slice(k, k + (1 << 16))
                    f = fp[cut].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(place[cut]), pa.array(np.full(len(f), block.as_py())), pa.array(count[cut].astype(np.int32))],
                                                     names=["fp", "place", "block", "n"])

    rows = made.select("block", "lang", "words", "ids")
    rows = rows.withColumn("marks", F.lit(None).cast("array<int>")) if marks is None else rows.join(marks, "block")
    return rows.mapInArrow(run, "fp bigint, place bigint, block bigint, n int")


def frequencies(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, words: int = WORDS, block_words: int = BLOCK_WORDS,
                bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of every phrase of one to ``words`` words with f >= min_count, (lang, n) of every language)."""
    spark = df.sparkSession
    path = scratch_path(spark, "collocations")
    blocks(df, lang_col, text_col, block_words).write.parquet(path)
    made = spark.read.parquet(path)
    group = Window.partitionBy("fp")  # a fingerprint has one row a block, so the group is no larger than the number of blocks
    at, check = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("place", 32)
    every, last = None, None
    for n in range(1, words + 1):
        # dealt as they are: columns that the window derives are not shuffled
        rows = _level(made, n, last, bits).repartition("fp").withColumn("at", at).withColumns({"f": F.sum("n").over(group), "mixed": F.min(check).over(group) != F.max(check).over(group),
                                                        "first": F.min(F.struct("block", "at")).over(group)}).where(F.col("f") >= min_count)
        told = F.when(F.col("mixed"), F.struct("at", F.col("n").cast("bigint").alias("n"))).when(F.struct("block", "at") == F.col("first"), F.struct("at", F.col("f").alias("n")))
        # a block's own n-grams: the lists are bounded by the block
        level = cut_lineage(rows.groupBy("block").agg(F.collect_list("at").alias("marks"), F.collect_list(told).alias("told")))
        last = level.select("block", "marks")
        level = level.select("block", F.lit(n).alias("size"), F.col("told.at").alias("at"), F.col("told.n").alias("n")).where(F.size("at") > 0)
        every = level if every is None else every.unionAll(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lang, size = b.column(0)[i].as_py(), b.column(3)[i].as_py()
                block = Block(lang, b.column(1)[i].as_py(), b.column(2)[i].as_py())
                at, count = b.column(4)[i].values.to_numpy(), b.column(5)[i].values.to_numpy()
                for k in range(0, len(at), 1 << 16):
                    cut = slice(k, k + (1 << 16))
                    phrases = [block.text(x, size) for x in at[cut].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(phrases), size, np.int32)), pa.array(count[cut])],
                                                     names=["lang", "phrase", "size", "n"])

    told = made.select("block", "lang", "words", "ids").join(every, "block").select("lang", "words", "ids", "size", "at", "n").mapInArrow(run, "lang string, phrase string, size int, n bigint")
    counted = cut_lineage(told.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
    return counted, cut_lineage(made.groupBy("lang").agg(F.sum("n_words").alias("n")))


def scored(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every candidate, by its lowest cut."""
    word = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(word, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(word, k + 1, F.col("size") - k), " ").alias("rest")))
    rows = counted.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    left, right = (counted.select("lang", F.col("phrase").alias(side), F.col("f").alias(c)) for side, c in (("first", "l"), ("rest", "r")))
    rows = rows.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(broadcast_if_small(totals), "lang")
    # 38 decimal digits hold both products; div is exact
    rows = rows.withColumn("score", F.expr(f"(cast({SCALE} as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = rows.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return best.select("lang", "phrase", "size", "a", "low.l", "low.r", "n", "low.score")


def within_longer(counted: DataFrame) -> DataFrame:
    """(lang, phrase, f) of candidates that lie in one of the same count."""
    word = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(word, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("size") - 1), " "))
    return counted.where("size > 2").select("lang", F.explode(parts).alias("phrase"), "f").distinct()


def _first(rows: DataFrame, by: list, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP, words: int = WORDS,
                 block_words: int = BLOCK_WORDS, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` candidates by score, count and phrase."""
    counted, totals = frequencies(df, lang_col, text_col, min_count, words, block_words, bits)
    rows = cut_lineage(scored(counted, totals))
    longer = within_longer(counted).select("lang", "phrase", F.col("f").alias("a"))
    rows = cut_lineage(rows.join(longer, ["lang", "phrase", "a"], "left_anti"))
    salts = rows.count() // (100 * top)
    while salts:  # the first ones of parts of a language before those of all of it, so that no task sorts more than about 100 x top rows
        rows = _first(rows, ["lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))], top)
        salts //= 100
    return _first(rows, ["lang"], top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(generate_series(1, len(ws) - size + 1), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(ws) >= size),
f AS (SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, x.f AS l, y.f AS r, t.n, ({SCALE} * k.a * t.n) // (x.f * y.f) AS score FROM k JOIN t USING (lang)
      JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, c.a FROM c, (SELECT unnest([2, 3, 4]) AS m) sizes, (SELECT unnest([1, 2, 3, 4]) AS i) starts
      WHERE m < c.size AND i + m - 1 <= c.size),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND 100 * d.a >= 100 * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= {TOP}
"""
