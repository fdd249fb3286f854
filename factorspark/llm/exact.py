"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is normalised (every run of space, tab, line feed, vertical tab, form feed, carriage return becomes one space) and cut into
blocks of ``BLOCK`` bytes. Different blocks are sorted into integer names; adjacent names are paired and the pairs named again, until
each text has one name. Texts are equal exactly when their number of rounds and their name are equal.

Blocks meet by a 64-bit hash, and the least and greatest block under each hash are compared byte by byte: one that holds different
blocks is told apart by the blocks themselves, so a name is never shared by two different blocks. Names are numbered inside ``BUCKETS``
buckets of the sorted keys, so no task sees more than its bucket and a lost task gets the same names again.

Null counts as the empty text. Of equal texts the row with the smallest id stays (a null id comes after all others); of rows that
repeat id and text exactly one stays. Every input row has an output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.tables import read
from factorspark.session import cut_lineage

BLOCK = 4096
BUCKETS = 65_536


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` with an integer ``name``: its place in the sorted bucket, made unique by the bucket."""
    bucket = keys.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*columns))
    return bucket.select(*columns, (place.cast("bigint") * BUCKETS + F.col("_bucket")).alias("name"))


def _blocks(df: DataFrame, id_col: str, text_col: str, block: int, block_hash) -> DataFrame:
    """(_id, _sha, _n, _at, _hash, _block) of every block of every row."""
    text = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).cast("binary").alias("_text"))
    count = F.greatest(F.ceil(F.length("_text") / F.lit(block)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.col("_text"), i * block + 1, F.lit(block)))
    rows = text.withColumn("_sha", F.unhex(F.sha2("_text", 256))).withColumn("_n", count).select("_id", "_sha", "_n", F.posexplode(cut).alias("_at", "_block"))
    return rows.withColumn("_hash", block_hash(F.col("_block")))


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_hash=F.xxhash64) -> DataFrame:
    """(_id, _sha, _rounds, name, _m): one row per id and text, its identity (_rounds, name) and how many rows repeat it."""
    rows = _blocks(df, id_col, text_col, block, block_hash)
    seen = cut_lineage(rows.groupBy("_hash").agg(F.min("_block").alias("_lo"), F.max("_block").alias("_hi")).select("_hash", (F.col("_lo") == F.col("_hi")).alias("_one")))
    names = named(seen.where("_one").select("_hash"), ["_hash"])
    cur = rows.drop("_block").join(names, "_hash")
    mixed = seen.where(~F.col("_one")).select("_hash")
    if not mixed.isEmpty():  # different blocks under one hash: they are named by their bytes, with names below zero
        told = rows.join(mixed, "_hash", "left_semi")
        apart = named(told.select("_block").distinct(), ["_block"]).select("_block", (-F.col("name")).alias("name"))
        cur = cur.unionByName(told.join(apart, "_block").drop("_block"))
    cur = cut_lineage(cur.select("_id", "_sha", "_n", "_at", "name", F.lit(1).cast("bigint").alias("_m")))
    done = [cur.where("_n = 1").select("_id", "_sha", F.lit(0).alias("_rounds"), "name", "_m")]
    longest = cur.agg(F.max("_n")).first()[0] or 1
    rounds, left = 0, cur.where("_n > 1")
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        even = F.col("_at") % 2 == 0
        pairs = left.groupBy("_id", "_sha", ((F.col("_n") + 1) / 2).cast("int").alias("_n"), (F.col("_at") / 2).cast("int").alias("_at")).agg(
            F.max(F.when(even, F.col("name"))).alias("_a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("_b"),
            F.sum(F.when(F.col("_at") == 0, F.col("_m")).otherwise(0)).alias("_m"))
        pairs = cut_lineage(pairs)
        names = named(pairs.select("_a", "_b").distinct(), ["_a", "_b"])
        left = cut_lineage(pairs.join(names, ["_a", "_b"]).select("_id", "_sha", "_n", "_at", "name", "_m"))
        done.append(left.where("_n = 1").select("_id", "_sha", F.lit(rounds).alias("_rounds"), "name", "_m"))
        left = left.where("_n > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("_id", "_sha", "_rounds", "name").agg(F.sum("_m").alias("_m"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_hash=F.xxhash64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    one = cut_lineage(identities(df, id_col, text_col, block, block_hash))
    # the group's aggregate is combined before its shuffle; a large group is then only a skewed key of a join with one row per group
    group = one.groupBy("_rounds", "name").agg(F.min("_id").alias("keep_id"), F.sum("_m").alias("group_size"))
    rows = one.join(group, ["_rounds", "name"])
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))).alias("_copy", "_"))
    return rows.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0)).alias("kept"),
                       F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = groups(df, id_col, text_col, block)
    keys = found.groupBy(F.col(id_col).alias("_key"), F.col("text_sha256").alias("_sha")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_m"))
    keys = cut_lineage(keys.where(~F.col("_kept") | (F.col("_m") > 1)))
    rows = df.withColumn("_sha", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    same = rows[id_col].eqNullSafe(keys["_key"]) & (rows["_sha"] == keys["_sha"])
    once = rows.join(keys, same, "left_anti").drop("_sha")
    again = keys.where("_kept")
    if again.isEmpty():
        return once
    same = rows[id_col].eqNullSafe(again["_key"]) & (rows["_sha"] == again["_sha"])
    return once.unionByName(rows.join(again, same, "left_semi").dropDuplicates([id_col, "_sha"]).drop("_sha"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n
"""
