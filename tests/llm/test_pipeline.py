"""The stages of the corpus pipeline on planted documents."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_pipeline_keeps_clean_documents_and_catches_planted_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(150)) for _ in range(4)]
    words = clean[1].split()
    words[70] = "other"
    planted = [(9000, clean[0]), (9001, clean[0].replace(" ", "\n ")), (9002, clean[1]), (9003, " ".join(words)), (9004, clean[2] + " " + item), (9005, clean[3])]
    rows = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in planted], docs.schema)
    cur = docs.unionByName(rows)
    left = []
    for name, stage in corpus_pipeline.STAGES:
        before = cur
        cur = stage(spark, cur, SMALL)
        if name != "bpe":
            assert cur.columns == docs.columns
        cur = spark.createDataFrame(cur.collect(), cur.schema)
        left.append({r[0] for r in cur.where(F.col("doc_id") >= 9000).collect()})
        assert cur.count() <= before.count()
    assert left == [{9000, 9001, 9002, 9003, 9004, 9005}, {9000, 9002, 9003, 9004, 9005}, {9000, 9002, 9004, 9005}, {9000, 9002, 9005}, {9000, 9002, 9005}]


def test_stages_on_an_empty_table(spark):
    cur = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        cur = spark.createDataFrame(stage(spark, cur, SMALL).collect(), stage(spark, cur, SMALL).schema)
        assert cur.count() == 0
