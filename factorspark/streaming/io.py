"""Stream sources, sinks and a bounded run for batch callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark import schemas
from factorspark.session import scratch_path
from factorspark.sources import keyed


def read_event_stream(spark: SparkSession, path: str, schema: str = schemas.EVENTS, files_per_trigger: int = 64) -> DataFrame:
    """File stream of Parquet events with a fixed schema.

    ``files_per_trigger`` bounds a micro-batch, and with it what one key can bring to a stateful call.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_event_topic(spark: SparkSession, servers: str, topic: str, schema: str = schemas.EVENTS) -> DataFrame:
    """The same events from a message topic, where the connector is on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def with_lateness(s: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Rows later than ``delay`` behind the newest event time are dropped by stateful operators downstream."""
    return s.withWatermark(ts, delay)


def write_stream(s: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Exactly-once file sink: the sink's log commits each micro-batch once."""
    w = s.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return w.trigger(**trigger).start() if trigger else w.start()


def write_updates(s: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger):
    """Update-mode results: each micro-batch overwrites its own folder, so a retried batch is not doubled."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    w = s.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode)
    return w.trigger(**trigger).start() if trigger else w.start()


def write_idempotent(s: DataFrame, table: str, checkpoint: str, keys: list[str], buckets: int = keyed.BUCKETS, part: Column | None = None, **trigger):
    """Insert only rows whose key the table lacks, batch by batch; a micro-batch reads the keys of the buckets it touches."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        keyed.insert_new(batch, table, keys, batch_id, buckets, part)
        batch.unpersist()
    w = s.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return w.trigger(**trigger).start() if trigger else w.start()


def write_upserts(s: DataFrame, table: str, checkpoint: str, keys: list[str], order: str, buckets: int = keyed.BUCKETS, **trigger):
    """Keep the last write per key, batch by batch; a micro-batch rewrites the buckets it touches."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        keyed.upsert_stored(batch, table, keys, order, batch_id, buckets)
        batch.unpersist()
    w = s.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return w.trigger(**trigger).start() if trigger else w.start()


def drain(s: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available now and return what it wrote.

    Output and checkpoint live in fresh folders of the shared folder. In update mode a key is written by every
    micro-batch that changed it; ``keys`` keeps the row of its last one.
    """
    spark = s.sparkSession
    base = scratch_path(spark, name)
    schema = s.schema
    run = write_stream if mode == "append" else write_updates
    q = run(s, f"{base}/out", f"{base}/checkpoint", mode, availableNow=True)
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out")
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
        out = out.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") == 1).drop("_i")
    return out.drop("batch")


def dropped_rows(query) -> int:
    """Rows a finished or running query dropped as too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
