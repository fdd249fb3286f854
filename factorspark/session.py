"""Session helpers: where shared state goes, and how large a side may be before it is no longer broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only after its row count was checked against this bound.
MAX_BROADCAST_ROWS = 200_000


# Settings the jobs are written for; a cluster sizes the partition numbers to its executors.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",  # splits hot values in rank joins
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",  # also where the join's keys are grouped or ranked afterwards
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session; a missing setting is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder, never reused between runs."""
    return f"{shared_dir(spark)}/factorspark/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for iterative jobs whose plan would otherwise grow with every round."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after a bounded row count; beyond the bound the plan keeps its shuffle join."""
    if df.select(F.lit(1)).limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
