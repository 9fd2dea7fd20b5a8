"""Session settings every operator relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("floodspark")
    if master:
        builder = builder.master(master)
    static = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**SETTINGS, **static, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, shuffled_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Let shuffles start with one partition per ``target_bytes``; adaptive execution merges small ones."""
    n = max(spark.sparkContext.defaultParallelism, -(-int(shuffled_bytes) // target_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only a local session may
    fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so lost executors cost no replay."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
