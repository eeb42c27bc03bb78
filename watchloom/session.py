"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings that hold for laptops and clusters alike; the number of shuffle
# partitions is left to the caller because AQE coalesces from above.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A long list of newest rows is sorted by all tasks, not held in one task's queue.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Long texts: a batch for Python is bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}

# Rows and stored bytes that a task on a table's rows gets at most.
TASK_ROWS = 250_000
TASK_BYTES = 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, for a session someone else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("watchloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over tasks of bounded size when its splits don't.

    Splits are cut by bytes but hold whole Parquet row groups: a few megabytes, or a long row group among
    many empty splits, would otherwise keep one core busy with all regexes. The footers say how many rows each split has; a
    scan with rows for every slot and none with more than a task's share is left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df.select(F.spark_partition_id().alias("split"), "_metadata.file_path", "_metadata.file_size").groupBy("split", "file_path").agg(
        F.count("*").alias("rows"), F.max("file_size").alias("size"))
    sums = splits.groupBy("split").agg(F.sum("rows").alias("rows")).agg(
        F.count("*").alias("busy"), F.max("rows").alias("largest"), F.sum("rows").alias("rows")).first()
    stored = splits.groupBy("file_path").agg(F.max("size").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = sums["rows"] or 0
    share = min(TASK_ROWS, max(1, TASK_BYTES * rows // max(1, stored)))
    if sums["busy"] >= slots and sums["largest"] <= share:
        return df
    return df.repartition(max(slots, -(-rows // share)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (a test) that names none gets a folder of
    its own; on a cluster, where executors do not share disks, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="watchloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialize an intermediate result that is used several times.

    A reliable checkpoint in the shared folder: it survives lost executors, and
    later steps read it instead of repeating what led to it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
