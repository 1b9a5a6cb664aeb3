"""Materialise a small derived table once, so later passes do not recompute its source."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast, or ordered in one task, up to these sizes; they are checked, not assumed.
BROADCAST_BYTES = 64 * 1024 * 1024
SINGLE_TASK_ROWS = 100_000
# Up to this measured size Spark may choose the join itself. Beyond it a side is shuffled: Spark's own estimate takes an array for
# one element and carries that through checkpoints, so it would send tables many times larger than its limit through the driver.
PLANNED_BYTES = 8 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A session that names none gets one below its warehouse, but only in local mode: elsewhere a local folder is
    another one on every machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/wardscore-shared"
    on_this_machine = "://" not in own and not own.startswith("hdfs:") or own.startswith("file:")
    if on_this_machine and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def land(df: DataFrame, label: str = "landed") -> DataFrame:
    """The table written once as Parquet in the shared folder and read back: later passes read only the columns they need.

    The files live as long as the application, as results that read them are lazy.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows that few tasks read over the cluster, for heavy work per row to follow; never over fewer tasks."""
    spark = df.sparkSession
    shuffle_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(shuffle_tasks, 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def broadcast_if(df: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast only where the measured size allows it."""
    return F.broadcast(df) if n_bytes <= limit else df


def shuffle_if(df: DataFrame, n_bytes: int | float, limit: int = PLANNED_BYTES) -> DataFrame:
    """Ask for a join by shuffle where the measured size is no longer small."""
    return df.hint("merge") if n_bytes > limit else df
