"""Incident totals kept up to date as files of incidents arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardscore.plans.incidents import clean_incidents, unit_totals
from wardscore.sources.tabular import write_table


# Folder of the markers; the name keeps readers of the tables out of it.
FINISHED = "_finished"


def incident_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    name_glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of the files in a folder; ``name_glob`` picks among them.

    ``folder`` may be a pattern that fits a file or a folder of part files.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    options = {"pathGlobFilter": name_glob, "maxFilesPerTrigger": files_per_batch}
    if fmt == "csv":
        options["header"] = "true"
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, value)
    return reader.load(folder)


def run_totals(
    incidents: DataFrame,
    totals_path: str,
    state_path: str,
    geo_level: str = "precinct",
    once: bool = True,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
):
    """Start the query that rewrites the totals table after every batch.

    State is one row per unit: counts and sums only, as medians cannot be kept
    up incrementally. The batch number is in the table's path. A batch is
    published by a marker once its table is whole, so readers never meet half a
    table, and a batch that is run again writes the same table once more. The
    batch before stays for those who read it; older ones are removed. ``once``
    reads what is there and stops.
    """
    totals = unit_totals(clean_incidents(prepare(incidents), geo_level))

    def store(batch: DataFrame, batch_id: int) -> None:
        publish(batch, totals_path, batch_id)
        for old in finished_batches(batch.sparkSession, totals_path):
            if old < batch_id - 1:
                withdraw(batch.sparkSession, totals_path, old)

    writer = totals.writeStream.outputMode("complete").option("checkpointLocation", state_path).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _files(spark: SparkSession, path: str):
    """Hadoop's path type and the file system that ``path`` is in."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's table and, once it is whole, its marker; a batch that runs again writes both anew."""
    write_table(batch, f"{path}/batch={batch_id}")
    kind, files = _files(batch.sparkSession, path)
    files.create(kind(f"{path}/{FINISHED}/{batch_id}"), True).close()


def withdraw(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove a batch's marker, then its table."""
    kind, files = _files(spark, path)
    files.delete(kind(f"{path}/{FINISHED}/{batch_id}"), False)
    files.delete(kind(f"{path}/batch={batch_id}"), True)


def latest_totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """The totals after the last finished batch."""
    return spark.read.parquet(f"{totals_path}/batch={max(finished_batches(spark, totals_path))}")


def finished_batches(spark: SparkSession, totals_path: str) -> list[int]:
    """Numbers of the batches that were published."""
    kind, files = _files(spark, path := f"{totals_path}/{FINISHED}")
    return [int(f.getPath().getName()) for f in files.listStatus(kind(path))] if files.exists(kind(path)) else []
