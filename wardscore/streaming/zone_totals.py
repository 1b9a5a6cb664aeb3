"""Incident totals per zone, kept up to date as files of incidents arrive: repeats are counted once, late rows not at all.

Each incident is placed by a join with the zones' cells, which are worked out before the stream starts. A report that comes again
within the watermark is known by its number, or by all its columns where it has none. Rows older than the watermark are dropped,
as their repeats can no longer be told.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.functions.clean import clean_missing
from wardscore.operators.quadtree import located
from wardscore.operators.tables import col
from wardscore.plans.incidents import incident_points
from wardscore.plans.zones import valid_points
from wardscore.streaming.incident_totals import finished_batches, publish, withdraw

NUMBER, KEY, TIME = "CMPLNT_NUM", "_report", "_seen"


def once_each(incidents: DataFrame, time: str, delay: str) -> DataFrame:
    """Every report once, the first row that arrives; rows later than ``delay`` behind the newest time are dropped.

    In a batch, where there is no watermark, repeats are told over all rows.
    """
    whole = F.sha2(F.to_json(F.struct(*[col(c) for c in incidents.columns])), 256)
    keyed = incidents.withColumns({KEY: F.coalesce(clean_missing(col(NUMBER)), whole), TIME: col(time).cast("timestamp")})
    if not incidents.isStreaming:
        return keyed.dropDuplicates([KEY])
    return keyed.withWatermark(TIME, delay).dropDuplicatesWithinWatermark([KEY])


def zone_totals(incidents: DataFrame, zones: DataFrame, time: str, delay: str = "7 days") -> DataFrame:
    """Per zone the incidents strictly inside: numbered ones counted, weights of all summed up."""
    points = incident_points(once_each(incidents, time, delay).drop(KEY))
    inside = located(valid_points(points), zones.select("zone_id", "parts"), exclude_boundary=True)
    return inside.groupBy("zone_id").agg(
        F.count(clean_missing(F.col(NUMBER))).alias("Incident_Count"), F.sum("weighted_incident").alias("Weighted_Severity_Sum")
    )


def run_zone_totals(
    incidents: DataFrame,
    zones: DataFrame,
    time: str,
    path: str,
    state_path: str,
    delay: str = "7 days",
    once: bool = True,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
):
    """Start the query that rewrites the zones' totals below ``path`` after every batch; read them with ``latest_zone_totals``.

    State is one row per zone and one per report younger than the watermark.
    """
    totals = zone_totals(prepare(incidents), zones, time, delay)

    def store(batch: DataFrame, batch_id: int) -> None:
        publish(batch, path, batch_id)
        for old in finished_batches(batch.sparkSession, path):
            if old < batch_id - 1:
                withdraw(batch.sparkSession, path, old)

    writer = totals.writeStream.outputMode("complete").option("checkpointLocation", state_path).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_zone_totals(spark: SparkSession, path: str) -> DataFrame:
    """The zones' totals after the last finished batch."""
    return spark.read.parquet(f"{path}/batch={max(finished_batches(spark, path))}")
