"""Incident totals with representative points, kept up to date as files of incidents arrive.

A median cannot be updated, but counts of values in buckets of equal width can: the state holds, per unit and coordinate, how
many values fell into each bucket, and a median follows from them to within a bucket's width. A batch stores the counts it
changed only; now and then the stored ones are put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.operators.tables import col
from wardscore.plans.incidents import COORDINATE_BOUNDS, REPRESENTATIVE, clean_incidents, totals
from wardscore.sources.tabular import write_table
from wardscore.streaming.incident_totals import finished_batches, publish, withdraw

# Buckets of a coordinate's range: medians are off by half a bucket at most, 3 feet or a hundred-thousandth of a degree.
MEDIAN_BUCKETS = 32_768
# So many batches are stored apart before they are put together.
APART = 16
KEYS = ["Geo_Unit", "_col", "_bucket"]
NAMES = list(COORDINATE_BOUNDS)
ROW = -1


def _step(name: str) -> float:
    low, high = COORDINATE_BOUNDS[name]
    return (high - low) / MEDIAN_BUCKETS


def bucket_counts(clean: DataFrame) -> DataFrame:
    """Per unit, coordinate and bucket the number of values, and per unit, in a row of its own, the totals."""

    def entry(number: int, bucket: Column) -> Column:
        return F.struct(F.lit(number).alias("_col"), bucket.cast("bigint").alias("_bucket"))

    entries = [entry(ROW, F.lit(0))]
    for i, name in enumerate(NAMES):
        if name in clean.columns:
            place = F.floor((col(name) - F.lit(COORDINATE_BOUNDS[name][0])) / F.lit(_step(name)))
            entries.append(entry(i, F.when(col(name).isNotNull(), F.least(place, F.lit(MEDIAN_BUCKETS - 1)))))
    sums = {name: c.alias(name) for name, c in totals().items()}
    rows = clean.select("Geo_Unit", *sums.values(), F.inline(F.array(*entries))).where("_bucket IS NOT NULL")
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in sums])


def run_medians(
    incidents: DataFrame,
    path: str,
    state_path: str,
    geo_level: str = "precinct",
    once: bool = True,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
):
    """Start the query that keeps the bucket counts below ``path``; read them with ``latest_medians``.

    Restarted with the same ``state_path`` it goes on where it stopped: a file is counted once. A batch that is run again
    stores the same counts again, in the same place. ``once`` reads what is there and stops.
    """
    counts = bucket_counts(clean_incidents(prepare(incidents), geo_level))

    def store(batch: DataFrame, batch_id: int) -> None:
        publish(batch, path, batch_id)
        spark = batch.sparkSession
        done = sorted(finished_batches(spark, path))
        # The last stored batches stay for those who read them now; the others are in this batch's table from here on.
        if len(done) > APART and done[-1] == batch_id:
            merged = latest_counts(spark, path, done)
            write_table(merged, f"{path}/merged")
            publish(spark.read.parquet(f"{path}/merged"), path, batch_id)
            for old in done[:-1]:
                withdraw(spark, path, old)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", state_path).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_counts(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """The last stored counts of every bucket."""
    batches = finished_batches(spark, path) if batches is None else batches
    stored = spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in batches])
    kept = [c for c in stored.columns if c not in (*KEYS, "batch")]
    last = F.max_by(F.struct(*kept), "batch").alias("_last")
    return stored.groupBy(*KEYS).agg(last).select(*KEYS, "_last.*")


def medians_of(counts: DataFrame) -> DataFrame:
    """Units with their totals, coverage and, from the bucket counts, their representative points."""
    group = Window.partitionBy("Geo_Unit", "_col")
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A unit's coordinate has no more rows than there are buckets.
    placed = counts.where(F.col("_col") != ROW).withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(group)})
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    # The middle of the bucket with the lower and of that with the upper middle rank.
    value = F.coalesce(*[F.when(F.col("_col") == i, F.lit(COORDINATE_BOUNDS[n][0]) + (F.col("_bucket") + 0.5) * F.lit(_step(n))) for i, n in enumerate(NAMES)])
    picked = placed.withColumns({"_low": F.when(holds(low), value), "_high": F.when(holds(high), value)})
    pairs = picked.groupBy("Geo_Unit", "_col").agg(((F.max("_low") + F.max("_high")) / 2).alias("_median"))
    points = pairs.groupBy("Geo_Unit").agg(*[F.max(F.when(F.col("_col") == i, F.col("_median"))).alias(n) for i, n in enumerate(NAMES)])
    units = counts.where(F.col("_col") == ROW).select("Geo_Unit", *totals())
    count = F.col("Incident_Count")
    coverage = F.col("Valid_Point_Count") / F.when(count != 0, count).otherwise(F.lit(1))
    table = units.join(points, "Geo_Unit", "left").withColumnsRenamed(REPRESENTATIVE)
    return table.withColumn("Point_Coverage_Rate", coverage)


def latest_medians(spark: SparkSession, path: str) -> DataFrame:
    """The units after the last finished batch."""
    return medians_of(latest_counts(spark, path))
