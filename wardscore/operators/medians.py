"""Exact grouped medians that never hold a group in one task.

A built-in exact percentile keeps every distinct value of a group in memory.
Here values are first counted in buckets of equal width (map-side combined,
at most BUCKETS rows per group and column). The counts tell which bucket holds
the middle ranks. While that bucket holds too many rows for one task, it is cut
into buckets between its own smallest and largest value and counted again; then
its values are read, again as counts. The bucket of a value rises with the
value, so the result is exact whatever the bounds; good bounds only save passes.

Sums over the groups ride along in the first pass, so that a table with both
is scanned no more often than one without.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardscore.operators.settle import broadcast_if, settle
from wardscore.operators.tables import col

BUCKETS = 256
# Rows of a bucket that one task may order.
TASK_ROWS = 1_000_000
PICK_ROW_BYTES = 128
ROW_ENTRY = -1


# What is known of a bucket with a middle rank: rows before it, middle ranks, its rows and its range.
PICKED = ["_col", "_before", "_lo", "_hi", "_n", "_min", "_max"]


def _extent() -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_min"), F.max("_value").alias("_max")]


def _holds_middle() -> Column:
    return (F.col("_hi") >= F.col("_before")) & (F.col("_lo") < F.col("_before") + F.col("_n"))


def grouped_medians(
    rows: DataFrame,
    keys: Sequence[str],
    bounds: Mapping[str, tuple[Column, Column]],
    totals: Mapping[str, Column] | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per key with the median of each column named in ``bounds``.

    ``bounds`` gives a column's likely low and high, as expressions of the row.
    ``totals`` adds a sum of each given expression, and makes keys without any
    value to take a median of keep their row.
    """
    names, totals = list(bounds), dict(totals or {})
    key_cols = [col(k) for k in keys]

    def bucketed(name: str) -> Column:
        low, high = bounds[name]
        step = F.nullif((high - low) / F.lit(float(BUCKETS)), F.lit(0.0))
        bucket = F.coalesce(F.floor((col(name) - low) / step), F.lit(0))
        return F.greatest(F.lit(0), F.least(bucket, F.lit(BUCKETS - 1)))

    def entry(number: int, bucket: Column, value: Column) -> Column:
        return F.struct(F.lit(number).alias("_col"), bucket.cast("bigint").alias("_bucket"), value.alias("_value"))

    entries = [entry(i, bucketed(n), col(n)) for i, n in enumerate(names)]
    # One more entry stands for the row itself and carries the totals.
    whole_row = [entry(ROW_ENTRY, F.lit(0), F.lit(0.0))] if totals else []

    def stacked(which: list[Column], extra: dict[str, Column]) -> DataFrame:
        named = [c.alias(n) for n, c in extra.items()]
        return rows.select(*key_cols, *named, F.inline(F.array(*which))).where(F.col("_value").isNotNull())

    counts = (
        stacked(entries + whole_row, totals)
        .groupBy(*key_cols, "_col", "_bucket")
        .agg(*_extent(), *[F.sum(col(n)).alias(n) for n in totals])
    )
    if totals:
        counts = settle(counts)
    group = Window.partitionBy(*key_cols, "_col")
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picks = (
        counts.where(F.col("_col") != ROW_ENTRY)
        .withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(group))
        # Ranks (from 0) of the one or two middle values.
        .withColumn("_lo", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2))
        .where(_holds_middle())
        .select(*key_cols, *PICKED)
    )
    picks = settle(picks)
    inside = F.col("_value").between(F.col("_min"), F.col("_max"))
    step = (F.col("_max") - F.col("_min")) / F.lit(float(BUCKETS))
    crowded = (F.col("_n") > task_rows) & (step > 0) & (step < float("inf"))
    while n_crowded := picks.where(crowded).count():
        large = picks.where(crowded).select(*key_cols, "_col", "_before", "_lo", "_hi", "_min", "_max")
        place = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_value") - F.col("_min")) / step)).cast("bigint")
        finer = (
            stacked(entries, {})
            .drop("_bucket")
            .join(broadcast_if(large, n_crowded * PICK_ROW_BYTES), [*keys, "_col"])
            .where(inside)
            .groupBy(*key_cols, "_col", "_before", "_lo", "_hi", place.alias("_bucket"))
            .agg(*_extent())
        )
        below = Window.partitionBy(*key_cols, "_col", "_before").orderBy("_bucket")
        upto_bucket = F.sum("_n").over(below.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        finer = finer.withColumn("_below", F.col("_before") + upto_bucket - F.col("_n")).drop("_before")
        finer = finer.withColumnRenamed("_below", "_before").where(_holds_middle()).select(*key_cols, *PICKED)
        picks = settle(picks.where(~crowded).unionByName(finer))
    small = broadcast_if(picks.drop("_n"), picks.count() * PICK_ROW_BYTES)

    cell = [*keys, "_col", "_min"]
    values = (
        stacked(entries, {})
        .drop("_bucket")
        .join(small, [*keys, "_col"])
        .where(inside)
        .groupBy(*[col(k) for k in cell], "_before", "_lo", "_hi", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto_value = (
        Window.partitionBy(*[col(k) for k in cell])
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.col("_before") + F.sum("_n").over(upto_value)
    ranked = values.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank: str, i: int) -> Column:
        hit = (F.col("_col") == i) & (F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end"))
        return F.max(F.when(hit, F.col("_value")))

    medians = ranked.groupBy(*key_cols).agg(
        *[((at("_lo", i) + at("_hi", i)) / 2).alias(n) for i, n in enumerate(names)]
    )
    if not totals:
        return medians
    sums = counts.where(F.col("_col") == ROW_ENTRY).select(*key_cols, *[col(n) for n in totals])
    return sums.join(medians, list(keys), "left")
