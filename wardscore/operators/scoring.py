"""Standardising, averaging and ranking of area tables.

The measures of the whole table (count, mean, deviation, range) come from one
aggregate over a settled table; they enter the next plan as literals, so no
cross join and no unpartitioned window is needed to standardise a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardscore.operators.settle import SINGLE_TASK_ROWS, settle
from wardscore.operators.tables import col

EPSILON = 1e-12
SEGMENT_SIZE = 10
NEUTRAL_QUALITY = 50.0


@dataclass(frozen=True)
class Measures:
    """Whole-table figures of one column."""

    present: int
    mean: float | None
    spread: float | None
    low: float | None
    high: float | None


def measure(df: DataFrame, names: Sequence[str]) -> tuple[int, dict[str, Measures]]:
    """Row count and the measures of each column, in one aggregate of one row."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        c = col(name)
        aggs += [
            F.count(c).alias(f"present_{i}"),
            F.avg(c).alias(f"mean_{i}"),
            F.stddev_pop(c).alias(f"spread_{i}"),
            F.min(c).alias(f"low_{i}"),
            F.max(c).alias(f"high_{i}"),
        ]
    row = df.agg(*aggs).first()
    return row["n"], {
        name: Measures(*(row[f"{part}_{i}"] for part in ("present", "mean", "spread", "low", "high")))
        for i, name in enumerate(names)
    }


def zscore(c: Column, m: Measures) -> Column:
    """Population z-score; 0 in a constant column, NULL where the value is NULL."""
    return (c - F.lit(m.mean)) / F.lit((m.spread or 0.0) + EPSILON)


def quality(c: Column, m: Measures, higher_is_better: bool) -> Column:
    """Rescaled to 0..100. No spread at all gives 50 for every row, NULL ones too."""
    if m.low is None or m.high == m.low:
        return F.lit(NEUTRAL_QUALITY)
    share = (c - F.lit(m.low)) / F.lit(m.high - m.low)
    return (share if higher_is_better else F.lit(1.0) - share) * F.lit(100.0)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the values present in the row; NULL if there is none."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return total / F.nullif(present, F.lit(0))


def row_range(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) - F.least(*columns)


def rank_rows(
    df: DataFrame, order: Sequence[Column], name: str, n_rows: int, single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Unique ranks 1..n in the given total order.

    A table of a checked small size is numbered by one window. A larger one is
    range-partitioned and sorted in parallel; each row's rank is its place in
    its partition plus the sizes of the partitions before it, of which there
    are only as many as tasks.
    """
    if n_rows <= single_task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    ranged = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # Partition number in the upper bits, place within it in the lower 33.
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned(F.col("_place"), 33)
    ranged = ranged.withColumn("_part", part).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place") + F.lit(1))
        .drop("_part", "_place", "_offset")
    )


def score_order(score: str, key: str, descending: bool) -> list[Column]:
    """By score, NULLs last; equal to nine digits means tied, and ties go by id."""
    c = F.round(col(score), 9)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), col(key).asc()]


def segment(rank: Column, n_rows: int) -> Column:
    """First and last k rows are Top and Bottom, k = min(10, n // 2)."""
    k = min(SEGMENT_SIZE, n_rows // 2)
    return (
        F.when(rank <= k, F.lit("Top")).when(rank > n_rows - k, F.lit("Bottom")).otherwise(F.lit("Middle"))
    )


def rank_and_segment(df: DataFrame, score: str, key: str, n_rows: int, descending: bool) -> DataFrame:
    ranked = rank_rows(df, score_order(score, key, descending), "Rank", n_rows)
    return ranked.withColumn("Segment", segment(F.col("Rank"), n_rows))


def mean_z_table(
    table: DataFrame, measures: Sequence[str], score: str, key: str, descending: bool
) -> DataFrame:
    """z-score each measure, average them into ``score``, rank and label.

    ``table`` should be settled. Measures with no value at all make no column.
    """
    n_rows, found = measure(table, measures)
    used = [m for m in measures if found[m].present]
    absent = [m for m in measures if not found[m].present]
    if not used:
        raise ValueError(f"No values left for {list(measures)} after filtering")
    zs = {m: zscore(col(m), found[m]) for m in used}
    scored = table.drop(*absent).withColumns({f"z_{m}": z for m, z in zs.items()})
    scored = scored.withColumn(score, row_mean([col(f"z_{m}") for m in used]))
    return rank_and_segment(scored, score, key, n_rows, descending)


def burden_table(table: DataFrame, key: str, burden: str = "Weighted_Severity_Sum") -> DataFrame:
    """Safety score of a burden sum: its z-score with the sign flipped, best first."""
    n_rows, found = measure(table, [burden])
    if n_rows == 0:
        raise ValueError("No rows left to score")
    scored = table.withColumn("CrimeBurden_z", zscore(col(burden), found[burden])).withColumn(
        "SafetyScore", -F.col("CrimeBurden_z")
    )
    return rank_and_segment(scored, "SafetyScore", key, n_rows, descending=True)
