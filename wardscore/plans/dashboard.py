"""Rankings, spreads and comparisons drawn from the district index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardscore.functions.codes import borough_of
from wardscore.functions.display import score_band
from wardscore.operators.medians import grouped_medians
from wardscore.operators.scoring import row_range
from wardscore.operators.tables import col
from wardscore.plans.combine import OVERALL, QUALITY_COLUMNS, RANK
from wardscore.plans.zones import ZONE_ID, ZONE_NAME

# What each quality column is called.
METRICS = {
    "Air Quality": "Air_QualityScore",
    "Drinking Water": "Water_QualityScore",
    "Education": "Education_QualityScore",
    "Public Safety": "Safety_QualityScore",
}
BIN_WIDTH = 10
TOP_SIZE = 10
BOARD_SIZE = 5


def tie_safe(c: Column) -> Column:
    """A score to nine digits: float noise must not decide an order."""
    return F.round(c, 9)


def with_borough(index: DataFrame) -> DataFrame:
    return index.withColumn("borough", borough_of(col(ZONE_ID)))


def with_range(index: DataFrame) -> DataFrame:
    """Adds metric_range: highest less lowest of the four scores present."""
    return index.withColumn("metric_range", row_range([col(c) for c in METRICS.values()]))


def stacked(index: DataFrame) -> DataFrame:
    """One row per area and metric."""
    entries = [
        F.struct(F.lit(i).alias("metric_no"), F.lit(label).alias("metric"), col(c).alias("score"))
        for i, (label, c) in enumerate(METRICS.items())
    ]
    return index.select(ZONE_ID, ZONE_NAME, F.inline(F.array(*entries)))


def city_summary(index: DataFrame) -> DataFrame:
    """Mean, median, range and count of the overall score, one row."""
    whole_city = index.select(F.lit("all").alias("scope"), OVERALL)
    # Scores lie between 0 and 100. One row at most comes back.
    row = grouped_medians(whole_city, ["scope"], {OVERALL: (F.lit(0.0), F.lit(100.0))}).first()
    median = row[OVERALL] if row else None
    return index.agg(
        F.count(F.lit(1)).alias("area_count"),
        F.avg(OVERALL).alias("average_overall"),
        F.max(OVERALL).alias("highest_overall"),
        F.min(OVERALL).alias("lowest_overall"),
        (F.max(OVERALL) - F.min(OVERALL)).alias("score_range"),
        F.lit(median).cast("double").alias("median_overall"),
    )


def metric_stats(index: DataFrame) -> DataFrame:
    """Per metric: mean, sample deviation, best and worst area.

    ``strongest``, ``weakest`` and ``most_variable`` mark one metric each, the
    first listed among equals.
    """
    rows = stacked(index)
    first_high = F.min(F.when(F.col("score").isNotNull(), F.struct((-tie_safe(F.col("score"))).alias("k"), ZONE_ID, ZONE_NAME, "score")))
    first_low = F.min(F.when(F.col("score").isNotNull(), F.struct(tie_safe(F.col("score")).alias("k"), ZONE_ID, ZONE_NAME, "score")))
    stats = rows.groupBy("metric_no", "metric").agg(
        F.avg("score").alias("average"),
        F.stddev_samp("score").alias("deviation"),
        first_high.alias("_top"),
        first_low.alias("_bottom"),
    )
    # Four rows, one per metric, from here on.
    place = {
        "strongest": tie_safe(F.col("average")).desc_nulls_last(),
        "weakest": tie_safe(F.col("average")).asc_nulls_last(),
        "most_variable": tie_safe(F.col("deviation")).desc_nulls_last(),
    }
    marks = {
        name: F.row_number().over(Window.orderBy(order, F.col("metric_no"))) == 1 for name, order in place.items()
    }
    return stats.select(
        "metric",
        "average",
        "deviation",
        *[
            F.col(f"_{side}.{field}").alias(f"{side}_{name}")
            for side in ("top", "bottom")
            for field, name in ((ZONE_ID, "id"), (ZONE_NAME, "name"), ("score", "score"))
        ],
        *[mark.alias(name) for name, mark in marks.items()],
    )


def borough_averages(index: DataFrame) -> DataFrame:
    """Mean overall score per borough, best first."""
    averages = with_borough(index).groupBy("borough").agg(F.avg(OVERALL).alias("average_overall"))
    return averages.orderBy(tie_safe(F.col("average_overall")).desc_nulls_last(), "borough")


def _extreme(df: DataFrame, score: str, n: int, highest: bool) -> DataFrame:
    c = tie_safe(col(score))
    return df.orderBy(c.desc_nulls_last() if highest else c.asc_nulls_last(), col(ZONE_ID)).limit(n)


def top_areas(index: DataFrame, n: int = TOP_SIZE) -> DataFrame:
    return _extreme(index, OVERALL, n, highest=True).select(ZONE_ID, ZONE_NAME, OVERALL, RANK)


def bottom_areas(index: DataFrame, n: int = TOP_SIZE) -> DataFrame:
    return _extreme(index, OVERALL, n, highest=False).select(ZONE_ID, ZONE_NAME, OVERALL, RANK)


def top_and_bottom(index: DataFrame, n: int = TOP_SIZE) -> DataFrame:
    return (
        top_areas(index, n)
        .withColumn("side", F.lit("top"))
        .unionByName(bottom_areas(index, n).withColumn("side", F.lit("bottom")))
    )


def leaderboards(index: DataFrame, n: int = BOARD_SIZE) -> DataFrame:
    """First and last n areas of every metric.

    Spark limits each group to n rows before it shuffles, so a metric's whole
    column never gathers in one task.
    """
    rows = stacked(index)

    def board(side: str, order: Column) -> DataFrame:
        by_metric = Window.partitionBy("metric").orderBy(order, F.col(ZONE_ID))
        return (
            rows.withColumn("place", F.row_number().over(by_metric))
            .where(F.col("place") <= n)
            .select("metric", F.lit(side).alias("side"), F.col("place").cast("bigint").alias("place"), ZONE_NAME, "score")
        )

    c = tie_safe(F.col("score"))
    return board("top", c.desc_nulls_last()).unionByName(board("bottom", c.asc_nulls_last()))


def balance_boards(index: DataFrame, n: int = BOARD_SIZE) -> DataFrame:
    """The n areas whose four scores lie closest together, and furthest apart."""
    ranged = with_range(index)
    columns = [ZONE_NAME, "metric_range", OVERALL]
    balanced = _extreme(ranged, "metric_range", n, highest=False).select(F.lit("balanced").alias("side"), *columns)
    uneven = _extreme(ranged, "metric_range", n, highest=True).select(F.lit("uneven").alias("side"), *columns)
    return balanced.unionByName(uneven)


def rank_curve(index: DataFrame) -> DataFrame:
    """Every area with its scores and range, in rank order."""
    return (
        with_range(with_borough(index))
        .select(ZONE_ID, ZONE_NAME, "borough", OVERALL, *QUALITY_COLUMNS, RANK, "metric_range")
        .orderBy(RANK)
    )


def score_histogram(index: DataFrame, width: int = BIN_WIDTH, count_missing_as_zero: bool = False) -> DataFrame:
    """Areas per score bin of 0..100, empty bins too; the last bin holds 100.

    Areas without a score are left out, or counted in the first bin on demand.
    """
    bins = -(-100 // width)
    score = F.coalesce(col(OVERALL), F.lit(0.0)) if count_missing_as_zero else col(OVERALL)
    # least() would turn a missing score into the last bin.
    scored = index.where(score.isNotNull())
    numbered = scored.select(F.least(F.floor(score / width), F.lit(bins - 1)).alias("bin"))
    counts = numbered.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    start = F.col("id") * width
    return (
        index.sparkSession.range(bins)
        .join(counts, F.col("id") == F.col("bin"), "left")
        .select(
            F.concat(start, F.lit("-"), start + width).alias("label"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("area_count"),
        )
    )


def score_bands(index: DataFrame) -> DataFrame:
    """Band of the overall score and of every metric, by area."""
    return index.select(
        ZONE_ID, *[score_band(col(c)).alias(c.replace("_QualityScore", "_Band")) for c in [OVERALL, *QUALITY_COLUMNS]]
    )


def compare_areas(index: DataFrame, first_id: str, second_id: str) -> DataFrame:
    """Two areas side by side, one row per metric and one for the overall score."""
    if first_id == second_id:
        raise ValueError("Pick two different areas to compare")
    both = index.where(col(ZONE_ID).isin(first_id, second_id))
    entries = [
        F.struct(F.lit(label).alias("metric"), col(c).alias("score"))
        for label, c in [("Overall", OVERALL), *METRICS.items()]
    ]
    rows = both.select(ZONE_ID, F.inline(F.array(*entries)))

    def of(area: str) -> Column:
        return F.max(F.when(col(ZONE_ID) == F.lit(area), F.col("score")))

    compared = rows.groupBy("metric").agg(of(first_id).alias("a"), of(second_id).alias("b"))
    return compared.withColumn("diff", F.col("a") - F.col("b"))


def compare_wide(index: DataFrame, first_id: str, second_id: str) -> DataFrame:
    """Two areas as one row: every score of the first and of the second."""
    if first_id == second_id:
        raise ValueError("Pick two different areas to compare")
    columns = [ZONE_ID, ZONE_NAME, OVERALL, *QUALITY_COLUMNS]
    picked = index.where(col(ZONE_ID).isin(first_id, second_id))

    def of(area: str, c: str) -> Column:
        return F.max(F.when(col(ZONE_ID) == F.lit(area), col(c)))

    return picked.agg(
        *[of(area, c).alias(f"{c}_{side}") for side, area in (("a", first_id), ("b", second_id)) for c in columns]
    )
