"""Score tables to one ranked index per district, and its nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.functions.clean import id_text
from wardscore.functions.codes import borough_of
from wardscore.functions.display import rounded, whole
from wardscore.operators.scoring import measure, quality, rank_rows, row_mean, score_order
from wardscore.operators.settle import settle
from wardscore.operators.tables import col
from wardscore.plans.zones import ZONE_ID, ZONE_NAME

QUALITY_COLUMNS = ["Air_QualityScore", "Water_QualityScore", "Education_QualityScore", "Safety_QualityScore"]
OVERALL = "Overall_QualityScore"
RANK = "Overall_Rank"
# Column order and wording of the published index.
INDEX_COLUMNS = [
    ZONE_ID, ZONE_NAME, "AirScore", "Air_QualityScore", "NO2", "O3", "PM2.5", "SafetyScore",
    "Safety_QualityScore", "Incident_Count", "Weighted_Severity_Sum", "WaterScore", "Water_QualityScore",
    "Water_Point_Count", "EducationScore", "Education_QualityScore", "Education_Point_Count", OVERALL, RANK,
]
DISTRICT_METHOD = "Equal average of air, water, education, and public safety quality scores"


def _rescaled(df: DataFrame, score: str, name: str, higher_is_better: bool) -> DataFrame:
    """Quality over the table's own full population, before any join narrows it."""
    _, found = measure(df, [score])
    return df.withColumn(name, quality(col(score), found[score], higher_is_better))


def combined_index(air: DataFrame, safety: DataFrame, water: DataFrame, education: DataFrame) -> DataFrame:
    """District index of four score tables; the air table sets which districts appear.

    ``air`` comes from ``air_index``, ``safety`` from ``incident_zone_index``,
    the other two from ``zone_quality``.
    """
    pollutants = [col(p).alias(p) if p in air.columns else F.lit(None).cast("double").alias(p) for p in ("NO2", "O3", "PM2.5")]
    air_scores = settle(
        air.select(
            id_text(col("Geo Join ID")).alias(ZONE_ID), col("Geo Place Name").alias(ZONE_NAME), "AirScore", *pollutants
        )
    )
    safety_scores = settle(
        safety.select(id_text(col(ZONE_ID)).alias(ZONE_ID), "SafetyScore", "Incident_Count", "Weighted_Severity_Sum")
    )
    joined = (
        _rescaled(air_scores, "AirScore", "Air_QualityScore", higher_is_better=False)
        .join(_rescaled(safety_scores, "SafetyScore", "Safety_QualityScore", higher_is_better=True), ZONE_ID, "left")
        .join(water.select(id_text(col(ZONE_ID)).alias(ZONE_ID), "WaterScore", "Water_QualityScore", "Water_Point_Count"), ZONE_ID, "left")
        .join(education.select(id_text(col(ZONE_ID)).alias(ZONE_ID), "EducationScore", "Education_QualityScore", "Education_Point_Count"), ZONE_ID, "left")
    )
    return ranked_index(settle(joined))


def ranked_index(scored: DataFrame) -> DataFrame:
    """Adds the overall score (mean of the four qualities present) and its rank."""
    overall = scored.withColumn(OVERALL, row_mean([col(c) for c in QUALITY_COLUMNS]))
    ranked = rank_rows(overall, score_order(OVERALL, ZONE_ID, descending=True), RANK, scored.count())
    return ranked.select(*[col(c) for c in INDEX_COLUMNS])


def index_from_raw(areas: DataFrame) -> DataFrame:
    """Index of a table that already holds the four raw scores per district."""
    areas = settle(areas)
    raw = {"Air": False, "Water": False, "Education": True, "Safety": True}
    _, found = measure(areas, [f"{name}Score" for name in raw])
    return ranked_index(
        areas.withColumns(
            {
                f"{name}_QualityScore": quality(col(f"{name}Score"), found[f"{name}Score"], better_high)
                for name, better_high in raw.items()
            }
        )
    )


def score_record(
    name: Column, borough: Column, code: Column, geography: str, method: str, source_label: str | None = None
) -> Column:
    """Nested record of one area's scores and the figures behind them."""

    def named(**parts: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    overall = {
        "rank": whole(col(RANK)),
        "components_used": F.lit(len(QUALITY_COLUMNS)),
        "method": F.lit(method),
    }
    if geography != "community_district":
        overall["source_label"] = F.lit(source_label).cast("string")
    return named(
        name=name,
        borough=borough,
        geography_type=F.lit(geography),
        code=code,
        overall=rounded(col(OVERALL)),
        air=rounded(col("Air_QualityScore")),
        water=rounded(col("Water_QualityScore")),
        edu=rounded(col("Education_QualityScore")),
        nypd=rounded(col("Safety_QualityScore")),
        details=named(
            overall=named(**overall),
            air=named(
                raw_score=rounded(col("AirScore"), 3),
                pm25=rounded(col("PM2.5"), 3),
                no2=rounded(col("NO2"), 3),
                o3=rounded(col("O3"), 3),
            ),
            water=named(raw_score=rounded(col("WaterScore"), 3), sample_sites=whole(col("Water_Point_Count"))),
            edu=named(raw_score=rounded(col("EducationScore"), 3), schools=whole(col("Education_Point_Count"))),
            nypd=named(
                raw_score=rounded(col("SafetyScore"), 3),
                incidents=whole(col("Incident_Count")),
                weighted_severity_sum=rounded(col("Weighted_Severity_Sum"), 1),
            ),
        ),
    )


def index_records(index: DataFrame) -> DataFrame:
    """geo_id and record of every district."""
    area = col(ZONE_ID)
    record = score_record(col(ZONE_NAME), borough_of(area), area, "community_district", DISTRICT_METHOD)
    return index.select(area.alias("geo_id"), record.alias("record"))


def index_json(index: DataFrame) -> DataFrame:
    """geo_id and the short published record as JSON text, rounded to two digits."""
    short = F.struct(
        col(ZONE_NAME).alias("name"),
        rounded(col(OVERALL)).alias("overall"),
        rounded(col("Air_QualityScore")).alias("air"),
        rounded(col("Water_QualityScore")).alias("water"),
        rounded(col("Education_QualityScore")).alias("edu"),
        rounded(col("Safety_QualityScore")).alias("nypd"),
    )
    return index.select(col(ZONE_ID).alias("geo_id"), F.to_json(short, {"ignoreNullFields": "false"}).alias("record"))


def find_area(records: DataFrame, geo_id: str) -> DataFrame:
    """The record of one area; no row if there is none."""
    return records.where(F.col("geo_id") == F.lit(geo_id))
