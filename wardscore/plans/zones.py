"""Point tables to scores per zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscore.functions.clean import clean_missing, number_column
from wardscore.operators.geometry import with_centroid, zone_bbox
from wardscore.operators.medians import grouped_medians
from wardscore.operators.scoring import burden_table, measure, quality, rank_rows, score_order
from wardscore.operators.settle import land, settle
from wardscore.operators.spatial import first_zone, points_in_zones
from wardscore.operators.tables import col, order_columns, require_columns, worked_out
from wardscore.plans.incidents import COORDINATE_BOUNDS
from wardscore.sources.laid_out import Extent, read_box

ZONE_ID = "Community_District_ID"
ZONE_NAME = "Community_District_Name"
TRUE_TEXTS = ["true", "1"]
# Column order of the zone table.
INCIDENT_COLUMNS = [
    ZONE_ID, ZONE_NAME, "Incident_Count", "Weighted_Severity_Sum", "Valid_Point_Count", "Point_Coverage_Rate",
    "Representative_Latitude", "Representative_Longitude", "CrimeBurden_z", "SafetyScore", "Rank", "Segment",
]


def valid_points(points: DataFrame) -> DataFrame:
    """Incident points flagged valid, inside the city box and weighted."""
    typed = points.withColumns(
        {c: number_column(points, c) for c in ("Latitude", "Longitude", "weighted_incident")}
    )
    flagged = col("has_valid_point")
    if points.schema["has_valid_point"].dataType != T.BooleanType():
        flagged = F.lower(F.trim(flagged.cast("string"))).isin(TRUE_TEXTS)
    inside = col("Latitude").between(*COORDINATE_BOUNDS["Latitude"]) & col("Longitude").between(
        *COORDINATE_BOUNDS["Longitude"]
    )
    return worked_out(typed).where(flagged & inside & col("weighted_incident").isNotNull())


def incident_zone_rows(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Every valid incident with every zone it lies strictly inside of."""
    return points_in_zones(valid_points(points), zones, exclude_boundary=True)


def city_extent() -> Extent:
    """The box that valid incident points lie in."""
    (south, north), (west, east) = COORDINATE_BOUNDS["Latitude"], COORDINATE_BOUNDS["Longitude"]
    return Extent(west, south, east, north)


def laid_out_zone_rows(spark: SparkSession, path: str, zones: DataFrame) -> DataFrame:
    """``incident_zone_rows`` of a few zones over incident points that ``lay_out`` wrote: only files near the zones are read.

    Without zones, or with zones without a shape, there are no rows.
    """
    box = zones.select(zone_bbox("parts").alias("box")).agg(
        *[f("box." + c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    )
    bounds = [float("nan") if v is None else v for v in box.first()]
    return incident_zone_rows(read_box(spark, path, *bounds), zones)


def incident_zone_index(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones with incident totals, name, centroid and SafetyScore."""
    needed = ["CMPLNT_NUM", "weighted_incident", "Latitude", "Longitude", "has_valid_point"]
    rows = incident_zone_rows(points.select(*needed), zones)
    totals = rows.groupBy("zone_id").agg(
        # Incidents without a number add to the sum but not to the count.
        F.count(clean_missing(F.col("CMPLNT_NUM"))).alias("Incident_Count"),
        F.sum("weighted_incident").alias("Weighted_Severity_Sum"),
    )
    # Zone tables may repeat an id; the first in file order gives name and place.
    first = F.min(F.struct("file_order", "zone_name", "Representative_Latitude", "Representative_Longitude"))
    places = with_centroid(zones).groupBy("zone_id").agg(first.alias("_z")).select(
        "zone_id", "_z.zone_name", "_z.Representative_Latitude", "_z.Representative_Longitude"
    )
    table = (
        totals.join(places, "zone_id", "left")
        .withColumnsRenamed({"zone_id": ZONE_ID, "zone_name": ZONE_NAME})
        .withColumn("Valid_Point_Count", F.col("Incident_Count"))
        .withColumn("Point_Coverage_Rate", F.lit(1.0))
    )
    return order_columns(burden_table(settle(table), ZONE_ID), INCIDENT_COLUMNS)


def zone_quality(
    points: DataFrame, zones: DataFrame, key: str, score: str, higher_is_better: bool, prefix: str
) -> DataFrame:
    """Points averaged per zone (first zone in file order wins), rescaled and ranked.

    Every row is a point of its own, whatever its ``key``: keys may repeat once they are trimmed, or be missing.
    """
    require_columns(points, [key])
    numbers = [number_column(points, c).alias(c) for c in ("Latitude", "Longitude", score)]
    typed = points.select(*numbers).na.drop(subset=["Latitude", "Longitude", score])
    # Landed, so that every pass sees a row under the same number.
    typed = land(typed.withColumn("_row", F.monotonically_increasing_id()), "points")
    # A zone's points lie in its box, which makes good bounds for their medians.
    boxed_zones = zones.withColumn("box", zone_bbox("parts"))
    placed = land(first_zone(typed, boxed_zones, "_row", [score, "Latitude", "Longitude"], zone_carry=["box"]).drop("_row"), "placed")
    means = placed.groupBy("zone_id").agg(F.count(F.lit(1)).alias("_count"), F.avg(col(score)).alias(score))
    box = F.col("box")
    medians = grouped_medians(
        placed,
        ["zone_id"],
        {"Latitude": (box["ymin"], box["ymax"]), "Longitude": (box["xmin"], box["xmax"])},
    )
    table = settle(
        means.join(medians, "zone_id").select(
            F.col("zone_id").alias(ZONE_ID),
            F.col("_count").alias(f"{prefix}_Point_Count"),
            col(score),
            F.col("Latitude").alias(f"{prefix}_Representative_Latitude"),
            F.col("Longitude").alias(f"{prefix}_Representative_Longitude"),
        )
    )
    n_rows, found = measure(table, [score])
    name = f"{prefix}_QualityScore"
    scored = table.withColumn(name, quality(col(score), found[score], higher_is_better))
    return rank_rows(scored, score_order(name, ZONE_ID, descending=True), "Rank", n_rows)
