"""Incident log to severity weights, clean points and one safety score per unit."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.functions.clean import area_code, number_column, precinct_code, within
from wardscore.functions.codes import attempt_factor, severity
from wardscore.operators.medians import grouped_medians
from wardscore.operators.scoring import burden_table
from wardscore.operators.settle import settle
from wardscore.operators.tables import keep_known, order_columns, require_columns

# Columns of the incident log.
REQUIRED = ["BORO_NM", "LAW_CAT_CD", "CRM_ATPT_CPTD_CD"]
OPTIONAL = [
    "CMPLNT_NUM", "ADDR_PCT_CD", "OFNS_DESC", "PD_DESC", "CMPLNT_FR_DT", "CMPLNT_TO_DT",
    "LOC_OF_OCCUR_DESC", "PREM_TYP_DESC", "X_COORD_CD", "Y_COORD_CD", "Latitude", "Longitude",
]
GEO_LEVELS = ("precinct", "borough")

# What coordinates of the city may be.
COORDINATE_BOUNDS = {
    "Latitude": (40.45, 40.95),
    "Longitude": (-74.30, -73.65),
    "X_COORD_CD": (900000.0, 1100000.0),
    "Y_COORD_CD": (110000.0, 280000.0),
}
REPRESENTATIVE = {
    "X_COORD_CD": "Representative_X",
    "Y_COORD_CD": "Representative_Y",
    "Latitude": "Representative_Latitude",
    "Longitude": "Representative_Longitude",
}
# Column order of the exports.
POINT_COLUMNS = [
    "CMPLNT_NUM", "Geo_Unit", "BORO_NM", "ADDR_PCT_CD", "CMPLNT_FR_DT", "CMPLNT_TO_DT", "OFNS_DESC",
    "PD_DESC", "LOC_OF_OCCUR_DESC", "PREM_TYP_DESC", "LAW_CAT_CD", "CRM_ATPT_CPTD_CD",
    "severity_weight", "attempt_factor", "weighted_incident",
    "X_COORD_CD", "Y_COORD_CD", "Latitude", "Longitude", "has_valid_point",
]
UNIT_COLUMNS = [
    "Geo_Unit", "Incident_Count", "Weighted_Severity_Sum", "Valid_Point_Count", "Point_Coverage_Rate",
    *REPRESENTATIVE.values(), "CrimeBurden_z", "SafetyScore", "Rank", "Segment",
]


def known_columns(incidents: DataFrame) -> DataFrame:
    """Required columns checked, all unknown ones left unread."""
    return keep_known(require_columns(incidents, REQUIRED), REQUIRED + OPTIONAL)


def with_unit(incidents: DataFrame, geo_level: str = "precinct") -> DataFrame:
    """Geo_Unit: the borough, or borough and precinct."""
    if geo_level not in GEO_LEVELS:
        raise ValueError(f"geo_level must be one of {GEO_LEVELS}, not {geo_level!r}")
    boro = area_code(F.col("BORO_NM"))
    if geo_level == "borough":
        return incidents.withColumn("Geo_Unit", boro)
    require_columns(incidents, ["ADDR_PCT_CD"])
    return incidents.withColumn("Geo_Unit", F.concat(boro, F.lit("-PCT-"), precinct_code(F.col("ADDR_PCT_CD"))))


def with_weights(incidents: DataFrame, keyword_rule: str = "last") -> DataFrame:
    """Severity, share by completion, and their product."""
    offense = F.col("OFNS_DESC") if "OFNS_DESC" in incidents.columns else None
    weight, factor = severity(F.col("LAW_CAT_CD"), offense, keyword_rule), attempt_factor(F.col("CRM_ATPT_CPTD_CD"))
    return incidents.withColumns(
        {"severity_weight": weight, "attempt_factor": factor, "weighted_incident": weight * factor}
    )


def with_location(incidents: DataFrame) -> DataFrame:
    """Coordinates out of bounds become NULL; a point is valid with both pairs."""
    clean = {
        name: within(number_column(incidents, name), lo, hi)
        for name, (lo, hi) in COORDINATE_BOUNDS.items()
        if name in incidents.columns
    }
    located = incidents.withColumns(clean)
    if len(clean) < len(COORDINATE_BOUNDS):
        return located.withColumn("has_valid_point", F.lit(False))
    return located.withColumn("has_valid_point", reduce(and_, (F.col(c).isNotNull() for c in COORDINATE_BOUNDS)))


def clean_incidents(incidents: DataFrame, geo_level: str = "precinct", keyword_rule: str = "last") -> DataFrame:
    return with_location(with_weights(with_unit(known_columns(incidents), geo_level), keyword_rule))


def incident_points(incidents: DataFrame, geo_level: str = "precinct") -> DataFrame:
    """The clean incident rows in export order."""
    points = clean_incidents(incidents, geo_level)
    return order_columns(keep_known(points, POINT_COLUMNS), POINT_COLUMNS)


def totals() -> dict[str, Column]:
    """What is summed up per unit."""
    return {
        "Incident_Count": F.lit(1).cast("bigint"),
        "Weighted_Severity_Sum": F.col("weighted_incident"),
        "Valid_Point_Count": F.col("has_valid_point").cast("bigint"),
    }


def unit_totals(clean: DataFrame) -> DataFrame:
    """Counts and sums by unit; combines on the map side."""
    return clean.groupBy("Geo_Unit").agg(*[F.sum(c).alias(name) for name, c in totals().items()])


def unit_table(clean: DataFrame) -> DataFrame:
    """Totals, coverage and the median point of each unit."""
    bounds = {
        name: (F.lit(lo), F.lit(hi)) for name, (lo, hi) in COORDINATE_BOUNDS.items() if name in clean.columns
    }
    table = grouped_medians(clean, ["Geo_Unit"], bounds, totals()) if bounds else unit_totals(clean)
    count = F.col("Incident_Count")
    coverage = F.col("Valid_Point_Count") / F.when(count != 0, count).otherwise(F.lit(1))
    return table.withColumnsRenamed(REPRESENTATIVE).withColumn("Point_Coverage_Rate", coverage)


def incident_index(incidents: DataFrame, geo_level: str = "precinct", keyword_rule: str = "last") -> DataFrame:
    """Units with totals and SafetyScore; rank 1 is the safest."""
    units = settle(unit_table(clean_incidents(incidents, geo_level, keyword_rule)))
    scored = burden_table(units, "Geo_Unit")
    return order_columns(scored, UNIT_COLUMNS)
