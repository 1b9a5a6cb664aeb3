"""Air readings to one pollution score per district."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscore.functions.clean import clean_missing, collapse_ws, collapse_ws_text, to_number
from wardscore.functions.codes import POLLUTANTS, pollutant
from wardscore.operators.scoring import mean_z_table
from wardscore.operators.settle import settle
from wardscore.operators.tables import col, q, require_columns

KEYS = ["Geo Join ID", "Geo Place Name"]
NEEDED = ["Name", "Geo Type Name", *KEYS, "Data Value"]
SCORED = ["PM2.5", "NO2", "O3"]


def pollutant_readings(readings: DataFrame, geo_type: str) -> DataFrame:
    """Typed readings at one geography level.

    Readings without a key, a wanted pollutant or a number stay in as NULLs.
    They drop out of the means, and dropping them here would make Spark work
    out every column once for the filter and once more for the result.
    """
    wanted = require_columns(readings.drop("Message"), NEEDED).where(
        collapse_ws(col("Geo Type Name")) == F.lit(collapse_ws_text(geo_type))
    )
    return wanted.select(
        *[clean_missing(col(k)).alias(k) for k in KEYS],
        pollutant(col("Name")).alias("Pollutant"),
        to_number(col("Data Value")).alias("value"),
    )


def pollutant_means(readings: DataFrame, geo_type: str) -> DataFrame:
    """Mean reading by district and pollutant, in long form."""
    long = pollutant_readings(readings, geo_type)
    means = long.groupBy(*[col(k) for k in KEYS], "Pollutant").agg(F.avg("value").alias("avg_value"))
    return means.na.drop()


def air_pivot(readings: DataFrame, geo_type: str) -> DataFrame:
    """Mean reading by district, one column per pollutant.

    Conditional averages give the pivot in one aggregation and one shuffle.
    """
    long = pollutant_readings(readings, geo_type)
    names = list(POLLUTANTS.values())
    means = [F.avg(F.when(F.col("Pollutant") == p, F.col("value"))).alias(p) for p in names]
    wide = long.groupBy(*[col(k) for k in KEYS]).agg(*means)
    return wide.na.drop(subset=[q(k) for k in KEYS]).na.drop("all", subset=[q(p) for p in names])


def air_index(readings: DataFrame, geo_type: str = "CD") -> DataFrame:
    """Districts with pollutant means, z-scores and AirScore; rank 1 is most polluted."""
    wide = settle(air_pivot(readings, geo_type))
    scored = mean_z_table(wide, SCORED, "AirScore", KEYS[0], descending=True)
    return scored.withColumn("Geo Type Name", F.lit(collapse_ws_text(geo_type)))
