"""Water samples to one score per sampling site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscore.functions.clean import clean_missing, number_column, to_number, uncensor
from wardscore.functions.projection import with_lonlat
from wardscore.operators.scoring import mean_z_table
from wardscore.operators.settle import settle
from wardscore.operators.tables import col, lookup_join, order_columns, q

SITE = "Sample Site"
SAMPLE_CLASS = "Sample class"

# Measures, those reported as text with a detection limit, lookup columns.
PLAIN = ["Residual Free Chlorine (mg/L)", "Turbidity (NTU)", "Fluoride (mg/L)"]
CENSORED = ["Coliform (Quanti-Tray) (MPN /100mL)", "E.coli(Quanti-Tray) (MPN/100mL)"]
MEASURES = PLAIN + CENSORED
LOOKUP_NAMES = {
    "X - Coordinate": "X_COORDINATE",
    "Y - Coordinate": "Y_COORDINATE",
    "Sample Station (SS) - Location Description": "Location_Description",
}
COLUMN_ORDER = [
    SITE, "Location_Description", "X_COORDINATE", "Y_COORDINATE", "Latitude", "Longitude",
    *MEASURES, *[f"z_{m}" for m in MEASURES], "WaterScore", "Rank", "Segment",
]


def add_lonlat(df: DataFrame) -> DataFrame:
    """Latitude and Longitude from X_COORDINATE and Y_COORDINATE; NULL without them."""
    if "X_COORDINATE" in df.columns and "Y_COORDINATE" in df.columns:
        return with_lonlat(df, number_column(df, "X_COORDINATE"), number_column(df, "Y_COORDINATE"))
    return df.withColumns({"Latitude": F.lit(None).cast("double"), "Longitude": F.lit(None).cast("double")})


def site_means(samples: DataFrame, sample_class: str | None) -> DataFrame:
    """Mean of every measure present, by site."""
    used = [m for m in MEASURES if m in samples.columns]
    if not used:
        raise ValueError("No water measure among the columns")
    if sample_class and SAMPLE_CLASS in samples.columns:
        samples = samples.where(col(SAMPLE_CLASS) == F.lit(sample_class))
    # Sites are grouped as written; only the lookup compares them trimmed.
    typed = samples.select(
        clean_missing(col(SITE)).alias(SITE),
        *[(to_number(uncensor(col(m))) if m in CENSORED else number_column(samples, m)).alias(m) for m in used],
    )
    means = typed.groupBy(col(SITE)).agg(*[F.avg(col(m)).alias(m) for m in used])
    return means.na.drop(subset=[q(SITE)])


def water_index(
    samples: DataFrame,
    lookup: DataFrame | None = None,
    sample_class: str | None = "Compliance",
    lookup_order: Sequence[str] = (),
) -> DataFrame:
    """Sites with measure means, z-scores and WaterScore; rank 1 is the lowest score.

    With a lookup, sites also get their coordinates and description.
    """
    means = settle(site_means(samples, sample_class))
    scored = mean_z_table(means, [m for m in MEASURES if m in means.columns], "WaterScore", SITE, descending=False)
    if lookup is not None and SITE in lookup.columns:
        kept = lookup.select(*[col(c) for c in [SITE, *LOOKUP_NAMES, *lookup_order] if c in lookup.columns])
        scored = add_lonlat(lookup_join(scored, kept.withColumnsRenamed(LOOKUP_NAMES), SITE, lookup_order))
    return order_columns(scored, COLUMN_ORDER)
