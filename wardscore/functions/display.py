"""Rounding, labels and bands of published figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound -> band name, from high to low.
SCORE_BANDS = [(90, "Excellent"), (70, "Good"), (50, "Moderate"), (30, "Below Average")]
LOWEST_BAND = "Needs Attention"


def rounded(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def whole(c: Column) -> Column:
    return F.bround(c).cast("bigint")


def score_band(score: Column) -> Column:
    """Band of the score rounded half up to a whole number; NULL for no score."""
    points = F.floor(score + F.lit(0.5))
    band = F.when(points.isNull(), F.lit(None).cast("string"))
    for bound, name in SCORE_BANDS:
        band = band.when(points >= bound, F.lit(name))
    return band.otherwise(F.lit(LOWEST_BAND))


def district_label(area_id: Column) -> Column:
    """'CD 1-01' for '101', 'CD 7' for ids shorter than three characters."""
    split = F.concat(F.substring(area_id, 1, 1), F.lit("-"), F.substr(area_id, F.lit(2)))
    return F.concat(F.lit("CD "), F.when(F.length(area_id) >= 3, split).otherwise(area_id))


def area_label(geography: str, area_id: Column, name: Column | None = None) -> Column:
    """What an area is called on screen, by geography."""
    if geography in ("borough", "nta"):
        return area_id if name is None else F.coalesce(name, area_id)
    if geography == "zip":
        return F.concat(F.lit("ZIP "), area_id)
    return district_label(area_id)
