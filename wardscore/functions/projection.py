"""Lambert conformal conic projection of the New York Long Island state plane.

Closed forms after Snyder, "Map Projections: A Working Manual" (1987), as column
expressions: US survey feet (EPSG:2263) to and from longitude/latitude degrees.
The NAD83 to WGS84 shift is taken as zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published parameters of the projection (GRS80 ellipsoid).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLEL_1 = math.radians(41 + 2 / 60)
PARALLEL_2 = math.radians(40 + 40 / 60)
LATITUDE_0 = math.radians(40 + 10 / 60)
LONGITUDE_0 = math.radians(-74.0)
FALSE_EASTING = 300000.0
METRES_PER_FOOT = 1200 / 3937

ECC = math.sqrt(FLATTENING * (2 - FLATTENING))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (ECC * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) * math.exp(ECC * math.atanh(ECC * math.sin(phi)))


CONE = (math.log(_m(PARALLEL_1)) - math.log(_m(PARALLEL_2))) / (
    math.log(_t(PARALLEL_1)) - math.log(_t(PARALLEL_2))
)
SCALE = SEMI_MAJOR * _m(PARALLEL_1) / (CONE * _t(PARALLEL_1) ** CONE)
RHO_0 = SCALE * _t(LATITUDE_0) ** CONE
INVERSE_STEPS = 5


# The formulas as steps of SQL, each on the values of the step before: as columns of
# a table (v = "") or as fields of the points of an array (v = "p.").


def _plane_steps(v: str, lon: str, lat: str) -> list[dict[str, str]]:
    phi = f"radians({v}{lat})"
    return [
        {
            "_t": f"tan(pi() / 4 - {phi} / 2) * exp({ECC!r}D * atanh({ECC!r}D * sin({phi})))",
            "_theta": f"(radians({v}{lon}) - {LONGITUDE_0!r}D) * {CONE!r}D",
        },
        {"_rho": f"{SCALE!r}D * pow({v}_t, {CONE!r}D)", "_theta": f"{v}_theta"},
        {
            "x": f"({FALSE_EASTING!r}D + {v}_rho * sin({v}_theta)) / {METRES_PER_FOOT!r}D",
            "y": f"({RHO_0!r}D - {v}_rho * cos({v}_theta)) / {METRES_PER_FOOT!r}D",
        },
    ]


def _lonlat_steps(v: str, x: str, y: str) -> list[dict[str, str]]:
    phi = f"pi() / 2 - 2 * atan({v}_t)"
    # Each step refers to the one before once, so the expression grows linearly.
    for _ in range(INVERSE_STEPS):
        phi = f"pi() / 2 - 2 * atan({v}_t * exp({-ECC!r}D * atanh({ECC!r}D * sin({phi}))))"
    return [
        # Metres from the apex of the cone: east, and towards the equator.
        {
            "_east": f"{v}{x} * {METRES_PER_FOOT!r}D - {FALSE_EASTING!r}D",
            "_north": f"{RHO_0!r}D - {v}{y} * {METRES_PER_FOOT!r}D",
        },
        # The cone's own coordinates: scaled radius and angle.
        {
            "_t": f"pow(sqrt({v}_east * {v}_east + {v}_north * {v}_north) / {SCALE!r}D, {1 / CONE!r}D)",
            "_theta": f"atan2({v}_east, {v}_north)",
        },
        {"x": f"degrees({v}_theta / {CONE!r}D + {LONGITUDE_0!r}D)", "y": f"degrees({phi})"},
    ]


def over_points(points: str, steps: list[dict[str, str]]) -> str:
    for step in steps:
        fields = ", ".join(f"{formula} AS {name}" for name, formula in step.items())
        points = f"transform({points}, p -> struct({fields}))"
    return points


def plane_sql(points: str) -> str:
    """SQL of an array of degrees struct<x, y> in plane feet."""
    return over_points(points, _plane_steps("p.", "x", "y"))


def lonlat_sql(points: str) -> str:
    """SQL of an array of plane feet struct<x, y> in degrees."""
    return over_points(points, _lonlat_steps("p.", "x", "y"))


def _with_steps(df: DataFrame, first: Column, second: Column, steps: list[dict[str, str]], out: tuple[str, str]) -> DataFrame:
    """Columns computed step by step, so that every part of the formula is computed once.

    The last step is a generator of one row: a later filter on the result then
    stays above it, instead of dragging a copy of the whole formula to the scan.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in out]
    staged = df.select(*kept, first.cast("double").alias("_first"), second.cast("double").alias("_second"))
    for step in steps[:-1]:
        staged = staged.select(*kept, *[F.expr(formula).alias(name) for name, formula in step.items()])
    last = F.struct(*[F.expr(formula).alias(name) for name, formula in zip(out, steps[-1].values())])
    return staged.select(*kept, F.inline(F.array(last)))


def with_plane(df: DataFrame, lon: Column, lat: Column, x: str, y: str) -> DataFrame:
    """Adds plane feet of degrees; NULL where either coordinate is NULL."""
    return _with_steps(df, lon, lat, _plane_steps("", "_first", "_second"), (x, y))


def with_lonlat(df: DataFrame, x: Column, y: Column, lon: str = "Longitude", lat: str = "Latitude") -> DataFrame:
    """Adds degrees of plane feet; NULL where either coordinate is NULL."""
    return _with_steps(df, x, y, _lonlat_steps("", "_first", "_second"), (lon, lat))
