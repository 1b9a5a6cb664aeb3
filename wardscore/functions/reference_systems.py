"""Reference systems of boundary files, by EPSG code, to and from degrees of longitude and latitude.

Transverse Mercator after Krueger (1912) in the series of Karney, "Transverse Mercator with an accuracy of a few nanometers"
(2011), to the fourth order; spherical Mercator as web maps use it; the state plane from ``projection``. Formulas are steps of
SQL over arrays of points, each on the values of the step before. Shifts between data of different datums are taken as zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardscore.functions.projection import SEMI_MAJOR, lonlat_sql, over_points, plane_sql

# Codes of systems in degrees, of spherical Mercator, of the state plane; bands of codes whose last two digits
# are a transverse Mercator zone, with the number of zones and the false northing.
DEGREES = ["4326", "4269", "4258", "4979"]
WEB_MERCATOR = ["3857", "3785", "900913", "102100", "102113"]
STATE_PLANE = "2263"
ZONED = {"326": (60, 0.0), "327": (60, 10_000_000.0), "269": (23, 0.0), "258": (60, 0.0)}
FLATTENING = {"326": 1 / 298.257223563, "327": 1 / 298.257223563, "269": 1 / 298.257222101, "258": 1 / 298.257222101}
SCALE, FALSE_EASTING = 0.9996, 500_000.0


def code_of(name: Column) -> Column:
    """The EPSG code in a system's name or description, as text; NULL for no name."""
    by_authority = F.regexp_extract(name, r"(?i)EPSG[:/]{1,2}(?:[0-9.]*[:/])?([0-9]{4,6})", 1)
    bare = F.regexp_extract(name, r"(?:^|[^0-9.])([0-9]{4,6})(?:[^0-9.]|$)", 1)
    return F.when(name.isNull() | (name == "null"), F.lit(None).cast("string")).when(
        name.rlike(r"(?i)CRS:?84"), F.lit(DEGREES[0])
    ).otherwise(F.coalesce(F.nullif(by_authority, F.lit("")), F.nullif(bare, F.lit("")), name))


def zone_of(code: str) -> tuple[str, int] | None:
    """Band and zone of a transverse Mercator code."""
    if re.fullmatch(r"[0-9]{5}", code) and code[:3] in ZONED and 1 <= int(code[3:]) <= ZONED[code[:3]][0]:
        return code[:3], int(code[3:])
    return None


def is_known(code: Column) -> Column:
    """Whether ``to_degrees`` can read the code; NULL counts as degrees."""
    zones = [f"{band}{zone:02d}" for band, (n, _) in ZONED.items() for zone in range(1, n + 1)]
    return code.isNull() | code.isin(*DEGREES, *WEB_MERCATOR, STATE_PLANE, *zones)


def _series(n: float) -> dict[str, list[float]]:
    """Coefficients of the series, forward, backward and for the latitude."""
    n2, n3, n4 = n**2, n**3, n**4
    return {
        "to": [n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280],
        "from": [n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280],
        "latitude": [2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45, 56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630],
    }


def _transverse(band: str, zone: int) -> tuple[float, float, float, dict[str, list[float]], float]:
    """Radius times scale, central meridian in radians, false northing, series, eccentricity."""
    f = FLATTENING[band]
    n = f / (2 - f)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * SCALE
    return radius, f"radians({6 * zone - 183}D)", ZONED[band][1], _series(n), (f * (2 - f)) ** 0.5


def _sum(terms: list[float], one: str, other: str) -> str:
    """Terms times ``one`` of twice, four times ... the north and ``other`` of the same of the east coordinate."""
    return " + ".join(f"{c!r}D * {one}({2 * j} * p._n) * {other}({2 * j} * p._e)" for j, c in enumerate(terms, 1))


def _from_transverse(band: str, zone: int) -> list[dict[str, str]]:
    radius, meridian, north, series, _ = _transverse(band, zone)
    latitude = " + ".join(f"{c!r}D * sin({2 * j} * p._c)" for j, c in enumerate(series["latitude"], 1))
    return [
        {"_n": f"(p.y - {north!r}D) / {radius!r}D", "_e": f"(p.x - {FALSE_EASTING!r}D) / {radius!r}D"},
        {"_n": f"p._n - ({_sum(series['from'], 'sin', 'cosh')})", "_e": f"p._e - ({_sum(series['from'], 'cos', 'sinh')})"},
        {"_c": "asin(sin(p._n) / cosh(p._e))", "_l": "atan2(sinh(p._e), cos(p._n))"},
        {"x": f"degrees(p._l + {meridian})", "y": f"degrees(p._c + {latitude})"},
    ]


def _to_transverse(band: str, zone: int) -> list[dict[str, str]]:
    radius, meridian, north, series, ecc = _transverse(band, zone)
    return [
        {"_s": "sin(radians(p.y))", "_l": f"radians(p.x) - {meridian}"},
        {"_t": f"sinh(atanh(p._s) - {ecc!r}D * atanh({ecc!r}D * p._s))", "_l": "p._l"},
        {"_n": "atan2(p._t, cos(p._l))", "_e": "atanh(sin(p._l) / sqrt(1D + p._t * p._t))"},
        {
            "x": f"{FALSE_EASTING!r}D + {radius!r}D * (p._e + {_sum(series['to'], 'cos', 'sinh')})",
            "y": f"{north!r}D + {radius!r}D * (p._n + {_sum(series['to'], 'sin', 'cosh')})",
        },
    ]


FROM_WEB = [{"x": f"degrees(p.x / {SEMI_MAJOR!r}D)", "y": f"degrees(2 * atan(exp(p.y / {SEMI_MAJOR!r}D)) - pi() / 2)"}]
TO_WEB = [{"x": f"{SEMI_MAJOR!r}D * radians(p.x)", "y": f"{SEMI_MAJOR!r}D * ln(tan(pi() / 4 + radians(p.y) / 2))"}]


def _choose(code: str, plane: Callable, web: list, transverse: Callable) -> Callable[[str], str]:
    if code in DEGREES:
        return lambda points: points
    if code == STATE_PLANE:
        return plane
    steps = web if code in WEB_MERCATOR else transverse(*zone) if (zone := zone_of(code)) else None
    if steps is None:
        raise ValueError(f"Unknown reference system: {code}")
    return lambda points: over_points(points, steps)


def to_degrees(code: str) -> Callable[[str], str]:
    """Makes the SQL of an array of struct<x, y> in the system into that of the same points in degrees."""
    return _choose(code, lonlat_sql, FROM_WEB, _from_transverse)


def from_degrees(code: str) -> Callable[[str], str]:
    """The way back of ``to_degrees``."""
    return _choose(code, plane_sql, TO_WEB, _to_transverse)
