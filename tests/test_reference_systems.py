"""Reference systems: published points, round trips, names in files."""

import math

import pytest
from pyspark.sql import functions as F

from wardscore.functions import reference_systems as R


def moved(spark, make, points):
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in points],)], "p array<struct<x:double,y:double>>")
    return [tuple(p) for p in df.select(F.expr(make("p")).alias("q")).first().q]


@pytest.mark.parametrize("code,plane,degrees,near", [
    # The meridian's length to 45 degrees, 4984944.378 m, times 0.9996.
    ("32618", (500000, 4982950.4), (-75, 45), 1e-8),
    ("26918", (500000, 4982950.4), (-75, 45), 1e-8),
    ("32718", (500000, 10000000 - 4982950.4), (-75, -45), 1e-8),
    ("3857", (6378137 * math.pi, 0), (180, 0), 1e-12),
    ("3857", (0, 20037508.342789244), (0, 85.0511287798066), 1e-9),
    ("2263", (984250, 0), (-74, 40.16666667), 1e-7),
    ("4326", (-74, 40), (-74, 40), 0),
])
def test_known_points(spark, code, plane, degrees, near):
    assert moved(spark, R.to_degrees(code), [plane])[0] == pytest.approx(degrees, abs=near)


@pytest.mark.parametrize("code", ["32618", "26917", "32756", "25832", "3857", "2263", "4269"])
def test_round_trips(spark, code):
    zone = R.zone_of(code)
    middle = 6 * zone[1] - 183 if zone else -74
    points = [(middle + dx, lat) for dx in (-3.2, -0.4, 0, 1.7, 3) for lat in (10.0, 40.7, 63.5)]
    back = moved(spark, R.to_degrees(code), moved(spark, R.from_degrees(code), points))
    for got, want in zip(back, points):
        assert got == pytest.approx(want, abs=2e-7 if code == "2263" else 1e-10)


def test_scale_is_true_to_shape(spark):
    """Conformal: a small step east and one north have the same length and stand upright on each other."""
    d = 1e-4
    lon, lat = -73.5, 40.7
    o, e, n = moved(spark, R.from_degrees("32618"), [(lon, lat), (lon + d, lat), (lon, lat + d)])
    ecc2 = 0.0066943799901413
    w = math.sqrt(1 - ecc2 * math.sin(math.radians(lat)) ** 2)
    east = math.dist(o, e) / (6378137 / w * math.cos(math.radians(lat)) * math.radians(d))
    north = math.dist(o, n) / (6378137 * (1 - ecc2) / w**3 * math.radians(d))
    assert east == pytest.approx(north, rel=1e-5) and 0.9996 <= east < 1.0004
    assert abs((e[0] - o[0]) * (n[0] - o[0]) + (e[1] - o[1]) * (n[1] - o[1])) < 1e-3


@pytest.mark.parametrize("name,code", [
    ("urn:ogc:def:crs:OGC:1.3:CRS84", "4326"), ("urn:ogc:def:crs:EPSG::2263", "2263"), ("EPSG:32618", "32618"), ("urn:ogc:def:crs:EPSG:6.9:3857", "3857"),
    ('{"type":"name","properties":{"name":"epsg:26918"}}', "26918"), ("http://www.opengis.net/def/crs/EPSG/0/4326", "4326"), (None, None), ("null", None),
    ("my own grid", "my own grid"), ('{"type":"EPSG","properties":{"code":2263}}', "2263"),
])
def test_names(spark, name, code):
    df = spark.createDataFrame([(name,)], "n string").select(R.code_of(F.col("n")).alias("c"))
    row = df.select("c", R.is_known(F.col("c")).alias("k")).first()
    assert row.c == code and row.k == (code != "my own grid")


def test_unknown_system():
    for code in ("27700", "32661", "32600", "26924", "abc"):
        with pytest.raises(ValueError):
            R.to_degrees(code)
