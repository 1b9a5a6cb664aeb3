"""Polygons as nested arrays of points, and measures of them as Spark expressions.

A zone row holds ``parts``: array (polygons) of array (rings, the outer one
first, then holes) of array of struct<x, y>. A ring may repeat its first point
at the end or not. Functions take the name of an array column; array formulas
are written as SQL, which nests more readably than functions of functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.functions.projection import lonlat_sql, plane_sql, with_lonlat
from wardscore.functions.reference_systems import to_degrees

PARTS_TYPE = "array<array<array<struct<x:double,y:double>>>>"
EDGE_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"
BOX = ("xmin", "ymin", "xmax", "ymax")

# Edges around a ring, closed if need be; none for fewer than three points.
RING_EDGES = f"""
CASE WHEN size(ring) >= 3 THEN
  filter(
    zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)),
             (p, n) -> named_struct('x1', p.x, 'y1', p.y, 'x2', n.x, 'y2', n.y)),
    e -> e.x1 <> e.x2 OR e.y1 <> e.y2)
ELSE cast(array() AS array<{EDGE_TYPE}>) END"""


def part_edges(parts: str) -> Column:
    """The same nesting as ``parts``, with edges in place of points."""
    return F.expr(f"transform({parts}, rings -> transform(rings, ring -> {RING_EDGES}))")


def signed_edges(parts: str) -> Column:
    """All edges of a shape in one array, each with a sign ``s``.

    The sign makes outer rings count as counter-clockwise and holes as
    clockwise, whichever way the file winds them. Each step works on the array
    the one before made, so that a ring's turn is summed up once.
    """
    rings = f"flatten(transform({parts}, rings -> transform(rings, (ring, i) -> struct(i = 0 AS outer, {RING_EDGES} AS edges))))"
    turn = "aggregate(r.edges, 0D, (total, e) -> total + (e.x1 * e.y2 - e.x2 * e.y1))"
    turned = f"transform({rings}, r -> struct(r.edges AS edges, signum({turn}) * CASE WHEN r.outer THEN 1D ELSE -1D END AS s))"
    return F.expr(
        f"flatten(transform({turned}, r -> transform(r.edges, e -> struct(e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2, r.s AS s))))"
    )


def _signed_sum(signed: str, factor: str) -> str:
    return f"aggregate({signed}, 0D, (total, e) -> total + ({factor}) * e.s * (e.x1 * e.y2 - e.x2 * e.y1))"


def area(signed: str) -> Column:
    """Planar area of signed edges, holes taken off."""
    return F.expr(f"{_signed_sum(signed, '1D')} / 2D")


def centroid(signed: str) -> tuple[Column, Column]:
    """Planar centroid, holes taken off; NULL for a shape without area."""
    base = f"nullif(3D * {_signed_sum(signed, '1D')}, 0D)"
    return tuple(F.expr(f"{_signed_sum(signed, f'e.{c}1 + e.{c}2')} / {base}") for c in "xy")


def _box(points: str) -> Column:
    xs, ys = (f"transform({points}, p -> p.{c})" for c in "xy")
    return F.expr(
        f"struct(array_min({xs}) AS xmin, array_min({ys}) AS ymin, array_max({xs}) AS xmax, array_max({ys}) AS ymax)"
    )


def zone_bbox(parts: str) -> Column:
    """Box around all parts: struct<xmin, ymin, xmax, ymax>."""
    return _box(f"flatten(flatten({parts}))")


def part_bbox(rings: str) -> Column:
    """Box around one part."""
    return _box(f"flatten({rings})")


def _each_ring(parts: str, ring_sql: str) -> str:
    return f"transform({parts}, rings -> transform(rings, ring -> {ring_sql}))"


def to_plane(parts: str) -> Column:
    """Longitude/latitude points to plane feet."""
    return F.expr(_each_ring(parts, plane_sql("ring")))


def to_lonlat(parts: str) -> Column:
    """Plane feet to longitude/latitude points."""
    return F.expr(_each_ring(parts, lonlat_sql("ring")))


def in_degrees(parts: str, code: str) -> Column:
    """Points of a reference system, by its EPSG code, to longitude/latitude points."""
    return F.expr(_each_ring(parts, to_degrees(code)("ring")))


def with_centroid(zones: DataFrame) -> DataFrame:
    """Adds Representative_Latitude/Longitude: the centroid taken in the plane."""
    plane = zones.withColumn("_plane", to_plane("parts"))
    signed = plane.withColumn("_signed", signed_edges("_plane"))
    x, y = centroid("_signed")
    return with_lonlat(signed, x, y, "Representative_Longitude", "Representative_Latitude").drop("_plane", "_signed")
