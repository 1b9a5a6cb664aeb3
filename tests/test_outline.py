"""Unions of polygons: areas by sampling and by hand, closed rings, nothing left inside."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from test_quadtree import shape_rows
from wardscore.operators import geometry as G
from wardscore.operators import outline as O
from wardscore.plans.rollup import boroughs, geo_features


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def union(spark, groups, **options):
    """Polygons of the union of each group's members: lists of rings of (x, y)."""
    names = [name for name, members in groups.items() for _ in members]
    places = [i for members in groups.values() for i in range(len(members))]
    rows = shape_rows(spark, [shape for members in groups.values() for shape in members])
    named = F.array(*map(F.lit, names))[F.col("file_order").cast("int")], F.array(*map(F.lit, places))[F.col("file_order").cast("int")]
    rows = rows.withColumns({"zone_id": named[0], "file_order": named[1].cast("bigint"), "zone_name": F.concat(F.lit("n"), named[1])})
    found = {name: [] for name in groups}
    for r in O.outlines(rows, **{"grid": 1e-7, **options}).collect():
        assert r.zone_name == "n0" and r.file_order == 0 and len(r.parts) == 1
        found[r.zone_id].append([[(p.x, p.y) for p in ring] for ring in r.parts[0]])
    return found


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def checked(polygons):
    """Total area; rings are closed, wound as they should be, and use no edge twice."""
    edges = []
    for rings in polygons:
        for i, ring in enumerate(rings):
            assert ring[0] == ring[-1] and len(ring) > 3
            assert (area(ring) > 0) == (i == 0)
            edges += [frozenset(e) for e in zip(ring, ring[1:])]
    assert len(edges) == len(set(edges))
    return sum(area(ring) for rings in polygons for ring in rings)


def length(polygons):
    return sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for rings in polygons for ring in rings for a, b in zip(ring, ring[1:]))


CASES = {
    "one": ([[[box(0, 0, 4, 4)]]], 16, 16, 1),
    "side by side": ([[[box(0, 0, 4, 4)]], [[box(4, 0, 4, 4)]]], 32, 24, 1),
    "corners in the middle of a side": ([[[box(0, 0, 4, 4)]], [[box(4, 1, 2, 2)]]], 20, 20, 1),
    "overlapping": ([[[box(0, 0, 4, 4)]], [[box(2, 2, 4, 4)]]], 28, 24, 1),
    "copies": ([[[box(0, 0, 4, 4)]]] * 5, 16, 16, 1),
    "one inside": ([[[box(0, 0, 8, 8)]], [[box(2, 2, 2, 2)]]], 64, 32, 1),
    "hole": ([[[box(0, 0, 8, 8), box(2, 2, 4, 4)]]], 48, 48, 1),
    "hole filled": ([[[box(0, 0, 8, 8), box(2, 2, 4, 4)]], [[box(2, 2, 4, 4)]]], 64, 32, 1),
    "island in a hole": ([[[box(0, 0, 8, 8), box(1, 1, 6, 6)]], [[box(3, 3, 2, 2)]]], 32, 64, 2),
    "touching in a corner": ([[[box(0, 0, 2, 2)]], [[box(2, 2, 2, 2)]]], 8, 16, 2),
    "ring of four": ([[[box(0, 0, 3, 1)]], [[box(2, 0, 1, 3)]], [[box(0, 2, 3, 1)]], [[box(0, 0, 1, 3)]]], 8, 16, 1),
    "cross": ([[[box(0, 3, 10, 2)]], [[box(4, 0, 2, 9)]]], 34, 38, 1),
    "apart": ([[[box(0, 0, 1, 1)], [box(5, 5, 1, 1)]]], 2, 8, 2),
    "clockwise": ([[[box(0, 0, 4, 4)[::-1]]], [[box(2, 0, 4, 4)]]], 24, 20, 1),
    "slanted": ([[[[(0, 0), (4, 0), (4, 4)]]], [[[(0, 0), (4, 4), (0, 4)]]]], 16, 16, 1),
}


def test_unions_by_hand(spark):
    # All groups lie in the same place: they must not mix.
    found = union(spark, {name: case[0] for name, case in CASES.items()})
    for name, (_, want, border, n) in CASES.items():
        got = found[name]
        assert (name, pytest.approx(want), pytest.approx(border), n) == (name, checked(got), length(got), len(got))


def crossings(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2


def star(n, draw, cx, cy, size):
    """A simple polygon: one corner per angle."""
    at = sorted((draw.uniform(0, 2 * math.pi), size * draw.uniform(0.4, 1)) for _ in range(n))
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in at]


def test_random_stars_by_sampling(spark):
    draw = random.Random(5)
    members = [[[star(12, draw, draw.uniform(0, 6), draw.uniform(0, 6), 1.2)]] for _ in range(25)]
    got = union(spark, {"g": members}, grid=1e-9, most_edges=16)["g"]
    checked(got)
    for _ in range(4000):
        x, y = draw.uniform(-1, 7), draw.uniform(-1, 7)
        inside = any(crossings([*rings[0], rings[0][0]], x, y) for parts in members for rings in parts)
        assert inside == (sum(crossings(ring, x, y) for rings in got for ring in rings) == 1)


def test_boroughs_of_given_districts(spark, sf_dir):
    layer = boroughs(A.districts(spark, sf_dir))
    total = lambda df: {r[0]: r[1] for r in df.groupBy("zone_id").agg(F.sum(O.perimeter("parts"))).collect()}
    inner, outer = total(layer), total(O.outlines(layer))
    assert inner and outer.keys() == inner.keys() and all(0 < outer[k] < inner[k] + 1e-9 for k in inner)


def test_features_of_outlines_by_row(spark):
    shapes = shape_rows(spark, [[[box(0, 0, 1, 1)], [box(5, 5, 1, 1)]], [[box(0, 0, 1, 1)]]])
    records = spark.createDataFrame([("0",)], "geo_id string")
    rows = geo_features(O.outlines(shapes), records, "nta", by_row=True).collect()
    assert [r.geo_id for r in rows] == ["0", "0"]
    assert all(len(json.loads(r.feature)["geometry"]["coordinates"]) == 1 for r in rows)
    whole = geo_features(O.outlines(shapes), records, "nta").collect()
    assert len(whole) == 1 and len(json.loads(whole[0].feature)["geometry"]["coordinates"]) == 2


def test_missing_ids_and_nothing(spark):
    rows = shape_rows(spark, [[[box(0, 0, 1, 1)]]]).withColumn("zone_id", F.lit(None).cast("string"))
    assert O.outlines(rows).count() == 0
    assert O.outlines(rows.limit(0)).count() == 0


def test_the_area_filter_closes_a_ring_once(spark):
    """The area's sum reads the closed ring, it does not close it again at every corner."""
    rows = spark.createDataFrame([("a", 1, box(0.0, 0.0, 2.0, 1.0)[:4]), ("a", 2, [(0.0, 0.0), (1.0, 1.0)])], "zone_id string, _ring int, _c array<struct<x: double, y: double>>")
    rings = O._with_area(rows)
    assert [(r._ring, r._area, len(r._c)) for r in rings.collect()] == [(1, 4.0, 5)]
    plan = rings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1 and plan.count("aggregate(") == 1
