import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wardscore.functions.projection import with_lonlat, with_plane
from wardscore.operators import geometry as G
from wardscore.operators import overlay as O
from wardscore.operators import spatial as S
from wardscore.sources.boundaries import load_zones, zones_from_features, features_from_text

ZONE_SCHEMA = f"zone_id string, zone_name string, file_order bigint, parts {G.PARTS_TYPE}"


def zones(spark, shapes):
    """shapes: id -> parts -> rings -> (x, y)."""
    rows = [
        (k, f"name {k}", i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in parts])
        for i, (k, parts) in enumerate(shapes)
    ]
    return spark.createDataFrame(rows, ZONE_SCHEMA)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


SHAPES = [
    ("big", [[box(0, 0, 4, 4)]]),
    ("ring", [[box(5, 0, 9, 4), box(6, 1, 8, 3)]]),
    ("twins", [[box(0, 6, 1, 7)], [box(3, 6, 4, 7)]]),
    ("over", [[box(2, 2, 6, 3)]]),
    ("ell", [[[(10, 0), (14, 0), (14, 2), (12, 2), (12, 4), (10, 4), (10, 0)]]]),
    ("clockwise", [[[(10, 6), (10, 8), (12, 8), (12, 6)]]]),
    ("line", [[[(0, 9), (1, 9)]]]),
    ("double", [[box(20, 0, 24, 4)], [box(22, 2, 26, 6)]]),
    ("tiny", [[box(20.01, 0.01, 20.03, 0.03)]]),
    ("huge", [[[(-300, -300), (300, -300), (0, 500)]]]),
]


def brute_in_ring(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1 + 1e-15) + x1:
            inside = not inside
    return inside and len(ring) >= 3


def brute(points):
    out = []
    for key, x, y in points:
        for zone, parts in SHAPES:
            if any(brute_in_ring(x, y, p[0]) and not any(brute_in_ring(x, y, h) for h in p[1:]) for p in parts):
                out.append((key, zone))
    return sorted(out)


def random_points(n=3000):
    rng = random.Random(1)
    points = [(i, rng.uniform(-1, 27), rng.uniform(-1, 10)) for i in range(n)]
    # A third of all points in one place.
    return points + [(n + i, 22.5, 2.5) for i in range(n // 2)]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "hot_rows": 100}, {"broadcast_bytes": 0}])
def test_points_in_zones_equals_brute_force(spark, options):
    points = random_points()
    df = spark.createDataFrame(points, "id bigint, Longitude double, Latitude double").repartition(5)
    got = S.points_in_zones(df, zones(spark, SHAPES), **options)
    assert sorted((r["id"], r["zone_id"]) for r in got.collect()) == brute(points)


def test_first_zone_takes_file_order(spark):
    points = random_points(500)
    df = spark.createDataFrame(points, "id bigint, Longitude double, Latitude double").withColumn("v", F.col("id") * 2.0)
    got = S.first_zone(df, zones(spark, SHAPES), "id", ["v"])
    order = {k: i for i, (k, _) in enumerate(SHAPES)}
    want = {}
    for key, zone in brute(points):
        want[key] = min(want.get(key, zone), zone, key=order.get)
    assert {r["id"]: r["zone_id"] for r in got.collect()} == want
    assert all(r["v"] == r["id"] * 2.0 for r in got.collect())


def test_points_on_edges_and_corners(spark):
    points = [(0, 0.0, 2.0), (1, 4.0, 2.0), (2, 0.0, 0.0), (3, 1.0, 1.0)]
    df = spark.createDataFrame(points, "id bigint, Longitude double, Latitude double")
    one = zones(spark, [SHAPES[0]])
    half_open = S.points_in_zones(df, one)
    assert sorted(r["id"] for r in half_open.collect()) == [0, 2, 3]
    strict = S.points_in_zones(df, one, exclude_boundary=True)
    assert [r["id"] for r in strict.collect()] == [3]


def test_points_without_coordinates_match_nothing(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, 1.0, None)], "id bigint, Longitude double, Latitude double")
    assert S.points_in_zones(df, zones(spark, SHAPES)).count() == 0


def test_area_and_centroid(spark):
    df = zones(spark, SHAPES).withColumn("s", G.signed_edges("parts"))
    x, y = G.centroid("s")
    got = {r["zone_id"]: (r["a"], r["x"], r["y"]) for r in df.select("zone_id", G.area("s").alias("a"), x.alias("x"), y.alias("y")).collect()}
    assert got["big"] == pytest.approx((16, 2, 2))
    assert got["ring"] == pytest.approx((12, 7, 2))
    assert got["twins"] == pytest.approx((2, 2, 6.5))
    assert got["clockwise"] == pytest.approx((4, 11, 7))
    assert got["ell"] == pytest.approx((12, 11 + 2 / 3, 1 + 2 / 3))
    assert got["line"][0] == 0 and got["line"][1] is None


def plane_overlay(spark, source, target, monkeypatch, **options):
    """Overlay with the projection left out, so that areas are known."""
    monkeypatch.setattr(G, "to_plane", F.col)
    return {
        (r["source_id"], r["target_id"]): r["intersection_area"]
        for r in O.overlay(zones(spark, source), zones(spark, target), **options).collect()
    }


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1}])
def test_overlay_known_areas(spark, monkeypatch, options):
    source = [
        ("two", [[box(0, 0, 2, 2)]]),
        ("ring", [[box(10, 0, 14, 4), box(11, 1, 13, 3)]]),
        ("left", [[box(20, 0, 21, 1)]]),
        ("pair", [[box(30, 0, 31, 1)], [box(31, 0, 32, 1)]]),
        ("same", [[[(40, 0), (44, 0), (42, 3)]]]),
    ]
    target = [
        ("shifted", [[[(1, 1), (1, 3), (3, 3), (3, 1)]]]),
        ("filler", [[box(11, 1, 13, 3)]]),
        ("corner", [[box(10, 0, 12, 2)]]),
        ("right", [[box(21, 0, 22, 1)]]),
        ("middle", [[box(30.5, 0, 31.5, 1)]]),
        ("same", [[[(40, 0), (44, 0), (42, 3)]]]),
    ]
    got = plane_overlay(spark, source, target, monkeypatch, **options)
    assert got == pytest.approx(
        {("two", "shifted"): 1, ("ring", "corner"): 3, ("pair", "middle"): 1, ("same", "same"): 6}
    )


def test_many_small_shapes_under_a_large_one(spark, monkeypatch):
    small = [(f"s{i}", [[box(i % 20, i // 20, i % 20 + 1, i // 20 + 1)]]) for i in range(400)]
    large = [("all", [[box(0.5, 0.5, 19.5, 19.5)]])]
    for source, target in ((small, large), (large, small)):
        plain = plane_overlay(spark, source, target, monkeypatch)
        assert sum(plain.values()) == pytest.approx(19 * 19) and len(plain) == 400
        assert plane_overlay(spark, source, target, monkeypatch, hot_rows=50) == pytest.approx(plain)


def clip(subject, clipper):
    """Sutherland-Hodgman on convex counter-clockwise polygons, then the shoelace."""
    out = subject
    for (ax, ay), (bx, by) in zip(clipper, clipper[1:] + clipper[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        new = []
        for p, n in zip(out, out[1:] + out[:1]):
            if side(p) >= 0:
                new.append(p)
            if (side(p) >= 0) != (side(n) >= 0):
                t = side(p) / (side(p) - side(n))
                new.append((p[0] + t * (n[0] - p[0]), p[1] + t * (n[1] - p[1])))
        out = new
        if not out:
            return 0.0
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(out, out[1:] + out[:1])) / 2


def test_overlay_equals_polygon_clipping(spark, monkeypatch):
    import math

    rng = random.Random(5)

    def convex(scale):
        cx, cy, r = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0.1, 1) * scale
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles]

    source = [(f"s{i}", convex(6)) for i in range(25)]
    target = [(f"t{i}", convex(1.5)) for i in range(60)]
    got = plane_overlay(spark, [(k, [[p]]) for k, p in source], [(k, [[p]]) for k, p in target], monkeypatch)
    want = {(s, t): clip(sp, tp) for s, sp in source for t, tp in target}
    for pair, a in want.items():
        assert got.get(pair, 0.0) == pytest.approx(a, abs=1e-9)
    assert len(got) > 50


def test_overlay_sums_shapes_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(G, "to_plane", F.col)
    merged = zones(spark, [("u", [[box(0, 0, 1, 1)]]), ("u", [[box(1, 0, 2, 1)]])])
    row = O.overlay(merged, zones(spark, [("t", [[box(0.5, 0, 1.5, 1)]])])).collect()
    assert len(row) == 1
    assert (row[0]["intersection_area"], row[0]["source_area"], row[0]["weight"]) == pytest.approx((1, 2, 1))


def test_weights_of_disjoint_sources_stay_below_one(spark):
    tiles = [(f"{i}-{j}", [[box(-74 + i / 10, 40.5 + j / 10, -74 + (i + 1) / 10, 40.5 + (j + 1) / 10)]]) for i in range(3) for j in range(3)]
    target = zones(spark, [("t", [[[(-73.95, 40.52), (-73.75, 40.55), (-73.8, 40.78), (-73.9, 40.7)]]])])
    total = O.overlay(zones(spark, tiles), target).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize(
    "x, y, lon, lat",
    [
        (984250, 0, -74, 40.1666667),
        (987600, 215300, -73.98790793, 40.75762458),
        (900000, 110000, -74.30279140, 40.46819906),
        (1100000, 280000, -73.58107836, 40.93444795),
    ],
)
def test_projection_constants(spark, x, y, lon, lat):
    df = with_lonlat(spark.createDataFrame([(float(x), float(y))], "x double, y double"), F.col("x"), F.col("y"))
    back = with_plane(df, F.col("Longitude"), F.col("Latitude"), "back_x", "back_y")
    row = back.select("Longitude", "Latitude", "back_x", "back_y").first()
    assert row[0] == pytest.approx(lon, abs=1e-7) and row[1] == pytest.approx(lat, abs=1e-7)
    assert row[2] == pytest.approx(x, abs=1e-5) and row[3] == pytest.approx(y, abs=1e-5)


def collection(features, **extra):
    return json.dumps({"type": "FeatureCollection", **extra, "features": features})


def feature(props, kind, coordinates):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates} if kind else None}


SQUARE = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
FEATURES = [
    feature({"BoroCD": 101, "cd_name": "One"}, "Polygon", SQUARE),
    feature({"BoroCD": " 102 ", "cd_name": "Two"}, "MultiPolygon", [SQUARE, [[[5, 5, 9], [6, 5, 9], [6, 6, 9]]]]),
    feature({"BoroCD": 103, "cd_name": "Point"}, "Point", [0, 0]),
    feature({"BoroCD": 104, "cd_name": "None"}, None, None),
]


def test_boundary_file(spark, tmp_path):
    path = tmp_path / "zones.geojson"
    path.write_text(collection(FEATURES))
    got = load_zones(spark, str(path)).orderBy("file_order").collect()
    assert [(r["zone_id"], r["zone_name"], len(r["parts"])) for r in got] == [("101", "One", 1), ("102", "Two", 2)]
    assert [tuple(p) for p in got[1]["parts"][1][0]] == [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]


def test_boundary_lines_keep_file_order(spark, tmp_path):
    path = tmp_path / "zones.geojsonl"
    path.write_text("\n".join(json.dumps(f) for f in FEATURES) + "\n")
    got = load_zones(spark, str(path), per_line=True).orderBy("file_order").collect()
    assert [r["zone_id"] for r in got] == ["101", "102"]


def test_boundaries_in_plane_feet(spark, tmp_path):
    path = tmp_path / "plane.geojson"
    ring = [[[984250, 0], [987600, 0], [987600, 215300]]]
    path.write_text(collection([feature({"id": "a"}, "Polygon", ring)], crs={"properties": {"name": "urn:ogc:def:crs:EPSG::2263"}}))
    points = load_zones(spark, str(path)).first()["parts"][0][0]
    assert tuple(points[0]) == pytest.approx((-74, 40.1666667), abs=1e-7)
    assert tuple(points[2]) == pytest.approx((-73.98790793, 40.75762458), abs=1e-7)


def test_boundary_file_without_id(spark, tmp_path):
    path = tmp_path / "bad.geojson"
    path.write_text(collection([feature({"colour": "red"}, "Polygon", SQUARE)]))
    with pytest.raises(ValueError):
        load_zones(spark, str(path))


def test_features_from_text(spark):
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(FEATURES)], "file_order bigint, text string")
    got = zones_from_features(features_from_text(df, "text"), "BoroCD", "cd_name")
    assert sorted(r["zone_id"] for r in got.collect()) == ["101", "102"]


def test_overlay_of_long_outlines(spark):
    """Two outlines of 5,000 corners, one the other moved: the shared area is known."""
    n, step = 2500, 360 / 2500

    def ring(shift):
        top = [(-74 + shift + 0.1 * math.cos(math.radians(i * step)), 40.7 + 0.1 * math.sin(math.radians(i * step))) for i in range(n)]
        doubled = []
        for i, (x, y) in enumerate(top):
            x2, y2 = top[(i + 1) % n]
            doubled += [{"x": x, "y": y}, {"x": (x + x2) / 2, "y": (y + y2) / 2}]
        return [[doubled + doubled[:1]]]

    kind = "zone_id string, file_order long, parts array<array<array<struct<x: double, y: double>>>>"
    one = spark.createDataFrame([("a", 0, ring(0.0))], kind)
    two = spark.createDataFrame([("b", 0, ring(0.0)), ("c", 1, ring(0.15)), ("d", 2, ring(0.3))], kind)
    got = {r["target_id"]: r for r in O.overlay(one, two).collect()}
    assert set(got) == {"b", "c"}
    assert got["b"]["weight"] == pytest.approx(1, abs=1e-9)
    # Discs of radius 0.1 whose centres lie 0.15 apart.
    lens = (2 * 0.01 * math.acos(0.75) - 0.075 * math.sqrt(0.04 - 0.0225)) / (math.pi * 0.01)
    assert got["c"]["weight"] == pytest.approx(lens, rel=2e-3)


def test_large_shapes_are_not_broadcast(spark):
    """Spark takes an array for one element: it would send shapes of a hundred megabytes to the driver as a few."""
    box = "array(array(array({})))".format(", ".join(f"struct({x} AS x, {y} AS y)" for x, y in (("a", "b"), ("a + 0.004", "b"), ("a + 0.004", "b + 0.004"), ("a", "b + 0.004"))))
    place = "-74 + 0.005 * (id % {side}) AS a", "40.6 + 0.005 * floor(id / {side}) AS b"

    def zones(n, side):
        cells = spark.range(n).selectExpr("id", *[p.format(side=side) for p in place])
        return cells.selectExpr("CAST(id AS string) AS zone_id", f"{box} AS parts")

    pieces = O.overlay(zones(40_000, 200), zones(40_000, 200))
    assert "BroadcastHashJoin" not in pieces._jdf.queryExecution().executedPlan().toString()
    assert pieces.count() == 40_000


def test_points_of_one_file_are_tested_by_many_tasks(spark):
    """Points that one task reads are spread before they meet cells that are broadcast; the matches stay the same."""
    points = spark.range(0, 200, 1, 1).select("id", (F.col("id") / 100 - 0.305).alias("Longitude"), F.lit(0.5).alias("Latitude"))
    matched = S.points_in_zones(points, zones(spark, [("z", [[box(0, 0, 1, 1)]])]))
    assert matched.rdd.getNumPartitions() > 1
    assert sorted(r["id"] for r in matched.collect()) == [i for i in range(200) if 0 < i / 100 - 0.305 < 1]
