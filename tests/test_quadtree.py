"""Point location by adaptive cells: against brute force, the other join, and bounds on what a cell holds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from test_spatial import SHAPES, brute, random_points, zones
from wardscore.operators import quadtree as Q
from wardscore.operators import spatial as S
from wardscore.plans.rollup import boroughs


def points_of(spark, points):
    return spark.createDataFrame(points, "id bigint, Longitude double, Latitude double").repartition(5)


@pytest.mark.parametrize("options", [{}, {"most_edges": 3}, {"most_edges": 8, "broadcast_bytes": 0, "hot_rows": 100}])
def test_located_equals_brute_force(spark, options):
    points = random_points()
    got = Q.located(points_of(spark, points), zones(spark, SHAPES), **options)
    assert got.columns == ["id", "Longitude", "Latitude", "zone_id", "zone_name", "file_order"]
    assert sorted((r["id"], r["zone_id"]) for r in got.collect()) == brute(points)


@pytest.mark.parametrize("most_edges", [2, 64])
def test_points_on_edges_and_corners(spark, most_edges):
    points = points_of(spark, [(0, 0.0, 2.0), (1, 4.0, 2.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, None, 1.0)])
    one = zones(spark, [SHAPES[0]])
    assert sorted(r["id"] for r in Q.located(points, one, most_edges=most_edges).collect()) == [0, 2, 3]
    assert [r["id"] for r in Q.located(points, one, exclude_boundary=True, most_edges=most_edges).collect()] == [3]


@pytest.mark.parametrize("match", [S.points_in_zones, Q.located])
def test_points_on_slanted_edges_are_told_exactly(spark, match):
    """On the decimal coordinates (0.1 k, 0.3 k) lie on the edge; as doubles most are off it by a rounding."""
    shape = shape_rows(spark, [[[[(0, 0), (0.7, 0), (0.7, 2.1)]]]])
    on_edge = [(k, 0.1 * k, 0.3 * k) for k in range(1, 7)] + [(k + 10, float(f"0.{k}"), float(f"{3 * k / 10:.1f}")) for k in range(1, 7)]
    off = [(50, 0.5, 0.3), (51, 0.30000001, 0.9), (52, 0.1, 0.29999999)]
    points = points_of(spark, on_edge + off)
    assert sorted(r["id"] for r in match(points, shape, exclude_boundary=True, digits=9).collect()) == [50, 51, 52]
    # Coarser coordinates take those a hundred-millionth off for on the edge.
    assert sorted(r["id"] for r in match(points, shape, exclude_boundary=True, digits=6).collect()) == [50]


def star(n, seed, cx=0.0, cy=0.0, size=1.0):
    draw = random.Random(seed)
    angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + size * (0.4 + 0.6 * draw.random()) * math.cos(a), cy + size * (0.4 + 0.6 * draw.random()) * math.sin(a)) for a in angles]


def shape_rows(spark, shapes):
    rows = [(str(i), f"n{i}", i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in parts]) for i, parts in enumerate(shapes)]
    return spark.createDataFrame(rows, "zone_id string, zone_name string, file_order bigint, parts array<array<array<struct<x:double,y:double>>>>")


def test_shapes_of_many_edges_and_parts(spark):
    draw = random.Random(7)
    coast = [[star(9, i, 10 * draw.random(), 10 * draw.random(), 0.3)] for i in range(400)]
    shapes = shape_rows(spark, [[[star(600, 1, 5, 5, 5)]], coast, [[star(200, 3, 2, 8, 1), star(100, 4, 2, 8, 0.3)]]])
    points = points_of(spark, [(i, draw.uniform(-1, 11), draw.uniform(-1, 11)) for i in range(4000)])
    want = sorted((r["id"], r["zone_id"]) for r in S.points_in_zones(points, shapes).collect())
    for most_edges in (16, 64):
        got = Q.located(points, shapes, most_edges=most_edges).collect()
        assert sorted((r["id"], r["zone_id"]) for r in got) == want
        cells = Q.adaptive_cells(shapes, most_edges)
        loads = cells.groupBy("level", "cx", "cy").agg(F.sum(Q.cell_loads(cells)).alias("n"))
        assert loads.agg(F.max("n")).first()[0] <= most_edges
        # The levels differ: crowded places have finer cells.
        assert cells.select("level").distinct().count() > 1


def test_a_corner_of_too_many_edges_ends(spark):
    fan = [[[(0.0, 0.0), (math.cos(a), math.sin(a)), (math.cos(a + 0.01), math.sin(a + 0.01))]] for a in (i * 0.06 for i in range(100))]
    points = points_of(spark, [(i, 0.5 * math.cos(i * 0.06 + d), 0.5 * math.sin(i * 0.06 + d)) for i in range(100) for d in (0.005, 0.03)])
    got = Q.located(points, shape_rows(spark, [fan]), most_edges=16).collect()
    assert len(got) == 100


@pytest.mark.parametrize("cells", [64, 6])
def test_given_zones(spark, sf_dir, cells):
    points = A.incidents(spark, sf_dir).select("event_id", "Latitude", "Longitude")
    layer = A.districts(spark, sf_dir).unionByName(boroughs(A.blocks(spark, sf_dir)))
    for strict in (False, True):
        pairs = lambda df: sorted(map(tuple, df.select("event_id", "file_order", "zone_id").collect()))
        assert pairs(Q.located(points, layer, exclude_boundary=strict, most_edges=cells)) == pairs(S.points_in_zones(points, layer, exclude_boundary=strict))


def test_no_zones(spark):
    points = points_of(spark, [(0, 1.0, 1.0)])
    assert Q.located(points, zones(spark, SHAPES).limit(0)).count() == 0


def test_edges_of_one_shape_are_dealt_out(spark, monkeypatch):
    """One row with all parts: no task may get all its edges."""
    from wardscore.operators import quadtree

    corner = "struct({} AS x, {} AS y)"
    box = ", ".join(corner.format(x, y) for x, y in (("i", "0D"), ("i + 0.5D", "0D"), ("i + 0.5D", "1D"), ("i", "1D")))
    zone = spark.range(1).selectExpr("'a' AS zone_id", f"transform(sequence(1, 1000), i -> array(array({box}))) AS parts")
    shares = []
    plain = quadtree.shape_cells

    def watched(edges, *more):
        shares.extend(r["n"] for r in edges.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        return plain(edges, *more)

    monkeypatch.setattr(quadtree, "shape_cells", watched)
    quadtree.adaptive_cells(zone)
    assert sum(shares) == 4000 and max(shares) < 1000


def test_sides_are_worked_out_once(spark):
    """The filter on located points holds the formula of the rings around a point once, and no power for every edge."""
    points = points_of(spark, [(0, 0.5, 0.5)])
    plan = Q.located(points, zones(spark, SHAPES), exclude_boundary=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(rings#") == 1 and "pow(" not in plan.lower()
