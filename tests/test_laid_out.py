"""Points laid out along a curve: the curve itself, boxes against full scans, and how little a box reads."""

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from wardscore.plans.incidents import incident_points
from wardscore.plans.zones import city_extent, incident_zone_rows, laid_out_zone_rows
from wardscore.sources import laid_out as L

CITY = L.Extent(-74.3, 40.4, -73.6, 41.0)


def keys_of(spark, order):
    side = 1 << order
    cells = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    return {(r["x"], r["y"]): r["key"] for r in cells.select("x", "y", L.curve_key(F.col("x"), F.col("y"), order).alias("key")).collect()}


@pytest.mark.parametrize("order", [1, 2, 5])
def test_neighbours_on_the_curve_are_neighbours_on_the_grid(spark, order):
    keys = keys_of(spark, order)
    assert sorted(keys.values()) == list(range(4**order))
    path = [cell for cell, _ in sorted(keys.items(), key=lambda item: item[1])]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("most", [1, 3, 8, 1000])
def test_ranges_hold_every_cell_of_a_box(spark, most):
    keys = keys_of(spark, 5)
    for low, high in [((0, 0), (31, 31)), ((3, 5), (17, 9)), ((15, 15), (16, 16)), ((31, 0), (31, 0)), ((0, 30), (31, 31))]:
        ranges = L.box_ranges(low, high, 5, most)
        inside = {k for (x, y), k in keys.items() if low[0] <= x <= high[0] and low[1] <= y <= high[1]}
        held = {k for first, last in ranges for k in range(first, last + 1)}
        assert inside <= held and len(ranges) <= max(most, 1)
        if most == 1000:
            assert inside == held


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Points over the city, a third of them in one place, some outside the extent, some without a place."""
    draw = lambda seed: F.rand(seed)
    crowd = F.col("id") % 3 == 0
    points = spark.range(60_000).select(
        "id",
        F.when(F.col("id") % 1000 == 1, F.lit(None)).when(crowd, F.lit(-73.95)).otherwise(-74.35 + 0.8 * draw(1)).alias("Longitude"),
        F.when(F.col("id") % 1000 == 2, F.lit(float("nan"))).when(crowd, F.lit(40.75)).otherwise(40.35 + 0.7 * draw(2)).alias("Latitude"),
        F.lit("x").alias("a.b"),
    )
    points = points.checkpoint()
    path = str(tmp_path_factory.mktemp("points") / "table")
    L.lay_out(points, path, CITY, rows_a_file=2000)
    return points, path


BOXES = [
    (-74.2, 40.55, -74.18, 40.57), (-73.95, 40.75, -73.95, 40.75), (-74.4, 40.3, -73.5, 41.1), (-74.4, 40.3, -74.31, 40.5),
    (-73.7, 40.9, -73.2, 41.2), (-10.0, 0.0, 10.0, 1.0),
]


@pytest.mark.parametrize("box", BOXES)
def test_a_box_has_the_rows_of_a_full_scan(spark, table, box):
    points, path = table
    wanted = points.where(F.col("Longitude").between(box[0], box[2]) & F.col("Latitude").between(box[1], box[3]))
    got = L.read_box(spark, path, *box)
    assert got.columns == points.columns
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in wanted.collect())
    assert L.read_box(spark, path, *box, most_ranges=2).count() == wanted.count()


def test_every_row_is_stored_once(spark, table):
    points, path = table
    assert spark.read.parquet(path).groupBy("id").count().where("count = 1").count() == points.count()
    for box in [(1.0, 0.0, 0.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)]:
        assert L.read_box(spark, path, *box).count() == 0


def metrics_of(df):
    """Files and rows that the scan of a run plan has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and "AdaptiveSparkPlan" in leaves.apply(0).getClass().getSimpleName():
        leaves = leaves.apply(0).executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return tuple(sum(m.apply(name).value() for m in found if m.contains(name)) for name in ("numFiles", "numOutputRows"))


def test_a_small_box_reads_few_files(spark, table):
    points, path = table
    all_files, all_rows = metrics_of(spark.read.parquet(path))
    files, rows = metrics_of(L.read_box(spark, path, *BOXES[0]))
    assert all_rows == 60_000 and 0 < files <= all_files / 10 and rows <= all_rows / 20
    plan = L.read_box(spark, path, *BOXES[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [_patch" in plan
    assert f"GreaterThanOrEqual({L.KEY}" in plan and "PushedFilters" in plan


def test_writing_again_replaces(spark, table, tmp_path):
    points, _ = table
    path = str(tmp_path / "again")
    for part in (points.where("id < 100"), points.where("id < 10"), points.limit(0)):
        L.lay_out(part, path, CITY)
        assert L.read_box(spark, path, -75.0, 40.0, -73.0, 42.0).count() == part.where("not isnan(Latitude) and Longitude is not null").count()


def test_zones_of_a_laid_out_table(spark, sf_dir, tmp_path):
    points, path = incident_points(A.incidents(spark, sf_dir)), str(tmp_path / "incidents")
    L.lay_out(points, path, city_extent())
    zones = A.districts(spark, sf_dir).where("zone_id in ('2', '5')")
    rows = lambda df: sorted((tuple(r) for r in df.select("CMPLNT_NUM", "zone_id").collect()), key=str)
    got = rows(laid_out_zone_rows(spark, path, zones))
    assert got and got == rows(incident_zone_rows(points, zones))
    assert laid_out_zone_rows(spark, path, zones.limit(0)).count() == 0


def test_keys_are_looked_up(spark):
    """Working out turns by arithmetic made a plan of thousands of operations a row, most of the time of a large layout."""
    cells = spark.range(1000).select((F.col("id") * 65).alias("x"), (65535 - F.col("id") * 3).alias("y"))
    keyed = cells.select("x", "y", L.curve_key(F.col("x"), F.col("y")).alias("key"))

    def plain(x, y):
        key, state = 0, 0
        for level in reversed(range(L.ORDER)):
            place, state = L.turned(x >> level & 1, y >> level & 1, state)
            key = key * 4 + int(place)
        return key

    assert all(r["key"] == plain(r["x"], r["y"]) for r in keyed.collect())
    # Arithmetic inside the fold, whose steps run one by one.
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambda") < 30
