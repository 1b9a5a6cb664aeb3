"""Points to polygons: a grid-cell equi-join instead of a nested-loop join.

Each zone part is laid over grid cells of its own size class: the cell width
is the power of four just below the part's extent. A part then touches at most
25 cells, and parts that crowd into one place use finer cells there, so a
dense spot does not meet all its neighbours. For every cell only the edges a
point of that cell can meet are kept; a cell no edge runs through is wholly in
or out, so points there need no geometry at all. Points join on their cell in
each size class in use, and the even-odd rule decides the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.operators import geometry as G
from wardscore.operators.settle import BROADCAST_BYTES, broadcast_if, settle, spread
from wardscore.operators.tables import col, q

SMALLEST_LEVEL = -30
# A cell with more points than this is split over several tasks.
HOT_CELL_ROWS = 4_000_000
EDGE_BYTES = 64
ROW_BYTES = 256
RAY_EPSILON = 1e-15


def box_level() -> Column:
    """Size class of a box (xmin, ymin, xmax, ymax): 4 ** level is its cell width."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.coalesce(F.floor(F.log2(extent) / 2), F.lit(SMALLEST_LEVEL))
    return F.greatest(level, F.lit(SMALLEST_LEVEL)).cast("int")


def levels_in(boxed: DataFrame) -> list[int]:
    """Size classes in use; at most a few dozen, as they are logarithms."""
    return sorted(r["level"] for r in boxed.select("level").distinct().collect())


def cell_width() -> Column:
    # A power of two, so that cell numbers and cell borders are exact doubles.
    return F.pow(F.lit(4.0), F.col("level"))


def explode_cells(boxed: DataFrame) -> DataFrame:
    """One row per grid cell (cx, cy) of the row's level its box touches."""
    xs = F.sequence(F.floor(F.col("xmin") / cell_width()), F.floor(F.col("xmax") / cell_width()))
    ys = F.sequence(F.floor(F.col("ymin") / cell_width()), F.floor(F.col("ymax") / cell_width()))
    return boxed.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def _in_ring(edges: str, x: str, y: str) -> str:
    crosses = (
        f"(e.y1 > {y}) <> (e.y2 > {y}) AND "
        f"{x} < (e.x2 - e.x1) * ({y} - e.y1) / ((e.y2 - e.y1) + {RAY_EPSILON!r}D) + e.x1"
    )
    return f"size(filter({edges}, e -> {crosses})) % 2 = 1"


def in_part(rings: str, x: str, y: str) -> str:
    """Even-odd rule as SQL: in the outer ring and in none of the holes."""
    holes = f"slice({rings}, 2, size({rings}))"
    return f"({_in_ring(f'element_at({rings}, 1)', x, y)} AND NOT exists({holes}, hole -> {_in_ring('hole', x, y)}))"


def on_edge(rings: str, x: str, y: str) -> str:
    """On an edge of the part, as far as doubles can tell, as SQL."""
    touches = (
        f"(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1) = 0 "
        f"AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) "
        f"AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)"
    )
    return f"exists({rings}, edges -> exists(edges, e -> {touches}))"


def on_edge_exactly(e: str, x: str, y: str, digits: int) -> str:
    """SQL: the point lies on the edge, both taken as decimals of so many digits: no rounding of products can hide it.

    Doubles tell that a point is too far off, as nearly all are; whole-number arithmetic decides about the others.
    """
    unit = 10.0**digits
    whole = lambda v: f"CAST(round(({v}) * {unit!r}D) AS decimal(19, 0))"
    x1, y1, x2, y2, px, py = (whole(v) for v in (f"{e}.x1", f"{e}.y1", f"{e}.x2", f"{e}.y2", x, y))
    off = f"abs(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({e}.y2 - {e}.y1) * ({x} - {e}.x1))"
    far = f"{off} > (abs({e}.x2 - {e}.x1) + abs({e}.y2 - {e}.y1)) * {4 / unit!r}D"
    return (
        f"(NOT {far} AND ({x2} - {x1}) * ({py} - {y1}) = ({y2} - {y1}) * ({px} - {x1}) "
        f"AND {px} BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2}) AND {py} BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}))"
    )


def _part_boxes(zones: DataFrame) -> DataFrame:
    parts = zones.withColumn("part_edges", G.part_edges("parts")).select(
        "*", F.posexplode("parts").alias("part_no", "_rings")
    )
    boxed = parts.withColumn("_box", G.part_bbox("_rings")).select(
        *[col(c) for c in zones.columns if c != "parts"],
        "part_no",
        "part_edges",
        *[F.col("_box")[k].alias(k) for k in G.BOX],
    )
    return boxed.withColumn("level", box_level())


def zone_cells(zones: DataFrame) -> DataFrame:
    """Zone parts cut up by grid cell, with ``rings``, ``earlier`` and ``covered``.

    ``earlier`` holds the parts of the same zone that come before: a point in
    two overlapping parts of one zone is then still matched once. ``covered``
    marks cells wholly inside.
    """
    wide = cell_width()
    corner_x, corner_y = F.col("cx") * wide, F.col("cy") * wide
    cells = explode_cells(_part_boxes(zones)).withColumns(
        {"_x0": corner_x, "_y0": corner_y, "_x1": corner_x + wide, "_y1": corner_y + wide}
    )
    met = "greatest(e.y1, e.y2) >= _y0 AND least(e.y1, e.y2) <= _y1 AND greatest(e.x1, e.x2) >= _x0"
    clip = f"rings -> transform(rings, edges -> filter(edges, e -> {met}))"
    # A kept edge does not lie left of the cell; a crossing one does not lie right of it either.
    crossed = "exists(rings, edges -> exists(edges, e -> least(e.x1, e.x2) <= _x1))"
    none = f"cast(array() AS array<array<{G.EDGE_TYPE}>>)"
    clipped = cells.withColumn("_clipped", F.expr(f"transform(slice(part_edges, 1, part_no + 1), {clip})"))
    return (
        clipped.withColumn("rings", F.expr("element_at(_clipped, part_no + 1)"))
        .where("size(element_at(rings, 1)) > 0")
        .withColumn("covered", F.expr(f"NOT {crossed}"))
        .where(F.expr(f"NOT covered OR {in_part('rings', '(_x0 + _x1) / 2', '(_y0 + _y1) / 2')}"))
        .withColumn("rings", F.expr(f"CASE WHEN covered THEN {none} ELSE rings END"))
        .withColumn("earlier", F.expr("slice(_clipped, 1, part_no)"))
        .drop("part_edges", "part_no", "_clipped", "_x0", "_y0", "_x1", "_y1", *G.BOX)
    )


CELL_KEY = ["level", "cx", "cy"]


def spread_hot_cells(points: DataFrame, cells: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Salt the cells that hold very many points; the others keep salt 0.

    There can be no more hot cells than rows / hot_rows, so the list is small.
    """
    hot = settle(
        points.groupBy(*CELL_KEY)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*CELL_KEY, F.ceil(F.col("_n") / F.lit(hot_rows)).alias("_salts"))
    )
    hot = broadcast_if(hot, hot.count() * ROW_BYTES)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    # Same on a retry of the task, yet copies of one row spread with the tasks that read them.
    spread = F.xxhash64(*[col(c) for c in points.columns]) + F.spark_partition_id()
    points = (
        points.withColumn("_spread", spread)
        .join(hot, CELL_KEY, "left")
        .withColumn("_salt", F.pmod("_spread", salts).cast("bigint"))
        .drop("_salts", "_spread")
    )
    cells = (
        cells.join(hot, CELL_KEY, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))))
        .drop("_salts")
    )
    return points, cells


def join_on_cells(
    points: DataFrame, cells: DataFrame, n_bytes: int, x: str, y: str, broadcast_bytes: int, hot_rows: int
) -> DataFrame:
    """Points with the settled cells they lie in, at each level in use; ``n_bytes`` is the cells' measured size.

    The points of a stream cannot be counted beforehand, so their hot cells are not salted.
    """
    px, py = col(x), col(y)
    cell_numbers = [
        F.struct(
            F.lit(n).alias("level"), F.floor(px / F.lit(4.0**n)).alias("cx"), F.floor(py / F.lit(4.0**n)).alias("cy")
        )
        for n in levels_in(cells) or [0]
    ]
    points = points.where(px.isNotNull() & py.isNotNull())
    if n_bytes <= broadcast_bytes and not points.isStreaming:
        # Nothing is shuffled behind a scan of a few files, yet the test of every point is the work.
        points = spread(points)
    placed = points.select("*", F.inline(F.array(*cell_numbers)))
    if n_bytes <= broadcast_bytes:
        return placed.join(F.broadcast(cells), CELL_KEY)
    if points.isStreaming:
        return placed.join(cells, CELL_KEY)
    placed, cells = spread_hot_cells(placed, cells, hot_rows)
    return placed.join(cells, [*CELL_KEY, "_salt"]).drop("_salt")


def points_in_zones(
    points: DataFrame,
    zones: DataFrame,
    x: str = "Longitude",
    y: str = "Latitude",
    exclude_boundary: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_CELL_ROWS,
    digits: int | None = None,
) -> DataFrame:
    """Inner join: every point with every zone it lies in.

    ``exclude_boundary`` leaves out points on an edge, as far as doubles can tell, or exactly on coordinates of ``digits``
    decimals.

    Points bring their columns, zones all of theirs but ``parts``. The zone
    cells are broadcast if their measured size is small; otherwise both sides
    shuffle on the cell, with hot cells salted by their measured counts.
    """
    cells = settle(zone_cells(zones))
    held = "aggregate(flatten(array_append(earlier, rings)), 0, (n, edges) -> n + size(edges))"
    size = cells.agg(F.sum(F.expr(held) * EDGE_BYTES + ROW_BYTES).alias("bytes")).first()["bytes"] or 0
    x_sql, y_sql = q(x), q(y)
    inside = in_part("rings", x_sql, y_sql)
    if exclude_boundary:
        exactly = f"exists(rings, edges -> exists(edges, e -> {on_edge_exactly('e', x_sql, y_sql, digits)}))" if digits is not None else ""
        inside = f"({inside} AND NOT {exactly or on_edge('rings', x_sql, y_sql)})"
    again = f"exists(earlier, part -> {in_part('part', x_sql, y_sql)})"
    joined = join_on_cells(points, cells, size, x, y, broadcast_bytes, hot_rows)
    return joined.where(F.expr(f"(covered OR {inside}) AND NOT {again}")).drop(*CELL_KEY, "rings", "earlier", "covered")


def first_zone(
    points: DataFrame,
    zones: DataFrame,
    key: str,
    carry: Sequence[str],
    zone_carry: Sequence[str] = (),
    x: str = "Longitude",
    y: str = "Latitude",
    match: Callable[..., DataFrame] = points_in_zones,
) -> DataFrame:
    """Each point with the first zone, in file order, it lies in; others dropped.

    ``key`` has to be unique per point, as equal keys count as one, and
    ``file_order`` per zone row; ``carry`` and ``zone_carry`` name the columns
    of either side to keep. ``match`` finds a point's zones.
    """
    needed = [col(c) for c in dict.fromkeys([key, *carry, x, y])]
    matched = match(points.select(*needed), zones.select("file_order", "parts"), x, y)
    # Only numbers are aggregated, which keeps this a hash aggregate; the zone's own columns follow by a join.
    best = matched.groupBy(col(key)).agg(
        F.min("file_order").alias("file_order"), *[F.first(col(c)).alias(c) for c in carry]
    )
    kept = zones.select("file_order", "zone_id", *zone_carry)
    return best.join(kept, "file_order").select(col(key), "zone_id", *[col(c) for c in (*zone_carry, *carry)])
