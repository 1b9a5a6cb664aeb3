"""Adaptive cells: a quadtree over edges, split where edges are counted to crowd.

A cell that more than a set number of edges touch is split into four by four, until none is left; cells are named by level and
place like those of ``spatial``, so points find them by an equi-join. Each cell knows for every shape near it on which side a
reference point inside the cell lies. A point's side follows from the shape's edges in its own cell alone: those that the way
from the reference point crosses, first upright, then level. So no row carries more of a shape than what its cell holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.operators import geometry as G
from wardscore.operators.settle import BROADCAST_BYTES, broadcast_if, settle, spread
from wardscore.operators.spatial import CELL_KEY, EDGE_BYTES, HOT_CELL_ROWS, RAY_EPSILON, ROW_BYTES, join_on_cells, on_edge_exactly
from wardscore.operators.tables import col, q, worked_out

MOST_EDGES = 64
# A corner where more edges meet than a cell may hold cannot be split apart: its cell stays after so many rounds.
MOST_ROUNDS = 8
SIDE = 4
# Place of the reference point within its cell, off any line that data are likely to lie on.
REF_X, REF_Y = 0.5617376914898996, 0.4381966011250105
# Share of a cell's width by which an edge outside still counts as touching.
SLACK = 1e-9
# Share of a shape's width and height by which a point outside its box is still tested against its edges.
BOX_SLACK = 0.01
EDGE = ("x1", "y1", "x2", "y2")


def left_of(x: str, y: str, e: str = "") -> str:
    """SQL: the point lies left of the edge's line, or below it if the edge is level; e names the edge's struct."""
    x1, y1, x2, y2 = (f"{e}{c}" for c in EDGE)
    ray = f"{x} < ({x2} - {x1}) * ({y} - {y1}) / (({y2} - {y1}) + {RAY_EPSILON!r}D) + {x1}"
    return f"(CASE WHEN {y1} = {y2} THEN ({y} >= {y1}) = ({x2} > {x1}) ELSE {ray} END)"


def passed(rx: str, ry: str, x: str, y: str, e: str = "") -> str:
    """SQL: the way from (rx, ry) upright to (rx, y) and level to (x, y) crosses the edge an odd number of times."""
    x1, y1, x2, y2 = (f"{e}{c}" for c in EDGE)
    corner = left_of(rx, y, e)
    upright = f"(({x1} > {rx}) <> ({x2} > {rx}) AND {left_of(rx, ry, e)} <> {corner})"
    level = f"(({y1} > {y}) <> ({y2} > {y}) AND {corner} <> {left_of(x, y, e)})"
    return f"({upright} <> {level})"


def _touches(cx: str, cy: str, width: str) -> str:
    """SQL: the edge touches the closed cell, or nearly so."""
    x0, y0 = f"(({cx} - {SLACK!r}D) * {width})", f"(({cy} - {SLACK!r}D) * {width})"
    x9, y9 = f"(({cx} + 1D + {SLACK!r}D) * {width})", f"(({cy} + 1D + {SLACK!r}D) * {width})"
    box = f"greatest(x1, x2) >= {x0} AND least(x1, x2) <= {x9} AND greatest(y1, y2) >= {y0} AND least(y1, y2) <= {y9}"
    sides = ", ".join(f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in (x0, x9) for y in (y0, y9))
    near = f"(abs(x2 - x1) + abs(y2 - y1)) * {width} * {SLACK!r}D"
    return f"({box} AND least({sides}) <= {near} AND greatest({sides}) >= -{near})"


def _reference(c: str, offset: float, width: str) -> str:
    return f"(({c} + {offset!r}D) * {width})"


def split_cells(edges: DataFrame, keys: Sequence[str], most_edges: int = MOST_EDGES, sides: bool = True) -> DataFrame:
    """Leaf cells (level, cx, cy): a row for every edge that touches the cell, keys and x1 to y2, and with ``sides`` one for
    every shape (equal keys) that has edges there or covers the cell: ``inside`` says so of the reference point.

    No leaf holds more than ``most_edges`` edges, but for cells at the last level around a corner where more of them meet.
    """
    box = edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    xmin, xmax, ymin, ymax = (v if v is not None else 0.0 for v in box)
    level = math.ceil(math.log(max(xmax - xmin, ymax - ymin, SIDE**-30), SIDE))
    width = float(SIDE) ** level
    wide = f"{width!r}D"
    roots = [(math.floor(x), math.floor(y)) for x in sorted({xmin // width, xmax // width}) for y in sorted({ymin // width, ymax // width})]
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy")) for x, y in roots]))
    rx, ry = _reference("cx", REF_X, wide), _reference("cy", REF_Y, wide)
    placed = edges.select(*[col(k) for k in keys], *EDGE, cells.alias("_c")).select("_c.cx", "_c.cy", *[col(k) for k in keys], *EDGE)
    ray = f"((y1 > {ry}) <> (y2 > {ry}) AND {left_of(rx, ry)})"
    fresh = placed.withColumns({"flip": F.expr(ray) if sides else F.lit(False), "near": F.expr(_touches("cx", "cy", wide))})

    leaves = []
    for _ in range(MOST_ROUNDS):
        fresh = settle(fresh.where("near OR flip"))
        rows = _with_sides(fresh, keys, sides)
        crowded = fresh.where("near").groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_edges)
        crowded = settle(crowded.select("cx", "cy"))
        n_crowded = crowded.count()
        at_level = F.lit(level).alias("level")
        if not n_crowded:
            leaves.append(rows.select(at_level, "*"))
            break
        crowded = broadcast_if(crowded, n_crowded * EDGE_BYTES)
        leaves.append(rows.join(crowded, ["cx", "cy"], "left_anti").select(at_level, "*"))
        fresh = _split(rows.join(crowded, ["cx", "cy"]), keys, width)
        level, width = level - 1, width / SIDE
    else:
        leaves.append(_with_sides(settle(fresh.where("near OR flip")), keys, sides).select(F.lit(level).alias("level"), "*"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return settle(out)


def _with_sides(fresh: DataFrame, keys: Sequence[str], sides: bool) -> DataFrame:
    """The edges of the cells, and the side of each cell's reference point for every shape that matters there."""
    edges = fresh.where("near").select("cx", "cy", *[col(k) for k in keys], *EDGE, F.lit(None).cast("boolean").alias("inside"))
    if not sides:
        return edges
    crossed = F.sum(F.col("flip").cast("int")) % 2 == 1
    status = fresh.groupBy("cx", "cy", *[col(k) for k in keys]).agg(crossed.alias("inside"), F.max("near").alias("near"))
    none = [F.lit(None).cast("double").alias(c) for c in EDGE]
    return edges.unionByName(status.where("inside OR near").select("cx", "cy", *[col(k) for k in keys], *none, "inside"))


def _split(rows: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Rows of crowded cells in each of their cells of a quarter of the width; ``flip`` says a side changes on the way there."""
    wide, fine = f"{width!r}D", f"{width / SIDE!r}D"
    child = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))).withColumns(
        {"_x": F.expr(f"cx * {SIDE} + _k % {SIDE}"), "_y": F.expr(f"cy * {SIDE} + _k div {SIDE}")}
    )
    way = passed(
        _reference("cx", REF_X, wide), _reference("cy", REF_Y, wide), _reference("_x", REF_X, fine), _reference("_y", REF_Y, fine)
    )
    return worked_out(
        child.select(
            F.col("_x").alias("cx"),
            F.col("_y").alias("cy"),
            *[col(k) for k in keys],
            *EDGE,
            F.expr(f"coalesce(inside, {way})").alias("flip"),
            F.expr(f"inside IS NULL AND {_touches('_x', '_y', fine)}").alias("near"),
        )
    )


def shape_cells(edges: DataFrame, keys: Sequence[str], most_edges: int = MOST_EDGES) -> DataFrame:
    """One row per leaf cell and shape: level, cx, cy, keys, inside, edges."""
    edge = F.when(F.col("x1").isNotNull(), F.struct(*EDGE))
    rows = split_cells(edges, keys, most_edges)
    # A cell holds few edges, so these lists are short.
    return rows.groupBy(*CELL_KEY, *[col(k) for k in keys]).agg(F.max("inside").alias("inside"), F.collect_list(edge).alias("edges"))


def reference_sql() -> tuple[str, str]:
    """SQL: the reference point of a cell (level, cx, cy)."""
    width = "pow(4D, level)"
    return _reference("cx", REF_X, width), _reference("cy", REF_Y, width)


def side_sql(x: str, y: str, inside: str, edges: str, rx: str | None = None, ry: str | None = None) -> str:
    """SQL: the point (x, y) of a cell (level, cx, cy) lies inside the shape with these edges there.

    ``rx`` and ``ry`` name the cell's reference point where it is at hand; else every edge works it out anew.
    """
    rx, ry = (rx, ry) if rx and ry else reference_sql()
    return f"({inside} <> (size(filter({edges}, e -> {passed(rx, ry, x, y, 'e.')})) % 2 = 1))"


def zone_edges(zones: DataFrame, zone: str) -> DataFrame:
    """(zone, part, ring, x1, y1, x2, y2) of all rings."""
    parts = zones.select(col(zone), F.posexplode(G.part_edges("parts")).alias("part", "_rings"))
    rings = parts.select(col(zone), "part", F.posexplode("_rings").alias("ring", "_edges"))
    return rings.select(col(zone), "part", "ring", F.inline("_edges"))


def adaptive_cells(zones: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """One row per leaf cell and zone: the zone's columns but ``parts``, and ``rings``: part, ring, inside and edges in the cell."""
    zones = settle(zones.withColumn("_zone", F.monotonically_increasing_id()))
    # A shape of very many parts is one row: its edges are dealt out one by one, as every later round keeps them where they are.
    edges = zone_edges(spread(zones), "_zone")
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    cells = shape_cells(edges.repartition(tasks), ["_zone", "part", "ring"], most_edges)
    held = cells.groupBy(*CELL_KEY, "_zone").agg(F.collect_list(F.struct("part", "ring", "inside", "edges")).alias("rings"))
    return held.join(zones.drop("parts"), "_zone").drop("_zone")


def located(
    points: DataFrame,
    zones: DataFrame,
    x: str = "Longitude",
    y: str = "Latitude",
    exclude_boundary: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_CELL_ROWS,
    most_edges: int = MOST_EDGES,
    digits: int | None = None,
) -> DataFrame:
    """Inner join: every point with every zone it lies in, as ``spatial.points_in_zones`` gives them.

    For shapes with very many edges or parts: a row of the cells holds at most ``most_edges`` edges, whatever the shape's size.
    """
    rx, ry = reference_sql()
    boxed = zones.withColumn("_box", G.zone_bbox("parts"))
    cells = settle(adaptive_cells(boxed, most_edges).withColumns({"_rx": F.expr(rx), "_ry": F.expr(ry)}))
    held = "aggregate(rings, 0, (n, r) -> n + size(r.edges))"
    n_bytes = cells.agg(F.sum(F.expr(held) * EDGE_BYTES + ROW_BYTES)).first()[0] or 0
    x_sql, y_sql = q(x), q(y)
    within = f"filter(rings, r -> {side_sql(x_sql, y_sql, 'r.inside', 'r.edges', '_rx', '_ry')})"
    touched = (
        f"(e.x2 - e.x1) * ({y_sql} - e.y1) - (e.y2 - e.y1) * ({x_sql} - e.x1) = 0 "
        f"AND {x_sql} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND {y_sql} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)"
    )
    touched = touched if digits is None else on_edge_exactly("e", x_sql, y_sql, digits)
    joined = join_on_cells(points, cells, n_bytes, x, y, broadcast_bytes, hot_rows)
    # In an outer ring and in none of the same part's holes; with the boundary out, in a part whose edges the point is not on.
    edge_of = f" AND NOT exists(rings, r -> r.part = o.part AND exists(r.edges, e -> {touched}))" if exclude_boundary else ""
    hit = f"exists(i, o -> o.ring = 0 AND NOT exists(i, h -> h.part = o.part AND h.ring > 0){edge_of})"
    # Spark writes a column's formula out wherever a filter names it, here once for each ring again; ``i`` is worked out once.
    # Most shapes of a cell are far from a point, which their boxes tell at less cost than their edges.
    near = " AND ".join(
        f"{p} >= _box.{c}min - {wide} AND {p} <= _box.{c}max + {wide}"
        for p, c in ((x_sql, "x"), (y_sql, "y"))
        for wide in [f"{BOX_SLACK!r}D * (_box.xmax - _box.xmin + _box.ymax - _box.ymin)"]
    )
    inside = f"CASE WHEN {near} THEN exists(array({within}), i -> {hit}) ELSE false END"
    return joined.where(F.expr(inside)).drop(*CELL_KEY, "_rx", "_ry", "_box", "rings")


def cell_loads(cells: DataFrame) -> Column:
    """Edges in a row of ``adaptive_cells``."""
    return F.expr("aggregate(rings, 0, (n, r) -> n + size(r.edges))")
