"""Union of polygons: the outline of all members of a group, no inner edge left, nothing counted twice.

Corners are rounded to a fine grid. Edges of a group that meet in a cell of the quadtree are cut where they cross and where a
corner lies on them, so that afterwards edges meet at corners only. A piece that members use in both directions has members on
both sides and goes; so does one whose middle lies inside another member. What is left has members on one side only. At each
corner the way in turns into the next way out that keeps the members on its left; pointers doubled along the ways number each
ring, in as many rounds as its length has binary digits. Everything is joins and aggregates keyed by group and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.operators import geometry as G
from wardscore.operators.quadtree import EDGE, MOST_EDGES, shape_cells, side_sql, split_cells
from wardscore.operators.settle import settle, spread
from wardscore.operators.spatial import CELL_KEY, levels_in, points_in_zones
from wardscore.operators.tables import first_by, worked_out

# Width of the grid, in the coordinates' unit: a hundredth of a millimetre, in degrees.
GRID = 1e-10
NODE = ["zone_id", "x", "y"]
# Rounds of doubling: rings of up to 2 ** 40 corners.
MOST_DOUBLINGS = 40


def member_edges(zones: DataFrame, grid: float, x0: float, y0: float) -> DataFrame:
    """(zone_id, _part, x1, y1, x2, y2): edges in whole grid steps from (x0, y0), a part's inside on their left."""
    parts = zones.where("zone_id IS NOT NULL").select("zone_id", F.explode("parts").alias("_rings"))
    # Settled, as the number of a part must not change between passes.
    parts = settle(spread(parts).withColumn("_part", F.monotonically_increasing_id()))
    signed = parts.withColumn("parts", F.array("_rings")).select("zone_id", "_part", F.inline(G.signed_edges("parts")))
    step = lambda c, o: F.round((F.col(c) - F.lit(o)) / F.lit(grid))
    ends = {c: step(c, x0 if c[0] == "x" else y0) for c in EDGE}
    placed = signed.where("s <> 0").withColumns(ends)
    turned = [F.when(F.col("s") > 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return placed.select("zone_id", "_part", *turned).where("x1 <> x2 OR y1 <> y2")


def _crossings(met: DataFrame) -> DataFrame:
    """(zone_id, x, y): where two edges of a group cross between their ends, on the grid."""
    side = lambda name: met.select(*CELL_KEY, "zone_id", "_edge", F.struct(*EDGE).alias(name)).withColumnRenamed("_edge", f"_{name}")
    pairs = side("a").join(side("b"), [*CELL_KEY, "zone_id"]).where("_a < _b")
    turn = "((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"
    t = f"((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif({turn}, 0D)"
    u = f"((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / nullif({turn}, 0D)"
    at = pairs.withColumns({"_t": F.expr(t), "_u": F.expr(u)}).where("_t > 0 AND _t < 1 AND _u > 0 AND _u < 1")
    return at.selectExpr("zone_id", "round(a.x1 + _t * (a.x2 - a.x1)) AS x", "round(a.y1 + _t * (a.y2 - a.y1)) AS y")


def _pieces(edges: DataFrame, most_edges: int) -> DataFrame:
    """The edges cut at every corner and crossing of their group that they run through."""
    edges = settle(edges.withColumn("_edge", F.monotonically_increasing_id()))
    met = split_cells(edges, ["zone_id", "_part", "_edge"], most_edges, sides=False)
    corners = edges.selectExpr("zone_id", "inline(array(struct(x1 AS x, y1 AS y), struct(x2 AS x, y2 AS y)))")
    corners = settle(corners.unionByName(_crossings(met)).distinct())
    # A corner's grid square may reach into neighbouring cells.
    cells = [
        F.struct(F.lit(n).alias("level"), *[F.floor((F.col(c) + d) / F.lit(4.0**n)).alias(f"c{c}") for c, d in (("x", dx), ("y", dy))])
        for n in levels_in(met) or [0]
        for dx in (-1.0, 1.0)
        for dy in (-1.0, 1.0)
    ]
    near = corners.select(*NODE, F.explode(F.array_distinct(F.array(*cells))).alias("_c")).select(*NODE, "_c.*")
    through = (
        "abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= 0.5D * (abs(x2 - x1) + abs(y2 - y1)) "
        "AND _t > 0 AND _t < 1 AND (x <> x1 OR y <> y1) AND (x <> x2 OR y <> y2)"
    )
    share = "((x2 - x1) * (x - x1) + (y2 - y1) * (y - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    cuts = met.join(near, [*CELL_KEY, "zone_id"]).withColumn("_t", F.expr(share)).where(through)
    cuts = cuts.groupBy("_edge").agg(F.array_sort(F.collect_set(F.struct("_t", "x", "y"))).alias("_cuts"))
    whole = edges.join(cuts, "_edge", "left")
    stops = "concat(array(struct(x1 AS x, y1 AS y)), transform(coalesce(_cuts, array()), c -> struct(c.x AS x, c.y AS y)), array(struct(x2 AS x, y2 AS y)))"
    listed = whole.withColumn("_stops", F.expr(stops))
    step = "zip_with(slice(_stops, 1, size(_stops) - 1), slice(_stops, 2, size(_stops)), (p, n) -> struct(p.x AS x1, p.y AS y1, n.x AS x2, n.y AS y2))"
    return settle(listed.select("zone_id", "_part", F.expr(f"inline({step})")).where("x1 <> x2 OR y1 <> y2"))


def _border(pieces: DataFrame, most_edges: int) -> DataFrame:
    """(zone_id, x1, y1, x2, y2, _id): the pieces with members on their left only, each once."""
    ahead = "(x1 < x2 OR x1 = x2 AND y1 < y2)"
    one_way = pieces.select(
        "zone_id", "_part", F.expr(ahead).alias("_ahead"),
        F.expr(f"CASE WHEN {ahead} THEN struct(x1, y1, x2, y2) ELSE struct(x2 AS x1, y2 AS y1, x1 AS x2, y1 AS y2) END").alias("_e"),
    )
    used = one_way.groupBy("zone_id", "_e").agg(
        F.min("_ahead").alias("_all"), F.max("_ahead").alias("_any"), F.collect_set("_part").alias("_owners")
    )
    used = settle(used.where("_all = _any").withColumn("_id", F.monotonically_increasing_id()))
    shapes = settle(shape_cells(pieces, ["zone_id", "_part"], most_edges))
    middles = used.selectExpr("_id", "zone_id", "_owners", "(_e.x1 + _e.x2) / 2 AS x", "(_e.y1 + _e.y2) / 2 AS y")
    cells = [F.struct(F.lit(n).alias("level"), *[F.floor(F.col(c) / F.lit(4.0**n)).alias(f"c{c}") for c in "xy"]) for n in levels_in(shapes) or [0]]
    placed = middles.select("*", F.inline(F.array(*cells)))
    others = placed.join(shapes, [*CELL_KEY, "zone_id"]).where(~F.array_contains("_owners", F.col("_part")))
    covered = others.where(F.expr(side_sql("x", "y", "inside", "edges"))).select("_id").distinct()
    kept = used.join(covered, "_id", "left_anti")
    turned = "CASE WHEN _any THEN _e ELSE struct(_e.x2 AS x1, _e.y2 AS y1, _e.x1 AS x2, _e.y1 AS y2) END"
    return settle(kept.withColumn("_d", F.expr(turned)).select("zone_id", "_id", "_d.*"))


def _followed(border: DataFrame) -> DataFrame:
    """(_id, _next): the piece that follows each, the first way out clockwise from where it came."""
    comes = border.selectExpr("zone_id", "_id", "x2 AS x", "y2 AS y", "atan2(y1 - y2, x1 - x2) AS _back")
    goes = border.selectExpr("zone_id", "_id AS _next", "x1 AS x", "y1 AS y", "atan2(y2 - y1, x2 - x1) AS _on")
    full = 6.283185307179586
    turn = F.expr(f"CASE WHEN _back - _on > 0 THEN _back - _on ELSE _back - _on + {full!r}D END")
    return comes.join(goes, NODE).groupBy("_id").agg(F.min_by("_next", turn).alias("_next"))


def _numbered_rings(border: DataFrame, follow: DataFrame) -> DataFrame:
    """(_id, _ring, _ahead): the ring of each piece, named by its smallest piece, and how many steps lead to that one."""
    state = settle(follow.selectExpr("_id", "_next", "_id AS _ring", "CAST(0 AS BIGINT) AS _ahead"))
    n_pieces = border.count()
    if state.select("_next").distinct().count() != n_pieces or state.count() != n_pieces:
        raise ValueError("outlines do not close: members all but touch along slivers; use a wider grid")
    for k in range(MOST_DOUBLINGS):
        on = state.selectExpr("_id AS _next", "_next AS _after", "_ring AS _r", "_ahead AS _a")
        state = settle(
            state.join(on, "_next").selectExpr(
                "_id", "_after AS _next", "least(_ring, _r) AS _ring", f"CASE WHEN _r < _ring THEN _a + {1 << k} ELSE _ahead END AS _ahead", "_r < _ring AS _moved"
            )
        )
        if not state.where("_moved").limit(1).count():
            break
        state = state.drop("_moved")
    return state.select("_id", "_ring", "_ahead")


def _with_area(rings: DataFrame) -> DataFrame:
    """The rings closed, with their signed ``_area``; those without one go."""
    closed = rings.withColumn("_c", F.expr("transform(concat(_c, slice(_c, 1, 1)), c -> struct(c.x AS x, c.y AS y))"))
    twice = "aggregate(sequence(1, size(_c) - 1), 0D, (t, i) -> t + (_c[i - 1].x - _c[0].x) * (_c[i].y - _c[0].y) - (_c[i].x - _c[0].x) * (_c[i - 1].y - _c[0].y))"
    # Else the filter would close the ring anew at each of its corners.
    return worked_out(closed.withColumn("_area", F.expr(twice))).where("_area <> 0")


def outlines(zones: DataFrame, grid: float = GRID, most_edges: int = MOST_EDGES) -> DataFrame:
    """The union of all rows of one zone_id: a row per polygon of it, with zone_id, zone_name, file_order, part_no and parts.

    Members may overlap, touch, repeat each other or have holes; a ring that crosses itself is refused where it keeps the
    outline from closing. zone_name and file_order are those of the group's first row.
    parts holds one polygon: a closed outer ring counter-clockwise, then its holes clockwise. Corners lie on a grid of width
    ``grid``; it has to be finer than any distance that matters. Rows without an id, and groups without area, give no row.
    """
    zones = settle(zones)
    names = first_by(zones.select("zone_id", "file_order", "zone_name"), ["zone_id"], ["file_order"])
    corner = zones.select(G.zone_bbox("parts").alias("b")).agg(F.min("b.xmin"), F.min("b.ymin")).first()
    x0, y0 = (v if v is not None else 0.0 for v in corner)
    border = _border(_pieces(member_edges(zones, grid, x0, y0), most_edges), most_edges)
    rings = border.join(_numbered_rings(border, _followed(border)), "_id")
    # The ring starts with its smallest piece; the one that has the most steps before it comes next.
    order = F.when(F.col("_ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("_ahead"))
    corners = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    listed = rings.groupBy("zone_id", "_ring").agg(corners.alias("_c"))
    listed = settle(_with_area(listed))
    outer = listed.where("_area > 0")
    polygons = outer.select("zone_id", "_ring", "_c").join(_holes(listed, outer), "_ring", "left")
    back = f"transform(ring, p -> struct(p.x * {grid!r}D + {x0!r}D AS x, p.y * {grid!r}D + {y0!r}D AS y))"
    parts = F.expr(f"array(transform(concat(array(_c), coalesce(_holes, array())), ring -> {back}))")
    return polygons.join(names, "zone_id").select("zone_id", "zone_name", "file_order", F.col("_ring").alias("part_no"), parts.alias("parts"))


def _holes(listed: DataFrame, outer: DataFrame) -> DataFrame:
    """(_ring, _holes): the holes of each outer ring, each in the smallest outer ring around it."""
    holes = listed.where("_area < 0").selectExpr(
        "zone_id AS _group", "_ring AS _hole", "_c AS _h", "(_c[0].x + _c[1].x) / 2 AS x", "(_c[0].y + _c[1].y) / 2 AS y"
    )
    around = outer.select("zone_id", "_ring", "_area", F.array(F.array("_c")).alias("parts"))
    found = points_in_zones(holes, around, "x", "y").where("_group = zone_id")
    owned = found.groupBy("_hole").agg(F.min_by("_ring", "_area").alias("_ring"), F.first("_h").alias("_h"))
    return owned.groupBy("_ring").agg(F.collect_list("_h").alias("_holes"))


def perimeter(parts: str) -> Column:
    """Length of all rings, in the coordinates' own unit."""
    length = "sqrt((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1))"
    edges = f"flatten(flatten(transform({parts}, rings -> transform(rings, ring -> {G.RING_EDGES}))))"
    return F.expr(f"aggregate({edges}, 0D, (total, e) -> total + {length})")
