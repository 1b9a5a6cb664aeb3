"""Polygon-on-polygon intersection areas from signed trapezoids.

A shape's indicator is the signed sum of the trapezoids between its
non-vertical edges and a common base line, so the area two shapes share is the
sum, over pairs of edges whose x-ranges overlap, of the signed area their
trapezoids share. Each term is closed form; holes, several parts and concave
outlines need nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.operators import geometry as G
from wardscore.operators.settle import land, settle, shuffle_if, spread
from wardscore.operators.spatial import CELL_KEY, EDGE_BYTES, ROW_BYTES, box_level, cell_width, explode_cells, levels_in, spread_hot_cells

# Shapes that only touch come out with up to some 1e-15 of the smaller one; by
# default an overlap counts from this share of it.
SLIVER = 1e-13
# Small shapes in one cell of a larger one that one task meets.
HOT_CELL_SHAPES = 200_000
# Strips of a pair: one for so many edges of the smaller outline.
STRIP_EDGES = 16


def overlay_shapes(zones: DataFrame) -> DataFrame:
    """zone_id with plane box, area and the signed edges trapezoids stand on."""
    signed = zones.select("zone_id", G.to_plane("parts").alias("_plane")).select(
        "zone_id", G.signed_edges("_plane").alias("_edges"), G.zone_bbox("_plane").alias("_box")
    )
    return signed.select(
        "zone_id",
        G.area("_edges").alias("area"),
        *[F.col("_box")[k].alias(k) for k in G.BOX],
        # Vertical edges span no area below them.
        F.expr("filter(_edges, e -> e.x1 <> e.x2)").alias("edges"),
    )


def _renamed(shapes: DataFrame, prefix: str) -> DataFrame:
    return shapes.select(*[F.col(c) if c in CELL_KEY else F.col(c).alias(f"{prefix}_{c}") for c in shapes.columns])


def _at_levels(shapes: DataFrame, levels: list[int], finer_only: bool) -> DataFrame:
    """Shapes repeated at each given level at (or only above) their own."""
    listed = ", ".join(str(n) for n in levels)
    usable = f"filter(array({listed}), n -> n {'>' if finer_only else '>='} level)"
    return shapes.withColumn("level", F.explode(F.expr(usable)))


def _sizes(shapes: DataFrame) -> tuple[int, int]:
    """Rows and measured bytes of shapes with their edges."""
    row = shapes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("edges")).alias("edges")).first()
    return row["n"], row["n"] * ROW_BYTES + (row["edges"] or 0) * EDGE_BYTES


def _pairs(source: DataFrame, target: DataFrame, hot_rows: int = HOT_CELL_SHAPES) -> DataFrame:
    """Shapes whose boxes overlap, each pair once.

    A pair meets in the grid of its larger shape's size class, so shapes that
    crowd into a small place meet on small cells. A pair sharing several cells
    is kept only in the one that holds the lower left corner of its common box.
    """
    source, target = (shapes.withColumn("level", box_level()) for shapes in (source, target))
    s_levels, t_levels = levels_in(source) or [0], levels_in(target) or [0]
    n_rows = {"s": source.count(), "t": target.count()}
    left, low = F.greatest("s_xmin", "t_xmin"), F.greatest("s_ymin", "t_ymin")
    right, top = F.least("s_xmax", "t_xmax"), F.least("s_ymax", "t_ymax")

    def meet(s: DataFrame, t: DataFrame, finer: str) -> DataFrame:
        sides = {"s": _renamed(explode_cells(s), "s"), "t": _renamed(explode_cells(t), "t")}
        on = CELL_KEY
        if n_rows[finer] > hot_rows:
            # Very many small shapes may lie under one large one: their cell goes to several tasks.
            coarser = "t" if finer == "s" else "s"
            sides[finer], sides[coarser] = spread_hot_cells(sides[finer], sides[coarser], hot_rows)
            on = [*CELL_KEY, "_salt"]
        return (
            shuffle_if(sides["s"], n_rows["s"] * ROW_BYTES)
            .join(shuffle_if(sides["t"], n_rows["t"] * ROW_BYTES), on)
            .drop("_salt")
            .where((left < right) & (low < top))
            .where((F.floor(left / cell_width()) == F.col("cx")) & (F.floor(low / cell_width()) == F.col("cy")))
        )

    met = meet(source, _at_levels(target, s_levels, finer_only=False), "t").unionByName(
        meet(_at_levels(source, t_levels, finer_only=True), target, "s")
    )
    return met.withColumns({"left": left, "right": right, "base": F.least("s_ymin", "t_ymin")})


def _strip(x: Column) -> Column:
    """Number of the strip of a pair's common x-range that ``x`` lies in; the outer ones reach beyond it."""
    place = F.floor((x - F.col("left")) / (F.col("right") - F.col("left")) * F.col("strips"))
    return F.greatest(F.lit(0), F.least(place, F.col("strips") - 1))


def _shared_trapezoid() -> str:
    """SQL of the signed area the trapezoids of two edges, a and b, share.

    The edges overlap in x, from l to r; 1 and 2 are the heights there. Where
    the edges cross, at the share t of the way, the lower line has a corner.
    """
    l, r = "greatest(least(a.x1, a.x2), least(b.x1, b.x2))", "least(greatest(a.x1, a.x2), greatest(b.x1, b.x2))"

    def height(e: str, x: str) -> str:
        # From the pair's own base line, so that large coordinates do not cancel.
        return f"(({e}.y1 - base) + ({e}.y2 - {e}.y1) * (({x} - {e}.x1) / ({e}.x2 - {e}.x1)))"

    def sign(e: str) -> str:
        return f"CASE WHEN {e}.x1 > {e}.x2 THEN {e}.s ELSE -{e}.s END"

    a1, a2, b1, b2 = height("a", l), height("a", r), height("b", l), height("b", r)
    low1, low2 = f"least({a1}, {b1})", f"least({a2}, {b2})"
    t = f"(({a1} - {b1}) / (({a1} - {b1}) - ({a2} - {b2})))"
    corner = f"({a1} + {t} * ({a2} - {a1}))"
    heights = (
        f"CASE WHEN ({a1} - {b1}) * ({a2} - {b2}) >= 0 THEN {low1} + {low2} "
        f"ELSE ({low1} + {corner}) * {t} + ({corner} + {low2}) * (1D - {t}) END"
    )
    return f"({sign('a')}) * ({sign('b')}) * ({r} - {l}) * ({heights}) / 2D"


def overlay(source: DataFrame, target: DataFrame, sliver: float = SLIVER, hot_rows: int = HOT_CELL_SHAPES) -> DataFrame:
    """Every overlapping pair: source_id, target_id, areas and shares.

    Areas are square feet in the plane; ``weight`` is the overlap's share of
    the target, ``source_share`` that of the source. Rows with the same zone_id
    count as one shape made of several, if they do not overlap each other.
    Overlaps of no more than ``sliver`` of the smaller shape are rounding noise.
    """
    # Shapes of one boundary file come from one task; neither their areas nor the pairs must all be worked out in that task.
    s_shapes, t_shapes = (
        settle(overlay_shapes(spread(zones)).withColumn("row", F.monotonically_increasing_id())) for zones in (source, target)
    )
    s_rows, s_bytes, t_rows, t_bytes = (n for shapes in (s_shapes, t_shapes) for n in _sizes(shapes))
    # Pairs without their edges: these follow by strips of the common x-range, so that no pair has to fit a task.
    outlines = (s.withColumn("n_edges", F.size("edges")).drop("edges") for s in (s_shapes, t_shapes))
    pairs = _pairs(*outlines, hot_rows).select(
        "s_row",
        "t_row",
        F.col("s_zone_id").alias("source_id"),
        F.col("t_zone_id").alias("target_id"),
        *["base", "left", "right"],
        F.greatest(F.lit(1), F.ceil(F.least("s_n_edges", "t_n_edges") / F.lit(STRIP_EDGES))).alias("strips"),
    )
    pairs = land(pairs, "pairs")

    def in_strips(shapes: DataFrame, n_bytes: int, row: str, name: str, carried: list[str]) -> DataFrame:
        """A pair's edges over its common x-range, once for each strip they reach."""
        edges = shapes.select(F.col("row").alias(row), F.explode("edges").alias(name))
        low, high = F.least(f"{name}.x1", f"{name}.x2"), F.greatest(f"{name}.x1", f"{name}.x2")
        over = pairs.join(shuffle_if(edges, n_bytes), row).where((high > F.col("left")) & (low < F.col("right")))
        strip = F.explode(F.sequence(_strip(low), _strip(high))).alias("strip")
        return over.select("s_row", "t_row", strip, name, *carried)

    both = in_strips(s_shapes, s_bytes, "s_row", "a", ["source_id", "target_id", "base", "left", "right", "strips"]).join(
        in_strips(t_shapes, t_bytes, "t_row", "b", []), ["s_row", "t_row", "strip"]
    )
    begin = F.greatest(F.least("a.x1", "a.x2"), F.least("b.x1", "b.x2"))
    end = F.least(F.greatest("a.x1", "a.x2"), F.greatest("b.x1", "b.x2"))
    # Two edges that share several strips count in the one where their common range begins.
    edge_pairs = both.where((begin < end) & (F.col("strip") == _strip(begin)))
    ids = ["source_id", "target_id"]
    pieces = edge_pairs.groupBy(*ids).agg(F.sum(F.expr(_shared_trapezoid())).alias("intersection_area"))

    def areas(shapes: DataFrame, n_rows: int, side: str) -> DataFrame:
        sums = shapes.groupBy(F.col("zone_id").alias(f"{side}_id")).agg(F.sum("area").alias(f"{side}_area"))
        return shuffle_if(sums, n_rows * ROW_BYTES)

    return (
        pieces.join(areas(s_shapes, s_rows, "source"), "source_id")
        .join(areas(t_shapes, t_rows, "target"), "target_id")
        .where(F.col("intersection_area") > F.least("source_area", "target_area") * F.lit(sliver))
        .select(
            *ids,
            "source_area",
            "target_area",
            "intersection_area",
            (F.col("intersection_area") / F.col("target_area")).alias("weight"),
            (F.col("intersection_area") / F.col("source_area")).alias("source_share"),
        )
    )
