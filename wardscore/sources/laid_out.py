"""Point tables laid out along a Hilbert curve, so that a box reads only the files near it.

Rows are sorted by their key on the curve, cell by cell of a grid over a stated extent. Near keys are near places, so every
file covers a small patch and its bounds, which Parquet keeps beside the rows, are narrow. Files are also grouped in folders
by the leading bits of the key: a box becomes a short list of key ranges, which prune folders before any file is opened; what
is left is skipped by the bounds of the row groups, and the coordinates themselves decide in the end.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import cache
from itertools import product
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.operators.tables import q, require_columns

# Bits of a key per axis, those of a folder per axis, and the ranges a box is cut into at most.
ORDER, FOLDER_ORDER = 16, 3
MOST_RANGES = 64
# Bits of both axes that a key takes up at a time, at most.
STEP_BITS = 4
KEY, FOLDER = "_curve", "_patch"
LAYOUT = "_layout"


@dataclass(frozen=True)
class Extent:
    """The box that the grid covers. Points outside lie in its outermost cells."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def steps(self, lon: Column, lat: Column, order: int) -> tuple[Column, Column]:
        """Column and row of a point's cell on a grid of 2^order cells a side."""
        side = 1 << order
        place = lambda v, lo, hi: F.floor(F.least(F.greatest((v - lo) / ((hi - lo) / side), F.lit(0.0)), F.lit(side - 1.0)))
        return place(lon, self.min_lon, self.max_lon), place(lat, self.min_lat, self.max_lat)

    def cell(self, lon: float, lat: float, order: int) -> tuple[int, int]:
        """The same for numbers; both must agree, so the same steps of arithmetic are taken."""
        side = 1 << order
        place = lambda v, lo, hi: int(min(max((v - lo) / ((hi - lo) / side), 0.0), side - 1.0))
        return place(lon, self.min_lon, self.max_lon), place(lat, self.min_lat, self.max_lat)


def turned(quadrant_x, quadrant_y, state):
    """Where a quadrant stands on the curve in an orientation, and the orientation of the curve inside it.

    An orientation is swap + 2 * mirror: axes exchanged, both axes turned round. Numbers and columns alike.
    """
    swap, mirror = state % 2, (state - state % 2) / 2
    x, y = (quadrant_x + mirror) % 2, (quadrant_y + mirror) % 2
    # With axes exchanged, x plays y.
    a, b = x + swap * (y - x), y + swap * (x - y)
    place = 3 * a - 2 * a * b + b
    # First quadrant: axes exchanged; last quadrant: exchanged and turned round; the two between keep theirs.
    first, last = (1 - a) * (1 - b), a * (1 - b)
    new_swap = (swap + first + last) % 2
    new_mirror = (mirror + last) % 2
    return place, new_swap + 2 * new_mirror


@cache
def turns(bits: int) -> list[int]:
    """Steps of so many bits an axis: 4 * place + orientation, listed by orientation, then x, then y."""
    found = []
    for state, x, y in product(range(4), range(1 << bits), range(1 << bits)):
        key = 0
        for level in reversed(range(bits)):
            place, state = turned(x >> level & 1, y >> level & 1, state)
            key = key * 4 + int(place)
        found.append(4 * key + int(state))
    return found


def curve_key(x: Column, y: Column, order: int = ORDER) -> Column:
    """The key of a cell on the Hilbert curve, as one expression: a fold over the bits of both axes, the highest first.

    Each step looks up several bits in a constant table, as working turns out by arithmetic costs hundreds of operations a bit.
    """
    bits = gcd(order, STEP_BITS)
    table = F.expr(f"array({', '.join(f'{t}L' for t in turns(bits))})")
    part = lambda v, shift: F.shiftright(v.cast("long"), shift).bitwiseAND((1 << bits) - 1)
    steps = F.array(*[part(x, n) * (1 << bits) + part(y, n) for n in range(order - bits, -1, -bits)])

    def step(so_far: Column, quadrant: Column) -> Column:
        # The key so far with the orientation in its last two bits.
        found = F.get(table, (so_far.bitwiseAND(3) * (1 << 2 * bits) + quadrant).cast("int"))
        return F.shiftleft(F.shiftright(so_far, 2), 2 * bits + 2).bitwiseOR(found)

    return F.aggregate(steps, F.lit(0).cast("long"), step, lambda end: F.shiftright(end, 2))


def box_ranges(low: tuple[int, int], high: tuple[int, int], order: int = ORDER, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that hold every cell from ``low`` to ``high``.

    Quadrants across the border are split, level by level, as long as no more than ``most`` pieces come out; those of the last
    level are taken whole, so the ranges may hold more cells than the box but never fewer.
    """
    within, across = [], [(0, 0, 0, 0.0, order)]
    while True:
        whole, split = [], []
        for x, y, key, state, level in across:
            half = 1 << level - 1 if level else 0
            for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1)) if level else ():
                place, turn = turned(dx, dy, state)
                part = (x + dx * half, y + dy * half, key * 4 + int(place), turn, level - 1)
                if part[0] <= high[0] and part[1] <= high[1] and part[0] + half > low[0] and part[1] + half > low[1]:
                    covered = low[0] <= part[0] and part[0] + half - 1 <= high[0] and low[1] <= part[1] and part[1] + half - 1 <= high[1]
                    (whole if covered else split).append(part)
        if not whole and not split or len(within) + len(whole) + len(split) > most:
            break
        within, across = within + whole, split
    merged: list[tuple[int, int]] = []
    for first, last in sorted((key << 2 * level, (key + 1 << 2 * level) - 1) for _, _, key, _, level in within + across):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def lay_out(
    points: DataFrame, path: str, extent: Extent, lon: str = "Longitude", lat: str = "Latitude", rows_a_file: int = 1_000_000
) -> None:
    """Write ``points`` along the curve: folders by patch, sorted files of at most ``rows_a_file`` rows in each.

    Tasks take ranges of keys of like size, and a hash of the row parts equal keys, so a place with a third of all points is
    spread over many of them. Rows without both coordinates lie in a folder of their own, which no box reads. An existing table is replaced; until the new one is whole its layout is gone, and it cannot be opened.
    """
    require_columns(points, [lon, lat])
    if {KEY, FOLDER} & {c.lower() for c in points.columns}:
        raise ValueError(f"{KEY} and {FOLDER} are the layout's own columns")
    spark = points.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    x, y = extent.steps(F.col(q(lon)).cast("double"), F.col(q(lat)).cast("double"), ORDER)
    known = F.col(q(lon)).isNotNull() & F.col(q(lat)).isNotNull() & ~F.isnan(q(lon)) & ~F.isnan(q(lat))
    keyed = points.withColumn(KEY, F.when(known, curve_key(x, y)))
    patch = F.coalesce(F.shiftright(KEY, 2 * (ORDER - FOLDER_ORDER)).cast("int"), F.lit(-1))
    spread = F.xxhash64(*[F.col(q(c)) for c, kind in points.dtypes if "map<" not in kind])
    ordered = keyed.withColumn(FOLDER, patch).repartitionByRange(F.col(FOLDER), F.col(KEY), spread).sortWithinPartitions(FOLDER, KEY)
    ordered.write.mode("overwrite").partitionBy(FOLDER).options(maxRecordsPerFile=rows_a_file, partitionOverwriteMode="static").parquet(path)
    layout = json.dumps({"extent": asdict(extent), "lon": lon, "lat": lat, "order": ORDER, "folder_order": FOLDER_ORDER, "schema": keyed.schema.json()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")


def read_box(
    spark: SparkSession, path: str, min_lon: float, min_lat: float, max_lon: float, max_lat: float, most_ranges: int = MOST_RANGES
) -> DataFrame:
    """The rows of a laid out table inside a box, its borders included, with the columns they were written with.

    An empty box (a lower bound above the upper one, or one that is not a number) has no rows.
    """
    from pyspark.sql.types import IntegerType, StructType

    layout = json.loads(spark.read.text(f"{path}/{LAYOUT}").first()["value"])
    extent, order, folder_order = Extent(**layout["extent"]), layout["order"], layout["folder_order"]
    schema = StructType.fromJson(json.loads(layout["schema"]))
    names = [f.name for f in schema.fields if f.name != KEY]
    table = spark.read.schema(schema.add(FOLDER, IntegerType())).parquet(path)
    if not (min_lon <= max_lon and min_lat <= max_lat):
        return table.where(F.lit(False)).select(*[q(c) for c in names])
    low, high = extent.cell(min_lon, min_lat, order), extent.cell(max_lon, max_lat, order)
    ranges = box_ranges(low, high, order, most_ranges)
    shift = 2 * (order - folder_order)
    patches = sorted({p for first, last in ranges for p in range(first >> shift, (last >> shift) + 1)})
    on_curve = F.lit(False)
    for first, last in ranges:
        on_curve = on_curve | F.col(KEY).between(first, last)
    lon, lat = F.col(q(layout["lon"])), F.col(q(layout["lat"]))
    inside = lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)
    return table.where(F.col(FOLDER).isin(patches) & on_curve & inside).select(*[q(c) for c in names])
