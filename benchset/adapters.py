"""The given tables in the shape the jobs read: messy text, gaps, odd polygons.

Every adapter is plain arithmetic on keys, so that the SQL in ``oracles.py``
can say the same thing independently.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.functions.codes import borough_of
from wardscore.operators.settle import spread
from wardscore.sources.boundaries import features_from_text, zones_from_features
from wardscore.sources.tabular import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def choose(key: Column, options: list) -> Column:
    """options[key]; None for NULL."""
    values = F.array(*[F.lit(o) if o is not None else F.lit(None).cast("string") for o in options])
    return F.get(values, key)


def incidents_of(events: DataFrame) -> DataFrame:
    """Incident log rows of an events table or stream."""
    e, u = F.col("event_id"), F.col("user_id")
    boroughs = ["Manhattan ", "BRONX", "brooklyn", "QUEENS", "STATEN ISLAND", "(null)"]
    offenses = ["FELONY ASSAULT", "Robbery", "BURGLARY", "GRAND LARCENY", "ASSAULT AND LARCENY", "HARASSMENT", None]
    law = (
        F.when(F.col("event_type") == "error", "FELONY")
        .when(F.col("event_type") == "purchase", "MISDEMEANOR")
        .when(F.col("event_type") == "signup", "VIOLATION")
        .when(F.col("event_type") == "click", "misdemeanor ")
        .otherwise("OTHER")
    )
    precinct = F.when(e % 50 == 1, F.lit("x")).when(e % 50 != 0, F.concat((u % 40 + 1).cast("string"), F.lit(".0")))
    return events.select(
        F.when(e % 37 != 0, e.cast("string")).alias("CMPLNT_NUM"),
        choose((u % 6).cast("int"), boroughs).alias("BORO_NM"),
        precinct.alias("ADDR_PCT_CD"),
        law.alias("LAW_CAT_CD"),
        choose((e % 4).cast("int"), ["ATTEMPTED", "completed", "COMPLETED", None]).alias("CRM_ATPT_CPTD_CD"),
        choose((e % 7).cast("int"), offenses).alias("OFNS_DESC"),
        (F.lit(890000) + (e * 31337) % 220000).alias("X_COORD_CD"),
        (F.lit(100000) + (e * 65537) % 200000).alias("Y_COORD_CD"),
        F.when(
            e % 97 != 0, F.lit(40.40) + ((e * 7919) % 10007).cast("double") / F.lit(10007.0) * F.lit(0.60)
        ).alias("Latitude"),
        (F.lit(-74.35) + ((e * 104729) % 10009).cast("double") / F.lit(10009.0) * F.lit(0.75)).alias("Longitude"),
        e.alias("event_id"),
    )


def timed_incidents_of(events: DataFrame) -> DataFrame:
    """Incident rows with the time they were reported at, each twice."""
    # The key becomes the time: seconds into the log.
    rows = incidents_of(events).withColumn("reported", F.timestamp_seconds("event_id")).drop("event_id")
    return rows.unionByName(rows)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_of(table(spark, sf_dir, "events"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air readings: one per line item, districts by supplier."""
    names = {"A": "Nitrogen dioxide (NO2)", "N": "Fine  particles (PM 2.5)"}
    flag, area = F.col("l_returnflag"), F.col("l_suppkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", names["A"]).when(flag == "N", names["N"]).otherwise(" Ozone (O3)").alias("Name"),
        F.when(F.col("l_linestatus") == "F", " CD ").otherwise("UHF42").alias("Geo Type Name"),
        area.alias("Geo Join ID"),
        F.concat(F.lit("AREA_"), area).alias("Geo Place Name"),
        F.when(F.col("l_orderkey") % 101 == 0, "N/A")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("Data Value"),
        F.lit(None).cast("string").alias("Message"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water samples: one per line item, sites by part."""
    line = F.col("l_linenumber").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        # One site under two spellings, which are two rows of the score table.
        F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(" ")).alias("Sample Site"),
        F.when(F.col("l_returnflag") == "N", "Operational").otherwise("Compliance").alias("Sample class"),
        F.col("l_discount").alias("Residual Free Chlorine (mg/L)"),
        F.col("l_tax").alias("Turbidity (NTU)"),
        F.col("l_quantity").alias("Fluoride (mg/L)"),
        F.when(F.col("l_linenumber") == 1, "<1").otherwise(line).alias("Coliform (Quanti-Tray) (MPN /100mL)"),
        F.when(F.col("l_linenumber") % 3 == 0, " < 1 ")
        .when(F.col("l_linenumber") % 3 == 2, "bad")
        .otherwise(line)
        .alias("E.coli(Quanti-Tray) (MPN/100mL)"),
    )


def _places(key: Column, copy: Column) -> tuple[Column, Column]:
    """Plane coordinates as text, some missing; the copy of a row lies elsewhere."""
    x = (F.lit(890000) + (key * 31337 + copy * 5000) % 220000).cast("string")
    y = (F.lit(100000) + (key * 65537 + copy * 5000) % 200000).cast("string")
    return F.when(key % 13 == 0, F.lit("N/A")).otherwise(x), y


def _with_copies(df: DataFrame, key: str) -> DataFrame:
    """Every tenth key twice; the order column says which row comes first."""
    copies = F.when(F.col(key) % 10 == 3, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(copies)).withColumn("row_no", F.col(key) * 2 + F.col("copy"))


def site_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _places(F.col("p_partkey"), F.col("copy"))
    return _with_copies(table(spark, sf_dir, "part"), "p_partkey").select(
        F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("Sample Site"),
        x.alias("X - Coordinate"),
        y.alias("Y - Coordinate"),
        F.col("p_name").alias("Sample Station (SS) - Location Description"),
        "row_no",
    )


RATING_CODES = ["U", "UD", "UPF", "D", "P", " wd ", "O", "No Data", "XX"]
RATING_FACTORS = [7, 11, 13, 17, 19]
OVERALL_FACTOR = 23


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School reviews: one per order, schools by customer."""
    o = F.col("o_orderkey")

    def code(factor: int) -> Column:
        # Shifted by parts of the key, so that the columns do not repeat each other.
        return choose(((o * factor + F.floor(o / factor)) % 9).cast("int"), RATING_CODES)

    school = F.concat(F.lit("BN"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.when(o % 307 == 0, F.lit(None)).when(o % 211 == 0, "2013 ALL Quality Reviews").otherwise(school).alias("BN"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-x")).alias("School_Year"),
        *[code(p).alias(f"IndicatorOverall_{i}") for i, p in enumerate(RATING_FACTORS, 1)],
        code(OVERALL_FACTOR).alias("Overall_Rating"),
    )


def school_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _places(F.col("c_custkey"), F.col("copy"))
    return _with_copies(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.concat(F.lit(" BN"), F.col("c_custkey").cast("string")).alias("location_code"),
        F.col("c_name").alias("location_name"),
        x.alias("X_COORDINATE"),
        y.alias("Y_COORDINATE"),
        F.col("c_mktsegment").alias("Location_Category_Description"),
        "row_no",
    )


# Outlines on a grid of eight by eight per tile: parts, each of rings, each of corners.
# The diamond is left unclosed; the clockwise box carries heights.
BOX = [[0, 0], [8, 0], [8, 8], [0, 8], [0, 0]]
OUTLINES = {
    "box": [[BOX]],
    "diamond": [[[[4, 0], [8, 4], [4, 8], [0, 4]]]],
    "ell": [[[[0, 0], [8, 0], [8, 4], [4, 4], [4, 8], [0, 8], [0, 0]]]],
    "ring": [[BOX, [[2, 2], [6, 2], [6, 6], [2, 6], [2, 2]]]],
    "twins": [[[[0, 0], [3, 0], [3, 8], [0, 8], [0, 0]]], [[[5, 0], [8, 0], [8, 8], [5, 8], [5, 0]]]],
    "wide": [[[[0, 0], [12, 0], [12, 8], [0, 8], [0, 0]]]],
    "clockwise": [[[[0, 0, 1], [0, 8, 1], [8, 8, 1], [8, 0, 1], [0, 0, 1]]]],
}
DISTRICT_OUTLINES = ["box", "box", "box", "box", "diamond", "ell", "ring", "twins", "wide", "clockwise"]
BLOCK_OUTLINES = ["box", "box", "ell", "ring", "diamond", "box", "clockwise"]
# West, south, width and height of the area a layer of tiles covers.
DISTRICT_EXTENT = (-74.30, 40.45, 0.65, 0.50)
BLOCK_EXTENT = (-74.29, 40.46, 0.63, 0.48)


def tiles_per_side(df: DataFrame, key: str) -> int:
    """Tiles get finer as the table grows, so they always cover the same area."""
    last = df.agg(F.max(key)).first()[0]
    return int(((last or 0) + 1) ** 0.5 - 1e-9) + 1


def features(df: DataFrame, key: str, outlines: list[str], extent: tuple, name: str) -> DataFrame:
    """One GeoJSON feature per row, on a tile given by its key."""
    west, south, width, height = extent
    k, side = F.col(key), tiles_per_side(df, key)

    # A corner (a, b) of the outline, moved to the tile; further values are kept.
    x = f"{west!r}D + {width!r}D * cast((tile_x * 8 + c[0]) AS double) / {float(8 * side)!r}D"
    y = f"{south!r}D + {height!r}D * cast((tile_y * 8 + c[1]) AS double) / {float(8 * side)!r}D"
    moved = f"concat(array({x}, {y}), cast(slice(c, 3, 1) AS array<double>))"
    drawn = F.from_json(F.lit(json.dumps([OUTLINES[o] for o in outlines])), "array<array<array<array<array<int>>>>>")
    parts = F.expr(f"transform(outline, rings -> transform(rings, ring -> transform(ring, c -> {moved})))")

    def geometry(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))

    shape = (
        F.when(k % 23 == 22, F.lit("null"))
        .when(k % 29 == 28, F.lit('{"type":"Point","coordinates":[-74.0,40.7]}'))
        .when(F.size("parts") == 1, geometry("Polygon", F.element_at("parts", 1)))
        .otherwise(geometry("MultiPolygon", F.col("parts")))
    )
    properties = F.to_json(
        F.struct(F.concat(k.cast("string"), F.lit(" ")).alias("BoroCD"), F.concat(F.lit(name), k.cast("string")).alias("name"))
    )
    text = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), shape, F.lit("}"))
    # Keys of one file come from one task; drawing and reading the shapes is the work.
    placed = spread(df).withColumns(
        {"outline": F.get(drawn, (k % len(outlines)).cast("int")), "tile_x": k % side, "tile_y": F.floor(k / side)}
    )
    return placed.withColumn("parts", parts).select(k.alias("file_order"), text.alias("feature"))


def district_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", DISTRICT_OUTLINES, DISTRICT_EXTENT, "AREA_")


def zones_of(feature_text: DataFrame) -> DataFrame:
    return zones_from_features(features_from_text(feature_text, "feature"), "BoroCD", "name")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District polygons, one per supplier; neighbours of 'wide' ones overlap."""
    return zones_of(district_features(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer layer of polygons across the districts, one per customer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return zones_of(features(customers, "c_custkey", BLOCK_OUTLINES, BLOCK_EXTENT, "BLOCK_"))


def block_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of a borough as one shape of many parts; the parts may overlap."""
    members = blocks(spark, sf_dir).groupBy(borough_of(F.col("zone_id")).alias("zone_id")).agg(
        F.min("file_order").alias("file_order"), F.flatten(F.collect_list("parts")).alias("parts")
    )
    return members.select("zone_id", F.col("zone_id").alias("zone_name"), "file_order", "parts")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores per district straight from line items, with gaps."""
    k = F.col("l_suppkey")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("air"),
        *[
            F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(name)
            for flag, name in (("A", "NO2"), ("R", "O3"), ("N", "PM2.5"))
        ],
        F.avg("l_extendedprice").alias("price"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_discount") * F.lit(1.3717)).alias("discounts"),
        F.avg("l_tax").alias("tax"),
        F.count(F.when(F.col("l_linenumber") == 1, 1)).alias("firsts"),
        F.avg("l_discount").alias("discount"),
        F.count(F.when(F.col("l_linenumber") == 2, 1)).alias("seconds"),
    )
    gone = k % 41 == 40
    return sums.select(
        k.cast("string").alias("Community_District_ID"),
        F.concat(F.lit("AREA_"), k.cast("string")).alias("Community_District_Name"),
        F.when(~gone, F.col("air")).alias("AirScore"),
        "NO2",
        "O3",
        "`PM2.5`",
        F.when(~gone, -F.col("price") / 1000).alias("SafetyScore"),
        F.col("lines").alias("Incident_Count"),
        F.col("discounts").alias("Weighted_Severity_Sum"),
        F.when(~gone & (k % 11 != 3), F.col("tax")).alias("WaterScore"),
        F.col("firsts").alias("Water_Point_Count"),
        F.when(~gone & (k % 7 != 0), F.col("discount")).alias("EducationScore"),
        F.col("seconds").alias("Education_Point_Count"),
    )
