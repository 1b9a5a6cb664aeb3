"""Boundary files: GeoJSON features to zone rows, and zone rows back to features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.functions.reference_systems import code_of, is_known
from wardscore.operators import geometry as G
from wardscore.operators.settle import settle
from wardscore.operators.tables import find_column
from wardscore.sources.feature_collections import collection_features, numbered_lines

# Property names an id or a name may have, by preference.
ID_CANDIDATES = [
    "boro_cd", "borocd", "communitydistrict", "community_district", "cdta2020", "geoid", "id",
    "nta2020", "modzcta",
]
NAME_CANDIDATES = ["cd_name", "name", "ntaname", "label", "boro_name", "borough"]

# The coordinates stay text at first: their depth depends on the geometry's type.
FEATURE_TYPE = "properties map<string,string>, geometry struct<type:string, coordinates:string>"
RINGS_JSON = "array<array<array<double>>>"


def feature_parts(geometry: str) -> Column:
    """Parts of a Polygon or MultiPolygon; NULL for other types or none.

    Coordinates beyond the second (heights) are left out.
    """
    text = f"{geometry}.coordinates"
    polygons = f"""CASE {geometry}.type
        WHEN 'Polygon' THEN array(from_json({text}, '{RINGS_JSON}'))
        WHEN 'MultiPolygon' THEN from_json({text}, 'array<{RINGS_JSON}>') END"""
    point = "struct(element_at(p, 1) AS x, element_at(p, 2) AS y)"
    return F.expr(f"transform({polygons}, rings -> transform(rings, ring -> transform(ring, p -> {point})))")


def zones_from_features(
    features: DataFrame,
    id_property: str,
    name_property: str | None = None,
    order: str = "file_order",
    system: str | None = None,
) -> DataFrame:
    """zone_id, zone_name, file_order, parts; shapes without a polygon are dropped.

    ``system`` is the EPSG code of the coordinates' reference system, which are turned into degrees; none means degrees.
    """
    name = F.try_element_at("properties", F.lit(name_property)) if name_property else F.lit(None).cast("string")
    polygons = features.where(F.col("geometry.type").isin("Polygon", "MultiPolygon"))
    return polygons.select(
        zone_id_text(F.try_element_at("properties", F.lit(id_property))).alias("zone_id"),
        name.alias("zone_name"),
        F.col(order).cast("bigint").alias("file_order"),
        feature_parts("geometry").alias("parts"),
    ).transform(lambda zones: zones.withColumn("parts", G.in_degrees("parts", system)) if system else zones)


def zone_id_text(c: Column) -> Column:
    """A zone's id: whole numbers without sign of decimals (101.0 is 101), other texts trimmed."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[0-9]+\.0*$"), F.regexp_replace(text, r"\.0*$", "")).otherwise(text)


def features_from_text(df: DataFrame, text: str, order: str = "file_order") -> DataFrame:
    """One GeoJSON Feature per row of text."""
    # A generator, as later filters would otherwise pull a second parse of the text down to the scan.
    return df.select(F.col(order), F.inline(F.array(F.from_json(F.col(text), FEATURE_TYPE))))


def read_features(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Features of GeoJSON files, with ascending unique numbers by file path and place in the file.

    A FeatureCollection's carry ``system``, the EPSG code the file names, or NULL; unknown ones raise. Both kinds of files split
    over tasks: newline-delimited features (``per_line``) at lines, a FeatureCollection at its features.
    """
    if per_line:
        return features_from_text(numbered_lines(spark, path), "value")
    found = collection_features(spark, path)
    code = code_of(F.col("crs"))
    refused = F.raise_error(F.concat(F.lit("Unknown reference system: "), F.col("crs"))).cast("string")
    system = F.when(is_known(code), code).otherwise(refused).alias("system")
    parsed = F.inline(F.array(F.from_json(F.col("value"), FEATURE_TYPE + ", type string")))
    return found.select(system, "file_order", parsed).where("type = 'Feature'").drop("type")


def property_names(features: DataFrame) -> list[str]:
    """Distinct property names; bounded by the schema of the file, not by its rows."""
    keys = features.select(F.explode(F.map_keys("properties")).alias("k")).groupBy("k").count()
    return sorted(r["k"] for r in keys.collect())


def load_zones(
    spark: SparkSession,
    path: str,
    id_property: str | None = None,
    name_property: str | None = None,
    per_line: bool = False,
    id_candidates: Sequence[str] = ID_CANDIDATES,
    name_candidates: Sequence[str] = NAME_CANDIDATES,
) -> DataFrame:
    """Zones of a boundary file; id and name properties are discovered if not given.

    Coordinates are taken as degrees unless the file names another reference system that ``reference_systems`` knows.
    """
    # Settled, as a scan split another way would number the features otherwise.
    features = settle(read_features(spark, path, per_line))
    names = property_names(features)
    if not names:
        raise ValueError(f"No features found in boundaries file: {path}")
    id_property = id_property or find_column(names, id_candidates)
    name_property = name_property or find_column(names, name_candidates, required=False)
    if "system" not in features.columns:
        return zones_from_features(features, id_property, name_property)
    # Few: the systems known by code.
    systems = [r["system"] for r in features.select("system").distinct().orderBy("system").collect()]
    by_system = [
        zones_from_features(features.where(F.col("system").eqNullSafe(F.lit(code))), id_property, name_property, system=code) for code in systems
    ]
    return reduce(DataFrame.unionByName, by_system)


def geometry_json(parts: str) -> Column:
    """GeoJSON geometry struct (MultiPolygon) of ``parts``."""
    coordinates = F.expr(f"transform({parts}, rings -> transform(rings, ring -> transform(ring, p -> array(p.x, p.y))))")
    return F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))


def feature_json(parts: str, properties: Column) -> Column:
    """One GeoJSON Feature as text."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), properties.alias("properties"), geometry_json(parts).alias("geometry")
        ),
        {"ignoreNullFields": "false"},
    )
