"""The queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchset import adapters as A
from wardscore.functions.display import district_label
from wardscore.functions.projection import with_plane
from wardscore.functions.reference_systems import from_degrees
from wardscore.operators import geometry as G
from wardscore.operators.outline import outlines, perimeter
from wardscore.operators.overlay import overlay
from wardscore.operators.quadtree import located, zone_edges
from wardscore.operators.settle import fresh_path
from wardscore.operators.spatial import first_zone, points_in_zones
from wardscore.operators.tables import col, keep_known
from wardscore.plans import dashboard as D
from wardscore.plans.air import air_index, air_pivot, pollutant_means
from wardscore.plans.combine import combined_index, find_area, index_from_raw, index_json, index_records
from wardscore.plans.incidents import clean_incidents, incident_index, incident_points
from wardscore.plans.refresh import refresh, refreshed_units
from wardscore.plans.rollup import boroughs, geo_features, rollup, rollup_borough, rollup_records
from wardscore.plans.schools import education_table, rating_agreement, school_grades, unmapped_codes
from wardscore.plans.water import add_lonlat, water_index
from wardscore.plans.zones import city_extent, incident_zone_index, incident_zone_rows, laid_out_zone_rows, zone_quality
from wardscore.sources.boundaries import feature_json, load_zones
from wardscore.sources.laid_out import lay_out
from wardscore.sources.stored import lookup, open_stored, star_join, store
from wardscore.sources.tabular import read_csv, read_index, write_table
from wardscore.streaming.incident_medians import latest_medians, run_medians
from wardscore.streaming.incident_totals import incident_stream, latest_totals, run_totals
from wardscore.streaming.zone_totals import latest_zone_totals, run_zone_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
# The review years of the given tables end in 2001; the job's own default is later.
AGREEMENT_YEAR = 1998


def plain_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def tidy(df: DataFrame) -> DataFrame:
    """Plain column names, whole numbers as bigint, doubles to six digits."""
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(plain_name(field.name)))
    return df.select(*out)


def query(name: str) -> Callable[[Query], Query]:
    """Registers a tidied form of the function; others may build on the plain one."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        return f

    return register


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_from_raw(A.areas(spark, sf_dir))


# Air, water, schools


@query("air_means")
def air_means(spark, sf_dir):
    return pollutant_means(A.readings(spark, sf_dir), "CD")


@query("air_pivot")
def air_wide(spark, sf_dir):
    return air_pivot(A.readings(spark, sf_dir), "  CD ")


@query("air_score")
def air_score(spark, sf_dir):
    return air_index(A.readings(spark, sf_dir))


@query("water_sites")
def water_sites(spark, sf_dir):
    return water_index(A.samples(spark, sf_dir), A.site_lookup(spark, sf_dir), lookup_order=["row_no"])


@query("water_sites_all_classes")
def water_sites_all_classes(spark, sf_dir):
    return water_index(A.samples(spark, sf_dir), sample_class=None)


@query("school_grades")
def school_grade(spark, sf_dir):
    return school_grades(A.reviews(spark, sf_dir), A.school_lookup(spark, sf_dir), lookup_order=["row_no"])


@query("education")
def education(spark, sf_dir):
    return education_table(school_grade(spark, sf_dir))


@query("rating_audit")
def rating_audit(spark, sf_dir):
    return unmapped_codes(A.reviews(spark, sf_dir))


@query("rating_corr")
def rating_corr(spark, sf_dir):
    return rating_agreement(A.reviews(spark, sf_dir), AGREEMENT_YEAR)


@query("project_points")
def project_points(spark, sf_dir):
    lookup = A.site_lookup(spark, sf_dir).select(
        "row_no", col("X - Coordinate").alias("X_COORDINATE"), col("Y - Coordinate").alias("Y_COORDINATE")
    )
    placed = add_lonlat(lookup)
    return with_plane(placed, F.col("Longitude"), F.col("Latitude"), "x_back", "y_back")


# Incidents


WEIGHTS = ["CMPLNT_NUM", "Geo_Unit", "severity_weight", "attempt_factor", "weighted_incident"]


@query("incident_weights")
def incident_weights(spark, sf_dir):
    return keep_known(clean_incidents(A.incidents(spark, sf_dir)), WEIGHTS)


@query("incident_weights_max")
def incident_weights_max(spark, sf_dir):
    return keep_known(clean_incidents(A.incidents(spark, sf_dir), "borough", "max"), WEIGHTS)


@query("incident_units")
def incident_units(spark, sf_dir):
    return incident_index(A.incidents(spark, sf_dir), "precinct")


@query("incident_boroughs")
def incident_boroughs(spark, sf_dir):
    return incident_index(A.incidents(spark, sf_dir), "borough")


@query("incident_points")
def incident_point_rows(spark, sf_dir):
    return incident_points(A.incidents(spark, sf_dir))


@query("stream_incident_units")
def stream_incident_units(spark, sf_dir):
    schema = A.table(spark, sf_dir, "events").schema
    # A pattern, as the table may be a file or a folder of part files.
    stream = incident_stream(spark, f"{sf_dir}/[e]vents.parquet", schema)
    totals = fresh_path(spark, "totals")
    run_totals(stream, totals, fresh_path(spark, "state"), prepare=A.incidents_of).awaitTermination()
    return latest_totals(spark, totals)


@query("stream_incident_medians")
def stream_incident_medians(spark, sf_dir):
    stream = incident_stream(spark, f"{sf_dir}/[e]vents.parquet", A.table(spark, sf_dir, "events").schema)
    path = fresh_path(spark, "medians")
    run_medians(stream, path, fresh_path(spark, "state"), prepare=A.incidents_of).awaitTermination()
    return latest_medians(spark, path)


@query("stream_zone_totals")
def stream_zone_totals(spark, sf_dir):
    """Every incident arrives twice and counts once."""
    stream = incident_stream(spark, f"{sf_dir}/[e]vents.parquet", A.table(spark, sf_dir, "events").schema)
    path = fresh_path(spark, "zone-totals")
    run = run_zone_totals(stream, A.districts(spark, sf_dir), "reported", path, fresh_path(spark, "state"), prepare=A.timed_incidents_of)
    run.awaitTermination()
    return latest_zone_totals(spark, path)


@query("incident_refresh")
def incident_refresh(spark, sf_dir):
    """Totals and representative points after three files have arrived one by one, each read once."""
    events = A.table(spark, sf_dir, "events")
    source, path = fresh_path(spark, "arriving"), fresh_path(spark, "refreshed")
    read = lambda files: A.incidents_of(spark.read.schema(events.schema).parquet(*files))
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(source)
        refresh(spark, source, path, read)
    return refreshed_units(spark, path)


@query("t_csv_bad_rows")
def csv_bad_rows(spark, sf_dir):
    """Rows with too few fields stay, those with too many go, also where the surplus is empty."""
    path = fresh_path(spark, "customers")
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    line = (
        F.when(key % 5 == 1, F.concat_ws(",", key, name))
        .when(key % 5 == 2, F.concat_ws(",", key, name, segment, F.lit("x")))
        .when(key % 5 == 3, F.concat_ws(",", key, name, segment, F.lit("")))
        .otherwise(F.concat_ws(",", key, name, segment))
    )
    # Each task writes one file, which begins with a header.
    lines = A.table(spark, sf_dir, "customer").select(line.alias("line"), F.monotonically_increasing_id().alias("place"))
    first = F.col("place").bitwiseAND((1 << 33) - 1) == 0
    with_header = F.when(first, F.array(F.lit("id,name,segment"), "line")).otherwise(F.array("line"))
    lines.select(F.explode(with_header).alias("value")).write.text(path)
    rows = read_csv(spark, path, skip_bad_rows=True)
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.sum(F.col("id").cast("bigint")).alias("id_sum")
    )


@query("t_csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "incidents")
    write_table(A.incidents(spark, sf_dir), path, fmt="csv")
    back = read_csv(spark, path, columns=["CMPLNT_NUM", "ADDR_PCT_CD", "OFNS_DESC", "Latitude"], required=["BORO_NM"])
    return back.groupBy("BORO_NM").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("CMPLNT_NUM").alias("numbered"),
        F.count("OFNS_DESC").alias("described"),
        F.sum(F.col("Latitude").try_cast("double")).alias("latitude_sum"),
    )


# Zones


@query("t_boundary_roundtrip")
def boundary_roundtrip(spark, sf_dir):
    """District features written line by line and read back, id and name found by their properties."""
    path = fresh_path(spark, "districts")
    A.district_features(spark, sf_dir).select("feature").write.text(path)
    zones = load_zones(spark, path, per_line=True)
    return zones.select("zone_id", "zone_name", F.size("parts").alias("part_count"))


@query("t_collection_roundtrip")
def collection_roundtrip(spark, sf_dir):
    """District features written as a few FeatureCollections, each one line, and read back cut at their features."""
    path = fresh_path(spark, "collections")
    features = A.district_features(spark, sf_dir).withColumn("file_no", F.col("file_order") % 4)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("file_order", "feature"))), lambda f: f["feature"])
    whole = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.concat_ws(", ", listed), F.lit("]}"))
    features.groupBy("file_no").agg(whole.alias("value")).write.partitionBy("file_no").text(path)
    zones = load_zones(spark, path)
    return zones.select("zone_id", "zone_name", F.size("parts").alias("part_count"))


@query("t_reference_systems")
def reference_systems(spark, sf_dir):
    """District corners written in two other reference systems and read back: their boxes in ten-thousandths of a degree."""
    path = fresh_path(spark, "systems")
    for code, rest in (("32618", 0), ("3857", 1)):
        moved = A.districts(spark, sf_dir).where(F.col("file_order") % 2 == rest)
        moved = moved.withColumn("parts", F.expr(f"transform(parts, rings -> transform(rings, ring -> {from_degrees(code)('ring')}))"))
        texts = moved.select(feature_json("parts", F.struct(F.col("zone_id").alias("id"))).alias("feature"), (F.col("file_order") % 7).alias("file_no"))
        named = f'{{"type": "FeatureCollection", "crs": {{"type": "name", "properties": {{"name": "urn:ogc:def:crs:EPSG::{code}"}}}}, "features": ['
        whole = F.concat(F.lit(named), F.concat_ws(", ", F.collect_list("feature")), F.lit("]}"))
        texts.groupBy("file_no").agg(whole.alias("value")).write.partitionBy("file_no").text(f"{path}/system={code}")
    boxed = load_zones(spark, path).withColumn("box", G.zone_bbox("parts"))
    return boxed.select("zone_id", *[(F.col("box")[k] * 1e4).alias(k) for k in G.BOX])


@query("geo_boundaries")
def geo_boundaries(spark, sf_dir):
    zones = A.districts(spark, sf_dir)
    signed = zones.withColumn("signed", G.signed_edges("parts")).withColumn("box", G.zone_bbox("parts"))
    return signed.select(
        "zone_id",
        "zone_name",
        F.size("parts").alias("part_count"),
        F.size("signed").alias("edge_count"),
        "box.xmin",
        "box.ymin",
        "box.xmax",
        "box.ymax",
        # In millionths of a square degree.
        (G.area("signed") * 1e6).alias("area"),
    )


@query("borough_outlines")
def borough_outlines(spark, sf_dir):
    """Boroughs as merged outlines, areas in thousandths of a square degree; members that overlap count once."""
    merged = outlines(boroughs(A.districts(spark, sf_dir)))
    rows = merged.withColumn("signed", G.signed_edges("parts")).select("zone_id", G.area("signed").alias("area"), perimeter("parts").alias("border"))
    return rows.groupBy("zone_id").agg((F.sum("area") * 1000).alias("area"), F.sum("border").alias("border"))


def edge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point on every district edge, as near as doubles come to it."""
    edges = zone_edges(A.districts(spark, sf_dir), "zone_id")
    return edges.select(((F.col("x1") * 2 + F.col("x2")) / 3).alias("Longitude"), ((F.col("y1") * 2 + F.col("y2")) / 3).alias("Latitude")).distinct()


@query("edge_points_strict")
def edge_points_strict(spark, sf_dir):
    """Points on edges, slanted ones too, with the districts they lie strictly inside of, on coordinates of nine digits."""
    inside = points_in_zones(edge_points(spark, sf_dir), A.districts(spark, sf_dir), exclude_boundary=True, digits=9)
    return inside.select("Longitude", "Latitude", "zone_id")


@query("edge_points_strict_adaptive")
def edge_points_strict_adaptive(spark, sf_dir):
    inside = located(edge_points(spark, sf_dir), A.districts(spark, sf_dir), exclude_boundary=True, digits=9)
    return inside.select("Longitude", "Latitude", "zone_id")


@query("zone_centroid")
def zone_centroid(spark, sf_dir):
    return G.with_centroid(A.districts(spark, sf_dir)).select(
        "zone_id", "Representative_Latitude", "Representative_Longitude"
    )


@query("point_zone_first")
def point_zone_first(spark, sf_dir):
    points = A.incidents(spark, sf_dir).select("event_id", "Latitude", "Longitude")
    return first_zone(points, A.districts(spark, sf_dir), "event_id", [])


@query("point_zone_adaptive")
def point_zone_adaptive(spark, sf_dir):
    points = A.incidents(spark, sf_dir).select("event_id", "Latitude", "Longitude")
    return first_zone(points, A.districts(spark, sf_dir), "event_id", [], match=located)


@query("point_block_groups")
def point_block_groups(spark, sf_dir):
    """Points in shapes of very many parts: all blocks of a borough as one shape."""
    points = A.incidents(spark, sf_dir).select("event_id", "Latitude", "Longitude")
    return located(points, A.block_groups(spark, sf_dir)).select("event_id", "zone_id")


@query("incident_zone_join")
def incident_zone_join(spark, sf_dir):
    points = incident_points(A.incidents(spark, sf_dir))
    return incident_zone_rows(points, A.districts(spark, sf_dir)).select(
        "CMPLNT_NUM", "zone_id", "zone_name", "weighted_incident"
    )


@query("laid_out_district")
def laid_out_district(spark, sf_dir):
    """One district's incidents, read from the files near it of a table laid out along a curve."""
    path = fresh_path(spark, "laid-out")
    lay_out(incident_points(A.incidents(spark, sf_dir)), path, city_extent())
    return laid_out_zone_rows(spark, path, A.districts(spark, sf_dir).where("zone_id = '5'")).select(
        "CMPLNT_NUM", "zone_id", "zone_name", "weighted_incident"
    )


@query("incident_zone_index")
def incident_zones(spark, sf_dir):
    return incident_zone_index(incident_points(A.incidents(spark, sf_dir)), A.districts(spark, sf_dir))


@query("zone_quality")
def water_zone_quality(spark, sf_dir):
    return zone_quality(water_sites(spark, sf_dir), A.districts(spark, sf_dir), "Sample Site", "WaterScore", False, "Water")


@query("education_zone_quality")
def education_zone_quality(spark, sf_dir):
    return zone_quality(education(spark, sf_dir), A.districts(spark, sf_dir), "BN", "EducationScore", True, "Education")


@query("zone_overlay")
def zone_overlay(spark, sf_dir):
    pieces = overlay(A.districts(spark, sf_dir), A.blocks(spark, sf_dir))
    # Areas in millions of square feet.
    millions = [(F.col(c) / 1e6).alias(c) for c in ("source_area", "target_area", "intersection_area")]
    return pieces.select("source_id", "target_id", *millions, "weight", "source_share")


# The index and its rollups


@query("combined_index")
def combined(spark, sf_dir):
    return combined_index(
        air_score(spark, sf_dir),
        incident_zones(spark, sf_dir),
        water_zone_quality(spark, sf_dir),
        education_zone_quality(spark, sf_dir),
    )


@query("index_table")
def index_table(spark, sf_dir):
    return index_of(spark, sf_dir)


@query("stored_index")
def stored_index(spark, sf_dir):
    """The score tables stored by district, opened again and joined bucket by bucket."""
    raw = A.areas(spark, sf_dir)
    key, first = raw.columns[0], 6
    own = [raw.columns[1:first], ["SafetyScore", "Incident_Count", "Weighted_Severity_Sum"], ["WaterScore", "Water_Point_Count"], ["EducationScore", "Education_Point_Count"]]
    paths = [fresh_path(spark, "stored") for _ in own]
    for path, columns in zip(paths, own, strict=True):
        store(raw.select(key, *[col(c) for c in columns]), path, key)
    air, *others = [open_stored(spark, path) for path in paths]
    return index_from_raw(star_join(air, others, key).select(*[col(c) for c in raw.columns]))


@query("stored_profile")
def stored_profile(spark, sf_dir):
    """One district's record read from the one bucket that holds it."""
    stored = store(index_records(index_of(spark, sf_dir)), fresh_path(spark, "records"), "geo_id")
    return lookup(stored, "geo_id", "5").select("geo_id", "record.name", "record.borough", "record.overall")


@query("t_index_roundtrip")
def index_roundtrip(spark, sf_dir):
    """The index written as CSV and read back as a page would read it."""
    path = fresh_path(spark, "index")
    write_table(index_of(spark, sf_dir), path, fmt="csv")
    names = ["Community_District_ID", "Community_District_Name", "borough", "AirScore", "WaterScore", "Overall_QualityScore"]
    return read_index(spark, path).select(*names)


@query("index_records")
def index_record_fields(spark, sf_dir):
    r = index_records(index_of(spark, sf_dir))
    details = F.col("record.details")
    return r.select(
        "geo_id",
        district_label(F.col("geo_id")).alias("label"),
        "record.name",
        "record.borough",
        "record.geography_type",
        "record.overall",
        "record.air",
        "record.water",
        "record.edu",
        "record.nypd",
        details["overall"]["rank"].alias("rank"),
        details["air"]["pm25"].alias("pm25"),
        details["water"]["sample_sites"].alias("sample_sites"),
        details["edu"]["schools"].alias("schools"),
        details["nypd"]["incidents"].alias("incidents"),
        details["nypd"]["weighted_severity_sum"].alias("weighted_severity_sum"),
    )


@query("area_profile")
def area_profile(spark, sf_dir):
    found = find_area(index_records(index_of(spark, sf_dir)), "5")
    return found.select("geo_id", "record.name", "record.borough", "record.overall")


@query("index_json")
def index_json_rows(spark, sf_dir):
    return index_json(index_of(spark, sf_dir))


@query("rollup_zone")
def rollup_zone(spark, sf_dir):
    return rollup(index_of(spark, sf_dir), A.districts(spark, sf_dir), A.blocks(spark, sf_dir))


@query("rollup_zone_source_share")
def rollup_zone_source_share(spark, sf_dir):
    return rollup(index_of(spark, sf_dir), A.districts(spark, sf_dir), A.blocks(spark, sf_dir), share="source")


@query("rollup_borough")
def rollup_boroughs(spark, sf_dir):
    return rollup_borough(index_of(spark, sf_dir), A.districts(spark, sf_dir))


@query("geo_features")
def geo_feature_rows(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return geo_features(A.districts(spark, sf_dir), index_records(index), "community_district")


@query("geo_features_borough")
def geo_features_of_boroughs(spark, sf_dir):
    districts = A.districts(spark, sf_dir)
    return geo_features(boroughs(districts), rollup_records(rollup_borough(index_of(spark, sf_dir), districts), "borough"), "borough")


@query("borough_record_rows")
def borough_record_rows(spark, sf_dir):
    rolled = rollup_borough(index_of(spark, sf_dir), A.districts(spark, sf_dir))
    records = rollup_records(rolled, "borough")
    return records.select(
        "geo_id", "record.name", "record.borough", "record.overall", "record.details.overall.rank",
        F.col("record.details.overall.method").alias("method"),
    )


# Dashboard


@query("city_summary")
def city_summary(spark, sf_dir):
    return D.city_summary(index_of(spark, sf_dir))


@query("metric_stats")
def metric_stats(spark, sf_dir):
    return D.metric_stats(index_of(spark, sf_dir))


@query("borough_avg")
def borough_avg(spark, sf_dir):
    return D.borough_averages(index_of(spark, sf_dir))


@query("top_bottom")
def top_bottom(spark, sf_dir):
    return D.top_and_bottom(index_of(spark, sf_dir))


@query("leaderboards")
def leaderboards(spark, sf_dir):
    return D.leaderboards(index_of(spark, sf_dir))


@query("balance_top")
def balance_top(spark, sf_dir):
    return D.balance_boards(index_of(spark, sf_dir))


@query("rank_curve")
def rank_curve(spark, sf_dir):
    return D.rank_curve(index_of(spark, sf_dir))


@query("score_histogram")
def score_histogram(spark, sf_dir):
    return D.score_histogram(index_of(spark, sf_dir))


@query("score_bands")
def score_bands(spark, sf_dir):
    return D.score_bands(index_of(spark, sf_dir))


@query("compare_areas")
def compare_areas(spark, sf_dir):
    return D.compare_areas(index_of(spark, sf_dir), "5", "8")


@query("compare_wide")
def compare_wide(spark, sf_dir):
    return D.compare_wide(index_of(spark, sf_dir), "5", "8")
