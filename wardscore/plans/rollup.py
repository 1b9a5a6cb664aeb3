"""Area-weighted rollup of the district index onto other geographies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.functions.codes import borough_of
from wardscore.functions.display import area_label
from wardscore.operators.overlay import overlay
from wardscore.operators.scoring import rank_rows, row_mean, score_order
from wardscore.operators.settle import land, settle, spread
from wardscore.operators.tables import col, first_by
from wardscore.plans.combine import DISTRICT_METHOD, OVERALL, QUALITY_COLUMNS, RANK, index_records, score_record
from wardscore.plans.zones import ZONE_ID
from wardscore.sources.boundaries import feature_json
from wardscore.sources.tabular import read_table, write_table

# Score columns that are averaged and those that are summed.
AVERAGED = [
    *QUALITY_COLUMNS, "AirScore", "PM2.5", "NO2", "O3", "WaterScore", "EducationScore", "SafetyScore",
]
SUMMED = ["Water_Point_Count", "Education_Point_Count", "Incident_Count", "Weighted_Severity_Sum"]


@dataclass(frozen=True)
class Geography:
    """What an area kind is called and how its scores came about."""

    label: str
    subtitle: str
    method: str
    source_label: str | None = None


# Published wording per geography.
GEOGRAPHIES = {
    "community_district": Geography("Community District", "by community district", DISTRICT_METHOD),
    "borough": Geography("Borough", "by borough", "Borough rollup of community-district prototype scores."),
    "nta": Geography(
        "Neighborhood",
        "by neighborhood tabulation area",
        "Area-weighted rollup of community-district prototype scores onto NTA neighborhood boundaries.",
    ),
    "zip": Geography(
        "ZIP Code",
        "by modified zip code tabulation area",
        "Area-weighted rollup of community-district prototype scores onto MODZCTA ZIP boundaries.",
        "MODZCTA geography",
    ),
}


def dissolve(zones: DataFrame, group: Column) -> DataFrame:
    """Zones relabelled by ``group``; rows without one are dropped.

    Members stay separate rows of one zone_id. For members that do not overlap
    each other, areas and shares add up, so no outline has to be merged.
    """
    grouped = zones.withColumn("_group", group).where(F.col("_group").isNotNull())
    return grouped.withColumns({"zone_id": F.col("_group"), "zone_name": F.col("_group")}).drop("_group")


def _weighted(pieces: DataFrame, weight: str) -> DataFrame:
    """Weighted means and sums of the score columns by target, NULL values left out."""
    w = F.col(weight)

    def mean(name: str) -> Column:
        used = F.when(col(name).isNotNull() & (w > 0), w)
        return F.sum(col(name) * used) / F.nullif(F.sum(used), F.lit(0.0))

    return pieces.groupBy("target_id").agg(
        *[mean(c).alias(c) for c in AVERAGED], *[F.sum(col(c) * w).alias(c) for c in SUMMED]
    )


def rollup(index: DataFrame, zones: DataFrame, target: DataFrame, share: str = "target") -> DataFrame:
    """Target areas with the district scores that fall on them, overall and rank.

    Averages weigh districts by overlap area. Sums weigh by the share of the
    target's area, so totals are not kept; ``share='source'`` keeps them.
    """
    if share not in ("target", "source"):
        raise ValueError(f"share must be 'target' or 'source', not {share!r}")
    # Landed, as shapes and names are read apart and the shapes may have to be worked out of text.
    target = land(spread(target.select("zone_id", "file_order", "zone_name", "parts")), "target")
    pieces = overlay(zones, target)
    scores = index.select(col(ZONE_ID).alias("source_id"), *[col(c) for c in [*AVERAGED, *SUMMED]])
    # Districts without a score keep their pieces, with nothing to add.
    weighted = _weighted(pieces.join(scores, "source_id", "left"), "weight" if share == "target" else "source_share")
    names = first_by(target.select("zone_id", "file_order", "zone_name"), ["zone_id"], ["file_order"])
    rolled = settle(
        # Shuffled, as there is a name for every target; the other side lies by target already.
        weighted.join(names.hint("merge"), weighted["target_id"] == names["zone_id"]).select(
            F.col("target_id").alias("geo_id"), F.col("zone_name").alias("name"), *[col(c) for c in [*AVERAGED, *SUMMED]]
        )
    ).withColumn(OVERALL, row_mean([col(c) for c in QUALITY_COLUMNS]))
    return rank_rows(rolled, score_order(OVERALL, "geo_id", descending=True), RANK, rolled.count())


def rollup_borough(index: DataFrame, zones: DataFrame, share: str = "target") -> DataFrame:
    """Rollup onto boroughs, each the union of the districts whose id names it."""
    return rollup(index, zones, boroughs(zones), share)


def boroughs(zones: DataFrame) -> DataFrame:
    """Districts relabelled by the borough their id names."""
    return dissolve(zones, borough_of(F.col("zone_id")))


def rollup_records(rolled: DataFrame, geography: str) -> DataFrame:
    """geo_id and nested record of every target area."""
    kind = GEOGRAPHIES[geography]
    borough = F.col("name") if geography == "borough" else F.lit(None).cast("string")
    record = score_record(F.col("name"), borough, F.col("geo_id"), geography, kind.method, kind.source_label)
    return rolled.select("geo_id", record.alias("record"))


def geo_features(zones: DataFrame, records: DataFrame, geography: str, by_row: bool = False) -> DataFrame:
    """GeoJSON feature text of the areas that have a score record, one per area.

    The rows of one zone_id, as ``dissolve`` or ``outlines`` makes them, are the parts of its outline, in file order. ``by_row``
    writes a feature for each of them instead, so that no area has to fit one row.
    """
    if by_row:
        return _features_of(zones, records, geography)
    members = zones.groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct("file_order", "zone_name", "parts"))).alias("_m"))
    whole = members.select(
        "zone_id", F.element_at("_m", 1)["zone_name"].alias("zone_name"), F.flatten(F.transform("_m", lambda m: m["parts"])).alias("parts")
    )
    return _features_of(whole, records, geography)


def _features_of(whole: DataFrame, records: DataFrame, geography: str) -> DataFrame:
    scored = whole.join(records.select(F.col("geo_id").alias("zone_id")), "zone_id", "left_semi")
    label = area_label(geography, F.col("zone_id"), F.col("zone_name"))
    properties = F.struct(F.col("zone_id").alias("geo_id"), label.alias("geo_label"))
    return scored.select(
        F.col("zone_id").alias("geo_id"), label.alias("geo_label"), feature_json("parts", properties).alias("feature")
    )


def write_geographies(index: DataFrame, zones: DataFrame, targets: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the records and shapes of districts, boroughs and the given targets, one table each, and what each is called.

    Pages then look areas up in these tables instead of rebuilding the rollup. Shapes are in ``<geography>_shapes``, label
    and subtitle of all in ``geographies``.
    """
    index = settle(index)
    shapes = {"community_district": zones, "borough": boroughs(zones), **targets}
    records = {"community_district": index_records(index)}
    for geography, target in shapes.items():
        if geography not in records:
            records[geography] = rollup_records(rollup(index, zones, target), geography)
    titles = [(name, GEOGRAPHIES[name].label, GEOGRAPHIES[name].subtitle) for name in records]
    tables = {**records, "geographies": index.sparkSession.createDataFrame(titles, "geography string, label string, subtitle string")}
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in [*tables, *(f"{g}_shapes" for g in records)]}
    for name, table in tables.items():
        write_table(table, paths[name])
    for geography in records:
        # The records as written tell which areas have one.
        known = read_table(index.sparkSession, paths[geography])
        write_table(geo_features(shapes[geography], known, geography), paths[f"{geography}_shapes"])
    return paths
