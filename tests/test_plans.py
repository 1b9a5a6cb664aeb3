"""Shapes of physical plans that decide whether a job holds up on large tables."""

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from benchset.registry import QUERIES
from wardscore.operators.spatial import points_in_zones
from wardscore.plans.air import air_pivot
from wardscore.plans.incidents import clean_incidents, unit_totals

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["air_score", "water_sites", "school_grades", "incident_units", "point_zone_first", "point_zone_adaptive", "incident_zone_join",
     "zone_overlay", "borough_outlines", "t_collection_roundtrip",
     "city_summary", "score_histogram", "metric_stats", "compare_wide"],
)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]


def test_zones_are_broadcast_only_when_small(spark, sf_dir):
    points = A.incidents(spark, sf_dir).select("event_id", "Latitude", "Longitude")
    zones = A.districts(spark, sf_dir)
    small = plan_of(points_in_zones(points, zones))
    assert "BroadcastHashJoin [level" in small and "Exchange hashpartitioning" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan_of(points_in_zones(points, zones, broadcast_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [level" in large and "_salt" in large


def test_raw_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(air_pivot(A.readings(spark, sf_dir), "CD"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in plan
    assert plan.count("Exchange") == 1
    totals = plan_of(unit_totals(clean_incidents(A.incidents(spark, sf_dir))))
    assert totals.count("Exchange") == 1 and "props" not in totals and "partial_sum" in totals


def test_filters_reach_the_scan(spark, sf_dir):
    incidents = A.table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan_of(incidents)
