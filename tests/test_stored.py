"""Stored views: pruned lookups, joins without an exchange, opened again by their layout."""

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from wardscore.sources import stored as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def parts(spark, sf_dir, tmp_path):
    raw = A.areas(spark, sf_dir)
    key = raw.columns[0]
    columns = [raw.columns[1:4], raw.columns[4:7], raw.columns[7:9]]
    paths = [str(tmp_path / f"part{i}") for i in range(3)]
    for path, own in zip(paths, columns):
        S.store(raw.select(key, *[F.col(f"`{c}`") for c in own]), path, key, 8)
    return raw, key, paths


def test_star_join_moves_nothing(spark, parts):
    raw, key, paths = parts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first, *others = [S.open_stored(spark, p) for p in paths]
        joined = S.star_join(first, others, key)
        plan = plan_of(joined)
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = raw.select([F.col(f"`{c}`") for c in joined.columns])
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert [r[:4] for r in order(joined)] == [r[:4] for r in order(want)] and joined.count() == raw.count()


def test_lookup_reads_one_bucket(spark, parts):
    raw, key, paths = parts
    found = S.lookup(S.open_stored(spark, paths[0]), key, "5")
    # A lookup alone is read without bucket order, but pruned all the same; the plan says so only for an ordered scan.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan_of(S.lookup(S.open_stored(spark, paths[0]), key, "5"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert found.rdd.getNumPartitions() == 1
    assert [r[0] for r in found.collect()] == ["5"]
    assert S.lookup(S.open_stored(spark, paths[0]), key, "nowhere").count() == 0


def test_replacing_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.store(spark.range(10).selectExpr("cast(id as string) AS `a.key`", "id AS n"), path, "a.key", 4)
    again = S.store(spark.range(3).selectExpr("cast(id as string) AS `a.key`", "id * 2 AS n"), path, "a.key", 2)
    assert sorted(map(tuple, again.collect())) == [("0", 0), ("1", 2), ("2", 4)]
    with pytest.raises(ValueError):
        S.store(spark.range(1), path, "missing")
