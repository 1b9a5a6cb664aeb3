import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardscore.operators import medians, scoring, tables


def frame(spark, values):
    return spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(values)], "id string, v double")


def test_zscore_is_the_population_one(spark):
    values = [1.0, 2.0, 4.0, None, 9.0]
    df = frame(spark, values)
    n, found = scoring.measure(df, ["v"])
    got = [r[0] for r in df.select(scoring.zscore(F.col("v"), found["v"])).collect()]
    present = [v for v in values if v is not None]
    mean, spread = statistics.fmean(present), statistics.pstdev(present)
    assert n == 5
    for v, z in zip(values, got):
        assert z is None if v is None else z == pytest.approx((v - mean) / spread)


def test_constant_column_has_zero_z_and_neutral_quality(spark):
    df = frame(spark, [3.0, 3.0, None])
    _, found = scoring.measure(df, ["v"])
    zs = [r[0] for r in df.select(scoring.zscore(F.col("v"), found["v"])).collect()]
    qs = [r[0] for r in df.select(scoring.quality(F.col("v"), found["v"], True)).collect()]
    assert zs == [0.0, 0.0, None]
    assert qs == [50.0, 50.0, 50.0]


def test_quality_direction(spark):
    df = frame(spark, [0.0, 1.0, 4.0])
    _, found = scoring.measure(df, ["v"])
    assert [r[0] for r in df.select(scoring.quality(F.col("v"), found["v"], True)).collect()] == [0.0, 25.0, 100.0]
    assert [r[0] for r in df.select(scoring.quality(F.col("v"), found["v"], False)).collect()] == [100.0, 75.0, 0.0]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(scoring.row_mean([F.col(c) for c in "abc"])).collect()] == [2.5, None]


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 60])
def test_segments(spark, n):
    df = scoring.rank_and_segment(frame(spark, [float(i) for i in range(n)]), "v", "id", n, descending=True)
    labels = [r["Segment"] for r in df.orderBy("Rank").collect()]
    k = min(10, n // 2)
    assert labels == ["Top"] * k + ["Middle"] * (n - 2 * k) + ["Bottom"] * k


def test_ties_go_by_id_and_nulls_come_last(spark):
    df = frame(spark, [1.0, None, 2.0, 1.0])
    ranked = scoring.rank_rows(df, scoring.score_order("v", "id", True), "r", 4)
    assert [(r["id"], r["r"]) for r in ranked.orderBy("r").collect()] == [("0002", 1), ("0000", 2), ("0003", 3), ("0001", 4)]


def test_distributed_rank_equals_the_single_task_one(spark):
    rng = random.Random(7)
    # Half of the scores are equal, some are missing.
    values = [None if i % 50 == 0 else 5.0 if i % 2 else rng.random() for i in range(5000)]
    df = frame(spark, values).repartition(6)
    order = scoring.score_order("v", "id", True)
    one = scoring.rank_rows(df, order, "r", 5000)
    many = scoring.rank_rows(df, order, "r", 5000, single_task_rows=10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def brute_medians(rows):
    out = {}
    for key in {r[0] for r in rows}:
        got = [r[1] for r in rows if r[0] == key and r[1] is not None]
        if got:
            out[key] = statistics.median(got)
    return out


def test_grouped_medians_exact_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(50, 20)) for _ in range(3000)]
    rows += [("copies", 7.25)] * 2000 + [("one", 3.0), ("none", None), ("pair", 1.0), ("pair", 2.0)]
    rows += [("outside", v) for v in (-500.0, 900.0, 1000.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = medians.grouped_medians(df, ["k"], {"v": (F.lit(0.0), F.lit(100.0))})
    assert {r["k"]: r["v"] for r in got.collect()} == pytest.approx(brute_medians(rows))


def test_grouped_medians_of_two_columns(spark):
    rows = [("a", 1.0, 10.0), ("a", 2.0, None), ("a", 9.0, 30.0), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = medians.grouped_medians(df, ["k"], {c: (F.lit(0.0), F.lit(0.0)) for c in "vw"})
    assert {r["k"]: (r["v"], r["w"]) for r in got.collect()} == {"a": (2.0, 20.0), "b": (None, 5.0)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_medians_of_any_values(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = medians.grouped_medians(df, ["k"], {"v": (F.lit(-10.0), F.lit(10.0))}).first()["v"]
    assert got == pytest.approx(statistics.median(values))


def test_first_by_keeps_the_first_row(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, n int, v string")
    assert sorted(map(tuple, tables.first_by(df, ["k"], ["n"]).collect())) == [("a", 1, None), ("b", 5, "z")]


def test_lookup_join_trims_and_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([("a ", 1), ("c", 2)], "k string, n int")
    lookup = spark.createDataFrame([(" a", "first", 1), ("a", "second", 2), ("b", "other", 3)], "k string, v string, o int")
    got = tables.lookup_join(left, lookup, "k", ["o"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, "first"), ("c", 2, None)]
    assert tables.lookup_join(left, None, "k") is left
    assert tables.lookup_join(left, lookup.withColumnRenamed("k", "other"), "k") is left


def test_find_column_prefers_the_later_duplicate():
    assert tables.find_column(["boro_cd", "BoroCD"], ["borocd"]) == "BoroCD"
    assert tables.find_column(["x"], ["y"], required=False) is None
    with pytest.raises(ValueError):
        tables.find_column(["x"], ["y"])


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b"):
        tables.require_columns(df, ["a", "b"])


def test_mean_z_table_without_values(spark):
    with pytest.raises(ValueError):
        scoring.mean_z_table(frame(spark, [None, None]), ["v"], "s", "id", True)


def test_z_has_mean_zero(spark):
    df = frame(spark, [math.sin(i) for i in range(200)])
    _, found = scoring.measure(df, ["v"])
    row = df.select(scoring.zscore(F.col("v"), found["v"]).alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1)


@pytest.mark.parametrize("task_rows", [1, 7, 50])
def test_grouped_medians_narrow_crowded_buckets(spark, task_rows):
    """Useless bounds put all rows of a group into one bucket, which is cut until it is small."""
    rows = [("a", float(i * i % 9973) / 7) for i in range(900)] + [("b", 5.0)] * 60 + [("c", v) for v in (1e-300, 2e300, -3.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = medians.grouped_medians(df, ["k"], {"v": (F.lit(1e9), F.lit(2e9))}, task_rows=task_rows)
    assert {r["k"]: r["v"] for r in got.collect()} == pytest.approx(brute_medians(rows))
