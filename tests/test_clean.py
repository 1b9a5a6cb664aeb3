import pytest
from pyspark.sql import functions as F

from wardscore.functions import clean, codes, display


def values(spark, column, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_to_number_takes_plain_numbers_only(spark):
    texts = ["1", " 1.5 ", "-2e3", ".5", "5.", "1.5d", "2f", "inf", "NaN", "0x1p3", "abc", "", None, "N/A", "1 2"]
    assert values(spark, clean.to_number, texts) == [1.0, 1.5, -2000.0, 0.5, 5.0] + [None] * 10


def test_number_column_by_type(spark):
    df = spark.createDataFrame([(1, float("nan"), "7"), (2, 2.5, "x")], "a int, b double, c string")
    rows = df.select(*[clean.number_column(df, n) for n in "abc"]).collect()
    assert [tuple(r) for r in rows] == [(1.0, None, 7.0), (2.0, 2.5, None)]


def test_missing_texts(spark):
    assert values(spark, clean.clean_missing, ["N/A", "nan", "", "x", " NA "]) == [None, None, None, "x", " NA "]


def test_collapse_ws(spark):
    assert values(spark, clean.collapse_ws, ["  a \t b  ", None, "c"]) == ["a b", "", "c"]
    assert clean.collapse_ws_text("  a \n b ") == "a b"


def test_area_code(spark):
    texts = [" bronx ", "nan", "(null)", "", None, "None"]
    assert values(spark, clean.area_code, texts) == ["BRONX"] + ["UNKNOWN"] * 5


def test_precinct_code_rounds_half_to_even(spark):
    assert values(spark, clean.precinct_code, ["14.0", "2.5", "3.5", "x", None]) == ["14", "2", "4", "0", "0"]


def test_id_text(spark):
    assert values(spark, clean.id_text, ["101.0", "101", " 101", "x"]) == ["101", "101", "101", None]


def test_uncensor(spark):
    assert values(spark, clean.uncensor, ["<1", " < 1 ", "<10", "3", None]) == ["0.5", "0.5", "<10", "3", None]


def test_start_year(spark):
    assert values(spark, clean.start_year, ["2013-14", "2001", "x-1", None]) == [2013, 2001, None, None]
    with pytest.raises(Exception):
        values(spark, lambda c: clean.start_year(c, strict=True), ["x-1"])


def test_offense_floor_last_against_max(spark):
    texts = ["ASSAULT AND LARCENY", "robbery", "none of these", None]
    assert values(spark, lambda c: codes.offense_floor(c, "last"), texts) == [2.0, 4.0, None, None]
    assert values(spark, lambda c: codes.offense_floor(c, "max"), texts) == [5.0, 4.0, None, None]
    with pytest.raises(ValueError):
        codes.offense_floor(F.lit("x"), "first")


def test_severity_never_falls_below_the_law_weight(spark):
    df = spark.createDataFrame([("FELONY", "GRAND LARCENY"), ("VIOLATION", "GRAND LARCENY"), (None, None)], "l string, o string")
    rows = df.select(codes.severity(F.col("l"), F.col("o"))).collect()
    assert [r[0] for r in rows] == [5.0, 2.0, 1.0]


def test_ratings(spark):
    texts = [" u ", "UD", "wd", "No Data", "nan", "XX", None]
    assert values(spark, codes.rating_code, texts) == ["U/UD", "U/UD", "WD", None, None, "XX", None]
    assert values(spark, lambda c: codes.rating_value(codes.rating_code(c)), texts) == [1.0, 1.0, 5.0, None, None, None, None]


def test_borough_and_labels(spark):
    assert values(spark, codes.borough_of, ["101", "503", "601", "", None]) == [
        "Manhattan", "Staten Island", "Unknown", "Unknown", "Unknown",
    ]
    assert values(spark, display.district_label, ["101", "7", "42"]) == ["CD 1-01", "CD 7", "CD 42"]
    assert values(spark, lambda c: display.area_label("zip", c), ["10001"]) == ["ZIP 10001"]


def test_score_bands_use_the_rounded_score(spark):
    scores = [29.4, 29.5, 49.5, 69.5, 89.49, 89.5, None]
    assert values(spark, display.score_band, scores, "double") == [
        "Needs Attention", "Below Average", "Moderate", "Good", "Good", "Excellent", None,
    ]
