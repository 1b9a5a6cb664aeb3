"""School reviews to one time-decayed grade per school."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardscore.functions.clean import clean_missing, start_year
from wardscore.functions.codes import rating_code, rating_value
from wardscore.operators.scoring import row_mean
from wardscore.operators.tables import keep_known, lookup_join, order_columns
from wardscore.plans.water import add_lonlat

SCHOOL = "BN"
INDICATORS = [f"IndicatorOverall_{i}" for i in range(1, 6)]
OVERALL = "Overall_Rating"
DECAY = 0.9
LAST_RATED_YEAR = 2014
NOT_A_SCHOOL = "all quality review"

# Weights are DECAY ** (anchor - year). The anchor cancels out of a weighted
# mean, so any fixed year does and no pass over the table for its latest one.
ANCHOR_YEAR = 2010

# Columns of the school lookup, and column order of the two tables.
LOOKUP_COLUMNS = [
    "location_code", "location_name", "X_COORDINATE", "Y_COORDINATE", "Location_Category_Description",
]
GRADE_COLUMNS = [
    SCHOOL, "location_name", "Final_Weighted_Grade", "Average_Completeness_Score", "Number_of_Years",
    "Earliest_Year", "Latest_Year", "X_COORDINATE", "Y_COORDINATE", "Location_Category_Description",
]
EDUCATION_COLUMNS = [
    SCHOOL, "location_name", "EducationScore", "Average_Completeness_Score", "Number_of_Years",
    "Earliest_Year", "Latest_Year", "X_COORDINATE", "Y_COORDINATE", "Latitude", "Longitude",
    "Location_Category_Description",
]


def school_rows(reviews: DataFrame) -> DataFrame:
    """Review rows of schools; summary rows are left out, rows without a key kept."""
    is_summary = F.lower(F.col(SCHOOL)).contains(NOT_A_SCHOOL)
    return reviews.where(~F.coalesce(is_summary, F.lit(False)))


def rated_reviews(reviews: DataFrame, strict_years: bool = False) -> DataFrame:
    """School, year, mean indicator value and completeness of each review."""
    rated = [*INDICATORS, OVERALL] if OVERALL in reviews.columns else INDICATORS
    # The ordinals are columns of their own first, as each is used more than once.
    ordinals = school_rows(reviews).select(
        clean_missing(F.col(SCHOOL)).alias(SCHOOL),
        start_year(F.col("School_Year"), strict_years).alias("School_Year"),
        *[rating_value(rating_code(F.col(c))).alias(c) for c in rated],
    )
    values = [F.col(c) for c in INDICATORS]
    present = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    columns = [SCHOOL, "School_Year", row_mean(values).alias("Synthetic_Rating")]
    columns.append((present / F.lit(len(values))).alias("Completeness_Score"))
    if OVERALL in rated:
        columns.append(F.col(OVERALL).alias("Overall_Value"))
    return ordinals.select(*columns)


def unmapped_codes(reviews: DataFrame) -> DataFrame:
    """Codes that are given but not on the scale, with the columns they occur in."""
    stacked = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column_name"), rating_code(F.col(c)).alias("code")) for c in INDICATORS])
    )
    codes = school_rows(reviews).select(stacked)
    return codes.where(F.col("code").isNotNull() & rating_value(F.col("code")).isNull()).distinct()


def rating_agreement(reviews: DataFrame, last_year: int = LAST_RATED_YEAR) -> DataFrame:
    """Pearson correlation of the overall rating with the mean indicator, one row."""
    both = rated_reviews(reviews).where(
        (F.col("School_Year") <= last_year) & F.col("Overall_Value").isNotNull() & F.col("Synthetic_Rating").isNotNull()
    )
    return both.agg(
        F.count(F.lit(1)).alias("review_count"), F.corr("Overall_Value", "Synthetic_Rating").alias("correlation")
    )


def grades(reviews: DataFrame, decay: float = DECAY, strict_years: bool = False) -> DataFrame:
    """Decayed mean rating per school. A school without any rated review gets no figures."""
    rows = rated_reviews(reviews, strict_years)
    rating = F.col("Synthetic_Rating")
    weight = F.when(rating.isNotNull(), F.pow(F.lit(decay), F.lit(ANCHOR_YEAR) - F.col("School_Year")))
    sums = rows.groupBy(SCHOOL).agg(
        F.count(rating).alias("_rated"),
        (F.sum(rating * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("_grade"),
        F.avg("Completeness_Score").alias("_completeness"),
        F.count(F.lit(1)).alias("_rows"),
        F.min("School_Year").alias("_first"),
        F.max("School_Year").alias("_last"),
    )

    def if_rated(name: str) -> Column:
        return F.when(F.col("_rated") > 0, F.col(name))

    return sums.where(F.col(SCHOOL).isNotNull()).select(
        SCHOOL,
        if_rated("_grade").alias("Final_Weighted_Grade"),
        if_rated("_completeness").alias("Average_Completeness_Score"),
        F.coalesce(if_rated("_rows"), F.lit(0)).cast("bigint").alias("Number_of_Years"),
        if_rated("_first").alias("Earliest_Year"),
        if_rated("_last").alias("Latest_Year"),
    )


def school_grades(
    reviews: DataFrame, lookup: DataFrame | None, decay: float = DECAY, lookup_order: Sequence[str] = ()
) -> DataFrame:
    """Grades with the school's name and place."""
    graded = grades(reviews, decay)
    if lookup is not None:
        lookup = keep_known(lookup, [*LOOKUP_COLUMNS, *lookup_order]).withColumnRenamed("location_code", SCHOOL)
    return order_columns(lookup_join(graded, lookup, SCHOOL, lookup_order), GRADE_COLUMNS)


def education_table(grade_table: DataFrame) -> DataFrame:
    """Grades in the layout of the other score tables, with coordinates in degrees."""
    renamed = grade_table.withColumnRenamed("Final_Weighted_Grade", "EducationScore")
    return order_columns(add_lonlat(renamed), EDUCATION_COLUMNS)
