r"""GeoJSON FeatureCollections cut at feature borders, so that many tasks read one file.

Spark's text reader splits a file into byte ranges and cuts it at every opening brace. Which braces open an object depends on all
text before: an odd number of quotes means the brace stands inside a string. So do the nesting of objects and arrays. All three
are running sums, taken inside a byte range by one window and carried over by the sums of the ranges before, of which a file has
few. A feature is an object right inside an array right inside the collection; its fragments are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.operators.settle import land

PLACE = ["_file", "_block", "_at"]


def with_place(rows: DataFrame) -> DataFrame:
    """Adds _file, _block (where the byte range begins) and _at (order within it) to rows of a file scan."""
    return rows.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )


def running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds for each named number the sum over all rows of the file before this one.

    A byte range is one task's, as it was for the scan; the sums of the ranges are one row each.
    """
    before_range = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_file", "_block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = ranges.select("_file", "_block", *[F.coalesce(F.sum(n).over(before_range), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({f"_r_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    total = placed.join(starts, ["_file", "_block"])
    return total.withColumns({n: F.col(f"_s_{n}") + F.col(f"_r_{n}") for n in sums}).drop(*[f"_{k}_{n}" for k in "sr" for n in sums])


def file_numbers(rows: DataFrame) -> DataFrame:
    """(_file, _number): files by their paths; there are few."""
    return rows.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("bigint"))


def in_file_order(rows: DataFrame, place: Column) -> DataFrame:
    """Adds file_order from a row's place in its file: the file's number in the upper bits."""
    return rows.join(file_numbers(rows), "_file").withColumn("file_order", F.shiftleft(F.col("_number"), 33) + place).drop("_number")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_order and value of every line that is not blank."""
    lines = land(with_place(spark.read.text(path)).where(F.length(F.trim("value")) > 0), "lines")
    counted = running(lines, {"_before": F.lit(1).cast("bigint")})
    return in_file_order(counted, F.col("_before") + 1).select("file_order", "value")


def _outside(text: str, starts_in_string: bool) -> str:
    """SQL of the text without its strings; escapes have been taken out."""
    head = f"regexp_replace({text}, '^[^\"]*(\"|$)', '')" if starts_in_string else text
    return f"regexp_replace({head}, '\"[^\"]*(\"|$)', '')"


def _count(text: str, sign: str) -> str:
    return f"(length({text}) - length(replace({text}, '{sign}', '')))"


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """The text between opening braces, with what it counts if it begins outside (0) or inside (1) a string."""
    pieces = with_place(spark.read.option("lineSep", "{").text(path)).withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))
    pieces = pieces.withColumns({f"_out{i}": F.expr(_outside("_plain", bool(i))) for i in (0, 1)})
    counts = {f"_{n}{i}": F.expr(_count(f"_out{i}", sign)) for n, sign in (("shut", "}"), ("open", "["), ("close", "]")) for i in (0, 1)}
    # Written once: later passes read the counts without the texts.
    return land(pieces.withColumns({"_quotes": F.expr(_count("_plain", '"')), **counts}).drop("_plain", "_out0", "_out1"), "fragments")


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """file_order, crs (text of the collection's reference system or NULL) and value (text of the feature) of every feature.

    Works on any valid FeatureCollection, whatever its white space. A reference system has to stand before the features, as
    writers put it; one after them is refused. What is no object with type Feature, right inside an array of the collection, is
    left out.
    """
    rows = running(fragments(spark, path), {"_quoted": F.col("_quotes")})
    state = (F.col("_quoted") % 2).cast("int")
    pick = lambda n: F.when(state == 0, F.col(f"_{n}0")).otherwise(F.col(f"_{n}1"))
    # All fragments but a file's first follow a brace.
    first = (F.col("_block") == 0) & (F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) == 1)
    rows = rows.withColumn("_first", first).withColumn("_starts", ((state == 0) & ~F.col("_first")).cast("int"))
    rows = rows.select(*PLACE, "value", "_first", "_starts", pick("shut").alias("_shut"), (pick("open") - pick("close")).alias("_arrays"))
    rows = running(rows, {"_deep": F.col("_starts") - F.col("_shut"), "_listed": F.col("_arrays")})
    # The brace itself counts: a feature's brace opens the second object, in the first array.
    begins = (F.col("_starts") == 1) & (F.col("_deep") == 1) & (F.col("_listed") == 1)
    late = (F.col("_starts") == 1) & (F.col("_deep") == 1) & (F.col("_listed") == 0)
    rows = running(rows.withColumns({"_begins": begins.cast("bigint"), "_late": late}), {"_before": F.col("_begins")})
    rows = rows.withColumn("_no", F.col("_before") + F.col("_begins"))
    text = F.when(F.col("_first"), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value")))
    piece = F.struct("_block", "_at", text.alias("text"))
    whole = rows.groupBy("_file", "_no").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"), F.max(F.col("_late") & (F.col("_no") > 0)).alias("_late"))
    whole = land(whole.select("_file", "_no", "_late", F.expr("concat_ws('', transform(_pieces, p -> p.text))").alias("value")), "features")
    crs = F.regexp_extract("value", r'(?s)"crs"\s*:\s*(\{.*\}|null|"[^"]*")', 1)
    heads = whole.where("_no = 0").select("_file", F.nullif(crs, F.lit("")).alias("crs"))
    refused = F.raise_error(F.lit("a reference system after the features is not read")).cast("string")
    features = whole.where("_no > 0").withColumn("value", F.when(F.col("_late") & F.col("value").rlike(r'(?s)\}.*\].*"crs"\s*:'), refused).otherwise(F.col("value")))
    return in_file_order(features.join(heads, "_file", "left"), F.col("_no")).select("file_order", "crs", "value")

