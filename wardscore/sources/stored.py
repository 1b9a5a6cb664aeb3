"""Stored views by area: tables bucketed and sorted by a key, so that lookups read one bucket and joins on the key move nothing.

The layout is stored beside the data, so that another session, whose catalog does not know the table, opens it the same way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.operators.tables import q, require_columns

BUCKETS = 16
LAYOUT = "_layout"


def store(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write a table bucketed by ``key`` and open it. Tables that are joined with each other need the same ``buckets``.

    Rows are brought together by bucket first, so each bucket is one file, whatever the number of tasks. An existing table is
    replaced, and until then its layout is gone, so that a reader never takes a half written one for whole.
    """
    require_columns(df, [key])
    spark = df.sparkSession
    _drop_layout(spark, path)
    name = _fresh_name()
    by_bucket = df.repartition(buckets, F.col(q(key)))
    by_bucket.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    layout = json.dumps({"key": key, "buckets": buckets, "schema": df.schema.json()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")
    return open_stored(spark, path)


def open_stored(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``store`` wrote, with its buckets known to the planner."""
    layout = json.loads(spark.read.text(f"{path}/{LAYOUT}").first()["value"])
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(layout["schema"]))
    columns = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    name, key = _fresh_name(), q(layout["key"])
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {layout['buckets']} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def star_join(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """``first`` with each of the others, left joined on the key they are all bucketed by."""
    joined = first
    for other in others:
        joined = joined.join(other.hint("merge"), key, "left")
    return joined


def lookup(stored: DataFrame, key: str, value: str | Column) -> DataFrame:
    """The rows of one key; only its bucket is read."""
    return stored.where(F.col(q(key)) == (F.lit(value) if isinstance(value, str) else value))


def _fresh_name() -> str:
    return f"stored_{uuid.uuid4().hex}"


def _drop_layout(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
