"""Sharding by rendezvous hashing: a record goes to the shard that scores highest for its key.

The score of (key, shard) is -weight / ln(u), with u a hash of both in (0, 1): a shard gets records in proportion to its
weight, and a new shard only takes records into itself, as the other scores stay. The law is ``key``: the key and the shard
list alone decide, so equal keys share a shard, and a third of all rows under one key do too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.operators.settle import land

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard for a key; ties go to the smaller number. A null key is a key like any other."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    scored = [
        # The upper 53 bits as a number inside (0, 1); a null key leaves the hash of the shard's number.
        F.struct(
            (
                F.lit(float(w))
                / -F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(2.0**53))
            ).alias("score"),
            F.lit(-shard).alias("order"),
        )
        for shard, w in enumerate(weights)
    ]
    return (-F.greatest(*scored)["order"]).cast("int") if len(scored) > 1 else F.lit(0)


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0
) -> DataFrame:
    """One row per row of ``docs``: its key, size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty, in size and in text_crc32. slot numbers the rows of a
    shard from 0 without gaps; which of several equal rows gets which slot does not matter, as they are equal. grown_shard is
    the shard with one more shard of weight ``grown``. Null and repeated keys are sharded like others, an empty table gives
    an empty one, other columns are not read.
    """
    name = docs.columns[[c.lower() for c in docs.columns].index(key.lower())]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(name).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    ).select(
        "*",
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown]).alias("grown_shard"),
    )
    # Written once: slots are counted and dealt in two passes, which must see the same places.
    rows = land(rows, "shards")
    # A row's slot is its place among the shard's rows of its part, after all the earlier parts. A part is what one task
    # read, so no group outgrows a task; the table of counts has shards x parts rows.
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("place")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "part"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"),
        "grown_shard",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
