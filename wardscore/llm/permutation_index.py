"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors are posted in the inverted files of these pivots, per block
of rows; a query reads the files of its own pivots, which gives the footrule distance of its order to that of every row of
the block. The share of the block with the smallest distances is reranked by exact cosine, and the best of all blocks stay.
As every block gives the same share, recall does not fall as the table grows. Equal vectors are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.llm.vectors import cell_parts, lengths, matrix, sample, unit, usable
from wardscore.operators.settle import land

PIVOTS, NEAREST = 256, 128
# Share of a block that is reranked, and its least number of rows; all rows within this share of the largest footrule
# distance are reranked whatever their number, as in a crowd of near copies the order tells little.
DEPTH, LEAST_DEPTH = 0.08, 64
CROWD = 0.25
BLOCK, QUERIES = 4096, 512
# Rows the pivots are chosen from, and the largest cosine between two pivots as long as there are others.
SAMPLE, ALIKE = 4096, 0.7


def apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, in order, no two of them alike: copies as pivots would only repeat each other's place."""
    chosen, rest = [], []
    for i in range(len(x)):
        if len(chosen) == n:
            break
        (rest if chosen and (x[chosen] @ x[i]).max() > ALIKE else chosen).append(i)
    return x[(chosen + rest)[:n]]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
    depth: float = DEPTH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors`` by cosine.

    The query's own id is no candidate. Nearest first, ties by the smaller id; fewer candidates than ``k`` are all given.
    The score is the cosine in double precision of the original vectors. Vectors that are null, empty, zero, hold null or
    non-finite components or have no id take no part; a query's candidates are the vectors of its length. Rows that repeat id
    and vector are one candidate and one query. An id with several vectors is a candidate with each of them, so it can take
    several ranks; as a query it has the nearest of all its vectors' neighbours. Empty tables give an empty one; other columns are not read.

    The pivots of each length are taken from the SAMPLE rows whose ids hash lowest; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    asked = queries.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows, asked = (t.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()) for t in (rows, asked))
    # No more than k + 1 equal vectors can be among the k nearest: those with the smallest ids, and one may be the query.
    order = Window.partitionBy("vector").orderBy("vec_id")
    firsts = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    firsts = firsts.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    firsts = land(firsts, "vectors")
    counts = lengths(firsts, "vector")
    asked_once = land(asked.groupBy("vector").agg(F.min("vec_id").alias("query")), "queries")
    wanted = {dim: n for dim, n in lengths(asked_once, "vector").items() if dim in counts}
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = []
    for dim, n in wanted.items():
        same = F.size("vector") == dim
        found.append(hits_of_length(firsts.where(same), asked_once.where(same), dim, counts[dim], n, k, pivots, nearest, depth))
    hits = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("query", "dim").orderBy(F.desc("score"), F.element_at("ids", 1))
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    hits = hits.select("query", "dim", "score", F.explode("ids").alias("vec_id"))
    # Each query's row meets the answers of its vector.
    ids = asked.select(F.col("vec_id").alias("query_id"), "vector").distinct().join(asked_once, "vector")
    ids = ids.select("query_id", "query", F.size("vector").alias("dim"))
    pairs = ids.join(hits, ["query", "dim"]).where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def hits_of_length(
    firsts: DataFrame, asked_once: DataFrame, dim: int, count: int, n_queries: int, k: int, pivots: int, nearest: int, depth: float
) -> DataFrame:
    """(query, dim, score, ids): of ``count`` vectors of ``dim`` components the best of every block for each of ``n_queries``."""
    spark = firsts.sparkSession
    kind = firsts.schema["vector"].dataType.simpleString()
    some = sample(firsts.select(F.element_at("ids", 1).alias("id"), "vector"), "id", "vector", dim, SAMPLE)
    chosen = apart(some, pivots)
    pivot = spark.sparkContext.broadcast(chosen)
    length = min(nearest, len(chosen))

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = unit(matrix(batch.column("vector"), dim)) @ pivot.value.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :length].astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([o.tobytes() for o in order], pa.binary())],
                names=["ids", "vector", "order"],
            )

    blocks, shares = -(-count // BLOCK), -(-n_queries // QUERIES)
    as_row = f"ids array<long>, vector {kind}, order binary"
    posted = firsts.select("ids", "vector").mapInArrow(orders, as_row)
    posted = posted.select(
        F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "ids", "vector", "order",
    )
    asking = asked_once.select(F.array("query").alias("ids"), "vector").mapInArrow(orders, as_row)
    asking = asking.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shares)).cast("int").alias("share"),
        F.lit(1).alias("kind"), "ids", "vector", "order",
    )
    cells = posted.unionByName(asking).repartition("block", "share").sortWithinPartitions("block", "share", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, files = None, [], None
        for where, who, part in cell_parts(batches, ["block", "share"], "kind"):
            if where != cell:
                cell, held, files = where, [], None
            if who == 0:
                held.append(part)
                continue
            if held:
                files = files or InvertedFiles(held, dim, length, len(pivot.value))
                yield files.answer(part, dim, length, k + 1, max(LEAST_DEPTH, int(np.ceil(depth * files.n))))

    hits = cells.mapInArrow(meet, "query long, score double, ids array<long>")
    return hits.select("query", F.lit(dim).alias("dim"), "score", "ids")


class InvertedFiles:
    """A block's rows under their pivots. A file holds for every row how far before the end of its order the pivot stands.

    For two orders of the same length L, the footrule distance with absent pivots at place L is
    L * (L + 1) - 2 * the sum over shared pivots of the smaller of both values, so the largest sums are the nearest.
    """

    def __init__(self, batches: list[pa.RecordBatch], dim: int, length: int, pivots: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
        # In the order of the ids, so that ties fall to the smaller one.
        by_id = np.argsort(first, kind="stable")
        table = table.take(pa.array(by_id)).combine_chunks()
        self.n, self.ids = table.num_rows, table.column("ids").combine_chunks()
        self.x = unit(matrix(table.column("vector").combine_chunks(), dim))
        order = np.frombuffer(b"".join(table.column("order").to_pylist()), np.int16).reshape(self.n, length)
        self.files = np.zeros((pivots, self.n), np.int16)
        self.files[order, np.arange(self.n)[:, None]] = length - np.arange(length, dtype=np.int16)

    def answer(self, rows: pa.RecordBatch, dim: int, length: int, k: int, depth: int) -> pa.RecordBatch:
        asked = rows.column("ids").flatten().to_numpy()
        x = unit(matrix(rows.column("vector"), dim))
        order = np.frombuffer(b"".join(rows.column("order").to_pylist()), np.int16).reshape(len(asked), length)
        weight = (length - np.arange(length, dtype=np.int16))[:, None]
        most = length * (length + 1) // 2
        queries, scores, picked = [], [], []
        for i in range(len(asked)):
            shared = np.minimum(self.files[order[i]], weight).sum(axis=0, dtype=np.int64)
            key = shared * self.n - np.arange(self.n)
            some = np.argpartition(-key, depth - 1)[:depth] if depth < self.n else np.arange(self.n)
            crowd = np.flatnonzero(shared >= (1 - CROWD) * most)
            some = np.union1d(some, crowd) if len(crowd) else some
            cosine = np.einsum("ij,j->i", self.x[some], x[i])
            top = np.lexsort((some, -cosine))[:k]
            queries.append(np.full(len(top), asked[i]))
            scores.append(cosine[top])
            picked.append(some[top])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(queries)),
                pa.array(np.concatenate(scores)),
                self.ids.take(pa.array(np.concatenate(picked))),
            ],
            names=["query", "score", "ids"],
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every embedding whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
