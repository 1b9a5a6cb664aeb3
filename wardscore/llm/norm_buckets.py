"""Exact top-k inner products by buckets of vectors of like length.

Vectors of one number of components whose lengths are within a ratio share a bucket; a large bucket is dealt out in blocks. The
longest vectors give each query a score that its k-th best reaches at least. A query visits only buckets whose longest vector can
still reach it. Inside a block, run by run from the longest on, that score over both lengths is the cosine a partner has to reach;
from it follow how many vectors are long enough and which range a partner's strongest components must lie in. Whichever leaves
less to verify is used, run by run and query by query, and the score rises as products are found. All products are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.llm.text_bytes import small_batches
from wardscore.llm.vectors import cell_parts
from wardscore.operators.settle import broadcast_if, land
from wardscore.operators.tables import col

K, SCALE = 20, 64
# Lengths within a bucket differ by less than this ratio; rows of a block and of a run inside it; queries that meet a block at once.
RATIO, BLOCK, RUN, SHARE = 0.95, 32_768, 2_048, 131_072
BUCKET_BYTES = 128
# The longest rows that thresholds start from.
HEAD = 1_024
# Components looked at per query, and how much dearer a vector fetched by its component is than the next one by length.
FOCUS, FETCH = 3, 16
# Lengths are doubles: what is within this share of a bound is verified.
SLACK = 1e-9
# Products stay below 2 ** 62 if all lengths do below 2 ** 31; below 2 ** 53 doubles hold them exactly.
LONGEST, EXACT = 2.0**31, 2.0**53
CELL = ["dim", "bucket", "part", "share"]
LAST = np.iinfo(np.int64).max

Batches = Iterator[pa.RecordBatch]


def whole_components(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component, in doubles; null where the vector is null or holds a null or non-finite component.

    Vectors of length 2 ** 31 or more after scaling are null too, as their products would not fit a long.
    """
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LONGEST / 2))
    floored = F.when(F.coalesce(fine, F.lit(False)), F.transform(scaled, lambda x: F.floor(x).cast("int")))
    return F.when(length_of(floored) < LONGEST, floored)


def length_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def search(
    rows: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "vector", block: int = BLOCK, head: int = HEAD
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` the ``k`` rows of largest inner product.

    ``vector`` holds ints, as ``whole_components`` makes them. Every row but the query's own is a candidate, if it has as many
    components; the product of two vectors without components is 0. Largest first, ties to the smaller id, rows without an id
    last; fewer than ``k`` candidates are all given. Rows that repeat an id are queries and candidates each for itself. Null
    vectors take no part; an empty table gives an empty one; other columns are not read.
    """
    small_batches(rows.sparkSession)
    kept = rows.select(col(key).cast("long").alias("vec_id"), col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kept = kept.where(F.col("vector").isNotNull()).withColumns({"row": F.monotonically_increasing_id(), "length": length_of(F.col("vector"))})
    step = F.floor(F.log(F.col("length")) / F.lit(-float(np.log(RATIO)))).cast("long")
    kept = kept.withColumns({"dim": F.size("vector").cast("long"), "bucket": F.when(F.col("length") > 0, step).otherwise(F.lit(-1 << 20))})
    # Written once: later passes must see a row under the same number.
    kept = land(kept, "lengths")
    order = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    # Of equal vectors no more than k + 1 can be needed, the first ones, as one may be the query.
    firsts = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place", "asks")
    firsts = land(firsts, "candidates")
    queries = kept.where("asks").select("row", "vec_id", "vector", "length", "dim")

    n_queries = queries.count()
    shares = max(1, -(-n_queries // SHARE))
    longest = Window.partitionBy("dim").orderBy(F.desc("length"), "row")
    heads = firsts.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= head)
    heads = heads.withColumns({"bucket": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    share = F.pmod(F.xxhash64("row"), F.lit(shares))
    first_visits = queries.withColumns({"bucket": F.lit(0).cast("long"), "part": F.lit(0).cast("long"), "share": share, "least": F.lit(None).cast("double")})
    hits = _met(heads, first_visits, shares, k)
    reached = hits.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
    started = land(queries.join(reached, queries["row"] == reached["query"], "left").drop("query"), "thresholds")

    # One row a bucket: some hundreds for each number of components.
    buckets = firsts.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    buckets = land(buckets.withColumn("parts", F.ceil(F.col("n") / F.lit(block))).drop("n"), "buckets")
    buckets = broadcast_if(buckets, buckets.count() * BUCKET_BYTES)
    # A threshold that is not positive bars no vector.
    can = F.col("least").isNull() | (F.col("least") <= 0) | (F.col("least") <= F.col("length") * F.col("longest") * (1 + SLACK))
    visits = started.join(buckets, "dim").where(can).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.withColumn("share", share).select("row", "vec_id", "vector", "length", "dim", "bucket", "part", "share", "least")
    residents = firsts.join(buckets.drop("longest"), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "partner")
    ranked = _met(residents, visits, shares, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _met(residents: DataFrame, visits: DataFrame, shares: int, k: int) -> DataFrame:
    """(query, query_id, partner, vec_id, score): the ``k`` best of each block for each of its visitors that reach ``least``."""
    columns = [*CELL, "kind", "row", "vec_id", "vector", "length", "least"]
    there = residents.withColumns(
        {"share": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))), "kind": F.lit(0), "least": F.lit(None).cast("double")}
    )
    cells = there.select(*columns).unionByName(visits.withColumn("kind", F.lit(1)).select(*columns))
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL, "kind")

    def meet(batches: Batches) -> Batches:
        cell, held, block = None, [], None
        for where, kind, part in cell_parts(batches, CELL, "kind"):
            if where != cell:
                cell, held, block = where, [], None
            if kind == 0:
                held.append(part)
            elif held:
                block = block or Block(held, where[0])
                yield block.answer(part, k)

    return cells.mapInArrow(meet, "query long, query_id long, partner long, vec_id long, score long")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Run:
    """Some vectors of like length, longest first, with each component's values in order."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, first: int) -> None:
        self.x, self.lengths, self.first = x, lengths, first
        unit = x / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.values = np.take_along_axis(unit, self.order, axis=0)
        self.unit = unit

    def ranges(self, unit: np.ndarray, cosine: np.ndarray, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and focus component: the range of a partner's component, given the cosine to reach."""
        own = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        far = np.arccos(np.clip(cosine, -1, 1))[:, None]
        low = np.where(own + far >= np.pi, -1.0, np.cos(np.minimum(own + far, np.pi)))
        high = np.where(own <= far, 1.0, np.cos(np.maximum(own - far, 0)))
        return low - SLACK, high + SLACK


class Block:
    """The vectors of a cell in runs of falling length."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        lengths = table.column("length").to_numpy()
        by_length = np.argsort(-lengths, kind="stable")
        x = _matrix(table.column("vector").combine_chunks(), dim)[by_length]
        self.dim, self.n, lengths = dim, len(x), lengths[by_length]
        self.rows = table.column("row").to_numpy()[by_length]
        ids = table.column("vec_id").combine_chunks().take(pa.array(by_length))
        self.ids, known = ids, ids.fill_null(LAST).to_numpy()
        # Place of each row in the order that decides ties: by id, then row.
        self.tie = np.empty(self.n, np.int64)
        self.tie[np.lexsort((self.rows, known, ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(self.n)
        self.runs = [Run(x[a : a + RUN], lengths[a : a + RUN], a) for a in range(0, self.n, RUN)]

    def answer(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        q, lengths = _matrix(batch.column("vector"), self.dim), batch.column("length").to_numpy()
        rows = batch.column("row").to_numpy()
        least = batch.column("least").fill_null(-np.inf).to_numpy().copy()
        unit = q / np.where(lengths > 0, lengths, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        # Found so far: query, row of the block, score.
        who, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for run in self.runs:
            found = list(self._verified(run, q, unit, lengths, least, focus, rows, k))
            if not found:
                continue
            who, at, score = (np.concatenate([old, *new]) for old, new in zip((who, at, score), zip(*found, strict=True), strict=True))
            in_order = np.lexsort((self.tie[at], -score, who))
            who, at, score = who[in_order], at[in_order], score[in_order]
            starts = np.searchsorted(who, np.arange(len(q)))
            place = np.arange(len(who)) - starts[who]
            keep = place < k
            last = place == k - 1
            least[who[last]] = np.maximum(least[who[last]], score[last].astype(np.float64))
            who, at, score = who[keep], at[keep], score[keep]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows[who]), batch.column("vec_id").take(pa.array(who)), pa.array(self.rows[at]),
                self.ids.take(pa.array(at)), pa.array(score),
            ],
            names=["query", "query_id", "partner", "vec_id", "score"],
        )

    def _verified(self, run: Run, q, unit, lengths, least, focus, rows, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row of the block, score) of the pairs of a run that reach the query's least score."""
        n = len(run.x)
        bars = least > 0
        reach = lengths * run.lengths[0]
        open_ = np.flatnonzero(~bars | (least <= reach * (1 + SLACK)))
        if not len(open_):
            return
        # Vectors that are long enough, the longest ones.
        short = np.where(bars, least / np.maximum(lengths, 1e-300), 0)[open_] * (1 - SLACK)
        by_length = np.searchsorted(-run.lengths, -short, side="right")
        by_length[~bars[open_]] = n
        # Vectors whose component lies in the range that the cosine allows, by the component that leaves fewest.
        with_bar = np.flatnonzero(bars[open_]) if self.dim else np.zeros(0, np.int64)
        fetched = np.zeros(len(open_), bool)
        if len(with_bar):
            some = open_[with_bar]
            low, high = run.ranges(unit[some], least[some] / reach[some] * (1 - SLACK), focus[some])
            begin, end = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
            for f in np.unique(focus[some]).tolist():
                here = focus[some] == f
                begin[here] = np.searchsorted(run.values[:, f], low[here], side="left")
                end[here] = np.searchsorted(run.values[:, f], high[here], side="right")
            narrow = (end - begin).argmin(axis=1)
            at = np.arange(len(some))
            count = (end - begin)[at, narrow]
            use = np.flatnonzero(count * FETCH < by_length[with_bar])
            fetched[with_bar[use]] = True
            for i in use.tolist():
                query, f = int(some[i]), int(focus[some[i], narrow[i]])
                picked = run.order[begin[i, narrow[i]] : end[i, narrow[i]], f]
                for j in range(focus.shape[1]):
                    values = run.unit[picked, focus[query, j]]
                    picked = picked[(values >= low[i, j]) & (values <= high[i, j])]
                picked = picked[picked < by_length[with_bar[i]]]
                if len(picked):
                    products = self._products(run.x[picked], q[query : query + 1], run.lengths[0] * lengths[query])[0]
                    good = (products >= least[query]) & (self.rows[run.first + picked] != rows[query])
                    yield np.full(int(good.sum()), query), run.first + picked[good], products[good].astype(np.int64)
        plain = open_[~fetched]
        wide = int(by_length[~fetched].max(initial=0))
        if not wide or not len(plain):
            return
        products = self._products(run.x[:wide], q[plain], float(reach[plain].max()))
        good = products >= least[plain][:, None]
        good &= self.rows[None, run.first : run.first + wide] != rows[plain][:, None]
        if wide > k + 1:
            # One of the k + 1 largest may be the query itself.
            good &= products >= np.partition(products, wide - k - 1, axis=1)[:, wide - k - 1 : wide - k]
        i, j = np.nonzero(good)
        yield plain[i], run.first + j, products[i, j].astype(np.int64)

    @staticmethod
    def _products(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
        """Queries by rows. Doubles are exact as long as no product can pass 2 ** 53, else longs."""
        if largest < EXACT / 2:
            return q @ x.T
        return q.astype(np.int64) @ x.astype(np.int64).T


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest products of every embedding whose id is divisible by 20, components in 64ths."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("vector", whole_components(F.col("embedding")))
    return search(rows, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.place AS query, q.vec_id AS query_id, c.place AS partner, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.place <> c.place AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, partner)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
