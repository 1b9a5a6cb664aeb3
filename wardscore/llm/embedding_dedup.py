"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosines.

Every different vector stands in the list of its nearest centroid with the codes of its residual. It visits each other list
whose border is at most half the linking distance away. Of two linked vectors in different lists, the way between them
crosses the border, so one of them is within half that distance and visits the other: the probes suffice, no link is lost.
In a cell (part of a list), a visitor's table of distances gives its distance to every resident's code; the resident's own
coding error bounds how far that is off, and what the bound leaves is checked by exact cosine.

Links inside a group of near copies are counted in the tasks and leave them as a star per cell, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.components import connected_components, local_labels
from wardscore.llm.vectors import cell_parts, lengths, matrix, sample, unit, usable
from wardscore.operators.settle import land

SAMPLE = 20_000
MOST_LISTS = 1024
SUBSPACES, CODES = 8, 64
# Residents of a cell, and visitors of a cell for each of them.
BLOCK, VISITORS = 2048, 8
STEP = 512
LINKS = "rep long, links long, root long"


@dataclass
class Quantiser:
    """Centroids of the lists, and for each part of the components the codewords of the residuals."""

    centroids: np.ndarray
    parts: list[np.ndarray]
    words: list[np.ndarray]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its distance to the border of every list."""
        c = self.centroids
        far = (c * c).sum(axis=1) - 2 * x @ c.T
        home = far.argmin(axis=1)
        between = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 1e-300))
        border = (far - far[np.arange(len(x)), home][:, None]) / (2 * between[home])
        border[np.arange(len(x)), home] = 0
        return home, border

    def code(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distance of each to what its codes stand for."""
        codes = np.empty((len(residuals), len(self.parts)), np.uint8)
        lost = np.zeros(len(residuals))
        for m, (part, words) in enumerate(zip(self.parts, self.words, strict=True)):
            r = residuals[:, part]
            far = (words * words).sum(axis=1) - 2 * r @ words.T
            codes[:, m] = far.argmin(axis=1)
            lost += ((r - words[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(lost)

    def lookup(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of every residual (rows) to every code (columns), by one table per part."""
        total = np.zeros((len(residuals), len(codes)))
        for m, (part, words) in enumerate(zip(self.parts, self.words, strict=True)):
            r = residuals[:, part]
            table = (r * r).sum(axis=1)[:, None] + (words * words).sum(axis=1) - 2 * r @ words.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(centres)
        full = np.flatnonzero(count)
        sums[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(x: np.ndarray, n_lists: int) -> Quantiser:
    centroids = k_means(x, n_lists)
    home = ((centroids * centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
    residuals = x - centroids[home]
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    return Quantiser(centroids, parts, [k_means(residuals[:, p], CODES) for p in parts])


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, sample_size: int = SAMPLE
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept. Linked: cosine >= threshold, in double precision.

    n_links counts the other vectors linked directly, equal ones included; component_id is the smallest id reachable, kept
    tells that it is the row's own. A vector that is null, empty, zero, holds null or non-finite components, or has no id
    links with nothing and is kept; vectors of different lengths never link, each length has an index of its own. Rows that repeat id and vector count as so many vectors; an id
    with several different vectors stands for all of them. An empty table gives an empty one; other columns are not read.

    An index is fitted to at most ``sample_size`` vectors, those whose ids hash lowest, and holds every vector of its length.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    good = base.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    reps = good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = land(reps, "vectors")
    sizes = lengths(reps, "vector")
    if not sizes:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = [
        linked_of_length(reps.where(F.size("vector") == dim), dim, count, threshold, sample_size) for dim, count in sizes.items() if count > 1
    ]
    found = reduce(DataFrame.unionByName, linked or [spark.createDataFrame([], LINKS)])
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select("rep", "root"))
    told = reps.join(links, "rep", "left").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    told = told.select("vector", "rep", "n", "links", "component")
    # A row without an id must not meet its vector's class.
    seen = F.when(F.col("vec_id").isNotNull(), F.col("vector"))
    joined = base.withColumn("seen", seen).drop("vector").join(told, F.col("seen") == F.col("vector"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return joined.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def linked_of_length(reps: DataFrame, dim: int, count: int, threshold: float, sample_size: int) -> DataFrame:
    """(rep, links, root) of the linked ones of ``count`` different vectors of ``dim`` components; a rep may have several rows."""
    spark = reps.sparkSession
    lists = max(1, min(MOST_LISTS, round(count**0.5)))
    model = spark.sparkContext.broadcast(fit(sample(reps, "rep", "vector", dim, sample_size), lists))
    reach = float(np.sqrt(2 - 2 * threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = model.value
        for batch in batches:
            x = unit(matrix(batch.column("vector"), dim))
            home, border = quantiser.homes(x)
            codes, error = quantiser.code(x - quantiser.centroids[home])
            row, to = np.nonzero(border <= reach / 2 + 1e-9)
            away = to != home[row]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row[away], minlength=len(x)))]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(cuts), pa.array(to[away].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"), batch.column("n"), batch.column("vector"), pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), visits,
                ],
                names=["rep", "n", "vector", "home", "codes", "error", "visits"],
            )

    kind = reps.schema["vector"].dataType.simpleString()
    coded = reps.select("rep", "n", "vector").mapInArrow(
        place, f"rep long, n long, vector {kind}, home int, codes binary, error double, visits array<int>"
    )
    coded = land(coded, "codes")
    # As many rows as lists at most, so these may go to every task.
    residents = coded.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("residents"))
    visitors = coded.select(F.explode("visits").alias("list")).groupBy("list").agg(F.count("*").alias("visitors"))
    sizes = F.broadcast(
        residents.join(visitors, "list", "left").select(
            "list",
            F.ceil(F.col("residents") / BLOCK).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("visitors", F.lit(0)) / (BLOCK * VISITORS))).cast("int").alias("shares"),
        )
    )
    own = coded.withColumn("list", F.col("home")).join(sizes, "list")
    own = own.withColumn("own_block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    carried = ["rep", "n", "vector", "home", "codes", "error", "visits"]
    at_home = own.select(
        "list", F.col("own_block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.lit(0).alias("kind"), *carried,
    )
    # Blocks of one's own list: each pair of blocks meets once.
    next_door = own.where("own_block < blocks - 1").select(
        "list", F.explode(F.sequence(F.col("own_block") + 1, F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), *carried,
    )
    abroad = coded.select(F.explode("visits").alias("list"), *carried).join(sizes, "list")
    abroad = abroad.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), *carried,
    )
    cells = at_home.unionByName(next_door).unionByName(abroad).repartition("list", "block", "share")
    cells = cells.sortWithinPartitions("list", "block", "share", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = model.value
        cell, held, home_side = None, [], None
        for where, who, rows in cell_parts(batches, ["list", "block", "share"], "kind"):
            if where != cell:
                cell, held, home_side = where, [], None
            if who == 0:
                held.append(rows)
                home_side = None
                # All of a block's residents stand here before its first visitor; pairs among them count in one share only.
                if where[2] == 0:
                    before = _Side(held[:-1], dim, quantiser, where[0]) if len(held) > 1 else None
                    now = _Side(held[-1:], dim, quantiser, where[0])
                    yield from _linked(now, now, True, where[0], quantiser, reach, threshold)
                    if before is not None:
                        yield from _linked(now, before, False, where[0], quantiser, reach, threshold)
                continue
            if not held:
                continue
            home_side = home_side or _Side(held, dim, quantiser, where[0])
            yield from _linked(_Side([rows], dim, quantiser, where[0]), home_side, False, where[0], quantiser, reach, threshold)

    return land(cells.mapInArrow(meet, LINKS), "links")


class _Side:
    """Rows of one side of a cell as arrays."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, quantiser: Quantiser, at: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.rep, self.n = column("rep").to_numpy(), column("n").to_numpy()
        self.x = unit(matrix(column("vector"), dim))
        self.residual = self.x - quantiser.centroids[at]
        self.home, self.error = column("home").to_numpy(), column("error").to_numpy()
        self.codes = np.frombuffer(b"".join(column("codes").to_pylist()), np.uint8).reshape(len(self.rep), -1)
        visits = column("visits")
        counts = np.diff(visits.offsets.to_numpy())
        self.visits = np.zeros((len(self.rep), len(quantiser.centroids)), bool)
        self.visits[np.repeat(np.arange(len(counts)), counts), visits.flatten().to_numpy()] = True


def _linked(
    guests: _Side, hosts: _Side, same: bool, at: int, quantiser: Quantiser, reach: float, threshold: float
) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) of all rows linked between the sides; ``same``: among one side's own rows."""
    for first in range(0, len(guests.rep), STEP):
        part = slice(first, first + STEP)
        near = quantiser.lookup(guests.residual[part], hosts.codes) <= reach + hosts.error + 1e-6
        if same:
            near &= np.arange(len(hosts.rep)) > np.arange(first, min(first + STEP, len(guests.rep)))[:, None]
        else:
            # Two rows that visit each other's lists meet twice: only the smaller list counts.
            home = guests.home[part]
            near &= ~(hosts.visits[:, home].T & (at > home)[:, None])
        g, h = np.nonzero(near)
        sure = np.zeros(len(g), bool)
        for a in range(0, len(g), 65536):
            b = slice(a, a + 65536)
            sure[b] = np.einsum("ij,ij->i", guests.x[first + g[b]], hosts.x[h[b]]) >= threshold
        if not sure.any():
            continue
        g, h = first + g[sure], h[sure]
        reps, rank = np.unique(np.concatenate([guests.rep[g], hosts.rep[h]]), return_inverse=True)
        left, right = rank[: len(g)], rank[len(g) :]
        links = np.bincount(left, hosts.n[h], len(reps)) + np.bincount(right, guests.n[g], len(reps))
        root = reps[local_labels(len(reps), left, right)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(reps), pa.array(links.astype(np.int64)), pa.array(root)], names=["rep", "links", "root"]
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at cosine 0.95."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), both_ways AS (
  SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs
), reach AS (
  WITH RECURSIVE r AS (SELECT u AS node, v AS seen FROM both_ways UNION SELECT r.node, b.v FROM r JOIN both_ways b ON b.u = r.seen)
  SELECT node, min(least(node, seen)) AS low FROM r GROUP BY node
), counts AS (
  SELECT u, count(*) AS n FROM both_ways GROUP BY u
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(r.low, e.vec_id) AS component_id,
  coalesce(r.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN reach r ON r.node = e.vec_id
"""
