"""Connected components of a large graph, without holding a node's neighbours or a component in one task.

Rounds of large-star and small-star: every node's neighbours are hung below its smallest neighbour until each component is
one star. A round needs only the minimum per node, which is combined before the shuffle, and joins on the node, whose hot
keys Spark may split. Each round is written to the shared folder, so a lost executor costs no more than its round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscore.operators.settle import land


class Forest:
    """Union-find over hashable ids that keeps the smallest id as the root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, x, y) -> bool:
        """Join two trees; False if they were one already."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        return True

    def edges(self) -> list[tuple]:
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def local_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1: the smallest node each is linked with over the given edges."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: as connected as before, and at most one edge per node."""
    for batch in batches:
        ids = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, at = np.unique(ids, return_inverse=True)
        half = len(at) // 2
        root = local_labels(len(nodes), at[:half], at[half:])
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def connected_components(edges: DataFrame, thin: bool = True) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    ``edges`` has two long columns. Edges with a null end are left out; loops, repeats and both directions are fine. A
    node met on loops only is not in the result. No edges give an empty table. ``thin`` first makes
    stars of each batch of edges; edges that are such already need no further pass through Python.
    """
    left, right = edges.columns
    pairs = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    pairs = pairs.mapInArrow(_thin, "u long, v long") if thin else pairs
    pairs = land(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = land(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # A star forest does not change any more; equal counts and sums tell that it did not.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # Every node of a star but its root stands once on the left.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
