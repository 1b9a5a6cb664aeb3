"""What the vector operators share: which vectors count, a bounded sample, and cells of residents met by visitors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths(rows: DataFrame, vector: str) -> dict[int, int]:
    """The lengths of the vectors and how many rows have each; vectors of different lengths have no cosine."""
    return {r["size"]: r["count"] for r in rows.groupBy(F.size(vector).alias("size")).count().orderBy("size").collect()}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: the square of a very small or large component would not be a number.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(rows: DataFrame, key: str, vector: str, dim: int, size: int) -> np.ndarray:
    """Unit vectors of at most ``size`` rows, those with the smallest hashes of the key."""
    picked = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(size).toArrow()
    x = unit(matrix(picked.column(vector).combine_chunks(), dim)) if picked.num_rows else np.zeros((0, dim))
    return x


def cell_parts(batches: Iterator[pa.RecordBatch], keys: list[str], kind: str) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """The slices of equal cell and kind of sorted batches; a cell may go on in the next slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in [*keys, kind]])
        cuts = np.concatenate([[0], np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield tuple(columns[:-1, a].tolist()), int(columns[-1, a]), batch.slice(a, b - a)
