"""Texts of an Arrow batch as one byte array: word bounds and 64-bit hashes of many slices at once, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Bytes of text that are hashed in one piece; a longer text makes a longer piece.
PIECE_BYTES = 1 << 19
# Fixed odd multipliers; any would do.
STEP, STIR = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """No more than ``rows`` whole texts in an Arrow batch: 10,000 long ones would not fit a task. Results do not change."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more: the end). Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each; always whole texts."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = last


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes other than ASCII white space, and each word's text."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = ~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))
    stops = ~space & (edge[1:] | np.concatenate([space[1:], [True]]))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step, back = U64(STEP), U64(pow(STEP, -1, 1 << 64))
    with np.errstate(over="ignore"):
        one = np.ones(1, U64)
        return tuple(np.concatenate([one, np.multiply.accumulate(np.full(n, x, U64))]) for x in (step, back))


def stirred(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(STIR)
        h = (h ^ (h >> U64(29))) * U64(STEP)
        return h ^ (h >> U64(32))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice's bytes, the same wherever the slice stands."""
    n = 1 << max(16, int(len(data)).bit_length())
    forward, backward = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * forward[: len(data)], out=sums[1:])
        return stirred((sums[ends] - sums[starts]) * backward[starts] + (ends - starts).astype(U64) * U64(STIR))


def array_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text."""
    data, bounds = flat(texts)
    out = np.zeros(len(bounds) - 1, U64)
    for a, b in pieces(bounds):
        at = bounds[a : b + 1] - bounds[a]
        out[a:b] = slice_hashes(data[bounds[a] : bounds[b]], at[:-1], at[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
