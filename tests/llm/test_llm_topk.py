"""Exact products against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardscore.llm import norm_buckets as N


def brute(rows, k, asks):
    kept = [(place, key, x) for place, (key, x) in enumerate(rows) if x is not None]
    out = []
    for place, key, q in kept:
        if key is None or not asks(key):
            continue
        found = [(-sum(a * b for a, b in zip(q, x)), other is None, other or 0, p, other) for p, other, x in kept if p != place and len(x) == len(q)]
        out += [(key, rank + 1, f[4], -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, rows, k, asks="vec_id % 5 = 0", **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, vector array<int>, score string").repartition(3)
    return sorted((tuple(r) for r in N.search(frame, F.expr(asks), k, **options).collect()), key=str)


def planted(seed, n=400, dim=8, spread=40.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) * np.exp(draw.normal(size=(n, 1))) * spread
    x[50:120] = x[50]
    x[130:160] = x[131] + draw.normal(size=(30, dim))
    x[170] = 0
    return [(i, [int(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("k", [1, 4, 30])
@pytest.mark.parametrize("seed,spread,sizes", [(1, 40.0, (64, 16, 32)), (2, 1.0, (32_768, 2_048, 1_024)), (3, 1e6, (64, 8, 8))])
def test_equals_all_pairs(spark, monkeypatch, k, seed, spread, sizes):
    monkeypatch.setattr(N, "RUN", sizes[1])
    monkeypatch.setattr(N, "SHARE", 40)
    rows = planted(seed, spread=spread)
    assert run(spark, rows, k, block=sizes[0], head=sizes[2]) == brute(rows, k, lambda i: i % 5 == 0)


@pytest.mark.parametrize("fetch", [0, 1e9])
def test_both_ways_of_pruning(spark, monkeypatch, fetch):
    monkeypatch.setattr(N, "FETCH", fetch)
    monkeypatch.setattr(N, "RUN", 32)
    rows = planted(4)
    assert run(spark, rows, 5, head=64) == brute(rows, 5, lambda i: i % 5 == 0)


def test_products_beyond_doubles(spark):
    big = 2**30 - 1
    rows = [(i, [big, big - i, i]) for i in range(12)] + [(20, [-big, 1, 1]), (25, [1, 0, 0])]
    assert run(spark, rows, 6) == brute(rows, 6, lambda i: i % 5 == 0)


def test_repeats_missing_ids_and_lengths(spark):
    rows = [(5, [1, 2]), (5, [1, 2]), (None, [3, 3]), (10, [1, 2, 3]), (15, []), (20, []), (7, None), (3, [0, 0]), (25, [0, 0]), (30, [9])]
    want = brute(rows, 3, lambda i: i % 5 == 0)
    assert run(spark, rows, 3) == want
    assert (30, 1, None, None) not in want and not any(r[0] == 30 for r in want)
    assert run(spark, rows[:0] + [(1, [1])], 3) == []
    empty = spark.createDataFrame([], "vec_id long, vector array<int>")
    assert N.search(empty, F.lit(True)).count() == 0


def test_whole_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, None), (2, [1.0, None]), (3, [nan]), (4, [inf]), (5, []), (6, [3e38]), (7, [2.0**25, 0.0]), (8, [2.0**23] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, e array<float>")
    got = {r[0]: r[1] for r in frame.select("vec_id", N.whole_components(F.col("e"))).collect()}
    assert got == {0: [32, -1], 1: None, 2: None, 3: None, 4: None, 5: [], 6: None, 7: None, 8: [2**29] * 4}


def test_given_vectors(spark, sf_dir):
    rows = [(r[0], [int(np.floor(64 * float(x))) for x in r[1]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in N.query(spark, sf_dir).collect()), key=str)
    assert got == brute(rows, 20, lambda i: i % 20 == 0)
