"""Vector operators against all pairs."""

import numpy as np
import pytest

from wardscore.llm import embedding_dedup, permutation_index


def planted(n=700, dim=24, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    x[100:180] = x[100] + 0.05 * draw.normal(size=(80, dim))
    x[200:240] = x[200]
    for i in range(300, 340):
        x[i + 100] = x[i] + 0.2 * draw.normal(size=dim)
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


ODD = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] * 24), (1005, [1.0, 2.0]), (1006, [float("inf")] * 24)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, rep string, n int")


def brute(rows, threshold):
    ids = [i for i, _ in rows]
    x = np.array([r for _, r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(near[k].sum()) - 1, ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)}
        label = new


@pytest.mark.parametrize("block", [None, 16])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "VISITORS", 1)
    rows = planted()
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.link_vectors(frame(spark, rows + ODD)).collect()}
    want = brute(rows, 0.95) | {i: (0, i, True) for i, _ in ODD}
    assert got == want


def test_links_of_repeats_and_missing_ids(spark):
    v, w = [1.0] * 24, [-1.0] * 24
    rows = [(5, v), (5, v), (3, v), (None, v), (9, w), (8, [2.0] * 24)]
    got = sorted((tuple(r) for r in embedding_dedup.link_vectors(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, 3, False)] * 2 + [(3, 3, 3, True), (8, 3, 3, False), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert embedding_dedup.link_vectors(frame(spark, ODD)).where("kept").count() == len(ODD)
    assert embedding_dedup.link_vectors(frame(spark, [(1, v)]).limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    rows = planted(1500, 24, 2)
    table = frame(spark, rows + ODD)
    got = permutation_index.search(table, table.where("vec_id % 10 = 0")).toPandas()
    x = np.array([r for _, r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, group in got.groupby("query_id"):
        group = group.sort_values("rank")
        cosine = x @ x[q]
        assert list(group["rank"]) == [1, 2, 3, 4, 5] and q not in set(group["vec_id"])
        assert np.allclose(group["score"], cosine[group["vec_id"]], atol=1e-12)
        assert (np.diff(group["score"]) <= 1e-15).all()
        cosine[q] = -2
        best = np.lexsort((np.arange(len(x)), -np.round(cosine, 12)))[:5]
        hits += len(set(best) & set(group["vec_id"]))
    assert set(got["query_id"]) == set(range(0, 1500, 10))
    assert hits / (5 * 150) >= 0.9


def test_search_ties_and_few_candidates(spark):
    v = [1.0] * 24
    rows = [(50, v), (50, v), *[(i, v) for i in range(1, 12)], (None, v), *ODD]
    table = frame(spark, rows)
    got = permutation_index.search(table, table.where("vec_id = 50 or vec_id = 3")).collect()
    by = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
    assert [by[50, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [by[3, k] for k in range(1, 6)] == [1, 2, 4, 5, 6] and len(by) == 10
    few = frame(spark, [(1, v), (2, [1.0] + [0.0] * 23)])
    assert [tuple(r)[:3] for r in permutation_index.search(few, few.where("vec_id = 1")).collect()] == [(1, 1, 2)]
    assert permutation_index.search(few.limit(0), few).count() == 0


def test_search_of_given_embeddings(spark, sf_dir):
    got = permutation_index.query(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in table])
    x = np.array([r[1] for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    for q in ids[ids % 50 == 0]:
        cosine = x @ x[ids == q][0]
        cosine[ids == q] = -2
        found.append(len(set(ids[np.argsort(-cosine)[:5]]) & set(got[got["query_id"] == q]["vec_id"])))
    assert sum(found) / (5 * len(found)) >= 0.9


def test_every_length_has_its_own_links(spark):
    rows = planted(450) + [(2000 + i, [float(1 + i % 2), 1.0]) for i in range(6)] + [(3000, [1.0, 2.0, 3.0])]
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.link_vectors(frame(spark, rows)).collect()}
    want = brute(rows[:450], 0.95) | {i: (2, 2000 + i % 2, i < 2002) for i in range(2000, 2006)} | {3000: (0, 3000, True)}
    assert 0.948 < 3 / np.sqrt(10) < 0.95
    assert got == want


def test_search_within_a_length(spark):
    rows = planted(450) + [(2000, [1.0, 0.0]), (2001, [2.0, 0.1]), (2002, [1.0, 1.0]), (3000, [1.0, 2.0, 3.0])]
    table = frame(spark, rows)
    got = permutation_index.search(table, table.where("vec_id = 2000 or vec_id = 3000 or vec_id = 7"), k=3).collect()
    by = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
    assert (by[2000, 1], by[2000, 2]) == (2001, 2002) and sorted(k for q, k in by if q == 7) == [1, 2, 3] and len(by) == 5
