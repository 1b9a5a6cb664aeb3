"""Importance resampling against its meaning spelled out word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from wardscore.llm import importance_resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least, run, buckets, seed):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, run)[1])
    s, t = count([x for _, x in docs]), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for key, text in docs:
        words, own = features(text, run)
        weight = math.floor(sum(gain(zlib.crc32(f.encode()) % buckets) for f in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


TEXTS = [None, "", " ?! ", "A-b C", "Ünï Ключ 漢字 x\x00y", "one two three " * 20, "The quick brown fox " * 3, "zero"]


@pytest.mark.parametrize("run,percent,least,buckets", [(1, 50, 1, 10_000), (3, 40, 2, 97), (2, 100, 0, 5)])
def test_equals_brute_force(spark, run, percent, least, buckets):
    docs = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id at all"), (3, "again the third")]
    target = ["quick foxes two", None, "漢字 brown", ""]
    frame = spark.createDataFrame([(*d, "x", 2.0) for d in docs], "doc_id long, text string, rank string, score double").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(frame, wanted, percent=percent, least_words=least, run=run, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, percent, least, run, buckets, R.SEED)


def test_given_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = sorted(map(tuple, R.query(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, target, 10, 20, 1, 10_000, 2024)


def test_large_tables_rank_in_parallel(spark, monkeypatch):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat_ws(' ', 'word', id % 7, 'and', id % 11) AS text")
    target = spark.createDataFrame([("word 3 and 4",)], "text string")
    want = sorted(map(tuple, R.resample(docs, target, percent=30, least_words=1).collect()))
    monkeypatch.setattr(R.rank_rows, "__defaults__", (10,))
    assert sorted(map(tuple, R.resample(docs, target, percent=30, least_words=1).collect())) == want


def test_draw_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"some words of {i}", "kept") for i in range(20)], "doc_id long, text string, note string")
    target = docs.select("text").where("doc_id < 5")
    drawn = R.draw(docs, target, percent=25, least_words=1)
    ranked = R.resample(docs, target, percent=25, least_words=1).where("rank IS NOT NULL")
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in ranked.collect()} and drawn.count() == 5
    assert R.resample(docs.limit(0), target).count() == 0
    assert R.resample(docs, target.limit(0), least_words=1).where("rank IS NOT NULL").count() == 2
    with pytest.raises(ValueError):
        R.draw(docs.unionByName(docs), target)
