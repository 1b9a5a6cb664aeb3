r"""Importance resampling towards a target: n-gram buckets counted in both corpora, log ratios, Gumbel top-k.

Texts stay UTF-8 bytes: a table of 256 bytes lower-cases A-Z and blanks every other ASCII byte that is no letter or digit,
bytes.split gives the words, and the checksum of a run of words goes on from that of the run one word shorter. Counters
reduce the checksums of a batch, tasks add them up per bucket, and Spark sums the tasks' buckets. Only the gains, one number
a bucket, go back to the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.text_bytes import small_batches
from wardscore.operators.scoring import rank_rows
from wardscore.operators.settle import land
from wardscore.operators.tables import col

BUCKETS, RUN, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
# Letters and digits stay, capitals become small, bytes of other alphabets stay, all else separates words.
KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in KEPT else 0x20 for b in range(256))
UNIT, RANGE = 1000, 1 << 32

Batches = Iterator[pa.RecordBatch]


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; a null text has none."""
    return text.translate(TABLE).split() if text else []


def checksums(words: list[bytes], run: int) -> Iterator[list[int]]:
    """For 1 to ``run``: the CRC-32 of every run of so many words joined by one space."""
    sums = list(map(crc32, words))
    yield sums
    spaced = [b" " + w for w in words] if run > 1 else []
    for n in range(1, run):
        sums = list(map(crc32, spaced[n:], sums))
        yield sums


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts, repeats counted; no rows or words give zeros."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter[int] = Counter()
            for body in _bytes(batch.column(0)):
                for sums in checksums(words_of(body), run):
                    seen.update(sums)
            at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    parts = texts.select(col(text)).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    # As many rows as there are buckets at most.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, thousandths of the log ratio of its smoothed shares in target and own corpus, rounded down."""
    buckets = len(own)
    all_own, all_target = float(own.sum() + buckets), float(target.sum() + buckets)
    ratio = (target + 1.0) * all_own / ((own + 1.0) * all_target)
    return np.array([math.floor(UNIT * math.log(r)) for r in ratio.tolist()], np.int64)


def luck(key: object, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of seed and key; a null key is an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / RANGE)))


def scored(
    docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs``."""
    name = docs.columns[[c.lower() for c in docs.columns].index(key.lower())]
    rows = docs.select(col(name).alias("doc_id"), col(text).alias("text"))
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Batches) -> Batches:
        gain = table.value
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                words = words_of(body)
                n = total = 0
                for sums in checksums(words, run):
                    n += len(sums)
                    total += int(gain[np.fromiter(sums, np.int64, len(sums)) % len(gain)].sum())
                weight = total // n if n else 0
                out.append((len(words), n, weight, weight + luck(key, seed)))
            figures = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, figures.T.copy())], names=["doc_id", "n_words", "n_features", "weight", "score"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    run: int = RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``; rank numbers the drawn rows and is null for others.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred are drawn, rounded down: those with the highest
    scores, ties to the smaller id, rows without an id last. ``target`` needs the column ``text`` alone.

    A null or empty text has no words, weight 0, and is never drawn. Repeated rows and ids each count and each get a row;
    those alike in id and score follow each other in any order. A long text is read whole, in one task. An empty table gives
    an empty one, an empty target even shares. Other columns of either table are not read.
    """
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, text, run, buckets))
    # Written once: the rows are counted and ordered after.
    rows = land(scored(docs, gain, key, text, run, seed), "scored")
    eligible = F.col("n_words") >= least_words
    n_rows, n = rows.agg(F.count(F.lit(1)), F.count(F.when(eligible, 1))).first()
    drawn = percent * n // 100
    order = [eligible.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = rank_rows(rows, order, "rank", n_rows)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; ids have to be unique and not null, else it raises."""
    ids, n, present = docs.agg(F.count_distinct(col(key)), F.count(F.lit(1)), F.count(col(key))).first()
    if not ids == n == present:
        raise ValueError(f"{key} is null or repeated")
    drawn = resample(docs, target, key, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(key))
    return docs.join(drawn, key, "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the benchmark texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)


# The checksum is worked out bit by bit for each distinct word.
ORACLE = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
own AS (SELECT place, unnest(words) AS w FROM doc_words),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM own UNION ALL SELECT w FROM target_words)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)
           / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), totals),
sums AS (SELECT place, sum(g)::DOUBLE AS g FROM own JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY place),
rows AS (
  SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(floor(g / len(words)), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM doc_words LEFT JOIN sums USING (place)),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM rows),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place,
         10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100 AS drawn FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM ranked
"""
