"""Document quality from a linear-chain conditional random field over the lines.

Every line is good or bad. Its features are shares of kinds of characters, sizes and repetition, of the line itself and of
the lines before and after; transitions between neighbouring lines are learned with them. Forward-backward gives each line's
marginal, and the marginals weighted by line length give the document's score. Documents are labelled, lines are not: their
labels stay hidden in training, where the score itself, the chance that a line drawn by length is good, is fitted to the
document's label. So a good document may hold bad lines, and of texts put together each part keeps its own side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.llm.text_bytes import flat, pieces, slice_hashes, small_batches, word_bounds
from wardscore.operators.settle import land
from wardscore.operators.tables import q

# The model is fitted to at most so many labelled documents with so many lines in all, none with more than a hundredth of them.
SAMPLE, SAMPLE_LINES = 3000, 300_000
ROUNDS, RATE, PENALTY = 150, 0.1, 1e-3

# Kinds of bytes that a line's shares are taken of; each byte is of the last kind that lists it.
KINDS = [
    bytes(range(256)), bytes(range(0x80, 0xC0)), bytes(range(0xC0, 256)), b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".", b",", b"!", b"?", b"|", b"*", b"&", b"%", b"$", b"#", b"\"'`",
    b"()[]", b"<>={}\\/", b"-_~", b"@", b":;",
]
KIND = np.zeros(256, np.int64)
for _place, _bytes in enumerate(KINDS):
    KIND[list(_bytes)] = _place
SPACE_KIND = KINDS.index(b" ")
OWN = len(KINDS) + 6


@dataclass
class Lines:
    """Features of all lines of some documents, and where each document's lines begin (with the end)."""

    features: np.ndarray
    weights: np.ndarray
    first: np.ndarray


def lines_of(data: np.ndarray, bounds: np.ndarray) -> Lines:
    """The lines of texts given as bytes; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    # A line begins with each text and after each line feed; a line feed at a text's end begins an empty line.
    starts = np.concatenate([bounds[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1])
    order = np.lexsort((np.arange(len(starts)), starts, doc))
    starts, doc = starts[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(bounds)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = bounds[1:]
    size = ends - starts
    n = len(starts)
    # Each byte's line; line feeds count with the line that they end.
    of = np.repeat(np.arange(n), np.diff(np.append(starts, bounds[-1])))
    kind = KIND[data]
    counts = np.bincount(of * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, len(KINDS))
    twice = np.zeros(len(data), bool)
    if len(data) > 1:
        twice[1:] = (data[1:] == data[:-1]) & (kind[1:] != SPACE_KIND)
    pairs = np.bincount(of, twice, minlength=n)
    # Words that repeat the word before them in the line.
    begin, stop, _ = word_bounds(data, bounds)
    word, line = slice_hashes(data, begin, stop), of[begin]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    echoes = np.bincount(line, same, minlength=n) / np.maximum(np.bincount(line, minlength=n), 1)
    hashes = slice_hashes(data, starts, ends)
    # A line that stood in its document before.
    again = np.zeros(n)
    by = np.lexsort((np.arange(n), hashes, doc))
    again[by[1:]] = (hashes[by[1:]] == hashes[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]])
    total = np.maximum(size, 1)[:, None]
    own = np.concatenate(
        [
            counts / total, pairs[:, None] / total, echoes[:, None], again[:, None], np.log1p(size)[:, None],
            (counts[:, SPACE_KIND] + 1)[:, None] / (total + 1), (size == 0)[:, None],
        ],
        axis=1,
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return Lines(np.concatenate([own, before, after, np.ones((n, 1), np.float32)], axis=1), (size + 1).astype(float), first)


def _log_add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, y)


def chain(odds: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of good against bad for each line; the forward ones hold the line's own evidence.

    ``odds`` are the lines' own log odds, ``steps`` the 2 x 2 log weights of transitions (from bad, good to bad, good).
    All documents go on together, one line a step.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, count = first[:-1][order], counts[order]
    going = np.searchsorted(-count, -np.arange(1, count.max(initial=1)))
    forward, backward = odds.copy(), np.zeros_like(odds)
    for t, active in enumerate(going.tolist(), start=1):
        at = begin[:active] + t
        a = forward[at - 1]
        forward[at] += _log_add(steps[0, 1], a + steps[1, 1]) - _log_add(steps[0, 0], a + steps[1, 0])
    last = begin + count - 1
    for t, active in enumerate(going.tolist(), start=1):
        at = last[:active] - t
        b = backward[at + 1] + odds[at + 1]
        backward[at] = _log_add(steps[1, 0], b + steps[1, 1]) - _log_add(steps[0, 0], b + steps[0, 1])
    return forward, backward


def good_shares(
    shares: np.ndarray, first: np.ndarray, steps: np.ndarray, odds: np.ndarray, forward: np.ndarray, backward: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each line (bad in row 0, good in row 1) the expected good ``shares`` up to it, its own included, and after it.

    What is expected before a line depends only on the line's label and the lines before, so both go along the chain.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, count = first[:-1][order], counts[order]
    going = np.searchsorted(-count, -np.arange(1, count.max(initial=1)))
    upto, after = np.stack([np.zeros_like(shares), shares]), np.zeros((2, len(shares)))
    for t, active in enumerate(going.tolist(), start=1):
        at = begin[:active] + t
        for label in (0, 1):
            good = sigmoid(forward[at - 1] + steps[1, label] - steps[0, label])
            upto[label, at] += upto[0, at - 1] + good * (upto[1, at - 1] - upto[0, at - 1])
    last = begin + count - 1
    for t, active in enumerate(going.tolist(), start=1):
        at = last[:active] - t
        if_bad, if_good = after[0, at + 1], shares[at + 1] + after[1, at + 1]
        for label in (0, 1):
            good = sigmoid(odds[at + 1] + backward[at + 1] + steps[label, 1] - steps[label, 0])
            after[label, at] = if_bad + good * (if_good - if_bad)
    return upto, after


def gradient(x: np.ndarray, lines: Lines, labels: np.ndarray, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean log chance of the documents' labels, and its slopes by the weights and by the steps.

    The slope of a score is the covariance of a feature and the good share of the document.
    """
    counts = np.diff(lines.first)
    starts = lines.first[:-1]
    spread_out = lambda of_docs: np.repeat(of_docs, counts)
    shares = lines.weights / spread_out(np.add.reduceat(lines.weights, starts))
    odds = x @ weights
    forward, backward = chain(odds, lines.first, steps)
    good = sigmoid(forward + backward)
    score = np.clip(np.add.reduceat(good * shares, starts), 1e-9, 1 - 1e-9)
    upto, after = good_shares(shares, lines.first, steps, odds, forward, backward)
    pull = spread_out((labels - score) / (score * (1 - score)) / len(labels))
    mean = spread_out(score)
    slope_w = x.T @ (pull * good * (upto[1] + after[1] - mean))
    inner = np.ones(len(x), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    a, b = forward[inner - 1], odds[inner] + backward[inner]
    joint = np.stack([np.full_like(a, steps[0, 0]), b + steps[0, 1], a + steps[1, 0], a + b + steps[1, 1]])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    gone = np.stack([upto[i, inner - 1] + j * shares[inner] + after[j, inner] for i in (0, 1) for j in (0, 1)])
    slope_s = ((joint * (gone - mean[inner])) @ pull[inner]).reshape(2, 2)
    return float(np.mean(np.where(labels == 1, np.log(score), np.log1p(-score)))), slope_w, slope_s


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def odds(self, lines: Lines) -> np.ndarray:
        return ((lines.features - self.mean) / self.scale) @ self.weights

    def scores(self, lines: Lines) -> np.ndarray:
        """Per document the mean marginal of its lines, weighted by their lengths."""
        odds = self.odds(lines)
        forward, backward = chain(odds, lines.first, self.steps)
        good = sigmoid(forward + backward) * lines.weights
        return np.add.reduceat(good, lines.first[:-1]) / np.add.reduceat(lines.weights, lines.first[:-1])


def fit(lines: Lines, labels: np.ndarray) -> Model:
    """Maximum likelihood of the documents' labels, the lines' hidden, with a quadratic penalty; documents weigh alike.

    By full gradients with moment estimates, from weights of zero.
    """
    width = lines.features.shape[1]
    mean, scale = np.zeros(width), np.ones(width)
    if len(labels):
        mean, scale = lines.features.mean(axis=0, dtype=float), lines.features.std(axis=0, dtype=float) + 1e-3
        mean[-1], scale[-1] = 0, 1
    model = Model(mean, scale, np.zeros(width), np.zeros((2, 2)))
    if not len(labels):
        return model
    x = (lines.features - mean) / scale
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.steps)]
    for t in range(1, ROUNDS + 1):
        _, *slopes = gradient(x, lines, labels, model.weights, model.steps)
        for p, slope, (m, v) in zip((model.weights, model.steps), slopes, state, strict=True):
            g = slope - PENALTY * p
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-6)
    return model


def remainder(key: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text",
    size: int = SAMPLE, most_lines: int = SAMPLE_LINES,
) -> Model:
    """A model fitted to at most ``size`` documents with a label: those of ``usable`` rows whose ids hash lowest.

    Whole documents are taken in that order, up to ``most_lines`` lines in all; one with more than a hundredth of them is not
    learned from, so long texts never fill the driver. Of an id's several labels the largest counts, of its several texts the
    one whose features hash lowest. Null labels and ids are left out. Without any labelled document all scores are one half.
    """
    small_batches(docs.sparkSession)
    told = labels.select(F.col(key).alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label is not null")
    if usable is not None:
        told = told.where(usable)
    told = told.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(size)
    # Its size is a parameter, so the sample may go to every task.
    picked = docs.select(docs[q(key)].alias("id"), docs[q(text)].alias("text")).join(F.broadcast(told), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            data, bounds = flat(batch.column(2))
            for a, b in pieces(bounds):
                lines = lines_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                cut = [slice(lines.first[i], lines.first[i + 1]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), marks.slice(a, b - a),
                        pa.array([lines.features[c, :OWN].tobytes() for c in cut], pa.binary()),
                        pa.array([lines.weights[c].tobytes() for c in cut], pa.binary()),
                    ],
                    names=["id", "label", "own", "weights"],
                )

    kind = picked.schema["id"].dataType.simpleString()
    made = picked.select("id", "label", "text").mapInArrow(features, f"id {kind}, label int, own binary, weights binary")
    made = made.withColumn("lines", (F.octet_length("weights") / 8).cast("int")).where(F.col("lines") <= most_lines // 100)
    made = made.groupBy("id").agg(F.min_by(F.struct("label", "own", "weights", "lines"), F.xxhash64("own", "weights")).alias("one"))
    made = land(made.select("id", "one.*"), "lines")
    # One row per sampled document: few enough for one window.
    so_far = F.sum("lines").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = made.select("id", so_far.alias("so_far")).where(F.col("so_far") <= most_lines).select("id")
    # In one order whatever the tasks' order.
    rows = sorted(made.join(F.broadcast(fitting), "id").collect(), key=lambda r: str(r["id"]))
    own = [np.frombuffer(r["own"], np.float32).reshape(-1, OWN) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(int)
    stacked = np.concatenate(own) if own else np.zeros((0, OWN), np.float32)
    before, after = np.zeros_like(stacked), np.zeros_like(stacked)
    before[1:], after[:-1] = stacked[:-1], stacked[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    lines = Lines(
        np.concatenate([stacked, before, after, np.ones((len(stacked), 1), np.float32)], axis=1),
        np.concatenate([np.frombuffer(r["weights"], float) for r in rows]) if rows else np.zeros(0),
        first,
    )
    return fit(lines, np.array([r["label"] for r in rows]))


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and its score: 0 (bad) to 1 (good), of the whole text; a null text is empty."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    n = len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(n))
            parts = [
                shared.value.scores(lines_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])) for a, b in pieces(bounds)
            ]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores)], names=[*batch.schema.names[:n], "score"])

    # Numbered on the way through Arrow, which takes no names with dots.
    kept = docs.select(*[docs[q(c)].alias(f"c{i}") for i, c in enumerate(keep)], docs[q(text)].cast("string").alias("body"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:n]]
    return kept.mapInArrow(score, ", ".join([*fields, "score double"])).toDF(*keep, name)


def good_documents(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, as they are."""
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    scored = score_documents(docs, model, docs.columns, text, name)
    return scored.where(scored[name] >= least).select(*[scored[q(c)] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model learned from the labels of two thirds of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, remainder(F.col("id"), 3) != 1)
    return score_documents(docs, model, ["doc_id"]).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
