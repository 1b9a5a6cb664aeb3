"""Near-duplicate documents by an inverted join of MinHash signatures.

1. Each document's set of word shingles gives a signature of 64 coordinates; documents with equal sets are one from here on.
2. A signature is a set of 64 (coordinate, value) entries. Two sets that agree in at least t entries share one of the first
   64 - t + 1 entries, in any order common to all; so only these are posted. The order puts entries of crowds last.
3. Within the list of each posted entry, agreements are counted over the whole signatures; pairs with t or more leave the
   task as stars, so that a crowd of near copies gives as many rows as it has members. Long lists are cut into blocks, and
   each pair of blocks is a cell of its own.
4. Components over these stars hold all candidates. Inside each, pairs with t or more agreements are confirmed on the full
   sets, best agreement first; a pair that is already linked by others needs no check. Large components are cut like lists.
5. Components over confirmed links are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.components import Forest, connected_components, local_labels
from wardscore.llm.mixing import free_name
from wardscore.llm.text_bytes import LOWER, STEP, U64, array_hashes, flat, pieces, slice_hashes, small_batches, stirred, word_bounds
from wardscore.llm.vectors import cell_parts
from wardscore.operators.settle import land

COORDINATES = 64
# The chance that a pair at the threshold agrees in too few coordinates is no larger.
MISSED = 1 / 50_000
# Counters that tell crowded entries from rare ones, and the occurrences in one task from which an entry is reported.
COUNTERS, REPORTED = 1 << 20, 4
# Members of a block of a list, and of a component; shingles of a block of a component.
LIST_BLOCK, CLASS_BLOCK, CLASS_SHINGLES = 1024, 512, 1 << 20
SMALL_GROUP = 24
# A sign of a word.
WORD = r"[^\x20\x09-\x0D]"
# The bits that tell which texts may be needed again number two to this power at most.
MOST_BITS = 27

_random = np.random.default_rng(64)
FACTORS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) | U64(1)
MARKS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def least_agreement(percent: int) -> int:
    """The match threshold: agreements that a pair with this similarity has but for a vanishing chance."""
    s, fewer = percent / 100, 0.0
    for t in range(COORDINATES):
        fewer += math.comb(COORDINATES, t) * s**t * (1 - s) ** (COORDINATES - t)
        if fewer > MISSED:
            return max(1, t)
    return COORDINATES


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its different shingles of ``words`` lower-cased words.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    data, bounds = flat(texts)
    for a, b in pieces(bounds):
        part = LOWER[data[bounds[a] : bounds[b]]]
        starts, ends, doc = word_bounds(part, bounds[a : b + 1] - bounds[a])
        hashes = slice_hashes(part, starts, ends)
        first = np.searchsorted(doc, np.arange(b - a + 1))
        with np.errstate(over="ignore"):
            n = max(0, len(hashes) - words + 1)
            rolled = np.zeros(n, U64)
            for j in range(words):
                rolled = rolled * U64(STEP) + hashes[j : j + n]
            rolled = stirred(rolled)
            for i in range(b - a):
                lo, hi = first[i], first[i + 1]
                if hi - lo >= words:
                    yield np.unique(rolled[lo : hi - words + 1])
                elif hi > lo:
                    whole = U64(hi - lo)
                    for h in hashes[lo:hi]:
                        whole = whole * U64(STEP) + h
                    yield stirred(np.array([whole], U64))
                else:
                    yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the smallest of the shingles' hashes."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            hashed = (shingles[a : a + 2048, None] * FACTORS) >> U64(32)
            low = np.minimum(low, hashed.min(axis=0).astype(np.uint32))
    return low


def entries(signatures: np.ndarray) -> np.ndarray:
    """The 64 (coordinate, value) entries of each signature as 64-bit numbers."""
    return stirred(signatures.astype(U64) ^ MARKS)


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, signature); d1 and d2 tell different sets apart, null for an empty set or no id."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks, signed = [], [], []
            for s in shingle_sets(batch.column(1), words):
                counts.append(len(s))
                if len(s):
                    marks.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                    signed.append(signature(s).tobytes())
                else:
                    marks.append(None)
                    signed.append(None)
            ids = batch.column(0).to_pylist()
            known = [m is not None and i is not None for m, i in zip(marks, ids, strict=True)]
            pick = lambda j: pa.array([int(m[j]) if k else None for m, k in zip(marks, known, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pick(0), pick(1), pa.array(signed, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "signature"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def crowded(reps: DataFrame) -> np.ndarray:
    """Per counter, about how many signatures have its entries; a bounded array whatever the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            at = (entries(_matrix(batch.column(0))) & U64(COUNTERS - 1)).astype(np.int64)
            total += np.bincount(at.ravel(), minlength=COUNTERS)
        some = np.flatnonzero(total >= REPORTED)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["counter", "n"])

    found = reps.select("signature").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[table.column("counter").to_numpy()] = table.column("n").to_numpy()
    return out


def posts(reps: DataFrame, least: int) -> DataFrame:
    """(entry, rep): each signature's first entries in the common order, rare ones first."""
    spark = reps.sparkSession
    crowd = spark.sparkContext.broadcast(crowded(reps))
    prefix = COORDINATES - least + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = entries(_matrix(batch.column(1)))
            order = np.lexsort((at, crowd.value[(at & U64(COUNTERS - 1)).astype(np.int64)]), axis=1)[:, :prefix]
            first = np.take_along_axis(at, order, axis=1)
            reps_ = np.repeat(batch.column(0).to_numpy(), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(first.ravel().view(np.int64)), pa.array(reps_)], names=["entry", "rep"])

    return reps.select("rep", "signature").mapInArrow(post, "entry long, rep long")


def _in_cells(rows: DataFrame, group: str, blocks: Column, carried: list[str]) -> DataFrame:
    """Rows dealt to cells (group, low, high) of their block and each block of the group, with the side they are on."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        group,
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        *carried,
    )


def candidates(reps: DataFrame, least: int) -> DataFrame:
    """(u, v): stars over all pairs of reps that agree in at least ``least`` coordinates."""
    posted = land(posts(reps, least), "posts")
    shared = posted.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1")
    met = posted.join(shared, "entry").join(reps.select("rep", "signature"), "rep")
    cells = _in_cells(met, "entry", F.ceil(F.col("members") / LIST_BLOCK), ["rep", "signature"])
    cells = cells.repartition("entry", "low", "high").sortWithinPartitions("entry", "low", "high", "side")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if carry is None else [*carry, batch])
            cell = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("entry", "low", "high")])
            cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            # The last cell may go on in the next batch.
            done = int(cuts[-1]) if len(cuts) else 0
            carry = table.slice(done).combine_chunks().to_batches()
            if done:
                yield from _agreeing(table.slice(0, done), np.concatenate([[0], cuts]), least)
        if carry:
            rest = pa.Table.from_batches(carry)
            yield from _agreeing(rest, np.array([0, rest.num_rows]), least)

    return cells.mapInArrow(agree, "u long, v long")


def _agreeing(table: pa.Table, cuts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Stars over the agreeing pairs of a table of whole cells that begin at ``cuts`` (with the end)."""
    sig, rep = _matrix(table.column("signature")), table.column("rep").to_numpy()
    side, low, high = (table.column(c).to_numpy() for c in ("side", "low", "high"))
    sizes = np.diff(cuts)
    left, right = [], []
    # Short lists all at once, each row with the next, the next but one, and so on.
    short = np.repeat(sizes <= SMALL_GROUP, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, min(SMALL_GROUP, int(sizes.max(initial=1)))):
        a = np.flatnonzero(short[:-step] & (group[:-step] == group[step:])) if step < len(group) else np.zeros(0, int)
        if not len(a):
            break
        b = a + step
        fits = ((low[a] == high[a]) | (side[a] != side[b])) & (rep[a] != rep[b])
        a, b = a[fits], b[fits]
        near = (sig[a] == sig[b]).sum(axis=1) >= least
        left.append(a[near])
        right.append(b[near])
    for g in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        a, b = int(cuts[g]), int(cuts[g + 1])
        inside = bool(low[a] == high[a])
        middle = b if inside else a + int(np.searchsorted(side[a:b], 1))
        for i in range(a, middle):
            rest = slice(i + 1, b) if inside else slice(middle, b)
            near = np.flatnonzero((sig[rest] == sig[i]).sum(axis=1) >= least) + rest.start
            left.append(np.full(len(near), i))
            right.append(near)
    left, right = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    nodes, at = np.unique(np.concatenate([rep[left], rep[right]]), return_inverse=True)
    root = nodes[local_labels(len(nodes), at[: len(left)], at[len(left) :])]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root != nodes]), pa.array(root[root != nodes])], names=["u", "v"])


def full_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, size, shingles) of the (rep, text) rows whose rep may be a node of ``wanted``: all that are, and few others.

    A bit per hash value, of a number bounded whatever the number of nodes, goes to every task, so that only few sets are
    made and shuffled for the exact join that follows. A row that repeats id and text is given once a task.
    """
    spark = rows.sparkSession
    size = 1 << min(MOST_BITS, max(16, (16 * wanted.count()).bit_length()))
    at = wanted.select(F.pmod(F.xxhash64("node"), F.lit(size)).alias("at"))
    marks = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(at, 64) as int))").alias("bit"))
    found = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(U64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            marks = list(zip(batch.column(0).to_pylist(), array_hashes(batch.column(1)).tolist(), strict=True))
            new = [m not in seen and not seen.add(m) for m in marks]
            batch = batch.filter(pa.array(new, pa.bool_()))
            found = list(shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                names=["rep", "size", "shingles"],
            )

    marked = rows.where("rep is not null").select("rep", "text", F.pmod(F.xxhash64("rep"), F.lit(size)).alias("at"))
    return marked.mapInArrow(sets, "rep long, size long, shingles binary")


def confirmed(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, percent: int, least: int) -> DataFrame:
    """(u, v): stars over the links inside each class of candidates (node, component), confirmed on the full sets."""
    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    rows = full_sets(rows, classes, words).join(classes.select(F.col("node").alias("rep"), "component"), "rep")
    rows = land(rows.select("rep", "component", "size", "shingles"), "sets")
    sizes = rows.groupBy("component").agg(F.count("*").alias("members"), F.sum("size").alias("total"))
    blocks = F.ceil(F.greatest(F.col("members") / CLASS_BLOCK, F.col("total") / CLASS_SHINGLES, F.lit(1.0)))
    cells = _in_cells(rows.join(sizes, "component"), "component", blocks, ["rep", "shingles"])
    cells = cells.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "side")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for where, side, part in cell_parts(batches, ["component", "low", "high"], "side"):
            if where != cell:
                if held:
                    yield _links(held, cell[1] == cell[2], percent, least)
                cell, held = where, []
            held.append((side, part))
        if held:
            yield _links(held, cell[1] == cell[2], percent, least)

    return cells.mapInArrow(confirm, "u long, v long")


def _links(held: list[tuple[int, pa.RecordBatch]], inside: bool, percent: int, least: int) -> pa.RecordBatch:
    sides = np.concatenate([np.full(part.num_rows, side) for side, part in held])
    rep = np.concatenate([part.column("rep").to_numpy() for _, part in held])
    sets = [np.frombuffer(x, U64) for _, part in held for x in part.column("shingles").to_pylist()]
    sig = np.stack([signature(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    left, right, agree = [], [], []
    for i in range(len(rep)):
        others = np.arange(i + 1, len(rep)) if inside else np.flatnonzero(sides > sides[i])
        # Sets too different in size cannot be that similar.
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= percent * large]
        same = (sig[others] == sig[i]).sum(axis=1)
        near = same >= least
        left.append(np.full(near.sum(), i))
        right.append(others[near])
        agree.append(same[near])
    left, right, agree = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
    forest = Forest()
    for p in np.argsort(-agree, kind="stable").tolist():
        a, b = int(left[p]), int(right[p])
        if forest.find(int(rep[a])) == forest.find(int(rep[b])):
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= percent * (sizes[a] + sizes[b] - common):
            forest.union(int(rep[a]), int(rep[b]))
    pairs = forest.edges()
    return pa.RecordBatch.from_arrays(
        [pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"]
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``words``-word shingles (A-Z lower-cased,
    words are runs without ASCII white space; with fewer words the whole sequence is one shingle). component_id is the
    smallest id reachable over links, kept tells that it is the row's own. A null text, or one without words, has no shingle
    and links with nothing, as does a row without an id; both are kept. Rows that repeat id and text are linked as equals;
    an id with several texts stands for all of them. An empty table gives an empty one; other columns are not read.

    Every link reported is exact. A link at the very threshold is missed with a chance below 1 in 50,000, as its signatures
    may agree in too few coordinates, and then only if no other document links the two.
    """
    least = least_agreement(percent)
    base = land(signatures(docs, key, text, words), "signatures")
    reps = base.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    reps = land(reps, "reps")
    classes = land(connected_components(candidates(reps, least), thin=False), "classes")
    linked = connected_components(confirmed(docs, classes, key, text, words, percent, least), thin=False)
    told = reps.select("d1", "d2", "rep").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return base.select("doc_id", "n_shingles", "d1", "d2").join(told, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which each group of near copies keeps one, that with the smallest id; rows without an id stay.

    Rows are told apart by their own number, so that different texts under one id stay. Rows without words are copies only
    if they repeat id and text.
    """
    row = free_name("__row", docs.columns)
    numbered = land(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    named = numbered.where(numbered[key].isNotNull())
    marked = near_duplicates(named, row, text, words, percent)
    marked = marked.select(F.col("doc_id").alias("__marked"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("__group"))
    own = named.select(
        row, F.col(key).alias("__id"), F.when(~F.coalesce(F.col(text), F.lit("")).rlike(WORD), F.coalesce(F.col(text), F.lit(""))).alias("__blank")
    )
    told = own.join(marked, own[row] == marked["__marked"])
    blank_id = F.when(F.col("__group").isNull(), F.col("__id"))
    best = told.groupBy("__group", blank_id.alias("__blank_id"), "__blank").agg(F.min(F.struct("__id", row)).alias("best"))
    kept = best.select(F.col("best")[row].alias("__kept"))
    single = named.join(kept, named[row] == kept["__kept"], "left_semi")
    return single.unionByName(numbered.where(numbered[key].isNull())).drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked on shingles of three words at 85 hundredths."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
