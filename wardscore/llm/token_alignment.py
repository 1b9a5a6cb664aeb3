r"""Alignment of two tokenizers' tokens over the same bytes: pandas merge_asof per batch, keyed by document.

Texts are cut where no token of the tokenizer can reach across; each distinct unit is encoded once per task by the tokenizer's own
library. Tokens become byte ranges. Each token's start finds the covering token of the other side, the last one that starts no
later in the same document; both directions together give all overlapping pairs, and ends that both sides share cut groups.

How many documents hold a pair linked is counted by Spark. The counts come back by chunks: a chunk is a few megabytes of text
that one task read in a row, so a pair travels once per chunk and not once per document, and no table of pairs is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardscore.llm.bpe import id_pieces
from wardscore.llm.text_bytes import flat, ragged
from wardscore.operators.settle import land
from wardscore.operators.tables import col

# Bytes of texts that are aligned at once, and in a chunk; a longer text is a piece, or a chunk, of its own.
PIECE_BYTES, CHUNK_BYTES = 1 << 21, 8 << 20
# Documents in an Arrow batch, ids that a task remembers of units it has met, and bytes of the longest remembered unit.
BATCH_ROWS, REMEMBERED, UNIT_BYTES = 200, 4_000_000, 256
# White space of the byte tokenizer's word pattern; a word never goes on into it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "\u2581"

Batches = Iterator[pa.RecordBatch]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Units(dict):
    """Number of each unit met; a new one gets the next number."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Side:
    """One tokenizer: how texts are cut, how units are encoded, and the bytes of each id."""

    pieces: pa.Array
    unit: re.Pattern

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.units, self.done = Units(), 0
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Every text is empty or begins with a space."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        found = []
        for text in texts:
            units = self.unit.findall(text)
            found.append(np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)))
        new = list(self.units)[self.done :]
        if new:
            encoded = self.encode_units(new)
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in encoded for i in ids), np.int32, int(lengths.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            self.done = len(self.units)
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        lengths = self.bounds[places + 1] - self.bounds[places]
        ids = self.ids[ragged(self.bounds[places], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        in_text = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        if max(map(len, new), default=0) > UNIT_BYTES:
            self.forget()
        return ids, np.diff(ends[in_text])


class ByteSide(Side):
    """Byte-level BPE of the tokenizers library. Units end where white space begins: no word of its pattern goes on there."""

    unit = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.pieces = id_pieces(path)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class PieceSide(Side):
    """SentencePiece BPE. Units end where a space begins: no piece holds one after anything else, checked at the start."""

    unit = re.compile(" *[^ ]+| +")

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            self.unit = re.compile("(?s).+")
        body = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.pieces = pa.array([*body, b""], pa.binary())
        self.space = self.model.piece_to_id(MARK)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        # The model puts a space before what it is given; it gives nothing for an empty text.
        encoded = self.model.encode([unit[1:] for unit in units], num_threads=1)
        return [ids if unit != " " else [self.space] for unit, ids in zip(units, encoded, strict=True)]


@dataclass
class Tokens:
    """Tokens of some texts in a row: document, id, and byte range counted through all texts."""

    doc: np.ndarray
    id: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Aligned:
    """Tokens of both sides, the links as places in them, and for each token the number of its group."""

    a: Tokens
    b: Tokens
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_docs: int

    def per_doc(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=self.n_docs).astype(np.int64)


def _covering(left: Tokens, right: Tokens) -> np.ndarray:
    """For each token of ``left`` the place of the token of ``right`` that covers its start."""
    ours = pd.DataFrame({"start": left.start, "doc": left.doc})
    theirs = pd.DataFrame({"start": right.start, "doc": right.doc, "place": np.arange(len(right.doc))})
    return pd.merge_asof(ours, theirs, on="start", by="doc", direction="backward")["place"].to_numpy(np.int64)


def align(texts: list[str | None], sides: tuple[Side, Side]) -> Aligned:
    """Tokens, links and groups of the texts. Null and empty texts, and those that the tokens of a side do not give back byte
    by byte, have no tokens."""
    spaced = [f" {t}" if t else "" for t in texts]
    wanted = [t.encode("utf-8", "surrogatepass") for t in spaced]
    sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
    found, whole = [], sizes > 0
    for side in sides:
        ids, counts = side.encode(spaced)
        data, bounds = flat(side.pieces.take(pa.array(ids)))
        cuts = np.concatenate([[0], np.cumsum(counts)])
        at, raw = bounds[cuts], data.tobytes()
        given = np.fromiter((raw[x:y] == w for x, y, w in zip(at[:-1].tolist(), at[1:].tolist(), wanted, strict=True)), bool, len(wanted))
        whole &= given
        found.append((ids, counts, np.diff(bounds)))
    base = np.cumsum(np.where(whole, sizes, 0)) - np.where(whole, sizes, 0)
    tokens = []
    for ids, counts, lengths in found:
        doc = np.repeat(np.arange(len(texts)), counts)
        kept = whole[doc]
        doc, ids, lengths = doc[kept], ids[kept], lengths[kept]
        # The kept texts follow each other without gaps, and so do their tokens.
        end = np.cumsum(lengths)
        tokens.append(Tokens(doc, ids, end - lengths, end))
    a, b = tokens
    if not len(a.doc):
        none = np.zeros(0, np.int64)
        return Aligned(a, b, none, none, none, none, len(texts))
    assert a.end[-1] == b.end[-1] == (base + np.where(whole, sizes, 0))[-1]
    from_a, from_b = _covering(a, b), _covering(b, a)
    # Tokens that start together are found from both sides.
    other = a.start[from_b] != b.start
    link_a = np.concatenate([np.arange(len(a.doc)), from_b[other]])
    link_b = np.concatenate([from_a, np.flatnonzero(other)])
    both = np.intersect1d(a.end, b.end, assume_unique=True)
    group_a, group_b = np.searchsorted(both, a.end), np.searchsorted(both, b.end)
    return Aligned(a, b, link_a, link_b, group_a, group_b, len(texts))


def _texts_of_groups(x: Aligned, numbers: pa.Array) -> list[bytes]:
    """Per document its groups as text: `a1,a2|b1;a3|b2,b3`; none for a document without tokens."""
    base = len(numbers) // 3
    group = np.concatenate([x.group_a, x.group_b])
    side = np.repeat(np.array([0, 1]), [len(x.group_a), len(x.group_b)])
    # By group, A before B, each in its own order.
    order = np.argsort(group * 2 + side, kind="stable")
    ids, doc = np.concatenate([x.a.id, x.b.id])[order].astype(np.int64), np.concatenate([x.a.doc, x.b.doc])[order]
    key = (group * 2 + side)[order]
    last = np.concatenate([key[1:] != key[:-1], np.ones(min(1, len(key)), bool)])
    # After a number: a comma, at the end of A's a bar, at the end of the group a semicolon.
    mark = np.where(last, 1 + side[order], 0)
    data, bounds = flat(numbers.take(pa.array(mark * base + ids)))
    cuts = bounds[np.concatenate([[0], np.cumsum(x.per_doc(doc))])].tolist()
    raw = data.tobytes()
    return [raw[s : max(s, e - 1)] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _pairs(x: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document and pair: the pair (A's id times ``width`` plus B's), how often it is linked, and pairs per document."""
    doc = x.a.doc[x.link_a]
    pair = x.a.id[x.link_a].astype(np.int64) * width + x.b.id[x.link_b]
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]))
    often = np.diff(np.concatenate([first, [len(doc)]]))
    return pair[first], often, x.per_doc(doc[first])


def _small_pieces(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of a batch with about PIECE_BYTES of text, and their bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first] - sizes[first]
        stop = max(first + 1, int(np.searchsorted(ends, done + PIECE_BYTES, side="right")))
        yield batch.slice(first, stop - first), int(ends[stop - 1] - done)
        first = stop


def _batches_of(spark: SparkSession, rows: int) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def _sides(paths: tuple[str, str]) -> tuple[Side, Side]:
    return ByteSide(paths[0]), PieceSide(paths[1])


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    name = docs.columns[[c.lower() for c in docs.columns].index(key.lower())]
    return docs.select(col(name).alias("doc_id"), col(text).alias("text"))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values, kind))


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, a_ids, a_ends, b_ids, b_ends, links and group_ends.

    Ends are byte offsets in a space and the text; tokens follow each other, so a token begins where the one before ends. links
    holds pairs of places (a, b) in the two lists, by a, then b; group_ends the offsets where both sides end a token. Texts that
    are null, empty or not given back by a side have empty lists; null and repeated ids each give their row, an empty table an
    empty one; other columns are not read. A long text is aligned whole, in one task.
    """
    paths = paths or default_paths()
    rows = _named(docs, key, text)
    _batches_of(docs.sparkSession, BATCH_ROWS)

    def run(batches: Batches) -> Batches:
        sides = _sides(paths)
        for batch in batches:
            for piece, _ in _small_pieces(batch, 1):
                x = align(piece.column(1).to_pylist(), sides)
                n_a, n_b = x.per_doc(x.a.doc), x.per_doc(x.b.doc)
                first = [np.cumsum(n) - n for n in (n_a, n_b)]
                order = np.lexsort((x.link_b, x.link_a))
                link_a, link_b = x.link_a[order], x.link_b[order]
                doc = x.a.doc[link_a]
                links = pa.StructArray.from_arrays(
                    [pa.array((link_a - first[0][doc]).astype(np.int32)), pa.array((link_b - first[1][doc]).astype(np.int32))], ["a", "b"]
                )
                base = np.zeros(x.n_docs, np.int64)
                base[x.a.doc[::-1]] = x.a.start[::-1]
                closes = np.isin(x.a.end, x.b.end, assume_unique=True)
                cuts = np.concatenate([[0], np.cumsum(x.per_doc(doc))]).astype(np.int32)
                columns = [piece.column(0)]
                for tokens, n in ((x.a, n_a), (x.b, n_b)):
                    columns += [_lists(tokens.id, n, pa.int32()), _lists(tokens.end - base[tokens.doc], n, pa.int64())]
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), links))
                columns.append(_lists((x.a.end - base[x.a.doc])[closes], x.per_doc(x.a.doc[closes]), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "links", "group_ends"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = "a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>"
    return rows.mapInArrow(run, f"doc_id {kind}, {lists}, links array<struct<a:int,b:int>>, group_ends array<long>")


def _digested(docs: DataFrame, key: str, text: str, paths: tuple[str, str], width: int) -> DataFrame:
    """Per row: its chunk, figures and digest, and each linked pair with its number of links, pairs in order."""
    rows = _named(docs, key, text)
    _batches_of(docs.sparkSession, BATCH_ROWS)

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        sides = _sides(paths)
        most = max(len(side.pieces) for side in sides)
        numbers = pa.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(most)], pa.binary())
        chunk, filled = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for piece, n_bytes in _small_pieces(batch, 1):
                if filled and filled + n_bytes > CHUNK_BYTES:
                    chunk, filled = chunk + 1, 0
                filled += n_bytes
                x = align(piece.column(1).to_pylist(), sides)
                groups = _texts_of_groups(x, numbers)
                pair, often, n_pairs = _pairs(x, width)
                figures = [x.per_doc(x.a.doc), x.per_doc(x.b.doc), x.per_doc(x.a.doc[np.isin(x.a.end, x.b.end)]), x.per_doc(x.a.doc[x.link_a])]
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array(np.full(len(piece), chunk)), *map(pa.array, figures), pa.array(digest, pa.string()),
                        _lists(pair, n_pairs, pa.int64()), _lists(often, n_pairs, pa.int32()),
                    ],
                    names=["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    figures = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return rows.mapInArrow(run, f"doc_id {kind}, chunk long, {figures}, pairs array<long>, often array<int>")


def _counted(chunk_pairs: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): in how many documents each pair is linked, and whether no other pair of its A id is in more."""
    counts = chunk_pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    # No A id has more pairs than B has ids.
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(width)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(a_id, b_id, count, best): in how many rows of ``docs`` the pair is linked; best: no other pair of the A id is in more."""
    paths = paths or default_paths()
    width = _width(paths)
    digested = _digested(docs, key, text, paths, width)
    pairs = digested.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.floor(F.col("pair") / F.lit(width)).cast("int"), (F.col("pair") % width).cast("int")
    return _counted(pairs, width).select(a.alias("a_id"), b.alias("b_id"), "count", "best")


def _width(paths: tuple[str, str]) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows of ``docs`` that hold it linked, repeated rows each for itself. n_best counts the links
    whose pair no other pair of the same A id beats, ties included; count_sum adds up the counts of all links. Texts without
    tokens, see ``alignments``, have zeros and an empty digest.
    """
    paths = paths or default_paths()
    width = _width(paths)
    rows = land(_digested(docs, key, text, paths, width), "aligned")
    # Documents of a chunk come from one task, so most pairs meet before the shuffle.
    wanted = rows.select("chunk", F.explode("pairs").alias("pair")).groupBy("chunk", "pair").agg(F.count(F.lit(1)).alias("n"))
    wanted = land(wanted, "pairs")
    counts = _counted(wanted.select("pair", "n"), width)
    answers = wanted.select("chunk", "pair").join(counts, "pair")
    kind = rows.schema["doc_id"].dataType.simpleString()
    kept = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often"]
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("doc_id", *kept)]
    # In a chunk the counts come first, in the order of their pairs, then the documents.
    asked = answers.select("chunk", "pair", F.col("count").alias("total"), "best", *nothing)
    asking = rows.select("chunk", F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "doc_id", *kept)
    both = asked.unionByName(asking).withColumn("turn", F.col("pair").isNull().cast("int"))
    both = both.repartition("chunk").sortWithinPartitions("chunk", "turn", "pair")

    def run(batches: Batches) -> Batches:
        chunk, held, table = None, [], None
        for batch in batches:
            for piece in _by_turn(batch):
                here, counts = piece.column("chunk")[0].as_py(), not piece.column("turn")[0].as_py()
                if here != chunk:
                    chunk, held, table = here, [], None
                if counts:
                    held.append(piece.select(["pair", "total", "best"]))
                else:
                    table = table or Counts(held)
                    yield table.summed(piece)

    figures = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return both.mapInArrow(run, f"doc_id {kind}, {figures}")


def _by_turn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one chunk with counts only, or with documents only."""
    if not batch.num_rows:
        return
    keys = np.stack([batch.column("chunk").to_numpy(), batch.column("turn").to_numpy().astype(np.int64)])
    cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
    for first, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(first, stop - first)


class Counts:
    """The counts of a chunk's pairs, in the order of the pairs."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        join: Callable[[str], np.ndarray] = lambda c: np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held] or [np.zeros(0, np.int64)])
        self.pairs, self.totals, self.best = join("pair").astype(np.int64), join("total").astype(np.int64), join("best").astype(bool)

    def summed(self, docs: pa.RecordBatch) -> pa.RecordBatch:
        pairs, often = docs.column("pairs"), docs.column("often").flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(self.pairs, pairs.flatten().to_numpy())
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy())]).astype(np.int64)

        def per_doc(x: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[cuts]))

        sums = per_doc(often * self.best[at]), per_doc(often * self.totals[at])
        columns = [*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, docs.column("groups_sha256")]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of byte-level BPE with SentencePiece BPE."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
