r"""Byte-level BPE over a table of distinct words.

Spark splits the texts into words and counts them; each distinct word is encoded once. The table of encoded words goes to
all tasks as long as it keeps below a checked size; of a larger one the most frequent words do, and the places of all other
words get their ids by a join. Decoding joins ids with their pieces, a table as large as the tokenizer's vocabulary.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.text_bytes import array_hashes, flat, ragged, small_batches
from wardscore.operators.settle import land

# Bytes of encoded words that go to every task: hash, place and ids.
TABLE_BYTES = 96 << 20
SPECIAL = "<|endoftext|>"

# The tokenizer's word pattern. White space is spelled out, as Java's \s knows ASCII only.
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+"
    r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_words(text: Column) -> Column:
    """The words of a text in order; the special token is a word of its own. A null text has none.

    Characters that this Java's tables do not know yet may be letters to the tokenizer, so a text with one is left whole:
    the tokenizer splits it itself.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    around = F.split(text, F.lit(r"<\|endoftext\|>"), F.lit(-1))
    joined = F.flatten(
        F.transform(
            around,
            lambda part, i: F.concat(
                F.when(i > 0, F.array(F.lit(SPECIAL))).otherwise(F.array().cast("array<string>")),
                F.regexp_extract_all(part, F.lit(WORD), F.lit(0)),
            ),
        )
    )
    return (
        F.when(text.rlike(r"\p{Cn}"), F.filter(F.array(text), lambda w: w != ""))
        .when(text.contains(SPECIAL), joined)
        .otherwise(words)
    )


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded_words(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, n, ids) from (word, n): every row's word is encoded once, with the library."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            ids = [e.ids for e in tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            lists = pa.array(ids, pa.list_(pa.int32()))
            hashes = pa.array(array_hashes(batch.column(0)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, lists], names=["word", "n", "hash", "ids"])

    return words.mapInArrow(encode, "word string, n long, hash long, ids array<int>")


class WordTable:
    """Word hashes in order with the ids of each; what the tasks look words up in."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.hashes, self.ids = hashes, ids
        self.bounds = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=self.bounds[1:])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places: all their ids in a row, and how many each has. A place of -1 has the one id -1."""
        missing = at < 0
        lengths = np.where(missing, 1, self.bounds[at + 1] - self.bounds[at])
        places = ragged(np.where(missing, 0, self.bounds[at]).astype(np.int64), lengths.astype(np.int64))
        ids = self.ids[places].astype(np.int32) if len(self.ids) else np.full(len(places), -1, np.int32)
        ids[np.repeat(missing, lengths)] = -1
        return ids, lengths


def _collected(table: DataFrame, kind: str) -> WordTable:
    """Sorted and packed in the tasks, so that the driver only strings a few arrays together; ``kind`` holds every id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()),
                    pa.array([pc.list_value_length(ids).to_numpy().astype(np.int32).tobytes()], pa.binary()),
                    pa.array([ids.flatten().to_numpy().astype(kind).tobytes()], pa.binary()),
                ],
                names=["h", "n", "i"],
            )

    # Partitions of a range follow each other in the order of their hashes, and so do their rows.
    in_order = table.select("hash", "ids").repartitionByRange("hash").sortWithinPartitions("hash")
    rows = in_order.mapInArrow(pack, "h binary, n binary, i binary").collect()
    join = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
    return WordTable(join("h", np.int64), join("n", np.int32), join("i", kind))


def _frequent(table: DataFrame, limit: int) -> DataFrame:
    """The words that occur at least so often that their entries keep below ``limit`` bytes."""
    size = F.sum(F.lit(12) + 2 * F.size("ids")).alias("bytes")
    # At most a row for each different count; the large counts are few.
    steps = table.groupBy("n").agg(size).orderBy(F.desc("n")).toLocalIterator()
    total, least = 0, None
    for step in steps:
        total += step["bytes"]
        if total > limit:
            break
        least = step["n"]
    return table.where(F.col("n") >= least) if least is not None else table.limit(0)


Batches = Iterator[pa.RecordBatch]


def encode_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs``: the ids of the whole text, as the tokenizers library gives them.

    A null text is empty and has no ids. Null and repeated keys each give their row, an empty table an empty one; other
    columns are not read. ``table_bytes`` bounds what goes to every task; it changes the plan, never the ids.
    """
    return _encoded(docs, key, text, tokenizer_path or default_tokenizer(), table_bytes, lambda batches: batches, "ids array<int>")


def _encoded(
    docs: DataFrame, key: str, text: str, path: str, table_bytes: int, then: Callable[[Batches], Batches], fields: str
) -> DataFrame:
    """The (doc_id, ids) batches, passed on in the same task to ``then``, which gives doc_id and ``fields``."""
    spark = docs.sparkSession
    small_batches(spark)
    name = docs.columns[[c.lower() for c in docs.columns].index(key.lower())]
    split = docs.select(F.col(name).alias("doc_id"), split_words(F.col(text)).alias("words"))
    counts = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    table = land(encoded_words(counts, path), "words")
    total = table.agg(F.sum(F.lit(12) + 2 * F.size("ids"))).first()[0] or 0
    whole = total <= table_bytes
    kind = "uint16" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "int32"
    known = spark.sparkContext.broadcast(_collected(table if whole else _frequent(table, table_bytes), kind))

    def fill(batches: Batches) -> Batches:
        words = known.value
        for batch in batches:
            lists = batch.column(1)
            flat_words = lists.flatten().dictionary_encode()
            place = words.find(array_hashes(flat_words.dictionary).view(np.int64))
            at = place[flat_words.indices.to_numpy()] if len(flat_words) else np.zeros(0, np.int64)
            # A word still to be joined keeps its place by one negative id.
            ids, lengths = words.entries(at)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            in_doc = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends[in_doc].astype(np.int32)), pa.array(ids))]
            if not whole:
                gaps = np.flatnonzero(at < 0)
                cuts = np.searchsorted(gaps, in_doc).astype(np.int32)
                missing = flat_words.dictionary.take(flat_words.indices.take(pa.array(gaps)))
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), missing))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "missing"][: len(columns)])

    key_type = split.schema["doc_id"].dataType.simpleString()
    if whole:
        return split.mapInArrow(lambda batches: then(fill(batches)), f"doc_id {key_type}, {fields}")
    rows = split.mapInArrow(fill, f"doc_id {key_type}, ids array<int>, missing array<string>")
    rows = land(rows.withColumn("row", F.monotonically_increasing_id()), "holes")
    gaps = rows.select("row", F.posexplode("missing").alias("at", "word"))
    parts = gaps.join(table.select("word", F.col("ids").alias("part")), "word")
    parts = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))

    def patch(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for ids, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fill_in = iter(part or ())
                out.append([x for i in ids for x in (next(fill_in)["part"] if i < 0 else (i,))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    joined = rows.join(parts, "row", "left").select("doc_id", "ids", "parts")
    return joined.mapInArrow(lambda batches: then(patch(batches)), f"doc_id {key_type}, {fields}")


def _joined_pieces(lists: pa.ListArray, pieces: pa.Array) -> list[bytes]:
    """Each list's pieces in a row; the last piece stands for null ids and ids outside the vocabulary."""
    last = len(pieces) - 1
    values = lists.flatten()
    values = pc.if_else(pc.and_(pc.greater_equal(values, 0), pc.less(values, last)), values, last).fill_null(last)
    data, bounds = flat(pieces.take(values))
    counts = pc.list_value_length(lists).fill_null(0).to_numpy()
    cuts = bounds[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_ids(encoded: DataFrame, ids: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """``encoded`` with one more column, decoded: the text of the ids, special tokens included.

    Null ids give an empty text; an id outside the vocabulary gives nothing; bytes that are no UTF-8 become U+FFFD.
    """
    path = tokenizer_path or default_tokenizer()
    at = encoded.columns.index(ids)

    def decode(batches: Batches) -> Batches:
        pieces = id_pieces(path)
        for batch in batches:
            texts = [raw.decode("utf-8", "replace") for raw in _joined_pieces(batch.column(at), pieces)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(decode, ", ".join([*fields, "decoded string"]))


def id_pieces(path: str) -> pa.Array:
    """The bytes of each id's piece, and one empty piece more."""
    tokenizer = _tokenizer(path)
    # The byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
    return pa.array([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens] + [b""], pa.binary())


def digests(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    table_bytes: int = TABLE_BYTES,
    with_ids: bool = False,
) -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text.

    Taken where the ids are made, so that decoded texts, and ids unless asked for, do not leave the task.
    """
    path = tokenizer_path or default_tokenizer()

    def digest(batches: Batches) -> Batches:
        pieces = id_pieces(path)
        numbers = pa.array([b"%d," % i for i in range(len(pieces) - 1)] + [b""], pa.binary())
        for batch in batches:
            lists = batch.column(1)
            ids = [hashlib.sha256(raw[:-1]).hexdigest() for raw in _joined_pieces(lists, numbers)]
            texts = [
                hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest() for raw in _joined_pieces(lists, pieces)
            ]
            columns = [batch.column(0), pc.list_value_length(lists).cast(pa.int64()), pa.array(ids), pa.array(texts)]
            columns += [lists] * with_ids
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _encoded(docs, key, text, path, table_bytes, digest, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
