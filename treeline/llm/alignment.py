"""Alignment of two tokenizers' tokens of the same texts.

Per block of documents, in Arrow: the tokens' byte lengths are taken from a table, flattened
over all documents with the number of their document beside them; cumulative sums within
each document give byte ends; a hash join on (document, end) finds the ends that both
tokenizers have, which cut the tokens into groups; grouping the linked pairs gives the
block's partial counts. Spark adds these up over the corpus, finds the best count of each
right-hand id, and brings the counts back to their blocks. Only one row per block and
distinct pair is shuffled for that, and no table of all pairs is sent to anybody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.tokens import (
    Encode, Encoded, as_bytes, byte_encode, byte_signs, byte_slices, flat, json_tokenizer, named, spread,
)
from treeline.session import scratch

SPACE = "▁"
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: A pair of ids is one number: the left id times this, plus the right id.
_RIGHT = 1 << 31


class Vocabulary:
    """How to encode words, and the bytes of each id."""

    def __init__(self, encode: Encode, raw: list[bytes]):
        self.encode, self.raw = encode, raw
        self.sizes = np.array([len(b) for b in raw], dtype=np.int64)
        self.names = pa.array([str(i) for i in range(len(raw))])


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary; strings of special tokens are plain text."""
    tokenizer, signs = json_tokenizer(path, True), byte_signs()
    raw = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, i in tokenizer.get_vocab().items():
        raw[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    return Vocabulary(byte_encode(path, True), raw)


def piece_level(path: str) -> Vocabulary:
    """A SentencePiece vocabulary, for words of texts that begin with a space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
        else:
            plain = not (model.is_control(i) or model.is_unknown(i))
            raw.append(piece.replace(SPACE, " ").encode() if plain else b"")
            if plain and (SPACE in piece.lstrip(SPACE) or "\n" in piece):
                raise ValueError("a piece goes on across a word's end")
    line = len(model.encode("\n"))  # the space that the library adds, and the line end

    def encode(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts a space in front: it stands for the word's own, or goes again
        texts = [w.decode() for w in some]
        found = model.encode([t[1:] if t.startswith(" ") else "\n" + t for t in texts], num_threads=1)
        # alone a space is nothing to the library
        return flat([(ids if len(t) > 1 else model.encode("\n")[:1]) if t.startswith(" ") else ids[line:]
                     for t, ids in zip(texts, found, strict=True)])

    return Vocabulary(encode, raw)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Once per Python worker; ``.json`` is byte-level, all else SentencePiece."""
    if path not in _LOADED:
        _LOADED[path] = byte_level(path) if path.endswith(".json") else piece_level(path)
    return _LOADED[path]


class _Side:
    """The tokens of one tokenizer of a block, with document and byte end of each."""

    def __init__(self, texts: pa.LargeBinaryArray, book: Vocabulary):
        self.book, found = book, Encoded(texts, book.encode)
        self.ids, self.starts, self.found = found.ids.astype(np.int64), found.ends, found
        parts = [book.raw[i] for i in found.known.tolist()]
        wrong = np.empty(0, dtype=np.int64)
        if b"".join(parts) != b"".join(found.words):
            stops = np.cumsum(found.sizes).tolist()
            alike = [b"".join(parts[a:b]) == w for w, a, b in zip(found.words, [0, *stops], stops)]
            wrong = np.flatnonzero(~np.array(alike)[found.at])
        #: Texts with a word whose tokens are not its bytes; only those are compared whole.
        self.doubtful = np.unique(np.searchsorted(found.first, wrong, side="right") - 1).tolist()

    def bytes_of(self, text: int) -> bytes:
        return b"".join(map(self.book.raw.__getitem__, self.ids[self.starts[text] : self.starts[text + 1]].tolist()))

    def only(self, texts: np.ndarray) -> None:
        """Leave the other texts without tokens."""
        counts = np.where(texts, np.diff(self.starts), 0)
        self.ids = self.ids[spread(counts, self.starts[:-1])]
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    def place(self) -> None:
        self.parent = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        sums = np.concatenate([[0], np.cumsum(self.book.sizes[self.ids])])
        self.end = sums[1:] - sums[self.starts[:-1]][self.parent]

    def table(self, name: str) -> pa.Table:
        return pa.table({"document": self.parent, "end": self.end, name: np.arange(len(self.ids))})

    def spelled(self, last: np.ndarray) -> pa.Array:
        """The ids of each group, joined by commas; ``last`` has the groups' last tokens."""
        ends = np.concatenate([[0], last + 1]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.book.names.take(pa.array(self.ids))), ",")


def align_block(texts: pa.Array, left: Vocabulary, right: Vocabulary) -> tuple[dict[str, pa.Array], pa.Table]:
    """(n_a, n_b, n_groups, n_links, groups and links of each text; the block's distinct
    pairs with their number). ``links`` are places in the table of pairs, in text order."""
    given = as_bytes(texts)
    none, space = (pa.scalar(b, pa.large_binary()) for b in (b"", b" "))
    raw = pc.if_else(pc.equal(given, none), given, pc.binary_join_element_wise(space, given, none))
    a, b = _Side(raw, left), _Side(raw, right)
    alike = np.ones(len(raw), dtype=bool)
    for side in (a, b):
        for text in side.doubtful:
            alike[text] &= side.bytes_of(text) == raw[text].as_py()
    for side in (a, b):
        if not alike.all():
            side.only(alike)
        side.place()
    met = a.table("a").join(b.table("b"), ["document", "end"], join_type="inner", use_threads=False)
    order = np.lexsort((np.asarray(met["b"]), np.asarray(met["a"])))
    document, end, at_a, at_b = (np.asarray(met[c])[order] for c in ("document", "end", "a", "b"))
    # groups end where both have an end; the last pair of an end has its last tokens
    closes = np.append((document[1:] != document[:-1]) | (end[1:] != end[:-1]), True)[: len(end)]
    spelled = pc.binary_join_element_wise(a.spelled(at_a[closes]), b.spelled(at_b[closes]), "|")
    of = np.searchsorted(document[closes], np.arange(len(raw) + 1)).astype(np.int32)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(of), spelled), ";")
    pair = pa.table({"pair": pa.array(a.ids[at_a] * _RIGHT + b.ids[at_b])})
    counted = pair.group_by("pair", use_threads=False).aggregate([("pair", "count")]).combine_chunks()
    places = pc.index_in(pair["pair"].combine_chunks(), value_set=counted["pair"].combine_chunks())
    ends = np.searchsorted(document, np.arange(len(raw) + 1)).astype(np.int32)
    return {
        "n_a": pa.array(np.diff(a.starts)), "n_b": pa.array(np.diff(b.starts)),
        "n_groups": pa.array(np.diff(of).astype(np.int64)), "n_links": pa.array(np.diff(ends).astype(np.int64)),
        "groups": groups, "links": pa.ListArray.from_arrays(pa.array(ends), places),
    }, counted


_PER_TEXT = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
    T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.IntegerType())),
])
_PER_BLOCK = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]))),
])


def _blocks(docs: DataFrame, left: str, right: str, key: str, text: str) -> DataFrame:
    """A row per document, and one per block with the block's pairs instead."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *_PER_TEXT.fields, *_PER_BLOCK.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, number = (vocabulary(left), vocabulary(right)), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in byte_slices(batch, 1, BLOCK_BYTES):
                found, counted = align_block(part.column(1), *books)
                keys, rows = part.column(0), part.num_rows
                pairs = pa.StructArray.from_arrays(
                    [counted["pair"].combine_chunks(), counted["pair_count"].combine_chunks()], names=["pair", "n"])
                none = pa.nulls(rows, pa.list_(pairs.type))
                block = pa.array(np.full(rows, number))
                yield pa.RecordBatch.from_arrays([keys, *found.values(), block, none], names=schema.fieldNames())
                one = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, keys.type), *[pa.nulls(1, c.type) for c in found.values()], block[:1], one],
                    names=schema.fieldNames())
                number += 1

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def alignments(
    docs: DataFrame,
    left: str,
    right: str,
    key: str = "doc_id",
    text: str = "text",
    keep: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """How the tokens of two vocabularies lie over each other: one row per row of ``docs``.

    ``left`` is a byte-level vocabulary, ``right`` a SentencePiece model (files that every
    executor has); both see a space and the text. Returned are key, n_a and n_b (tokens), n_groups,
    n_links, n_best, count_sum and groups. A group ends where both have a token's end, and
    a link is a pair of tokens that end together; a pair of ids counts as often as the
    corpus links it. count_sum adds the counts of a text's links; n_best is how many of them
    have the largest count of their right-hand id. ``groups`` has the ids: ``a1,a2|b1;a3|b2``; what
    ``keep`` makes of it is all that is written and shuffled of it.

    Texts that are null, empty, or not the same bytes in both vocabularies have no tokens: zeros and an empty
    ``groups``. Repeated keys are rows of their own; only key and text are read. An empty
    table gives an empty result. Each text is encoded once; a lost executor repeats its
    blocks, or reads what was written of them in the shared folder.
    """
    spark = docs.sparkSession
    path = scratch(spark, "alignment")
    found = _blocks(docs, left, right, key, text)
    found.withColumn("groups", keep(F.col("groups"))).write.parquet(path)
    written = spark.read.parquet(path)
    pairs = written.filter("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("at", "p")).select(
        "block", "at", F.col("p.pair").alias("pair"), F.col("p.n").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % _RIGHT)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    rated = pairs.join(rated, "pair").select("block", "at", "count", "best")
    texts = spark.read.parquet(path).filter("pairs IS NULL").drop("pairs")
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups"]
    schema = T.StructType([
        *[texts.schema[c] for c in names], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(some: pa.Table, of: pa.Table) -> pa.Table:
        count, best = np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
        count[np.asarray(of["at"])], best[np.asarray(of["at"])] = np.asarray(of["count"]), np.asarray(of["best"])
        links = some["links"].combine_chunks()
        at = np.asarray(pc.list_flatten(links))
        parent = np.asarray(pc.list_parent_indices(links))
        sums = [np.zeros(len(some), dtype=np.int64) for _ in range(2)]
        for total, each in zip(sums, (best, count)):
            np.add.at(total, parent, each[at])
        return some.select(names).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    out = texts.groupBy("block").cogroup(rated.groupBy("block")).applyInArrow(run, schema)
    return out.select(F.col("key").alias(key), *names[1:-1], "n_best", "count_sum", "groups")
