"""Packing by vector best-fit.

A sequence has a capacity of tokens, of documents and of attention cost (tiles of 128 x 128
that attention within each document touches). Examples come in descending order; each goes
to the open sequence that has room for it in every respect and fits it best: where the
weighted norm of what would be left is least, or where the weighted dot product of example
and room, relative to the room's own norm, is largest. A respect weighs as much as it is
scarce. Without room anywhere a sequence is opened. Blocks of examples are packed by tasks
of their own, with both measures, and the one that takes fewer sequences counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.blocks import EXAMPLES_PER_BLOCK, packed_in_blocks
from treeline.llm.tokens import Encoded, as_bytes, byte_encode, byte_slices, cut_ids, id_blobs, named

TOKENS, DOCUMENTS, TILES, TILE = 2048, 256, 320, 128
MEASURES = ("norm", "dot")


def cut_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, tokens: int = TOKENS
) -> DataFrame:
    """Pieces of all texts: key, piece, start, length, ids (little-endian unsigned 32-bit).

    A text's ids are those of the tokenizers library for a byte-level vocabulary, then ``end_id``. Only more than ``tokens``
    of them are cut: into full pieces behind a first one that may be shorter. Null counts
    as empty: the end id alone. ``tokenizer`` is a file that every executor has at that
    path. Only key and text are read; a repeated key gives rows of its own. An empty table
    gives an empty result.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encode(tokenizer)
        for batch in batches:
            for part in byte_slices(batch, 1):
                found = Encoded(as_bytes(part.column(1)), encode)
                cut = cut_ids(found.ids, found.ends, end_id, tokens, short_first=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cut["row"])), pa.array(cut["piece"].astype(np.int32)),
                     pa.array(cut["start"]), pa.array(cut["length"]), id_blobs(cut)],
                    names=schema.fieldNames())

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def best_fit(items: np.ndarray, limits: np.ndarray, measure: str) -> tuple[np.ndarray, int]:
    """(the sequence of each item, their number) for items in the order in which they are
    placed. An item beyond a limit gets a sequence of its own."""
    sequence = np.empty(len(items), dtype=np.int64)
    beyond = (items > limits).any(axis=1)
    sequence[beyond] = np.arange(beyond.sum())
    number, rest = int(beyond.sum()), np.flatnonzero(~beyond)
    if not len(rest):
        return sequence, number
    sizes = items[rest] / limits
    weight = sizes.mean(axis=0)
    # what a sequence needs at least to take any later item; others are set aside
    needed = np.minimum.accumulate(items[rest][::-1], axis=0)[::-1]
    room = np.empty((len(limits), len(rest)), dtype=np.int64)
    name = np.empty(len(rest), dtype=np.int64)
    opened, limit = 0, limits[:, None]
    for turn, i in enumerate(rest):
        item = items[i]
        if turn % 256 == 0 and opened:
            keep = np.flatnonzero((room[:, :opened] >= needed[turn][:, None]).all(axis=0))
            room[:, : len(keep)], name[: len(keep)] = room[:, keep], name[keep]
            opened = len(keep)
        fits = np.flatnonzero((room[:, :opened] >= item[:, None]).all(axis=0))
        if len(fits):
            free, asked = room[:, fits] / limit, sizes[turn][:, None]
            if measure == "norm":
                best = fits[np.argmin(weight @ (free - asked) ** 2)]
            else:
                best = fits[np.argmax((weight @ (free * asked)) / (weight @ free**2))]
        else:
            best, number = opened, number + 1
            room[:, best], name[best] = limits, number - 1
            opened += 1
        room[:, best] -= item
        sequence[i] = name[best]
    return sequence, number


def pack_best_fit(
    examples: DataFrame,
    costs: dict[str, tuple[Column, int]],
    order: tuple[str, ...],
    length: str = "length",
    per_block: int = EXAMPLES_PER_BLOCK,
    measures: tuple[str, ...] = MEASURES,
) -> DataFrame:
    """``examples`` with sequence_id and offset: where each example goes.

    ``costs`` names what is limited: what an example takes of it (whole numbers, null as
    0) and how much a sequence holds. Examples are placed in descending order of their costs, ties by
    ``order``. Nothing is cut or dropped; an example beyond a limit has a sequence of its own.
    Clashing columns, repeated rows and empty tables as in ``packed_in_blocks``.
    """
    limits = np.array([limit for _, limit in costs.values()], dtype=np.int64)

    def place(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tried = [best_fit(items, limits, measure) for measure in measures]
        return min(tried, key=lambda found: found[1])[0], np.arange(len(items))

    return packed_in_blocks(examples, [cost for cost, _ in costs.values()], place, order, length, per_block)


def tiles(length: str, tile: int = TILE) -> Column:
    """Attention cost of a document: the tiles of ``tile`` x ``tile`` that it touches."""
    side = F.ceil(named(length) / tile)
    return side * side


def packed_best_fit(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    tokens: int = TOKENS, documents: int = DOCUMENTS, most_tiles: int = TILES,
) -> DataFrame:
    """Pieces of all documents with their places and the CRC-32 of their ids, in few
    sequences of at most ``tokens`` tokens, ``documents`` documents and ``most_tiles`` tiles
    of attention. The ids themselves come from ``cut_documents`` again, by key and start.

    A full sequence of one document has 256 tiles, so the limit of 320 binds only where long
    documents share a sequence with dozens of tiny ones. Cases as in ``cut_documents``.
    """
    pieces = cut_documents(docs, tokenizer, key, text, tokens=tokens)
    pieces = pieces.select(named(key), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    costs = {"tokens": (F.col("length"), tokens), "documents": (F.lit(1), documents), "attention": (tiles("length"), most_tiles)}
    return pack_best_fit(pieces, costs, order=(key, "start"))
