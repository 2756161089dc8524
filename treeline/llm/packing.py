"""Packing by vector bin packing with the dot-product heuristic.

An example takes tokens, one segment, and loss-bearing tokens; a sequence has a limit on
each. The open sequence takes, of all examples that fit, the one whose vector has the
largest dot product with what is left of the limits, weighted by how scarce each of them
is overall. Blocks of examples are packed by tasks of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.blocks import EXAMPLES_PER_BLOCK, packed_in_blocks
from treeline.llm.tokens import (
    Encoded, around_letters, as_bytes, before_spaces, buffers, byte_slices, cut_ids, id_blobs, json_encode, json_tokenizer,
    letter_encode, named,
)

TOKENS, SEGMENTS, LOSS_TOKENS = 2048, 128, 2048


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


_LOADED: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts by a tokenizer that counts capitals as small letters, drops white
    space, and keeps letters apart from all else."""

    def __init__(self, path: str):
        self.words, self.small = json_encode(path), letter_encode(path)
        special = json_tokenizer(path).get_added_tokens_decoder().values()
        #: What the tokenizer takes for a special token before it looks at letters.
        self.special = "|".join(re.escape(t.content) for t in special)

    def of(self, texts: pa.LargeBinaryArray) -> Encoded:
        if self.special and pc.any(pc.match_substring_regex(texts, self.special, ignore_case=True)).as_py():
            return Encoded(texts, self.words, before_spaces)
        ends, raw = buffers(texts)
        small = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw])])
        return Encoded(small, self.small, around_letters)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.of(as_bytes(pa.array([text]))).ids.astype("<u4").tobytes()


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, tokens: int = TOKENS
) -> DataFrame:
    """The ids of each whole text, then ``end_id``, cut into pieces of ``tokens`` and the rest:
    key, start, length, doc_tokens and ids (little-endian unsigned 32-bit numbers).

    Null counts as empty: the end id alone. ``tokenizer`` is a file that every executor has
    at that path. Only key and text are read. An empty table gives an empty result.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            for part in byte_slices(batch, 1):
                found = words.of(as_bytes(part.column(1)))
                cut = cut_ids(found.ids, found.ends, end_id, tokens, short_first=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cut["row"])), *[pa.array(cut[c]) for c in ("start", "length", "whole")], id_blobs(cut)],
                    names=schema.fieldNames())

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def fill(items: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, turn) of each item of a block. An item beyond a limit gets a sequence of
    its own. Equal items are interchangeable, so only kinds of items are compared."""
    sequence, turn = np.full(len(items), -1), np.zeros(len(items), dtype=np.int64)
    number = 0
    for i in np.flatnonzero((items >= limits).any(axis=1)):
        sequence[i], number = number, number + 1
    rest = np.flatnonzero(sequence < 0)
    if not len(rest):
        return sequence, turn
    kinds, of = np.unique(items[rest], axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    counts = np.bincount(of.ravel(), minlength=len(kinds))
    taken = np.concatenate([[0], np.cumsum(counts)])[:-1]
    limit_of, sizes = limits.astype(float), kinds / limits
    weight = sizes.T @ counts / counts.sum()
    left, filled = np.ones(len(limits)), 0
    while True:
        fits = np.flatnonzero((counts > 0) & (kinds <= left * limit_of + 1e-6).all(axis=1))
        if len(fits):
            best = fits[np.argmax(sizes[fits] @ (weight * left))]
            i = rest[order[taken[best]]]
            sequence[i], turn[i] = number, filled
            taken[best] += 1
            counts[best] -= 1
            left, filled = left - sizes[best], filled + 1
        else:
            number, left, filled = number + 1, np.ones(len(limits)), 0
            if not counts.any():
                return sequence, turn


def pack(
    examples: DataFrame,
    length: str = "length",
    loss: str | None = None,
    order: tuple[str, ...] = ("doc_id", "start"),
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss_tokens: int = LOSS_TOKENS,
    per_block: int = EXAMPLES_PER_BLOCK,
) -> DataFrame:
    """``examples`` with sequence_id and offset: where each example goes.

    A sequence holds at most ``tokens`` tokens, ``segments`` examples and ``loss_tokens``
    loss-bearing tokens; ``loss`` names their number, by default all tokens but the first.
    Nothing is cut or dropped: an example beyond a limit has a sequence of its own. ``order``
    makes the result repeatable; rows that repeat it and the length are interchangeable.
    Nulls, clashing columns, repeated rows and empty tables as in ``packed_in_blocks``.
    """
    bearing = F.greatest(named(length) - 1, F.lit(0)) if loss is None else named(loss)
    limits = np.array([tokens, segments, loss_tokens])

    def place(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return fill(np.insert(items, 1, 1, axis=1), limits)

    return packed_in_blocks(examples, [named(length), bearing], place, order, length, per_block)


def packed_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", tokens: int = TOKENS) -> DataFrame:
    """Pieces of all documents with their places and the CRC-32 of their ids. The ids
    themselves come from ``token_pieces`` again, by key and start.

    In plain text every token but a piece's first bears loss, so here the limit of
    loss-bearing tokens is that of tokens and never the tighter one; it is for instruction
    data, whose prompts bear none.
    """
    pieces = token_pieces(docs, tokenizer, key, text, tokens=tokens).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, order=(key, "start"), tokens=tokens, loss_tokens=tokens)
