"""Whole texts as token ids, by way of the distinct words of a batch.

A batch of texts is cut where its tokenizer surely joins nothing. Arrow then finds the
distinct words, each of them is encoded once, and numpy puts the ids of all texts together.
No word is a Python object more than once in a batch, and nothing is remembered between
batches.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are encoded together; a longer text is encoded alone.
BYTES_AT_ONCE = 8 << 20
#: Words that the library is given at once.
_WORDS_AT_ONCE = 10_000

#: From words to (the ids of all, how many ids each has).
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
#: From the bytes of texts to whether there is a cut in front of each.
Cuts = Callable[[np.ndarray], np.ndarray]


def named(name: str) -> Column:
    """The column of exactly that name, also if there is a dot in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def byte_slices(batch: pa.RecordBatch, column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` bytes of text, or of a single row."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(texts: pa.Array) -> pa.LargeBinaryArray:
    """UTF-8 of each text; null counts as empty."""
    return texts.cast(pa.large_binary()).fill_null(b"")


def buffers(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 ends from 0, all bytes one after the other)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return ends - ends[0], raw[ends[0] : ends[-1]]


def before_spaces(raw: np.ndarray) -> np.ndarray:
    """Cuts in front of a run of white space, and behind a single line end, for tokenizers
    that put at most the last space of a run to the next word."""
    # what stands in front surely is no white space: a sign of ASCII, or one of two bytes
    # other than those that begin with C2, which may be a space
    solid = np.zeros(len(raw) + 1, dtype=bool)
    plain = (raw > 0x20) & (raw < 0x7F)
    solid[1:] = plain
    solid[2:] |= (raw[1:] >= 0x80) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
    line = raw == 0x0A
    cut = ((raw == 0x20) | line) & solid[:-1]
    cut[2:] |= (cut & line)[1:-1] & plain[2:]
    return cut


def around_letters(raw: np.ndarray) -> np.ndarray:
    """Cuts behind white space and behind letters in front of another sign of ASCII, for
    tokenizers that drop white space and keep letters apart from all else."""
    letter = _LETTER[raw]
    space = _SPACE[raw]
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = (letter[:-1] & ~letter[1:] & (raw[1:] < 0x80)) | (space[:-1] & ~space[1:])
    return cut


_LETTER, _SPACE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True


def words(texts: pa.LargeBinaryArray, cuts: Cuts) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts, and for each text the number of its first word, n + 1 in all.
    Joined again, the words of a text are the text."""
    ends, raw = buffers(texts)
    cut = cuts(raw)
    cut[ends[:-1][ends[:-1] < ends[1:]]] = True
    starts = np.flatnonzero(cut)
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
    return found, np.searchsorted(starts, ends)


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of ``lengths[i]`` neighbours from ``starts[i]`` on, for all i in turn."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoded:
    """Ids of a batch of texts, flat, with what is known of each word."""

    def __init__(self, texts: pa.LargeBinaryArray, encode: Encode, cuts: Cuts = before_spaces):
        found, first = words(texts, cuts)
        kinds = found.dictionary_encode()
        self.words: list[bytes] = kinds.dictionary.to_pylist()
        #: The ids of all ``words`` and how many each has.
        self.known, self.sizes = encode(self.words)
        #: Which of ``words`` stands at each place, and where the words of each text begin.
        self.at, self.first = np.asarray(kinds.indices, dtype=np.int64), first
        lengths = self.sizes[self.at]
        self.ids = self.known[spread(lengths, (np.cumsum(self.sizes) - self.sizes)[self.at])]
        #: n + 1 ends of the texts in ``ids``.
        self.ends = np.concatenate([[0], np.cumsum(lengths)])[first]


def flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(ids) for ids in each], dtype=np.int64)
    return np.fromiter(chain.from_iterable(each), dtype=np.uint32, count=int(sizes.sum())), sizes


_LOADED: dict[tuple[str, bool], object] = {}


def json_tokenizer(path: str, special_as_text: bool = False):
    """A tokenizer of the tokenizers library, once per Python worker."""
    if (path, special_as_text) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_as_text
        _LOADED[path, special_as_text] = tokenizer
    return _LOADED[path, special_as_text]


def json_encode(path: str, special_as_text: bool = False) -> Encode:
    """Encoding by the tokenizers library."""
    tokenizer = json_tokenizer(path, special_as_text)

    def encode(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int]] = []
        for first in range(0, len(some), _WORDS_AT_ONCE):
            texts = [w.decode() for w in some[first : first + _WORDS_AT_ONCE]]
            out += [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return flat(out)

    return encode


def byte_signs() -> dict[str, int]:
    """The byte for which each sign of a byte-level vocabulary stands: visible signs for
    themselves, the other bytes, in order, for the signs from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def together(quick: np.ndarray, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of both in turn: those that ``quick`` marks come from ``one``."""
    sizes = np.zeros(len(quick), dtype=np.int64)
    sizes[quick], sizes[~quick] = one[1], other[1]
    starts = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), dtype=np.uint32)
    ids[spread(sizes[quick], starts[quick])], ids[spread(sizes[~quick], starts[~quick])] = one[0], other[0]
    return ids, sizes


# Both fast ways below merge any two neighbours that together are a token, in the order of
# the ids. That is the same as merging by the list of merges if every token's own text
# becomes that token: then, whenever two neighbours stand where a token may, the list has them.

# Fixed value: how byte-level vocabularies cut a text.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RANKS: dict[str, object] = {}


def _model(path: str) -> tuple[dict, list[str]]:
    """The tokenizer's file, and its merged tokens in the order of the merges."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    merges = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
    return given, ["".join(m) for m in merges]


def _in_order(ids: dict[str, int], merged: list[str]) -> bool:
    places = [ids.get(t, -1) for t in merged]
    return all(a < b for a, b in zip(places, places[1:]))


def _ranked(path: str):
    """The same byte-level vocabulary for the tiktoken library, which is several times as fast on
    single words; None where its ids are not in the order of the merges, or it is of another kind."""
    if path not in _RANKS:
        import tiktoken

        given, merged = _model(path)
        model, before, signs = given["model"], given["pre_tokenizer"] or {}, byte_signs()
        plain = (
            given["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and set(model["vocab"]) == {*merged, *signs} and _in_order(model["vocab"], [min(signs, key=lambda c: -model["vocab"][c]), *merged])
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        ranks = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items()} if plain else {}
        _RANKS[path] = tiktoken.Encoding("words", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if plain else None
    return _RANKS[path]


def byte_encode(path: str, special_as_text: bool = False) -> Encode:
    """Encoding by a byte-level vocabulary, with the ids of the tokenizers library.

    Words of Latin letters go another, faster way to the same ids. The libraries may know letters of
    different editions of Unicode, so all other words, and those with a special token, are
    left to the tokenizers library.
    """
    ranked, whole = _ranked(path), json_encode(path, special_as_text)
    if ranked is None:
        return whole
    special = [] if special_as_text else [t.content.encode() for t in json_tokenizer(path).get_added_tokens_decoder().values()]

    def latin(word: bytes) -> bool:
        return max(word) < 0xCA and not any(s in word for s in special)  # up to U+027F

    def encode(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        quick = np.fromiter(map(latin, some), dtype=bool, count=len(some))
        known = flat(list(map(ranked.encode_ordinary, [w.decode() for w, q in zip(some, quick, strict=True) if q])))
        return together(quick, known, whole([w for w, q in zip(some, quick, strict=True) if not q]))

    return encode


def letter_encode(path: str) -> Encode:
    """Encoding, with the ids of the tokenizers library, by a vocabulary whose words end in
    ``</w>``, for words without capitals.

    Words of a to z go a faster way: a capital stands for a last letter, so all of them are
    encoded as one text, and ids that end a word tell them apart again.
    """
    import tiktoken

    whole = json_encode(path)
    given, merged = _model(path)
    vocab, small = given["model"]["vocab"], re.compile("[a-z]+(</w>)?")
    letters = {t: i for t, i in vocab.items() if small.fullmatch(t)}
    if not _in_order(letters, [t for t in merged if t in letters]) or given["model"].get("end_of_word_suffix") != "</w>":
        return whole

    def spelled(token: str) -> bytes:
        word = token.removesuffix("</w>")
        return (word if word == token else word[:-1] + word[-1].upper()).encode()

    ranked = tiktoken.Encoding("letters", pat_str="[a-zA-Z]+", mergeable_ranks={spelled(t): i for t, i in letters.items()}, special_tokens={})
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for t, i in letters.items() if t.endswith("</w>")]] = True

    def encode(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        quick = np.fromiter((w.isalpha() and w.islower() for w in some), dtype=bool, count=len(some))
        text = b" ".join(w[:-1] + w[-1:].upper() for w, q in zip(some, quick, strict=True) if q).decode()
        ids = np.array(ranked.encode_ordinary(text), dtype=np.uint32)
        sizes = np.diff(np.flatnonzero(ends[ids]), prepend=-1)
        return together(quick, (ids, sizes), whole([w for w, q in zip(some, quick, strict=True) if not q]))

    return encode


def cut_ids(ids: np.ndarray, ends: np.ndarray, end_id: int, tokens: int, short_first: bool) -> dict[str, np.ndarray]:
    """Pieces of at most ``tokens`` ids of texts that get ``end_id`` behind their own.

    All pieces of a text but one are full; that one is its first (``short_first``) or last.
    row, piece, start, length, whole (ids of the text), and from, the place in all ids."""
    whole = np.diff(ends) + 1
    pieces = -(-whole // tokens)
    rest = whole - (pieces - 1) * tokens
    row = np.repeat(np.arange(len(whole)), pieces)
    piece = spread(pieces, np.zeros(len(whole), dtype=np.int64))
    if short_first:
        start = np.where(piece > 0, rest[row] + (piece - 1) * tokens, 0)
        length = np.where(piece > 0, tokens, rest[row])
    else:
        start = piece * tokens
        length = np.where(piece < pieces[row] - 1, tokens, rest[row])
    every = np.full(int(whole.sum()), end_id, dtype="<u4")
    shifted = ends[:-1] + np.arange(len(whole))
    every[spread(whole - 1, shifted)] = ids
    return {"row": row, "piece": piece, "start": start, "length": length, "whole": whole[row],
            "from": shifted[row] + start, "ids": every}


def id_blobs(cut: dict[str, np.ndarray]) -> pa.Array:
    """The ids of each piece as little-endian unsigned 32-bit numbers."""
    offsets = np.append(cut["from"], len(cut["ids"])).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cut["from"]), [None, pa.py_buffer(offsets), pa.py_buffer(cut["ids"].tobytes())]).cast(pa.binary())
