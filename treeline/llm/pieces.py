"""SentencePiece (merge type) encoding by backtracking, and decoding.

A merge-type encoding is the one sequence of pieces in which every two neighbours are
compatible, that is, merging the two of them again from characters gives back the same
two. So a text is encoded by trying the longest matching piece at each position (found by
an Aho-Corasick automaton), then its shorter prefixes; a position from which nothing fits
is marked in a bitfield and never tried again.

Two neighbouring characters that stand side by side in no piece are never merged. Texts are
cut there (so at the start of white space, and at characters without a piece, which become
bytes), and the encodings of the cuts are kept in a bounded cache per Python worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treeline.llm.tokens import named

SPACE = "▁"
#: Entries of each cache; a full cache is emptied.
CACHED = 1 << 18


class Pieces:
    """The pieces of one model file with their ids and the order of their merges."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.end_id, self.unknown_id = model.eos_id(), model.unk_id()
        self.texts: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.texts.append(piece)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        if not {c for piece in self.ids for c in piece} <= set(self.ids):
            raise ValueError("a character of some piece is no piece itself")
        self.neighbours = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        if any(b[0] != SPACE and b[1] in f"{SPACE}\n" or b[0] == "\n" for b in self.neighbours):
            raise ValueError("a piece has white space that is not in front, or a line end")
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            self.matcher.add_word(piece, (len(piece) - 1, piece))
        self.matcher.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str | None] = {}
        self._parts: dict[str, bytes] = {}
        self._runs: dict[str, bytes] = {}

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives the same two pieces again."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHED:
                self._pairs.clear()
            known = self._pairs[left, right] = self._merged_apart(left, right)
        return known

    def _merged_apart(self, left: str, right: str) -> bool:
        symbols, border, scores = [*left, *right], len(left), self.scores
        ranks = [scores.get(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                return border == 1 and len(symbols) == 2
            if at == border - 1:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = scores.get(symbols[at - 1] + symbols[at])
            if at < len(ranks):
                ranks[at] = scores.get(symbols[at] + symbols[at + 1])
            border -= at < border

    def _next_shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix."""
        if piece not in self._shorter:
            ends = range(len(piece) - 1, 0, -1)
            self._shorter[piece] = next((piece[:e] for e in ends if piece[:e] in self.ids), None)
        return self._shorter[piece]

    def split(self, run: str) -> list[str]:
        """The pieces of a run of characters that all have a piece."""
        size = len(run)
        longest: list[str | None] = [None] * size
        for last, (before, piece) in self.matcher.iter(run):
            longest[last - before] = piece  # ends ascend, so the longest comes last
        open_ = bytearray(b"\1") * (size + 1)  # positions not known to fail
        pairs, out = self._pairs, []
        at, piece, last = 0, longest[0], None
        while at < size:
            while piece is not None:
                if open_[at + len(piece)]:
                    if last is None:
                        break
                    fits = pairs.get((last, piece))
                    if self.compatible(last, piece) if fits is None else fits:
                        break
                piece = self._next_shorter(piece)
            if piece is not None:
                out.append(piece)
                at += len(piece)
                last, piece = piece, longest[at] if at < size else None
            else:
                open_[at] = 0
                if last is None:
                    raise ValueError("no encoding")
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
        return out

    def _run(self, run: str) -> bytes:
        """Ids of characters that all stand side by side in pieces."""
        known = self._runs.get(run)
        if known is None:
            if len(self._runs) >= CACHED:
                self._runs.clear()
            if len(run) > 1 or run in self.ids:
                ids = [self.ids[p] for p in self.split(run)]
            else:
                values = [self.bytes.get(b) for b in run.encode()]
                ids = [self.unknown_id] if None in values else values
            known = self._runs[run] = array("i", ids).tobytes()
        return known

    def _part(self, part: str) -> bytes:
        """Ids of a part between line ends and starts of white space."""
        neighbours, out, start = self.neighbours, [], 0
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in neighbours:
                out.append(self._run(part[start:i]))
                start = i
        out.append(self._run(part[start:]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids with the end id, as 32-bit numbers."""
        end = array("i", [self.end_id]).tobytes()
        if not text:
            return end
        if len(self._parts) >= CACHED:
            self._parts.clear()
        known = self._parts
        parts = _PARTS.findall(SPACE + text.replace(" ", SPACE))
        for part in parts:
            if part not in known:
                known[part] = self._part(part)
        return b"".join(map(known.__getitem__, parts)) + end

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: white space signs become spaces, the one in front goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return _text(raw.removeprefix(b" "))


_PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def _text(raw: bytes) -> str:
    """UTF-8, with one replacement sign for each byte that is none."""
    try:
        return raw.decode()
    except UnicodeDecodeError as error:
        return raw[: error.start].decode() + "�" + _text(raw[error.start + 1 :])


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One set of tables per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_and_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids and decoded: the ids of each text with the end id, as the library of the
    model's kind gives them, and the text that these ids stand for.

    One row per input row, in one pass without a shuffle; whole texts. Null counts as
    empty: the end id alone. An empty table gives an empty result. Only key and text are
    read. ``model`` is a file that every executor has at that path.
    """
    held = docs.select(named(key), named(text))
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            # some megabytes of text at a time
            for part in _slices(batch):
                blobs = [pieces.encode(t or "") for t in part.column(1).to_pylist()]
                flat = np.frombuffer(b"".join(blobs), dtype=np.int32)
                ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
                decoded = [pieces.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(decoded, pa.string())], names=[key, "ids", "decoded"]
                )

    return held.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
