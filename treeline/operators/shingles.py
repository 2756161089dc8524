"""Word shingles of many texts at once as 64-bit hashes, and tables of fixed size about hashes.

Texts come as bytes in lower case. Words are what spaces, tabs and line ends separate; a shingle
is a run of three words, and a text of one or two words is a run of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = 3
#: Buckets of the corpus-wide shingle counts that order the shingles, a byte each for a task.
BUCKETS = 1 << 22
#: Parts in which these counts are summed up.
_PARTS = 256
#: Bytes of text and number of hashes that are handled at once.
_BYTES_AT_ONCE, _HASHES_AT_ONCE = 1 << 18, 1 << 20
#: Powers of two: the bits of a table about hashes, at least and at most (32 MB).
_LEAST_BITS, _MOST_BITS = 16, 28
#: Hashes of which a task sees which ones come several times.
_HASHES_PER_SLICE = 1 << 21

_TO_SPACE = bytes.maketrans(b"\t\r\n", b"   ")
_SPACES = re.compile(b"  +")
_STEP, _STEP_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_VALUES = np.random.default_rng(20260104).integers(1, 1 << 64, 256, dtype=np.uint64)
_FACTORS = np.random.default_rng(20260105).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    spaced = text.translate(_TO_SPACE)
    return (_SPACES.sub(b" ", spaced) if b"  " in spaced else spaced).strip(b" ")


def digest(words: bytes) -> bytes:
    return hashlib.sha256(words).digest()


class _Powers:
    """Powers of the word hash's step and of its inverse, as many as the longest piece needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_STEP, have, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_STEP_INVERSE, have, 1 << 64))])


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(words: bytes) -> np.ndarray:
    """Every word hashed, where single spaces separate them."""
    raw = np.frombuffer(words + b" ", dtype=np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    _POWERS.need(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * _POWERS.up[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _POWERS.down[starts])


def _pieces(words: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(words) - at > 2 * _BYTES_AT_ONCE and (end := words.find(b" ", at + _BYTES_AT_ONCE)) >= 0:
        yield words[at:end]
        at = end + 1
    yield words[at:]


def _runs(each: np.ndarray, size: int) -> np.ndarray:
    h = np.full(max(0, len(each) - size + 1), size, dtype=np.uint64)
    for j in range(size):
        h += each[j : len(each) - size + 1 + j] * _FACTORS[j]
    return _mix(h)


def shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The shingles of each of these plain texts, none of them empty, as they come in it."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _BYTES_AT_ONCE):
            size, to = size + len(texts[to]), to + 1
        counts = [t.count(b" ") + 1 for t in texts[at:to]]
        if to == at + 1:
            each = np.concatenate([_words(p) for p in _pieces(texts[at])])
        else:
            each = _words(b" ".join(texts[at:to]))
        runs, first = _runs(each, WORDS), 0
        for n in counts:
            yield runs[first : first + n - WORDS + 1] if n >= WORDS else _runs(each[first : first + n], n)
            first += n
        at = to


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


# -- counts by bucket


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


class Counts:
    """How many hashes fell in each bucket."""

    def __init__(self):
        self.total, self.held, self.size = np.zeros(BUCKETS, dtype=np.uint32), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.size += len(h)
        if self.size > _HASHES_AT_ONCE:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.total += np.bincount(_bucket(np.concatenate(self.held)), minlength=BUCKETS).astype(np.uint32)
            self.held, self.size = [], 0

    def packed(self) -> list[bytes]:
        self.settle()
        return [zlib.compress(x.tobytes(), 1) for x in self.total.reshape(_PARTS, -1)]


def levels(parts: DataFrame) -> bytes:
    """From rows (part, counts) of all tasks a byte for each bucket that sorts like its count.
    The table reaches the driver; its size is fixed."""

    def level(rows: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // _PARTS, dtype=np.int64)
        for packed in rows["counts"]:
            total += np.frombuffer(zlib.decompress(packed.as_py()), dtype="<u4")
        grade = np.minimum(255, np.round(8 * np.log2(total + 1))).astype(np.uint8)
        return pa.table({"part": rows["part"].slice(0, 1).combine_chunks(), "grade": pa.array([grade.tobytes()], pa.binary())})

    out = np.zeros((_PARTS, BUCKETS // _PARTS), dtype=np.uint8)
    for row in parts.select("part", "counts").groupBy("part").applyInArrow(level, "part int, grade binary").collect():
        out[row.part] = np.frombuffer(row.grade, dtype=np.uint8)
    return out.tobytes()


def rare_first(h: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Distinct shingles in the order of these levels, which is the same for all texts."""
    h = distinct(h)
    return h[np.argsort(grades[_bucket(h)], kind="stable")]


# -- which hashes there are


class Bits:
    """A bit for each group of hashes, to be sent to tasks."""

    def __init__(self, table: bytes, power: int):
        self.table, self.power = table, power

    def of(self, h: np.ndarray) -> np.ndarray:
        place = (h >> np.uint64(64 - self.power)).astype(np.int64)
        return np.frombuffer(self.table, dtype=np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def bits(rows: DataFrame, count: int, several: bool = False) -> Bits:
    """Which hashes there are in a column of numbers, or of packed hashes; or of those that come
    ``several`` times, and few others. ``count`` is about how many there are. A task sends four bytes
    for each; the table has a size that does not depend on their number from some on."""
    power = min(_MOST_BITS, max(_LEAST_BITS, math.ceil(math.log2(16 * count + 1))))
    cut = min(12, max(4, math.ceil(math.log2(count / _HASHES_PER_SLICE + 1))))
    (name, kind), = rows.dtypes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held) >> np.uint64(32 - cut), return_counts=True)
            if several:
                h = np.repeat(h, np.minimum(times, 2))
            ends = np.searchsorted(h, np.arange(1 << cut, dtype=np.uint64) << np.uint64(32))
            parts = np.split(h.astype("<u4"), ends[1:])
            found = [(i, x.tobytes()) for i, x in enumerate(parts) if len(x)]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["slice", "hashes"])

        for batch in batches:
            if kind == "binary":
                h = np.frombuffer(b"".join(batch.column(0).drop_null().to_pylist()), dtype="<u8")
            else:
                h = batch.column(0).drop_null().to_numpy().view(np.uint64)
            held.append(h)
            size += len(h)
            if size > _HASHES_AT_ONCE:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def mark(group: pa.Table) -> pa.Table:
        h = np.sort(np.frombuffer(b"".join(group["hashes"].to_pylist()), dtype="<u4"))
        if several:
            h = h[1:][h[1:] == h[:-1]]
        there = np.zeros(1 << (power - cut), dtype=np.uint8)
        there[h >> np.uint32(32 - power + cut)] = 1
        return pa.table({"slice": group["slice"].slice(0, 1).combine_chunks(),
                         "bits": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

    dealt = rows.select(name).mapInArrow(deal, "slice int, hashes binary")
    table = np.zeros((1 << cut, 1 << (power - cut) >> 3), dtype=np.uint8)
    for row in dealt.groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect():
        table[row.slice] = np.frombuffer(row.bits, dtype=np.uint8)
    return Bits(table.tobytes(), power)


# -- pairs of texts


def squeezed(text: bytes) -> bytes:
    """A plain text in few bytes: a third of what its hashes take."""
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(text, asbytes=True)


def whole(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the sets numbered a and b share, pair by pair; each set is looked up
    in a table of marks for all its partners at once."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    marks, out = np.zeros(len(known), dtype=bool), np.zeros(len(a), dtype=np.int64)
    order = np.argsort(a, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1], [True]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x = a[order[i]]
        own = place[first[x] : first[x + 1]]
        marks[own] = True
        part = np.cumsum(sizes[b[order[i:j]]]) // _HASHES_AT_ONCE
        for at in np.split(order[i:j], np.flatnonzero(np.diff(part)) + 1):
            met = marks[np.concatenate([place[first[y] : first[y + 1]] for y in b[at].tolist()])]
            out[at] = np.add.reduceat(met, np.concatenate([[0], np.cumsum(sizes[b[at]])[:-1]]), dtype=np.int64)
        marks[own] = False
    return out
