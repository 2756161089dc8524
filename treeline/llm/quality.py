"""Quality classifier: a byte-level convolutional network in numpy.

A byte enters as a learned vector of its value and of whether the four bytes from it on
also stand a little before. Learned filters read overlapping chunks of 32 bytes, one every
8, from the first byte to the last; each filter's maximum over the document goes through
one hidden layer into one probability. Weights are fitted by one task, on a bounded sample
of labelled rows, and sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.fitting import bounded_sample, fitted, whole_within
from treeline.llm.tokens import named

BLOCK, BLOCKS = 8, 4  # bytes of a step, steps of a chunk
WIDTH, FILTERS, HIDDEN = 8, 32, 16
_NONE = 512  # the symbol behind the end of a text
_LAGS = range(3, 25)
#: The fit reads at most so many labelled rows of each class, whole, and of both classes
#: together at most so many bytes, but for one row.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 12 << 20
EPOCHS, BATCH = 8, 32
THRESHOLD = 0.3


@dataclass
class Weights:
    vectors: np.ndarray  # symbol x WIDTH
    filters: np.ndarray  # chunk position x WIDTH, by filter
    shift: np.ndarray
    inner: np.ndarray
    inner_shift: np.ndarray
    outer: np.ndarray
    outer_shift: np.ndarray

    def all(self) -> list[np.ndarray]:
        return list(self.__dict__.values())


def fresh(seed: int = 7) -> Weights:
    rng, chunk = np.random.default_rng(seed), BLOCK * BLOCKS * WIDTH
    draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    zero = lambda n: np.zeros(n, dtype=np.float32)
    return Weights(
        draw(_NONE + 1, WIDTH, scale=0.5), draw(chunk, FILTERS, scale=chunk**-0.5), zero(FILTERS),
        draw(FILTERS, HIDDEN, scale=FILTERS**-0.5), zero(HIDDEN), draw(HIDDEN, scale=HIDDEN**-0.5), zero(1),
    )


def symbols(text: bytes) -> np.ndarray:
    """One symbol per byte, filled up to whole blocks and to one chunk at least."""
    raw = np.frombuffer(text, dtype=np.uint8)
    out = np.full(max(BLOCKS, -(-len(raw) // BLOCK)) * BLOCK, _NONE, dtype=np.int16)
    out[: len(raw)] = raw
    if len(raw) > 4:
        four = raw[:-3].astype(np.uint32)
        for i in range(1, 4):
            four |= raw[i : len(raw) - 3 + i].astype(np.uint32) << (8 * i)
        again = np.zeros(len(four), dtype=bool)
        for lag in _LAGS:
            if lag < len(four):
                again[lag:] |= four[lag:] == four[:-lag]
        out[: len(four)] += again.astype(np.int16) * 256
    return out


def _chunks(w: Weights, flat: np.ndarray) -> np.ndarray:
    """Filter values of the chunk that starts at each block (the last ones are incomplete)."""
    blocks = w.vectors[flat].reshape(-1, BLOCK * WIDTH)
    n, step = len(blocks) - BLOCKS + 1, BLOCK * WIDTH
    out = blocks[:n] @ w.filters[:step]
    for j in range(1, BLOCKS):
        out += blocks[j : j + n] @ w.filters[j * step : (j + 1) * step]
    return out


def _combine(w: Weights, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ w.inner + w.inner_shift, 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w.outer + w.outer_shift, -30, 30)))


def _pool(w: Weights, docs: list[np.ndarray]) -> np.ndarray:
    ends = np.cumsum([len(d) // BLOCK for d in docs])
    starts = ends - [len(d) // BLOCK for d in docs]
    values = _chunks(w, np.concatenate(docs))
    edges = np.column_stack([starts, ends - BLOCKS + 1]).ravel()
    # one row more, so that the last edge may be the end
    most = np.maximum.reduceat(np.concatenate([values, values[-1:]]), edges, axis=0)[::2]
    return np.maximum(most + w.shift, 0)


#: Symbols looked at together; a longer text goes through in pieces that overlap.
_TOGETHER = 1 << 18


def scores(w: Weights, texts: list[bytes]) -> np.ndarray:
    """A probability for each whole text."""
    pooled = np.zeros((len(texts), FILTERS), dtype=np.float32)
    held: list[np.ndarray] = []
    of: list[int] = []

    def flush() -> None:
        if held:
            np.maximum.at(pooled, of, _pool(w, held))
            held.clear()
            of.clear()

    size = 0
    for i, text in enumerate(texts):
        all_ = symbols(text)
        for start in range(0, max(1, len(all_) - (BLOCKS - 1) * BLOCK), _TOGETHER):
            held.append(all_[start : start + _TOGETHER + (BLOCKS - 1) * BLOCK])
            of.append(i)
            size += len(held[-1])
            if size > _TOGETHER:
                flush()
                size = 0
    flush()
    return _combine(w, pooled)[1]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Weights:
    """Adam on the log loss; both classes weigh the same. A maximum passes its gradient to
    the one chunk it came from."""
    w, rng = fresh(seed), np.random.default_rng(seed)
    if not len(texts):
        return w
    docs = [symbols(t) for t in texts]
    y = np.asarray(labels, dtype=np.float32)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    momentum, square, step = [np.zeros_like(p) for p in w.all()], [np.zeros_like(p) for p in w.all()], 0
    chunk = np.arange(BLOCK * BLOCKS)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), BATCH):
            part = order[first : first + BATCH]
            pooled, picked = np.zeros((len(part), FILTERS), np.float32), np.zeros((len(part), FILTERS, len(chunk)), np.int16)
            for row, d in enumerate(part):
                values = _chunks(w, docs[d])
                at = values.argmax(axis=0)
                pooled[row] = values[at, range(FILTERS)] + w.shift
                picked[row] = docs[d][at[:, None] * BLOCK + chunk]
            live = np.maximum(pooled, 0)
            hidden, p = _combine(w, live)
            error = (p - y[part]) * weight[part] / len(part)
            d_hidden = np.outer(error, w.outer) * (hidden > 0)
            d_pooled = (d_hidden @ w.inner.T) * (pooled > 0)
            seen = w.vectors[picked].reshape(len(part), FILTERS, -1)
            d_vectors = np.zeros_like(w.vectors)
            back = d_pooled[:, :, None, None] * w.filters.T.reshape(1, FILTERS, len(chunk), WIDTH)
            np.add.at(d_vectors, picked.ravel(), back.reshape(-1, WIDTH))
            slopes = [
                d_vectors, np.einsum("df,dfx->xf", d_pooled, seen), d_pooled.sum(0), live.T @ d_hidden,
                d_hidden.sum(0), hidden.T @ error, np.array([error.sum()], np.float32),
            ]
            step += 1
            rate = 0.004 * min(1.0, 2 * (1 - epoch / epochs))
            for value, m, v, g in zip(w.all(), momentum, square, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(key: str) -> Column:
    """Rows never learned from: the CRC-32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(named(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES, epochs: int = EPOCHS,
) -> Weights:
    """Weights fitted on at most ``rows`` labelled rows of each class that are not held out,
    chosen by a hash of the key, as far as their whole texts have ``most`` bytes in all. Labels
    other than 0 and 1, and null keys, are not used; without labels the weights stay as drawn."""
    known = labels.select(named(key).alias("k"), named(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~held_out("k")).dropDuplicates(["k"])
    present = docs.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t"))
    chosen = None
    for y in (0, 1):
        part = bounded_sample(known.filter(F.col("y") == y), rows, "k")
        chosen = part if chosen is None else chosen.unionByName(part)
    found = present.join(F.broadcast(chosen), "k").select(F.col("k").cast("string").alias("k"), "t", "y").dropDuplicates(["k"])
    return fitted(
        whole_within(found, most, F.octet_length("t") + 1, "k"),
        lambda rows: fit([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]), epochs),
    )


def scored(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score: the probability that each whole text has label 1.

    One row per input row, in one pass without a shuffle. Null counts as empty; empty texts
    get the score of an empty chunk. Only key and text are read. An empty table gives an
    empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [v.as_py() or b"" for v in part.column(1).cast(pa.large_binary())]
                found = scores(w, texts).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=[key, "score"])

    return docs.select(named(key), named(text)).mapInArrow(run, schema)


def kept(docs: DataFrame, weights: Weights, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores at least ``threshold``."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(weights), docs.schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [v.as_py() or b"" for v in part.column(place).cast(pa.large_binary())]
                yield part.filter(pa.array(scores(w, texts) >= threshold))

    return docs.mapInArrow(run, schema)
