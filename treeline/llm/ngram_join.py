"""Exact Jaccard join on word n-grams with rare-first prefix filtering.

1. Texts become sets of hashed n-grams; rows with equal sets become one node.
2. Sketches of fixed size count n-grams and words over the whole corpus. Each set is
   ordered rare-first by them: n-grams that are frequent themselves last, the others by how
   rare their words are (the order need not be perfect, only the same for all). The prefix
   that two similar sets cannot both miss is posted.
3. Postings meet on prefix n-grams. A pair has to pass the length filter, the positional
   filter and the suffix filter (what stands behind the common n-gram in either set is dealt
   into parts by hash, and the parts' parities bound the difference from below), the same
   with finer parities of the whole sets, and a comparison of how many elements either set has
   in each part of a division as fine as the set is large, before it is verified, once, on both sets.
4. First every node is compared with the best centre of its lists, which joins most of a
   large group without pairing it up. Then all remaining pairs between different groups
   are compared, so no link between groups is lost. Links inside a group are implied.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.exact_dedup import one_row
from treeline.llm.tokens import named
from treeline.operators.components import components
from treeline.session import cut_lineage

#: Buckets of the corpus-wide counts, of n-grams and of words: 2 MB each are sent to the
#: tasks, however large the corpus is.
SKETCH = 1 << 20
#: Longs of the parities of whole sets: parts of a set, one bit each.
PARITY = 8
#: Postings of one n-gram that a task pairs up; more become a grid of tasks.
GRID = 20_000
#: Pairs with one set that a task verifies; more are spread.
PAIRS_PER_SET = 5_000
#: Bits by which the later passes over the texts skip n-grams that only one set has, and
#: sets that no pair needs.
WANTED_BITS = 1 << 26
#: Sets a task remembers so as to post equal ones once.
_REMEMBERED = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP, _STEP_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)[_LOWER]


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles are linked from Jaccard ``num`` / ``den`` on."""

    words: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, n: int) -> int:
        """How many of the first elements two linked sets cannot both miss."""
        return n - -(-self.num * n // self.den) + 1


class _Powers:
    """Powers of the word hash's step and of its inverse, as many as the longest text needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_STEP, have, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_STEP_INVERSE, have, 1 << 64))])


_POWERS = _Powers()


def _mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15 + salt & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes, seed: int = 0) -> np.ndarray:
    """The hashed words of a UTF-8 text in order. A-Z count as a-z; words are what ASCII
    white space separates."""
    raw = np.frombuffer(b" %b " % text, dtype=np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    _POWERS.need(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _POWERS.up[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _POWERS.down[starts], seed)


_FACTORS = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(each: np.ndarray, words: int) -> np.ndarray:
    """The hashed shingle at each place. With fewer words, the whole sequence is the one."""
    size = min(words, len(each))
    places = len(each) - size + 1
    h = np.full(places if size else 0, size, dtype=np.uint64)
    for j in range(size):
        if j and not j % len(_FACTORS):
            h = _mix(h)
        h += each[j : places + j] * _FACTORS[j % len(_FACTORS)]
    return _mix(h)


def shingle_set(text: bytes, words: int, seed: int = 0) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending; none without words."""
    return _distinct(_windows(word_hashes(text, seed), words))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _print_of(grams: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit prints of a set; its elements are mixed already."""
    with np.errstate(over="ignore"):
        total = grams.sum(dtype=np.uint64)
        other = np.bitwise_xor.reduce((grams ^ (grams >> np.uint64(29))) * _FACTORS[0], initial=0)
    return tuple(_mix(np.array([total, other], dtype=np.uint64)).astype(np.int64).tolist())


def _parities(grams: np.ndarray) -> np.ndarray:
    odd = np.bincount((grams >> np.uint64(7) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _histogram(grams: np.ndarray) -> bytes:
    """How many elements a set has in each of about a quarter as many parts; a smaller division
    is a sum of this one. Nothing where a part has too many."""
    size = max(64, 1 << (len(grams) // 4).bit_length())
    counts = np.bincount((grams >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _least_difference(a: bytes, b: bytes) -> int:
    """What two sets with these histograms differ by at least."""
    size = min(len(a), len(b))
    if not size:
        return 0
    one, other = (np.frombuffer(x, dtype=np.uint8).reshape(-1, size).sum(axis=0, dtype=np.int64) for x in (a, b))
    return int(np.abs(one - other).sum())


def _tails(grams: np.ndarray) -> np.ndarray:
    """For each place of an ordered set the parities, in 64 parts, of what stands behind it."""
    bits = np.uint64(1) << (grams >> np.uint64(9) & np.uint64(63))
    return np.append(np.bitwise_xor.accumulate(bits[::-1])[::-1][1:], np.uint64(0))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    """UTF-8 of each row, null as empty, without making strings of them."""
    array = batch.column(column).cast(pa.large_binary())
    for value in array:
        yield value.as_py() or b""


_DOCS = T.StructType([
    T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType()),
    *[T.StructField(f"p{i}", T.LongType()) for i in range(PARITY)],
    T.StructField("whole", T.LongType()), T.StructField("hist", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])


def _survey(docs: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """For rows (key, text): its set's size, prints and parities, and a hash of its text; per task one row
    with its counts of n-grams and of words by bucket (compressed) instead."""
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), *_DOCS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * SKETCH, dtype=np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows, grams_held, words_held, size = [], [], [], 0
            for t in _texts(batch, 1):
                each = word_hashes(t, seed)
                grams = _distinct(_windows(each, rule.words))
                rows.append((len(grams), *_print_of(grams), *_parities(grams).tolist(), _hash_of(t), _histogram(grams)))
                grams_held.append(grams)
                words_held.append(each)
                size += len(each)
                if size > 1 << 20:
                    _add_counts(counts, grams_held, words_held)
                    grams_held, words_held, size = [], [], 0
            _add_counts(counts, grams_held, words_held)
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:-1]],
                 pa.array(columns[-1], pa.binary()), pa.nulls(len(rows), pa.binary())], names=schema.fieldNames())
        if kind is not None:
            packed = zlib.compress(counts.astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * (3 + PARITY),
                 pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names=schema.fieldNames())

    return docs.select("key", "text").mapInArrow(run, schema)


def _hash_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _add_counts(counts: np.ndarray, grams: list[np.ndarray], words: list[np.ndarray]) -> None:
    for half, held in ((counts[:SKETCH], grams), (counts[SKETCH:], words)):
        if held:
            half += np.bincount(_bucket(np.concatenate(held)), minlength=SKETCH)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def _levels(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What orders n-grams: for each bucket of n-grams 0, or a level if it holds far more than
    the mean, and for each bucket of words a level. 2 * SKETCH small numbers reach the driver."""
    def summed(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(2 * SKETCH, dtype=np.int64)
        for batch in batches:
            for packed in batch["counts"]:
                total += np.frombuffer(zlib.decompress(packed), dtype="<i8")
        return total

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"counts": [zlib.compress(summed(batches).astype("<i8").tobytes(), 1)]})

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = summed(batches)
        level = np.round(256 * np.log2(total + 1)).astype("<u2")
        often = total[:SKETCH] > 4 * total[:SKETCH].mean() + 16
        level[:SKETCH] = np.where(often, level[:SKETCH], 0)
        yield pd.DataFrame({"levels": [zlib.compress(level.tobytes(), 1)]})

    parts = survey.filter("counts IS NOT NULL").select("counts")
    # in two steps of about as many tables each
    first = parts.repartition(max(1, math.isqrt(parts.count()))).mapInPandas(add, "counts binary")
    found = first.coalesce(1).mapInPandas(rank, "levels binary").collect()
    level = np.frombuffer(zlib.decompress(found[0][0]), dtype="<u2") if found else np.zeros(2 * SKETCH, dtype="<u2")
    return level[:SKETCH], level[SKETCH:]


def _rare_first(each: np.ndarray, rule: Rule, levels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The distinct shingles of a text's words in the order of the whole corpus."""
    h = _windows(each, rule.words)
    size = min(rule.words, len(each))
    word = levels[1][_bucket(each)].astype(np.int64)
    often = sum(word[j : len(h) + j] for j in range(size))
    place = np.argsort(h, kind="stable")
    h = h[place]
    once = np.concatenate([[True], h[1:] != h[:-1]])
    h, often = h[once], often[place][once]
    return h[np.lexsort((h, often, levels[0][_bucket(h)]))]


def _postings(docs: DataFrame, rule: Rule, seed: int, levels, shared=None) -> DataFrame:
    """(gram, fp, n, at, tail) of each prefix n-gram, as far as the bits of ``shared`` have it.
    Equal sets are posted once per task."""
    names = ["gram", "fp", "n", "at", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, bits = levels.value, set(), shared.value if shared else None
        for batch in batches:
            out: list[tuple] = []
            for t in _texts(batch, 0):
                whole = _hash_of(t)
                if whole in seen:
                    continue
                if len(seen) < _REMEMBERED:
                    seen.add(whole)
                each = word_hashes(t, seed)
                if len(each):
                    grams = _rare_first(each, rule, known)
                    at = np.arange(rule.prefix(len(grams)), dtype=np.int32)
                    if bits is not None:
                        place = (grams[: len(at)] & np.uint64(WANTED_BITS - 1)).astype(np.int64)
                        at = at[bits[place >> 6] >> (place & 63) & 1 == 1]
                    if len(at):
                        out.append((grams[at], _print_of(grams)[0], len(grams), _tails(grams)[at], at))
            if out:
                sizes = [len(g) for g, *_ in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([g for g, *_ in out]).view(np.int64)),
                    pa.array(np.repeat(np.array([f for _, f, *_ in out], dtype=np.int64), sizes)),
                    pa.array(np.repeat(np.array([n for _, _, n, *_ in out], dtype=np.int32), sizes)),
                    pa.array(np.concatenate([at for *_, at in out])),
                    pa.array(np.concatenate([t for *_, t, _ in out]).view(np.int64)),
                ], names=names)

    return docs.select("text").mapInArrow(run, "gram bigint, fp bigint, n int, at int, tail bigint")


def _room(rule: Rule, a: str, b: str) -> Column:
    """Twice the difference two linked sets of these sizes may have is (num + den) times less."""
    return (F.col(a).cast("bigint") + F.col(b)) * (rule.den - rule.num)


def _near(rule: Rule, na: str, nb: str, difference: Column) -> Column:
    """Whether sets with at least this symmetric difference may be linked."""
    return difference * (rule.num + rule.den) <= _room(rule, na, nb)


def _positional(rule: Rule, na: str, ia: str, nb: str, ib: str) -> Column:
    most = F.least(ia, ib) + F.lit(1) + F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib)) - 1
    return _near(rule, na, nb, F.col(na) + F.col(nb) - most * 2)


def _length(rule: Rule, na: str, nb: str) -> Column:
    return _near(rule, na, nb, F.abs(F.col(na) - F.col(nb)))


def _suffix(rule: Rule, a: str, b: str) -> Column:
    """In front of the common n-gram the sets differ at least by the places' distance, and
    behind it by the parts whose parities differ: both are in the same order."""
    behind = F.bit_count(F.col(f"{a}tail").bitwiseXOR(F.col(f"{b}tail")))
    return _near(rule, f"{a}n", f"{b}n", F.abs(F.col(f"{a}at") - F.col(f"{b}at")) + behind)


def _parity(rule: Rule, a: str, b: str) -> Column:
    differing = sum(
        (F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))) for i in range(1, PARITY)),
        F.bit_count(F.col(f"{a}p0").bitwiseXOR(F.col(f"{b}p0"))),
    )
    return _near(rule, f"{a}n", f"{b}n", differing)


def _side(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(prefix + c) for c in ("fp", "n", *[f"p{i}" for i in range(PARITY)])])


def _wanted(hashes: DataFrame) -> np.ndarray:
    """A bit per hash in the column ``whole``; WANTED_BITS bits reach the driver."""
    word = F.shiftright(F.col("whole").bitwiseAND(F.lit(WANTED_BITS - 1)), 6)
    bits = F.expr("bit_or(shiftleft(1L, cast(whole & 63 AS int)))")
    words = hashes.groupBy(word.alias("w")).agg(bits.alias("bits")).toPandas()
    out = np.zeros(WANTED_BITS // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out


def _sets(docs: DataFrame, text: str, rule: Rule, seed: int, wanted) -> DataFrame:
    """(fp, grams) of the sets that pairs may need, made again from the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            prints, sets = [], []
            for t in _texts(batch, 0):
                whole = _hash_of(t)
                bit = whole & (WANTED_BITS - 1)
                if whole in seen or not int(bits[bit >> 6]) >> (bit & 63) & 1:
                    continue
                if len(seen) < _REMEMBERED:
                    seen.add(whole)
                grams = shingle_set(t, rule.words, seed)
                if len(grams):
                    prints.append(_print_of(grams)[0])
                    sets.append(grams.view(np.int64))
            if prints:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    names=["fp", "grams"])

    return docs.select(text).mapInArrow(run, "fp bigint, grams array<bigint>")


def _close(pairs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that their sets' histograms do not rule out; those are far smaller than the sets."""
    ends = pairs.select(F.explode(F.array("a_fp", "b_fp")).alias("fp")).distinct()
    known = rows.select("fp", "n", "hist").join(ends, "fp", "left_semi").dropDuplicates(["fp"])
    both = pairs.join(known.toDF("a_fp", "a_n", "a_hist"), "a_fp").join(known.toDF("b_fp", "b_n", "b_hist"), "b_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, na, nb, ha, hb = (c.to_pylist() for c in batch.columns)
            keep = [_least_difference(x, y) * (rule.num + rule.den) <= (m + n) * (rule.den - rule.num)
                    for m, n, x, y in zip(na, nb, ha, hb, strict=True)]
            yield batch.select(["a_fp", "b_fp"]).filter(pa.array(keep, pa.bool_()))

    held = both.select("a_fp", "b_fp", "a_n", "b_n", "a_hist", "b_hist").mapInArrow(run, "a_fp bigint, b_fp bigint")
    return cut_lineage(held)


def _verified(docs: DataFrame, text: str, rule: Rule, seed: int, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a_fp, b_fp) that are linked; each is compared once."""
    spark = docs.sparkSession
    ends = pairs.select(F.posexplode(F.array("a_fp", "b_fp")).alias("side", "fp")).groupBy("fp").agg(F.sum("side").alias("pairs"))
    ends = cut_lineage(ends)
    wanted = spark.sparkContext.broadcast(_wanted(nodes.join(ends, "fp", "left_semi").select("whole")))
    held = cut_lineage(_sets(docs, text, rule, seed, wanted))
    wanted.unpersist()
    # equal sets of several tasks go before anything is joined
    sets = held.join(ends.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    left, right, on = pairs, sets.select(F.col("fp").alias("b_fp"), F.col("grams").alias("gb")), ["b_fp"]
    hot = ends.filter(F.col("pairs") > PAIRS_PER_SET).select(
        F.col("fp").alias("b_fp"), F.ceil(F.col("pairs") / PAIRS_PER_SET).cast("int").alias("slots"))
    if not hot.isEmpty():  # a centre of very many pairs is copied for several tasks
        slots, on = F.coalesce("slots", F.lit(1)), ["b_fp", "slot"]
        left = left.join(hot, "b_fp", "left").withColumn("slot", F.pmod(F.xxhash64("a_fp"), slots).cast("int")).drop("slots")
        right = right.join(hot, "b_fp", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("slots")
    both = left.join(sets.select(F.col("fp").alias("a_fp"), F.col("grams").alias("ga")), "a_fp").join(right, on)
    both = both.withColumn("common", F.size(F.array_intersect("ga", "gb")))
    union = F.size("ga") + F.size("gb") - F.col("common")
    linked = both.filter(F.col("common").cast("bigint") * rule.den >= union.cast("bigint") * rule.num)
    return cut_lineage(linked.select("a_fp", "b_fp"))


def _labelled(postings: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return postings.withColumn("comp", F.col("fp"))
    return postings.join(groups.select(F.col("node").alias("fp"), F.col("component").alias("comp")), "fp", "left").withColumn(
        "comp", F.coalesce("comp", "fp"))


def _centres(labelled: DataFrame) -> DataFrame:
    """Lists with more than one group, and their centre: the set for which the n-gram is
    rarest, as that has the fewest elements of its own."""
    return (
        labelled.groupBy("gram")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("at", "n", "fp", "comp", "tail")).alias("c"),
             F.ceil(F.count(F.lit(1)) / GRID).cast("int").alias("slots"))
        .filter("c0 <> c1").select("gram", "c", "slots")
    )


def _star_pairs(postings: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """For every set the one centre that it shares most prefix n-grams with, of those that
    pass the filters."""
    labelled = _labelled(postings, None)
    met = labelled.join(_centres(labelled), "gram").filter("fp <> c.fp").select(
        *[F.col(c).alias(f"a_{c}") for c in ("fp", "n", "at", "tail")], *[F.col(f"c.{c}").alias(f"b_{c}") for c in ("fp", "n", "at", "tail")])
    met = met.filter(_length(rule, "a_n", "b_n") & _positional(rule, "a_n", "a_at", "b_n", "b_at") & _suffix(rule, "a_", "b_"))
    pairs = met.groupBy("a_fp", "b_fp").agg(F.count(F.lit(1)).alias("shared"))
    filtered = (
        pairs.join(_side(nodes, "a_"), "a_fp").join(_side(nodes, "b_"), "b_fp").filter(_parity(rule, "a_", "b_"))
    )
    best = filtered.groupBy("a_fp").agg(F.max(F.struct("shared", "b_fp")).alias("best"))
    return best.select(F.least("a_fp", "best.b_fp").alias("a_fp"), F.greatest("a_fp", "best.b_fp").alias("b_fp")).distinct()


def _remaining_pairs(postings: DataFrame, nodes: DataFrame, groups: DataFrame, tried: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of sets in different groups that share a prefix n-gram and pass the filters,
    but for those already ``tried``. An n-gram with very many postings becomes a grid of tasks."""
    labelled = _labelled(postings, groups)
    lists = _centres(labelled).select("gram", F.col("c.comp").alias("main"), "slots")
    rows = labelled.select("gram", "fp", "comp", "at", "tail").join(lists, "gram")
    rows = cut_lineage(rows.join(nodes.select("fp", "n", *[f"p{i}" for i in range(PARITY)]), "fp"))
    own, every = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1))

    def side(some: DataFrame, prefix: str, i: Column, j: Column, *more: str) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("gram", "main", "slots")]
        dealt = some.withColumn("i", i).withColumn("j", j)
        return dealt.select("gram", "i", "j", *more, *[F.col(c).alias(f"{prefix}{c}") for c in kept])

    # every pair between groups has an end outside the centre's group
    left, right = side(rows.filter("comp <> main"), "a_", own, every), side(rows, "b_", every, own, "main")
    met = left.alias("l").join(
        right.alias("r"),
        (F.col("l.gram") == F.col("r.gram")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
        & (F.col("a_comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("main")) | (F.col("a_fp") < F.col("b_fp")))
        & _length(rule, "a_n", "b_n") & _positional(rule, "a_n", "a_at", "b_n", "b_at") & _suffix(rule, "a_", "b_")
        & _parity(rule, "a_", "b_"),
    )
    # all that two sets share up to their last common prefix n-gram has been met by now, so
    # only what stands behind it in both can add to the overlap
    first = F.col("a_fp") < F.col("b_fp")
    ordered = met.select(*[
        F.when(first == (side == "a"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"{side}_{c}")
        for side in "ab" for c in ("fp", "n", "at")
    ])
    pairs = ordered.groupBy("a_fp", "b_fp").agg(
        F.count(F.lit(1)).alias("shared"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"),
        F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    most = F.col("shared") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) - 1
    kept = pairs.filter(_near(rule, "a_n", "b_n", F.col("a_n") + F.col("b_n") - most * 2))
    return kept.select("a_fp", "b_fp").join(tried, ["a_fp", "b_fp"], "left_anti")


def linked_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id.

    Two rows are linked when their sets of ``words``-word shingles have a Jaccard similarity
    of at least ``num`` / ``den``; component_id is the least key that links reach, the row's
    own included. Null and empty texts, and texts without words, have an empty set and no
    links. Rows that repeat a key count as rows of their own; null keys take part but are
    never a component's name unless it has no other. An empty table gives an empty result.
    Columns other than key and text are not read. Texts are read three or four times.

    Shingles are compared by 64-bit hashes; should two different sets of the corpus get the
    same 64-bit print, all is hashed anew.
    """
    rule, seed, sc = Rule(words, num, den), 0, docs.sparkSession.sparkContext
    given = docs.select(named(key).alias("key"), named(text).alias("text"))
    while True:
        survey = cut_lineage(_survey(given, rule, seed))
        rows = survey.filter("counts IS NULL")
        nodes = cut_lineage(
            rows.filter("n > 0").groupBy("fp").agg(
                F.min("key").alias("least"), F.min("n").alias("n"), F.min("whole").alias("whole"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(PARITY)],
                ((F.min("fp2") != F.max("fp2")) | (F.min("n") != F.max("n"))).alias("clash"))
        )
        if nodes.filter("clash").isEmpty():
            break
        seed += 1
    levels = sc.broadcast(_levels(survey))
    posted = _postings(given, rule, seed, levels).select("gram", "fp")
    shared = cut_lineage(posted.groupBy("gram").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).filter("f0 <> f1").select("gram"))
    # most n-grams stand in one set only, and need not move again
    bits = sc.broadcast(_wanted(shared.select(F.col("gram").alias("whole"))))
    postings = cut_lineage(_postings(given, rule, seed, levels, bits).join(shared, "gram", "left_semi").distinct())
    levels.unpersist()
    bits.unpersist()
    tried = cut_lineage(_star_pairs(postings, nodes, rule))
    links = _verified(given, "text", rule, seed, _close(tried, rows, rule), nodes)
    groups = cut_lineage(components(links, "a_fp", "b_fp"))
    rest = _close(_remaining_pairs(postings, nodes, groups, tried, rule), rows, rule)
    if not rest.isEmpty():
        more = _verified(given, "text", rule, seed, rest, nodes)
        if not more.isEmpty():
            groups = cut_lineage(components(links.unionByName(more), "a_fp", "b_fp"))
    known = nodes.select("fp", "least").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    names = known.groupBy("component").agg(F.min("least").alias("name"))
    labels = cut_lineage(known.join(names, "component").select("fp", "name"))
    return rows.join(labels, "fp", "left").select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.coalesce("name", "key")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that of the least key, null keys last.

    Rows, not keys, stay or go: other rows under the key of a row that goes are not touched.
    Of rows of one key the text's digest decides, and of rows that repeat key and text the
    least (as JSON where a column has no order). Rows without words have no links and all stay. All columns stay.
    """
    names = docs.columns
    known = F.struct(  # equal rows of it have equal texts, thus one component
        named(key).isNull().alias("none"), named(key).alias("id"),
        F.unhex(F.sha2(F.coalesce(named(text), F.lit("")), 256)).alias("digest"))
    found = linked_documents(docs.select(known.alias("known"), named(text).alias("text")), "known", "text", words, num, den)
    linked = found.filter("n_shingles > 0").groupBy("known").agg(
        F.first("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rest = cut_lineage(linked.select("known", (F.col("known") == F.col("first")).alias("kept"), "n").filter("NOT kept OR n > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), known.alias("known"))

    def met(some: DataFrame, how: str) -> DataFrame:
        some = some.select(*[F.col(f"known.{c}").alias(f"_{c}") for c in ("id", "digest")])
        same = F.col("known.id").eqNullSafe(F.col("_id")) & (F.col("known.digest") == F.col("_digest"))
        return rows.join(some, same, how)

    out = met(rest, "left_anti").select("row")
    again = rest.filter("kept")
    if not again.isEmpty():
        out = out.unionByName(met(again, "left_semi").groupBy("known").agg(one_row("row", docs)).select("row"))
    spare = "_" * (max(map(len, names)) + 1)  # helper names that cannot clash
    return out.select(*[F.col(f"row.`{c}`").alias(f"{spare}{i}") for i, c in enumerate(names)]).toDF(*names)
