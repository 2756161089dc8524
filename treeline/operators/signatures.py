"""64-bit perceptual signatures of ready-made vectors, and pairs within k bits.

A signature is kept as four 16-bit numbers s0..s3.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.columns import as_col
from treeline.skew import skew_self_join

BANDS = ("s0", "s1", "s2", "s3")
_BAND_ROWS = 20_000


def _pack(bits: Column) -> Column:
    """Array of 64 booleans to struct(s0..s3), first bit lowest."""
    def band(n: int) -> Column:
        part = F.slice(bits, 16 * n + 1, 16)
        return F.aggregate(
            F.transform(part, lambda bit, i: F.when(bit, F.pow(F.lit(2.0), i)).otherwise(0.0)),
            F.lit(0.0), lambda acc, x: acc + x,
        ).cast("bigint")

    return F.struct(*[band(n).alias(name) for n, name in enumerate(BANDS)])


def difference_signature(vector: Column | str) -> Column:
    """Bit i: value i is below its right neighbour (the last one's is the first)."""
    v = as_col(vector)
    right = F.concat(F.slice(v, 2, 63), F.slice(v, 1, 1))
    return _pack(F.zip_with(v, right, lambda x, y: x < y))


def average_signature(vector: Column | str) -> Column:
    """Bit i: value i is above the mean."""
    v = as_col(vector)
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / 64
    return _pack(F.transform(v, lambda x: x > mean))


#: The cosines of an eight-point transform, by frequency and place.
COSINES = [math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8) for x in range(8)]


def frequency_signature(vector: Column | str) -> Column:
    """Bit i: coefficient i of the 8 x 8 cosine transform is above the median of all 64."""
    table = F.array(*[F.lit(c) for c in COSINES])

    def product(values: Column, step: Column, first: Column, frequency: Column) -> Column:
        terms = [F.get(values, first + step * x) * F.get(table, frequency * 8 + x) for x in range(8)]
        return reduce(add, terms)

    places = F.sequence(F.lit(0), F.lit(63))
    # along the rows, then along the columns of what that gives
    rows = F.transform(places, lambda i: product(as_col(vector), F.lit(1), F.floor(i / 8).cast("int") * 8, i % 8))
    both = F.transform(F.array(rows), lambda r: F.transform(places, lambda i: product(r, F.lit(8), i % 8, F.floor(i / 8).cast("int"))))
    return F.get(F.transform(both, lambda c: _pack(_above_median(c))), F.lit(0))


def _above_median(values: Column) -> Column:
    def of(ordered: Column) -> Column:
        median = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2
        return F.transform(values, lambda v: v > median)

    return F.get(F.transform(F.array(F.array_sort(values)), of), F.lit(0))


def _blocks(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of k + 2 blocks: signatures within k bits agree in two of them."""
    edges = [64 * i // (k + 2) for i in range(k + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def hamming_pairs(signatures: DataFrame, k: int = 3, limit: int = _BAND_ROWS) -> DataFrame:
    """Pairs (a < b) of distinct signatures that differ in at most k bits, once each.

    The 64 bits are cut into k + 2 blocks. Of these at least two are equal then, so any two
    together are an equi-join key of about 128 / (k + 2) bits; a pair is reported by its
    first two equal blocks. Equal signatures are collapsed to their least id with a count; a
    key shared by many is spread over a grid of tasks. Exact for every k; the larger k, the
    shorter and more numerous the keys.
    """
    if not 0 <= k <= 30:
        raise ValueError("k is a number of bits from 0 to 30")
    reps = signatures.groupBy(*BANDS).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    whole = F.col("s0")
    for n, band in enumerate(BANDS[1:], 1):
        whole = whole.bitwiseOR(F.shiftleft(F.col(band), 16 * n))
    blocks = _blocks(k)
    places = list(combinations(range(len(blocks)), 2))

    def block(bits: Column, n: int) -> Column:
        first, size = blocks[n]
        return F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << size) - 1))

    def key(i: int, j: int) -> Column:
        return block(F.col("bits"), i).bitwiseOR(F.shiftleft(block(F.col("bits"), j), blocks[i][1]))

    keyed = reps.select("id", "copies", whole.cast("bigint").alias("bits")).select(
        F.posexplode(F.array(*[key(i, j) for i, j in places])).alias("place", "value"), "id", "copies", "bits"
    )

    def differing(left: str, right: str) -> Column:
        return F.col(left + "bits").bitwiseXOR(F.col(right + "bits"))

    def accept(left: str, right: str) -> Column:
        differs = [block(differing(left, right), n) != 0 for n in range(len(blocks))]
        first = F.lit(False)
        for at, (i, j) in enumerate(places):
            before = [differs[n] for n in range(j) if n != i]
            first = first | reduce(and_, before, F.col("l.place") == at)
        near = F.bit_count(differing(left, right)) <= k
        return (F.col(left + "id") < F.col(right + "id")) & near & first

    joined = skew_self_join(keyed, ["place", "value"], accept, ["id"], limit)
    return joined.select(
        F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.bit_count(differing("l_", "r_")).alias("distance"),
        F.col("l_copies").alias("copies_a"), F.col("r_copies").alias("copies_b"),
    )
