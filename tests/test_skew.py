"""The skew-safe forms against the plain ones, with limits small enough to split."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from treeline import skew

LIMITS = (3, 10, 1_000_000)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    # key 1 holds a third of the rows, key 2 ten, the rest are spread
    keys = [1] * 200 + [2] * 10 + [rnd.randrange(3, 200) for _ in range(390)]
    rnd.shuffle(keys)
    data = [(k, rnd.randrange(50), i, rnd.choice([None, rnd.randrange(100)])) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "k int, t int, i int, v int").repartition(5).cache()


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", LIMITS)
def test_skew_join(spark, rows, how, limit):
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 150)], "k int, w int")
    plain = rows.join(right, ["k"], how)
    salted = skew.skew_join(rows, right, ["k"], how, ["i"], limit)
    cols = ["k", "i"] + (["w"] if how in ("inner", "left") else [])
    assert listed(salted, *cols) == listed(plain, *cols)


def test_skew_join_with_known_counts(spark, rows):
    right = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    salted = skew.skew_join(rows, right, ["k"], "inner", ["i"], 20, rows_per_key="n")
    assert listed(salted, "i", "n") == listed(rows.join(right, "k"), "i", "n")


@pytest.mark.parametrize("limit", LIMITS)
def test_skew_self_join(rows, limit):
    got = skew.skew_self_join(
        rows.select("k", "i", "t"), ["k"],
        lambda l, r: (F.col(l + "i") < F.col(r + "i")) & (F.col(l + "t") == F.col(r + "t")), ["i"], limit,
    )
    a, b = rows.alias("a"), rows.alias("b")
    want = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.i") < F.col("b.i")))
    assert listed(got, "l_i", "r_i") == listed(want, "a.i", "b.i")


@pytest.mark.parametrize("limit", LIMITS)
def test_fragments_are_ordered_and_whole(rows, limit):
    cut = skew.fragments(rows, ["k"], ["t", "i"], limit).collect()
    assert len(cut) == 600
    for key in {r["k"] for r in cut}:
        mine = sorted((r["t"], r["i"], r["_frag"]) for r in cut if r["k"] == key)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert (min(m[2] for m in mine) >= 0) == (len(mine) > limit)
    if limit == 10:
        assert len({r["_frag"] for r in cut if r["k"] == 1}) > 8


@pytest.mark.parametrize("limit", LIMITS)
def test_running(rows, limit):
    got = skew.running(
        rows, ["k"], ["t", "i"],
        {"s": ("sum", F.col("v")), "n": ("sum", F.lit(1)), "m": ("max", F.struct("v", "i"))}, limit,
    )
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("i", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"),
                       F.max(F.struct("v", "i")).over(w).alias("m"))
    assert listed(got, "i", "s", "n", "m.v", "m.i") == listed(want, "i", "s", "n", "m.v", "m.i")


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("before", [1, 9])
def test_halo(rows, limit, before):
    spread = skew.with_halo(rows, ["k"], ["t", "i"], before, limit)
    local = Window.partitionBy("k", "_frag").orderBy("t", "i").rowsBetween(-before, 0)
    got = spread.withColumn("f", F.first("i").over(local)).filter(~F.col("_halo"))
    plain = Window.partitionBy("k").orderBy("t", "i").rowsBetween(-before, 0)
    want = rows.withColumn("f", F.first("i").over(plain))
    assert listed(got, "i", "f") == listed(want, "i", "f")
