import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from treeline.llm.sharding import coordinate, kd_shards, numbered

SCHEMA = "doc_id bigint, text string, lang string, size int, shard int, node int"


def rows(n=3000):
    rng = random.Random(2)
    out = [(i, "w " * rng.randint(0, 60) + str(i), rng.choice(["de", "en", "en", "fr", None])) for i in range(n)]
    out += [(n + i, "hot text " * 9, "en") for i in range(n // 2)]  # a third of all rows
    return out + [(None, None, None), (1, out[1][1], out[1][2]), (n * 2, "", "en")]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in data], SCHEMA)


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_shards_have_nearly_equal_bytes(spark, shards):
    data = rows()
    got = kd_shards(frame(spark, data), shards=shards).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(weight) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(weight.values()) - min(weight.values()) <= 0.01 * sum(weight.values()) / shards + 2 * 130


def test_small_groups_of_equal_texts_stay_together(spark):
    data = [(i, f"text {i % 400} " * 5, "en") for i in range(4000)]
    data += [(5000 + i, "x" * 100 + str(i), "de") for i in range(20000)]
    shards = defaultdict(set)
    got = {r.doc_id: r.shard for r in kd_shards(frame(spark, data), shards=16).collect()}
    for i, t, _ in data:
        shards[t].add(got[i])
    assert sum(len(s) > 1 for s in shards.values()) <= 16


def test_leaves_reach_the_target_bytes(spark):
    data = rows()
    got = kd_shards(frame(spark, data), target_bytes=40_000).collect()
    weight = Counter()
    for r in got:
        weight[r.shard] += r.size
    assert max(weight.values()) <= 40_000 * 1.01 + 130 and len(weight) == -(-sum(weight.values()) // 40_000)


def test_empty_and_single(spark):
    assert kd_shards(frame(spark, []), shards=16).count() == 0
    assert [(r.shard, r.slot) for r in kd_shards(frame(spark, [(1, "a", None)]), shards=16).collect()][0][1] == 0


def test_result_does_not_depend_on_partitions(spark):
    data = rows(400)
    a = kd_shards(frame(spark, data).repartition(1), shards=4).collect()
    b = kd_shards(frame(spark, data).repartition(9), shards=4).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize("shards", [4])
def test_repeated_rows_are_cut(spark, shards):
    """A third of all rows equal in key, text and metadata."""
    data = [(1, "w" * 49, "en")] * 2000 + [(10 + i, f"text {i} " * 6, "en") for i in range(4000)]
    got = kd_shards(frame(spark, data).repartition(6), shards=shards).collect()
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(weight.values()) / shards
    assert len(got) == 6000 and len(weight) == shards
    assert max(weight.values()) <= 1.01 * mean + 70 and min(weight.values()) >= 0.99 * mean - 70
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_of_a_hot_key_are_numbered_in_pieces(spark):
    rows_ = kd_shards(frame(spark, [(1, "x", "en")] * 900), shards=1)
    held = rows_.selectExpr("doc_id AS key", "size", "shard", "7L AS i", "7L AS h", "slot AS tag")
    got = numbered(held, 900, 1, rows_per_piece=100)
    assert sorted(r.slot for r in got.collect()) == list(range(900))
    assert got.groupBy("piece").count().agg({"count": "max"}).first()[0] < 200


def test_against_a_plain_tree(spark):
    """Row by row: the widest dimension, the rows in order, and the cut nearest to the aim."""
    data = rows(330)
    df = frame(spark, data)
    held = F.coalesce("text", F.lit(""))
    size = (F.octet_length(held) + 1).cast("bigint")
    axes = F.array(coordinate(df, "lang"), (F.ln(size.cast("double")) * (1 << 20)).cast("bigint"))
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)
    found = df.select("doc_id", size.alias("size"), axes.alias("c"), hashed(held).alias("h"), hashed(F.col("doc_id")).alias("i")).collect()
    ranges = [max(1, max(r.c[d] for r in found) - min(r.c[d] for r in found)) for d in range(2)]

    def split(some, leaves, first):
        if leaves == 1:
            return [(first, r.doc_id, r.size) for r in some]
        width = [(max(r.c[d] for r in some) - min(r.c[d] for r in some)) / ranges[d] for d in range(2)]
        dim = 0 if width[0] >= width[1] else 1
        some = sorted(some, key=lambda r: (r.c[dim], r.h, r.i))
        need = sum(r.size for r in some) * (leaves // 2) / leaves
        at = 0
        while need > some[at].size:
            need -= some[at].size
            at += 1
        at += need >= some[at].size / 2
        half = leaves // 2
        return split(some[:at], half, first) + split(some[at:], leaves - half, first + half)

    for shards in (5,):
        want = Counter((s, i, n) for s, i, n in split(found, shards, 0))
        got = Counter((r.shard, r.doc_id, r.size) for r in kd_shards(df, shards=shards).collect())
        assert got == want
