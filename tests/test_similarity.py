import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import shingles, signatures, texts, vectors
from treeline.operators.components import components


@pytest.fixture(scope="module")
def cloud():
    """Clusters of vectors in eight dimensions, with copies."""
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(12, 8))
    points = np.vstack([c + rnd.normal(scale=0.25, size=(15, 8)) for c in centers])
    points = np.vstack([points, np.repeat(points[:1], 40, axis=0)])
    return points


def as_table(spark, points):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(6)


def cosines(points):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    return unit @ unit.T


@pytest.mark.parametrize("threshold", [0.35, 0.85, 0.97])
@pytest.mark.parametrize("block_rows, rows_per_cell", [(2048, 100_000), (7, 10)])
def test_similar_pairs(spark, cloud, threshold, block_rows, rows_per_cell):
    got = vectors.similar_pairs(as_table(spark, cloud), threshold, block_rows=block_rows, rows_per_cell=rows_per_cell).collect()
    real = cosines(cloud[:180])
    want = {(i, j) for i, j in itertools.combinations(range(180), 2) if real[i, j] >= threshold}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["similarity"] - real[r["a"], r["b"]]) < 1e-9 for r in got)
    assert all(r["copies_a"] == (41 if r["a"] == 0 else 1) for r in got)


@pytest.mark.parametrize("block_rows, rows_per_cell", [(2048, 100_000), (7, 10), (5, 60)])
def test_top_k(spark, cloud, block_rows, rows_per_cell):
    got = vectors.top_k_neighbors(as_table(spark, cloud), 4, block_rows=block_rows, rows_per_cell=rows_per_cell).collect()
    real = cosines(cloud[:180])
    np.fill_diagonal(real, -2)
    want = {(i, int(j), r + 1) for i in range(180) for r, j in enumerate(np.argsort(-real[i], kind="stable")[:4])}
    assert {(r["id"], r["neighbor"], r["rank"]) for r in got} == want


def test_vectors_move_once_per_block_that_they_meet(spark, monkeypatch):
    points = np.random.default_rng(5).normal(size=(3000, 8))
    vecs = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    asked, real = [], vectors._blocks

    def kept(placed, *rest):
        asked.append(placed)
        return real(placed, *rest)

    monkeypatch.setattr(vectors, "_blocks", kept)
    pairs = vectors.similar_pairs(vecs, 0.5, rows_per_cell=300)
    # a row per vector, however many of the ten cells it visits, and floats as they were given
    assert asked[0].count() == 3000 and asked[0].schema["vec"].dataType.simpleString() == "array<float>"
    assert asked[0].selectExpr("max(size(cells))").first()[0] == 10
    real_cosines = cosines(points.astype(np.float32).astype(np.float64))
    assert pairs.count() == int((np.triu(real_cosines, 1) >= 0.5).sum())


def test_nearest_come_from_all_tiles(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "_TILE", 9)
    test_top_k(spark, cloud, 64, 100_000)


def test_ids_may_be_paths(spark, cloud):
    cloud = as_table(spark, cloud)
    named = cloud.withColumn("vec_id", F.concat(F.lit("/f/"), F.lpad(F.col("vec_id").cast("string"), 6, "0")))
    plain = vectors.similar_pairs(cloud, 0.8).select("a", "b").collect()
    got = vectors.similar_pairs(named, 0.8, block_rows=16, rows_per_cell=32).select("a", "b").collect()
    assert sorted((int(r.a[3:]), int(r.b[3:])) for r in got) == sorted(map(tuple, plain))
    near = vectors.top_k_neighbors(named, 2, block_rows=16, rows_per_cell=32)
    assert near.schema["neighbor"].dataType.simpleString() == "string" and near.count() > 0


def test_top_k_with_few_vectors(spark):
    got = vectors.top_k_neighbors(as_table(spark, np.eye(3)), 5).collect()
    assert sorted((r["id"], r["neighbor"]) for r in got) == [(a, b) for a in range(3) for b in range(3) if a != b]


def _bits(row):
    return sum(row[f"s{n}"] << (16 * n) for n in range(4))


@pytest.mark.parametrize(("limit", "k"), [(5, 3), (20_000, 3), (20_000, 0), (50, 9)])
def test_hamming_pairs(spark, limit, k):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(5)]
    values = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(10))) for b in base for _ in range(20)] + base[:1] * 30
    values = [v & (2**64 - 1) for v in values]
    rows = [(i, *[(v >> (16 * n)) & 0xFFFF for n in range(4)]) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "id int, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    got = signatures.hamming_pairs(table, k, limit).collect()
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(min(i, j), max(i, j), bin(a ^ b).count("1")) for (a, i), (b, j) in itertools.combinations(first.items(), 2)
            if bin(a ^ b).count("1") <= k}
    assert len(got) == len(want) and {(r["a"], r["b"], r["distance"]) for r in got} == want
    with pytest.raises(ValueError):
        signatures.hamming_pairs(table, 31)


def test_signatures(spark):
    v = [float((i * 37) % 64) for i in range(64)]
    row = spark.createDataFrame([(v,)], "v array<double>").select(
        signatures.difference_signature("v").alias("d"), signatures.average_signature("v").alias("a")).first()
    assert _bits(row["d"]) == sum(1 << i for i in range(64) if v[i] < v[(i + 1) % 64])
    assert _bits(row["a"]) == sum(1 << i for i in range(64) if v[i] > sum(v) / 64)


def _shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    out = []
    for _ in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        out.append(text)
        for _ in range(3):
            near = list(text)
            for _ in range(rnd.randrange(1, 4)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            out.append(near)
    out += [["Same", "text", "by", "a", "third", "of", "all", "rows"]] * 50
    out += [["one"], [], ["a", "b", "c", "d"], ["one", "two"], ["One", "two"], ["one", "two", "three"]]
    out += [["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e", "f", "g"]]
    return [(i, "  ".join(t) + ("\n" if i % 2 else "")) for i, t in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7, 0.85, 0.99])
def test_near_duplicates(spark, corpus, threshold):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    got = texts.near_duplicate_pairs(docs, threshold, limit=10).collect()
    first = {}
    for i, t in corpus:
        first.setdefault(tuple(t.lower().split()), i)
    sets = {i: _shingle_set(" ".join(k)) for k, i in first.items()}
    want = {}
    for a, b in itertools.combinations(sorted(i for i, s in sets.items() if s), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            want[a, b] = j
    assert len(got) == len(want) and {(r["a"], r["b"]): r["similarity"] for r in got} == want


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7, 0.85, 0.99])
def test_forest_has_the_components_of_all_pairs(spark, corpus, threshold):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    pairs = texts.near_duplicate_pairs(docs, threshold).cache()
    forest = texts.near_duplicate_forest(docs, threshold, limit=10).cache()
    assert {tuple(r) for r in forest.collect()} <= {tuple(r) for r in pairs.collect()}
    assert forest.count() == forest.select("a", "b").distinct().count()
    assert {tuple(r) for r in components(forest).collect()} == {tuple(r) for r in components(pairs).collect()}


def test_forest_of_no_rows_null_texts_and_ids_that_are_paths(spark):
    empty = spark.createDataFrame([], "path string, body string")
    assert texts.near_duplicate_forest(empty, 0.8, "path", "body").count() == 0
    words = [f"w{i}" for i in range(40)]
    rows = [("/a", " ".join(words)), ("/b", " ".join([*words, "x"])), ("/c", None), ("/d", ""), ("/e", "other text altogether")]
    named = spark.createDataFrame(rows, "path string, body string")
    got = texts.near_duplicate_forest(named, 0.8, "path", "body").collect()
    assert [(r["a"], r["b"], r["copies_a"]) for r in got] == [("/a", "/b", 1)]


def test_a_group_costs_as_many_comparisons_as_it_has_texts(spark, monkeypatch):
    rnd = random.Random(11)
    groups, members = 3, 120
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(300)]
        for m in range(members):
            near = list(base)
            near[rnd.randrange(300)] = f"own{g}x{m}"
            rows.append((g * members + m, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    asked = []
    real = texts._verified

    def counted(candidates, *rest):
        asked.append(candidates.count())
        return real(candidates, *rest)

    monkeypatch.setattr(texts, "_verified", counted)
    forest = texts.near_duplicate_forest(docs, 0.9)
    assert sorted(r["component"] for r in components(forest).collect()) == sorted(
        g * members for g in range(groups) for _ in range(members))
    assert sum(asked) <= 2 * groups * members


def test_places_rule_out_pairs_before_whole_sets_move(spark, monkeypatch):
    common = [f"c{i}" for i in range(90)]
    docs = spark.createDataFrame([(k, " ".join([f"{k}own{i}" for i in range(12)] + common)) for k in range(2)], "doc_id bigint, text string")
    asked, real = [], texts._verified

    def counted(candidates, *rest):
        asked.append(candidates.count())
        return real(candidates, *rest)

    monkeypatch.setattr(texts, "_verified", counted)
    assert texts.near_duplicate_pairs(docs, 0.85).count() == 0 and texts.near_duplicate_forest(docs, 0.85).count() == 0
    assert not any(asked)  # their prefixes meet in four shingles, but 88 of 112 in all are too few
    near = texts.near_duplicate_pairs(docs, 0.75).collect()
    assert [(r.a, r.b, r.similarity) for r in near] == [(0, 1, 88 / 112)]


@pytest.mark.parametrize("asked", ["near_duplicate_pairs", "near_duplicate_forest"])
def test_a_pair_that_meets_too_late_is_not_counted(spark, monkeypatch, asked):
    common = [f"c{i}" for i in range(90)]
    docs = spark.createDataFrame([(k, " ".join([f"{k}own{i}" for i in range(12)] + common)) for k in range(2)], "doc_id bigint, text string")
    met, real = [], texts._can_reach

    def counted(postings, *rest):
        met.append(postings.count())
        return real(postings, *rest)

    monkeypatch.setattr(texts, "_can_reach", counted)
    assert getattr(texts, asked)(docs, 0.85).count() == 0
    assert met and not any(met)  # four shingles are in both prefixes, but too few come from the first of them on


def test_an_id_with_several_texts_loses_no_pair(spark):
    rnd = random.Random(23)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(60):
        near = list(base)
        for _ in range(rnd.randrange(6)):
            near[rnd.randrange(60)] = f"x{rnd.randrange(400)}"
        rows.append((rnd.randrange(20), " ".join(near[: rnd.choice([20, 60])])))
    sets = [(i, {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}) for i, t in rows]
    want = {(i, j) for (i, x), (j, y) in itertools.product(sets, sets) if i < j and len(x & y) >= 0.6 * len(x | y)}
    got = texts.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.6).collect()
    assert {(r.a, r.b) for r in got} <= want
    least = {t: min(i for i, u in rows if u == t) for _, t in rows}
    kept = [(i, x) for (i, x), (_, t) in zip(sets, rows) if least[t] == i]
    assert {(i, j) for (i, x), (j, y) in itertools.product(kept, kept) if i < j and len(x & y) >= 0.6 * len(x | y)} <= {(r.a, r.b) for r in got}


@pytest.mark.parametrize("asked", ["near_duplicate_pairs", "near_duplicate_forest"])
def test_tables_hold_postings_that_meet_and_no_sets_of_pairs(spark, monkeypatch, asked):
    rnd = random.Random(31)
    alone = [(i, " ".join(f"{i}w{rnd.randrange(10**9)}" for _ in range(300))) for i in range(40)]
    base = [f"w{i}" for i in range(300)]
    near = [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(0, 300, 20)]
    docs = spark.createDataFrame([*alone, *near], "doc_id bigint, text string").repartition(4)
    postings, moved, stored, join = [], [], texts._stored, texts.skew_join

    def counted(df, path):
        out = stored(df, path)
        if "h" in out.columns:
            postings.append(out.count())
        return out

    def watched(left, *rest, **named):
        moved.extend(kind for _, kind in left.dtypes)
        return join(left, *rest, **named)

    monkeypatch.setattr(texts, "_stored", counted)
    monkeypatch.setattr(texts, "skew_join", watched)
    links = getattr(texts, asked)(docs, 0.9).collect()
    assert len(links) == (15 * 14 // 2 if asked == "near_duplicate_pairs" else 14)
    # the rarest tenth of either text's shingles is posted, and unrelated texts meet no other
    assert 0 < max(postings) <= 15 * 31
    assert moved and not any("array" in kind or kind == "binary" for kind in moved)


def test_shingles_of_texts_at_once(monkeypatch):
    rnd = random.Random(41)
    given = ["a", "a b", "a b c", "A\tb\r\n c  ", "c b a", "é 界 x", "one", "x" * 3000,
             *[" ".join(rnd.choice(["", "u", "v", "ww", "é"]) for _ in range(rnd.randrange(1, 400))) + " end" for _ in range(60)]]
    monkeypatch.setattr(shingles, "_BYTES_AT_ONCE", 200)
    plain = [shingles.plain(t.lower().encode()) for t in given]
    sets = [shingles.distinct(h) for h in shingles.shingles(plain)]
    want = [_shingle_set(t) for t in given]
    assert [t.decode().split(" ") for t in plain] == [t.lower().split() for t in given]
    assert [len(s) for s in sets] == [len(s) for s in want]
    a, b = (np.array(x) for x in zip(*itertools.product(range(len(sets)), repeat=2)))
    assert shingles.common(sets, a, b).tolist() == [len(want[i] & want[j]) for i, j in zip(a, b)]
    monkeypatch.setattr(shingles, "_HASHES_AT_ONCE", 50)
    assert shingles.common(sets, a, b).tolist() == [len(want[i] & want[j]) for i, j in zip(a, b)]
    assert [shingles.whole(shingles.squeezed(t)) for t in plain] == plain


def test_bits_miss_no_hash(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    h = rnd.integers(-(1 << 63), 1 << 63, 5000)
    monkeypatch.setattr(shingles, "_HASHES_PER_SLICE", 100)
    often = np.concatenate([h, h[:300], h[:300]])
    table = spark.createDataFrame([(int(x),) for x in often], "h bigint").repartition(5)
    there, twice = shingles.bits(table, len(h)), shingles.bits(table, len(h), several=True)
    assert there.of(h.view(np.uint64)).all() and twice.of(h[:300].view(np.uint64)).all()
    other = rnd.integers(-(1 << 63), 1 << 63, 5000).view(np.uint64)
    assert there.of(other).mean() < 0.12 and twice.of(h[300:].view(np.uint64)).mean() < 0.02
    packed = spark.createDataFrame([(bytearray(h[i : i + 50].tobytes()),) for i in range(0, 5000, 50)], "head binary")
    assert shingles.bits(packed, len(h)).of(h.view(np.uint64)).all()
    assert not shingles.bits(table.filter("h IS NULL"), 0).of(h.view(np.uint64)).any()


def test_letters_are_counted_in_one_pass(spark):
    from treeline.catalog import similarity_queries as queries

    rows = [(1, "aab Zz.,9 é界a"), (2, ""), (3, None), (None, "A" * 5000)]
    given = spark.createDataFrame(rows, "id bigint, text string")
    got = given.mapInArrow(queries._letter_counts, "id bigint, v array<bigint>").collect()
    assert {r.id: r.v for r in got} == {i: [(t or "").count(c) for c in queries._CELLS] for i, t in rows}


def test_clusters_hold_all_copies(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    pairs = texts.near_duplicate_pairs(docs, 0.5).cache()
    members = texts.near_duplicate_clusters(docs, pairs)
    got = {r["id"]: r["cluster"] for r in members.collect()}
    assert {got[i] for i in range(100, 150)} == {100}
    for r in pairs.collect():
        assert got[r["a"]] == got[r["b"]]
    assert all(got[c] == c for c in set(got.values()))
    one = {r["cluster"]: r for r in texts.cluster_summary(members, pairs).collect()}[100]
    assert (one["members"], one["similarity"], one["confidence"]) == (50, 1.0, 1.0)


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_components(spark, limit):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)]
    edges += [(rnd.randrange(300, 360), rnd.randrange(300, 360)) for _ in range(45)]
    rnd.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent}
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    got = components(table, limit=limit).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_no_pairs_no_components(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
