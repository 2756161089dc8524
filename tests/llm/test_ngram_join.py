import random
import re

import numpy as np
import pytest

from treeline.llm import ngram_join as N


def shingles(text, words):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(zip(*[ws[i:] for i in range(words)])) if len(ws) >= words else frozenset([tuple(ws)])


def brute(rows, words, num, den):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(sets[i]), least.get(root(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


def corpus(seed, groups=25, copies=12, length=120, hot=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    boiler = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for g in range(groups):
        size = rng.randint(3, length)
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(hot if hot and g == 0 else rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(size)] = f"u{rng.randint(0, 10**6)}"
            rows.append(" ".join(text) + (" " + boiler if g % 3 == 0 else ""))
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one  two", "ÉCOLE maison", "école maison", "a b c", "x " * 500]
    rng.shuffle(rows)
    return [(i * 7 % 1009 + i // 1009, t) for i, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id bigint, text string, n int, fp int, gram string")


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_against_brute_force(spark, words, num, den):
    rows = corpus(words)
    rows += [rows[3], (rows[4][0], rows[9][1]), (None, rows[5][1]), (None, "nobody else writes this")]
    got = N.linked_documents(frame(spark, rows).repartition(5), words=words, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, words, num, den)


def test_large_group_without_all_pairs(spark, monkeypatch):
    rows = corpus(9, groups=6, hot=400)
    sizes = []
    verified = N._verified

    def counting(docs, text, rule, seed, pairs, nodes):
        sizes.append(pairs.count())
        return verified(docs, text, rule, seed, pairs, nodes)

    monkeypatch.setattr(N, "_verified", counting)
    got = N.linked_documents(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90, 100)
    assert sum(sizes) < 20 * len(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    got = N.one_of_each(frame(spark, rows), words=5, num=80, den=100)
    assert got.columns == ["doc_id", "text", "n", "fp", "gram"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _, c in brute(rows, 5, 80, 100) if i == c)


def test_one_row_of_each_group_stays_under_repeated_and_null_keys(spark):
    rng = random.Random(6)

    def near(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        return [" ".join(base[:-1] + [f"x{i}"]) for i in range(n)]

    a, b, c, d = near(3), near(3), near(2), near(2)
    clean = [near(1)[0] for _ in range(4)]
    rows = [(1, a[0]), (7, a[1]), (7, a[2])]  # linked to a smaller key, under a hot one
    rows += [(7, clean[0]), (7, clean[1]), (None, clean[2]), (None, clean[3])]  # linked to none
    rows += [(8, t) for t in b] + [(None, t) for t in c] + [(None, d[0]), (9, d[1])]
    rows += [(10, clean[0] + " more"), (11, "same key and text"), (11, "same key and text"), (12, None), (12, None), (12, "")]
    got = [(r.doc_id, r.text) for r in N.one_of_each(frame(spark, rows).repartition(3), words=5, num=80, den=100).collect()]
    assert sorted(got, key=str).count((11, "same key and text")) == 1
    assert [t for _, t in got if t in a] == [a[0]] and sum(t in b for _, t in got) == 1 and sum(t in c for _, t in got) == 1
    assert [x for x in got if x[1] in d] == [(9, d[1])]
    assert {(7, clean[0]), (7, clean[1]), (None, clean[2]), (None, clean[3])} <= set(got)
    assert sorted((k, t or "") for k, t in got if k == 12) == [(12, "")] * 3
    assert len(got) == 1 + 4 + 1 + 1 + 1 + 1 + 3


def test_empty_table_and_no_links(spark):
    assert N.linked_documents(frame(spark, [])).count() == 0
    got = N.linked_documents(frame(spark, [(1, "a b c d"), (2, "e f g h")])).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 2)]


def test_shingles_are_those_of_the_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB é漢\t\n  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids = {}
    for t in texts:
        grams = N.shingle_set(t.encode(), 3)
        assert len(grams) == len(shingles(t, 3))
        assert ids.setdefault(shingles(t, 3), grams.tobytes()) == grams.tobytes()
    assert len(set(ids.values())) == len(ids)


def test_filters_never_exclude_linked_sets():
    rng, rule = np.random.default_rng(1), N.Rule(3, 80, 100)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 8 + 1)) :], rng.integers(1, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        differing = sum(int(x).bit_count() for x in (N._parities(a) ^ N._parities(b)).view(np.uint64))
        assert differing <= union - common
        if common * 100 >= union * 80:
            assert differing * 180 <= (len(a) + len(b)) * 20
            assert set(a[: rule.prefix(len(a))]) & set(b[: rule.prefix(len(b))])


def test_no_pair_is_verified_twice(spark, monkeypatch):
    rows = corpus(12, groups=40, copies=15)
    asked, verified = [], N._verified

    def counting(docs, text, rule, seed, pairs, nodes):
        asked.extend(frozenset((r.a_fp, r.b_fp)) for r in pairs.collect())
        return verified(docs, text, rule, seed, pairs, nodes)

    monkeypatch.setattr(N, "_verified", counting)
    got = N.linked_documents(frame(spark, rows), words=3, num=80, den=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 80, 100)
    assert len(asked) == len(set(asked)) > 0


def test_frequent_grams_and_centres_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "GRID", 7)
    monkeypatch.setattr(N, "PAIRS_PER_SET", 5)
    rows = corpus(3, groups=12, hot=60)
    got = N.linked_documents(frame(spark, rows), words=3, num=70, den=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 70, 100)


def test_suffix_filter_never_excludes_linked_sets():
    rng, rule = np.random.default_rng(2), N.Rule(3, 80, 100)
    refused = 0
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.3, 0.97])], rng.integers(1, 1 << 63, n // 10, dtype=np.uint64)]))
        common, union = np.intersect1d(a, b), len(np.union1d(a, b))
        ta, tb = N._tails(a), N._tails(b)
        for g in common[:5]:  # both are in ascending order
            i, j = int(np.searchsorted(a, g)), int(np.searchsorted(b, g))
            least = abs(i - j) + int(ta[i] ^ tb[j]).bit_count()
            assert least <= union - len(common)
            refused += least * 180 > (len(a) + len(b)) * 20
    assert refused > 100


def test_columns_of_any_name_and_kind(spark):
    text = " ".join(f"w{i}" for i in range(60))
    frame_ = spark.createDataFrame([(1, text, {"a": 1}), (2, text + " x", {"b": 2}), (2, text + " x", {"c": 3}), (3, "none of it", None)],
                                   "`n` bigint, `te.xt` string, whole map<string,int>")
    got = N.linked_documents(frame_, "n", "te.xt", 5, 80, 100)
    assert sorted(map(tuple, got.collect())) == [(1, 56, 1), (2, 57, 1), (2, 57, 1), (3, 1, 3)]
    kept = N.one_of_each(frame_.filter("n > 1"), "n", "te.xt")
    assert kept.columns == frame_.columns and sorted((r["n"], str(r.whole)) for r in kept.collect()) == [(2, "{'b': 2}"), (3, "None")]


def test_histograms_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(1, 1 << 63, int(rng.integers(1, 3000)), dtype=np.uint64))
        kept = a[rng.random(len(a)) < rng.choice([0.1, 0.5, 0.95])]
        b = np.unique(np.concatenate([kept, rng.integers(1, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)]))
        least = N._least_difference(N._histogram(a), N._histogram(b))
        assert least <= len(np.setxor1d(a, b))
    many, other = (np.unique(rng.integers(1, 1 << 63, 3000, dtype=np.uint64)) for _ in range(2))
    assert N._least_difference(N._histogram(many), N._histogram(other)) > 1500
