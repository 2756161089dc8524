import hashlib
import re

from pyspark.sql import functions as F

from treeline.llm.exact_dedup import exact_duplicates, sha256_of, without_duplicates

TEXTS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (4, "a\n\r b"), (1, "ab"), (2, None), (7, ""), (8, " "), (6, "\x0b"),
    (10, "é ñ"), (11, "é ñ"), (12, "a b"), (12, "a b"), (None, "a b"), (None, "only null"), (13, "x" * 200_000),
    (14, "x" * 200_000), (15, "\xa0"), (16, " lead"), (17, "lead"),
]
SCHEMA = "doc_id bigint, text string, id string, digest int, tag int, row int, `second` int"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "c", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


def test_against_brute_force(spark):
    got = exact_duplicates(docs(spark), salts=3).collect()
    groups = expected(TEXTS)
    assert len(got) == len(TEXTS)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.digest.hex() == sha]
        named = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
        assert {(r.keep_id, r.group_size) for r in mine} == {(min(named, default=None), len(ids))}
        kept = [r for r in mine if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == min(named, default=None)


def test_hot_text_over_many_partitions(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}") for i in range(3000)]
    got = exact_duplicates(docs(spark, rows).repartition(40), salts=4).collect()
    assert sum(r.kept for r in got) == len(expected(rows))
    assert {r.group_size for r in got if r.keep_id == 0} == {1000}


def test_weak_digest_never_merges_different_texts(spark):
    got = exact_duplicates(docs(spark), digest=lambda t: sha256_of(F.substring(t, 1, 1))).collect()
    assert sum(r.kept for r in got) == len(expected(TEXTS))


def test_rows_that_stay_are_unchanged(spark):
    frame = docs(spark)
    got = without_duplicates(frame)
    assert got.columns == frame.columns
    groups = expected(TEXTS)
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len(groups)
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        match = [i for i, t in rows if re.sub(r"[\x20\x09-\x0D]+", " ", t or "") == text]
        assert match == [min(named, default=None)]


def test_empty_table(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    assert without_duplicates(docs(spark, [])).count() == 0
