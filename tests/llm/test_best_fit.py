import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from tests.llm.test_alignment import texts  # noqa: E402
from treeline.llm.best_fit import MEASURES, best_fit, cut_documents, pack_best_fit, packed_best_fit  # noqa: E402

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_packed_documents(spark, library):
    data = [(i, t) for i, t in enumerate(texts())] + [(None, "nobody")] + [(7, "again")] * 40
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in data], "doc_id bigint, text string, length int, offset int, row string")
    got = packed_best_fit(frame, PATH, tokens=512).collect()
    whole = defaultdict(list)
    for i, t in data:
        whole[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for i, texts_of in whole.items():
        for ids in texts_of:
            first = (len(ids) - 1) % 512 + 1
            cuts = [0, *range(first, len(ids) + 1, 512)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                wanted[i].append((piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in wanted.items()}
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 512
    assert packed_best_fit(frame.limit(0), PATH).count() == 0


def plain(items, limits, measure):
    """Each item against every sequence, with plain numbers."""
    fitting = [i for i in items if all(x <= y for x, y in zip(i, limits))]
    weight = [sum(i[d] / limits[d] for i in fitting) / len(fitting) for d in range(len(limits))]
    rooms, out = [], []
    for item in items:
        best, at = None, None
        for n, room in enumerate(rooms):
            if room is None or any(x > r for x, r in zip(item, room)):
                continue
            asked, free = [[v / y for v, y in zip(z, limits)] for z in (item, room)]
            if measure == "norm":
                score = -sum(w * (f - x) ** 2 for w, f, x in zip(weight, free, asked))
            else:
                score = sum(w * f * x for w, f, x in zip(weight, free, asked)) / sum(w * f * f for w, f in zip(weight, free))
            if best is None or score > best + 1e-12:
                best, at = score, n
        if at is None:
            at = len(rooms)
            rooms.append(list(limits) if any(x <= y for x, y in zip(item, limits)) and item in fitting else None)
        if rooms[at] is not None:
            rooms[at] = [r - x for r, x in zip(rooms[at], item)]
        out.append(at)
    return out, len(rooms)


@pytest.mark.parametrize("measure", MEASURES)
def test_against_a_plain_best_fit(measure):
    rng = np.random.default_rng(3)
    limits = np.array([2048, 6, 40])
    tokens = np.sort(rng.integers(1, 2300, 600))[::-1]
    items = np.column_stack([tokens, np.ones(600, dtype=int), rng.integers(0, 30, 600)])
    sequence, number = best_fit(items, limits, measure)
    _, plain_number = plain([tuple(map(int, i)) for i in items], limits.tolist(), measure)
    assert abs(number - plain_number) <= 1  # equal scores may be told apart by rounding
    used = np.zeros((number, 3), dtype=int)
    np.add.at(used, sequence, items)
    alone = (items > limits).any(axis=1)
    assert (used[sequence[~alone]] <= limits).all()
    assert all((sequence == s).sum() == 1 for s in sequence[alone])


def test_every_capacity_binds():
    small = np.column_stack([np.full(1000, 2), np.ones(1000, dtype=int), np.ones(1000, dtype=int)])
    for limits, least in (([100, 256, 320], 20), ([2048, 50, 320], 20), ([2048, 256, 40], 25)):
        sequence, number = best_fit(small, np.array(limits), "norm")
        assert number == least and np.bincount(sequence).max() * least == 1000


def test_few_sequences(spark):
    rng = random.Random(5)
    rows = [(i, min(2048, int(rng.lognormvariate(5.5, 1.2)) + 2)) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, length bigint")
    costs = {"tokens": (F.col("length"), 2048), "documents": (F.lit(1), 256)}
    got = pack_best_fit(frame, costs, order=("doc_id",), per_block=5000).collect()
    assert sum(r.length for r in got) >= 0.99 * 2048 * len({r.sequence_id for r in got})


def test_repeated_rows_nulls_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, 10, 5, {"a": 1}, 3)] * 3000 + [(2, None, 6, None, 4), (None, 5000, 7, None, 5)],
                                  "doc_id bigint, length bigint, block int, row map<string,int>, sequence_id int")
    got = pack_best_fit(frame, {"tokens": (F.col("length"), 2048)}, order=("doc_id",), per_block=500)
    assert sorted(got.columns) == ["block", "doc_id", "length", "offset", "row", "sequence_id"]
    rows = got.collect()
    blocks = defaultdict(int)
    for r in rows:
        blocks[r.sequence_id >> 32] += 1
    assert len(rows) == 3002 and len(blocks) == 7 and max(blocks.values()) < 700  # a repeated row fills no block alone


def test_only_long_documents_are_cut(spark):
    frame = spark.createDataFrame([(1, " a" * 7), (2, " a" * 8), (3, " a" * 20), (4, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.piece, r.start, r.length) for r in cut_documents(frame, PATH, tokens=8).collect())
    assert got == [(1, 0, 0, 8), (2, 0, 0, 1), (2, 1, 1, 8), (3, 0, 0, 5), (3, 1, 5, 8), (3, 2, 13, 8), (4, 0, 0, 1)]


def test_every_token_is_its_own_encoding(library):
    """So merging neighbours that are a token together is merging by the list of merges."""
    import json

    from treeline.llm.tokens import byte_signs

    model = json.load(open(PATH))["model"]
    merges = {tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}
    signs = byte_signs()
    for token in model["vocab"]:
        parts = list(token)
        assert all(p in signs for p in parts)
        while len(parts) > 1:
            found = [(model["vocab"][a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
            assert found, token
            i = min(found)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]


def test_words_equal_the_library(library):
    from treeline.llm.tokens import Encoded, as_bytes, byte_encode

    import pyarrow as pa

    some = [t for t in texts() if t]
    found = Encoded(as_bytes(pa.array(some)), byte_encode(PATH))
    for i, t in enumerate(some):
        assert found.ids[found.ends[i] : found.ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
