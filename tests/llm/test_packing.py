import json
import re
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from treeline.llm.packing import WordIds, fill, pack, packed_documents, token_pieces  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(8)
    signs = "abcTHE 'stre\n\t \x1cßİΣς漢😀é́,.!<|>0129"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return [*out, "", "<|endoftext|> x", "a <|startoftext|>b", "don't I'LL", "Ünïcode ΑΣ", "word, word. " * 4000, " x　y\x85z"]


def test_ids_equal_the_library(library):
    words = WordIds(PATH)
    for t in texts():
        assert np.frombuffer(words.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packed_documents(spark, library):
    data = [(i, t) for i, t in enumerate(texts())] + [(2000, None), (None, "nobody"), (5, texts()[5])]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in data], "doc_id bigint, text string, length int, offset int, ids string")
    got = packed_documents(frame, PATH).collect()
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in data}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.array(whole[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in whole.items():
        times = sum(k == i for k, _ in data)
        assert sorted(x for s, n in parts[i] for x in range(s, s + n)) == sorted(list(range(len(ids))) * times)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048 and len(places) <= 128
    assert packed_documents(frame.limit(0), PATH).count() == 0


def test_pieces_are_cut_at_the_limit(spark, library):
    frame = spark.createDataFrame([(1, "word " * 10)], "doc_id bigint, text string")
    assert [(r.start, r.length) for r in token_pieces(frame, PATH, tokens=4).collect()] == [(0, 4), (4, 4), (8, 3)]


def test_three_limits_hold_at_once():
    rng = np.random.default_rng(2)
    items = np.column_stack([rng.integers(1, 1200, 3000), np.ones(3000, dtype=int), rng.integers(0, 500, 3000)])
    limits = np.array([2048, 6, 700])
    sequence, turn = fill(items, limits)
    assert (sequence >= 0).all()
    used = np.zeros((sequence.max() + 1, 3), dtype=int)
    np.add.at(used, sequence, items)
    assert (used <= limits).all()
    # no fewer than the scarcest limit allows, and not many more
    least = np.ceil(items.sum(axis=0) / limits).max()
    assert least <= len(used) <= 1.05 * least + 1
    assert all(sorted(turn[sequence == s]) == list(range((sequence == s).sum())) for s in range(0, len(used), 50))


def test_example_beyond_a_limit_stands_alone(spark):
    frame = spark.createDataFrame([(1, 0, 5000), (2, 0, 10), (3, 0, None)], "doc_id bigint, start bigint, length bigint")
    got = {r.doc_id: r.sequence_id for r in pack(frame).collect()}
    assert got[2] == got[3] != got[1]


def test_little_padding(spark):
    rng = random.Random(5)
    rows = [(i, 0, min(2048, int(rng.lognormvariate(5.5, 1.2)) + 2)) for i in range(20_000)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint"), per_block=5000).collect()
    used = sum(r.length for r in got)
    assert used >= 0.98 * 2048 * len({r.sequence_id for r in got})


def test_every_token_is_its_own_encoding(library):
    """So merging neighbours that are a token together is merging by the list of merges."""
    words = WordIds(PATH)
    letters = [t for t in library.get_vocab() if re.fullmatch("[a-z]+(</w>)?", t)]
    ended = [t.removesuffix("</w>") for t in letters if t.endswith("</w>")]
    assert len(ended) > 20_000
    assert [e.ids for e in library.encode_batch(ended, add_special_tokens=False)] == [[library.token_to_id(f"{w}</w>")] for w in ended]
    # a token that ends no word: what stands in front of a word's end cannot merge with it
    inner, split = [t for t in letters if not t.endswith("</w>")], 0
    merges = {tuple(m) for m in json.load(open(PATH))["model"]["merges"]}
    for token in inner:
        parts = list(token)
        while len(parts) > 1:
            found = [(library.token_to_id(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
            if not found:
                split += 1
                break
            i = min(found)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
    assert split == 0
    rng = random.Random(1)
    made = [rng.choice(["", "x'", "3"]) + "".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 25))) for _ in range(20_000)]
    assert [np.frombuffer(words.encode(w), dtype="<u4").tolist() for w in made] == [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
