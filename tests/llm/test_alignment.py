import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from treeline.llm import alignment  # noqa: E402
from treeline.llm.queries import QUERIES  # noqa: E402

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(libraries, data):
    """One text after the other, one token after the other."""
    a, b = libraries
    signs = alignment.byte_signs()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for key, text in data:
        raw = f" {text}".encode() if text else b""
        left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        right = [(i, piece(i)) for i in b.encode(text)] if text else []
        if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            left = right = []
        groups, links, waiting, at = [], [], ([], []), [0, 0]
        rest = (list(left), list(right))
        while any(rest):
            side = 0 if at[0] <= at[1] else 1
            i, raw_token = rest[side].pop(0)
            waiting[side].append(i)
            at[side] += len(raw_token)
            if at[0] == at[1]:
                groups.append("|".join(",".join(map(str, w)) for w in waiting))
                links.append((waiting[0][-1], waiting[1][-1]))
                waiting = ([], [])
        counts.update(links)
        rows.append((key, len(left), len(right), groups, links))
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((key, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups))
                   for key, n_a, n_b, groups, links in rows), key=str)


def texts():
    rng = random.Random(6)
    signs = "abcTHE  'stre\n\t \x1cßİΣς漢😀é́\xa0　\x85 ,.!<|>0129\r\x00"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*out, "", None, " ", "\n", "  x", "a  \n b\n\nc", "a▁b", "▁", "<s> <0x0A></s> <|endoftext|> x", "don't I'LL", "漢字かな混じり文" * 50,
            "word, word. " * 3000, " the  and\nof\n\n the\n", "x" * 5000, "é è\nà ñ", "<|endoftext|>"]


def test_against_one_token_after_the_other(spark, libraries, monkeypatch):
    data = [(i, t) for i, t in enumerate(texts())] + [(None, "nobody"), (3, "the same key"), (3, "the same key")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id bigint, text string, n_a int, links string").repartition(5)
    found = alignment.alignments(frame, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(libraries, data)


def test_blocks_do_not_matter(libraries):
    import pyarrow as pa

    books = alignment.vocabulary(A), alignment.vocabulary(B)
    some = texts()
    whole, counted = alignment.align_block(pa.array(some), *books)
    total = dict(zip(*(counted[c].to_pylist() for c in ("pair", "pair_count")), strict=True))
    parts = Counter()
    for first in range(0, len(some), 100):
        found, more = alignment.align_block(pa.array(some[first : first + 100], pa.string()), *books)
        assert found["groups"].to_pylist() == whole["groups"].to_pylist()[first : first + 100]
        parts.update(dict(zip(*(more[c].to_pylist() for c in ("pair", "pair_count")), strict=True)))
    assert parts == total


def test_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, alignment.alignments(nothing, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_query_digests(spark, libraries, tmp_path):
    data = [(1, "the and of"), (2, "a▁b"), (3, "")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.groups_sha256 for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[-1] and hashlib.sha256(r[-1].encode()).hexdigest() for r in plain(libraries, data)}
