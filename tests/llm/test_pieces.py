import random

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from treeline.llm.pieces import Pieces, encode_and_decode  # noqa: E402

MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(6)
    signs = "aabcdeirstnhTHE  ▁é漢ß\n\t0123<>/s😀.,'\"-́​\x00"
    words = ["the", "ing", "tion", "  ", " ", "\n", "Über", "naïve", "</s>", "<0x41>", "<unk>", "▁▁", "http://", "1234567", "안녕"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    out += ["a" * n + " " * n + "ab" * n for n in range(40)] + ["aeiou" * 4000, " " * 5000, "x\n" * 3000]
    return out


def test_ids_and_decoded_text_equal_the_library(library):
    pieces = Pieces(MODEL)
    for text in texts():
        ids = np.frombuffer(pieces.encode(text), dtype=np.int32).tolist()
        assert ids == library.encode(text, add_eos=True), text
        assert pieces.decode(ids) == library.decode(ids)


def test_decoding_of_broken_bytes(library):
    pieces = Pieces(MODEL)
    byte = lambda b: 3 + b
    for ids in ([byte(0xC3)], [byte(0xC3), byte(0xA9)], [byte(0xF0), byte(0x9F), byte(0x98)], [byte(0xFF), 2], [1, byte(0x41), 2], []):
        assert pieces.decode(ids) == library.decode(ids), ids


def test_backtracking_goes_back(library):
    """Texts for which always taking the longest piece is wrong."""
    pieces, wrong = Pieces(MODEL), 0
    for text in texts()[:1500]:
        for word in text.split():
            run = "".join(c for c in word if c in pieces.ids)
            if run:
                greedy, at = [], 0
                while at < len(run):
                    size = max(n for n in range(1, len(run) - at + 1) if run[at : at + n] in pieces.ids)
                    greedy.append(run[at : at + size])
                    at += size
                wrong += greedy != pieces.split(run)
    assert wrong > 20


def test_table(spark, library):
    rows = [(i, t) for i, t in enumerate([None, "", "one two", "one two", "\n", "long " * 20_000])] + [(None, "x"), (1, "y")]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, ids string, decoded int")
    got = encode_and_decode(frame, MODEL).collect()
    want = [(i, library.encode(t or "", add_eos=True), t or "") for i, t in rows]
    assert sorted(map(str, ((r.doc_id, list(r.ids), r.decoded) for r in got))) == sorted(map(str, want))
    assert encode_and_decode(frame.limit(0), MODEL).count() == 0
