import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tarnbeck.llm import sentence_piece
from tarnbeck.llm.text import pieces
from tests.llm import brute
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return sentence_piece.Coder(PATH)


def test_same_as_library(library, coder):
    rng = random.Random(5)
    letters = list("abcdeehinorst   \n\té漢字🎉▁\x00_-.,!")
    texts = [t or "" for _, t in ODD]
    for _ in range(1500):
        kind = rng.random()
        if kind < 0.4:
            texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(30))))
        elif kind < 0.8:
            texts.append("".join(rng.choice(coder.pieces) for _ in range(rng.randrange(8))).replace("▁", " "))
        else:
            texts.append(" " * rng.randrange(40) + "x" * rng.randrange(20) + " " * rng.randrange(30))
    parts = [coder.encode(p) for p in pieces(pa.array(texts), 1 << 13)]
    ids, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(size)
    for text, a, b, want in zip(texts, ends - size, ends, library.encode(texts), strict=True):
        assert ids[a:b].tolist() == want, text[:80]
        assert coder.decode(ids[a:b]) == library.decode(want)


def test_long_units(library, coder, monkeypatch):
    """Words much longer than a window equal the library's; so do those whose windows meet nowhere."""
    rng = random.Random(8)
    letters = "abcdeehinorst漢é"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (2304, 2305, 5000, 60_000)]
    texts += ["a" * 9000, "ab" * 5000, "x" * 2303 + "yz" * 3000, "\U0001f389" * 6000, " " * 7000, "begin " + "".join(rng.choice(coder.pieces[300:]).replace("▁", "") for _ in range(4000)) + " end"]
    for window in (sentence_piece.WINDOW, 50):
        monkeypatch.setattr(sentence_piece, "WINDOW", window)
        monkeypatch.setattr(sentence_piece, "OVERLAP", min(window, 256))
        coder.units.clear()
        for p in pieces(pa.array(texts), 1 << 20):
            ids, size = coder.encode(p)
            for t, a, b in zip(texts[p.lo : p.hi], np.cumsum(size) - size, np.cumsum(size), strict=True):
                assert ids[a:b].tolist() == library.encode(t), t[:40]
    coder.units.clear()


def test_suffix_array():
    rng = np.random.default_rng(0)
    for size, kinds in ((1, 1), (50, 2), (3000, 3), (3000, 500)):
        codes = rng.integers(1, kinds + 1, size).astype(np.uint32)
        order = sentence_piece.suffix_array(codes)
        heads = [tuple(codes[k : k + 16]) for k in order]
        assert sorted(order.tolist()) == list(range(size)) and heads == sorted(heads)


def test_documents(documents, library):
    out = {r.doc_id: r for r in sentence_piece.encode_documents(documents, PATH, keep=["lang"]).collect()}
    for r in documents.collect():
        want = library.encode(r.text)
        got = out[r.doc_id]
        assert (got.ids, got.n_tokens, got.ids_crc32, got.round_trip, got.lang) == (want, len(want), brute.crc(want), True, r.lang)


def test_odd_rows(odd, none):
    coded = sentence_piece.encode_documents(odd, PATH, keep=["score"])
    rows = coded.collect()
    assert len(rows) == 16 and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[3] == 0
    back = {r.doc_id: r.text for r in sentence_piece.decode_documents(coded, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in ODD)
    assert sentence_piece.encode_documents(none, PATH, with_ids=False).count() == 0


def test_mark_in_text(spark):
    row = sentence_piece.encode_documents(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), PATH).first()
    assert not row.round_trip and row.n_tokens > 0
