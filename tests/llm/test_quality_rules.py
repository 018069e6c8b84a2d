import pytest

from tarnbeck.llm.quality_rules import RepetitionLimits, apply_rules
from tests.llm import brute


def check(row, text):
    n, chars, symbols, lines, repeat = brute.rules(text)
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, lines, repeat), (text or "")[:80]
    assert row.base_failed == (n < 50 or 100 * repeat > 50 * n)
    shares = {k: brute.dup_share(text, k) for k in (5, 7, 10)}
    for k, share in shares.items():
        assert row[f"dup_{k}gram_share"] == pytest.approx(share)
    if row.kept:
        assert not row.base_failed and all(shares[k] <= most + 1e-12 for k, most in RepetitionLimits().grams.items())


def test_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = apply_rules(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])


def test_odd_rows(odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = apply_rules(odd).collect()
    assert len(rows) == 16
    for r in rows:
        check(r, texts[r.doc_id])
        assert not r.kept
    assert apply_rules(none).count() == 0


def test_repetition_fails(spark):
    plain = " ".join(f"word{k}" for k in range(200))
    loop = plain + " " + " ".join(f"word{k}" for k in range(60))
    lines = "\n".join(["this line comes again and again"] * 4 + [f"line {k} differs from all the others here" for k in range(9)])
    out = {r.doc_id: r.kept for r in apply_rules(spark.createDataFrame([(1, plain), (2, loop), (3, lines)], "doc_id long, text string")).collect()}
    assert out == {1: True, 2: False, 3: False}
