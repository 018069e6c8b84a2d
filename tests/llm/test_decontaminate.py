import random

import numpy as np
import pyarrow as pa
import pytest

from tarnbeck.llm import decontaminate
from tarnbeck.llm.decontaminate import Leak
from tests.llm import brute


@pytest.fixture(scope="module")
def benchmark(spark, small):
    return spark.read.parquet(f"{small}/benchmark.parquet")


def split(text):
    return ["".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in w) for w in [(text or "").lower()]][0].split()


def test_against_full_alignment(documents, benchmark):
    """Every document with every item, aligned over its whole text."""
    items = {r.item_id: split(r.text) for r in benchmark.collect()}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(documents, benchmark).collect()}
    want = {}
    for r in documents.collect():
        w = split(r.text)
        have = set(w)
        for i, item in items.items():
            if sum(x in have for x in item) >= 0.4 * len(item):
                score = brute.smith_waterman(w, item) / (2 * len(item))
                if score >= 0.45:
                    want[r.doc_id, i] = score
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_edited_copies(spark, documents, benchmark):
    rng = random.Random(2)
    clean = [r.text for r in decontaminate.decontaminate(documents, benchmark).limit(40).collect()]
    items = benchmark.limit(40).collect()
    rows = []
    for k, (text, item) in enumerate(zip(clean, items, strict=False)):
        w = item.text.split()
        for _ in range(len(w) // 6):
            w[rng.randrange(len(w))] = f"other{rng.randrange(99)}"
        at = rng.randrange(len(text.split()) + 1)
        words = text.split()
        rows.append((k, " ".join([*words[:at], *w, *words[at:]])))
    rows += [(1000 + k, t) for k, t in enumerate(clean)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert {(k, items[k].item_id) for k in range(len(items))} <= found and all(d < 1000 for d, _ in found)


def test_alignment():
    rng = np.random.default_rng(0)
    a = [rng.integers(2, 8, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(2, 8, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    got = decontaminate.align(a, b, Leak())
    assert got.tolist() == [brute.smith_waterman(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_odd_rows(spark, odd, none, benchmark):
    tests = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "a b"), (5, "???"), (None, "no id here at all")], "item_id long, text string")
    found = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.find_leaks(odd, tests).collect())
    assert found == [("1", "1"), ("1", "1"), ("12", "4"), ("2", "1"), ("8", "4"), ("None", "None")]
    assert decontaminate.find_leaks(none, tests).count() == 0 and decontaminate.find_leaks(odd, tests.limit(0)).count() == 0
    kept = decontaminate.decontaminate(odd, tests)
    assert kept.columns == odd.columns and not {1, 2, None} & {r.doc_id for r in kept.collect()}
    assert decontaminate.decontaminate(odd, tests.limit(0)).count() == 16


def test_groups_of_items(documents, benchmark, monkeypatch):
    whole = sorted(map(tuple, decontaminate.find_leaks(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "GROUP_WORDS", 300)
    assert sum(1 for _ in decontaminate.item_groups(benchmark, "item_id", Leak())) > 2
    assert sorted(map(tuple, decontaminate.find_leaks(documents, benchmark).collect())) == whole


def test_short_item():
    items = decontaminate.Items.of([1], ["alpha beta"], Leak())
    for _, _, h, first in decontaminate.word_hashes(pa.array(["x alpha beta y", "alpha x beta"])):
        row, item, share = decontaminate.confirmed(items, h, first, Leak())
        assert row.tolist() == [0] and share.tolist() == [1.0]


def test_long_part_of_an_item():
    """A run of 40 words of an item of 200 is found, though it is a fifth of the item; one of 20 words is not."""
    words = [f"w{k}" for k in range(200)]
    items = decontaminate.Items.of([7], [" ".join(words)], Leak())
    texts = [f"before all {' '.join(words[80:n])} and after it" for n in (120, 100)]
    for _, _, h, first in decontaminate.word_hashes(pa.array(texts)):
        row, _, share = decontaminate.confirmed(items, h, first, Leak())
        assert row.tolist() == [0] and share.tolist() == [0.2]


def test_repeated_items():
    """An exact copy of an item, and an edited one, are found however many rows hold the item."""
    text = " ".join(f"word{k}" for k in range(15))
    edited = text.replace("word4 ", "other ").replace("word9 ", "other ")
    for copies in (1, 13, 14, 40):
        items = decontaminate.Items.of(list(range(copies)), [text] * copies, Leak())
        for _, _, h, first in decontaminate.word_hashes(pa.array([f"before {text} after", f"before {edited} after", "nothing of it"])):
            row, item, _ = decontaminate.confirmed(items, h, first, Leak())
            assert sorted(zip(row.tolist(), item.tolist(), strict=True)) == [(r, k) for r in (0, 1) for k in range(copies)]
