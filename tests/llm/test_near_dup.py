import random

import numpy as np
import pytest

from tarnbeck.llm import near_dup, splits
from tarnbeck.llm.near_dup import MinHash
from tarnbeck.llm.store import Store
from tests.llm import brute


def found(docs, spec):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, spec).collect()}


def expected(rows, spec):
    comp, sets = brute.components(rows, spec.size, spec.percent)
    return {i: (len(sets[i]), c, c == i) for i, c in comp.items()}


@pytest.mark.parametrize("spec", [MinHash(3, 85), MinHash(5, 80)])
def test_documents(documents, spec):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, spec) == expected(rows, spec)


def test_large_group_of_near_copies(spark):
    """More near copies than two blocks hold, at all similarities to one another."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 3, " ".join(w)))
    rng.shuffle(rows)
    spec = MinHash(3, 85)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spec) == expected(rows, spec)


def test_odd_rows(odd, none):
    got = found(odd, MinHash(3, 85))
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False)
    for i in (3, 4, 5):
        assert got[i] == (0, i, True)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False) and got[8] == (1, 8, True)
    assert got[None] == (3, None, True)
    assert near_dup.near_duplicates(odd, MinHash(3, 85)).count() == 16
    assert found(none, MinHash(3, 85)) == {}


def test_drop(odd, none):
    kept = near_dup.drop_near_duplicates(odd, MinHash(5, 80))
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 7 not in ids and None in ids and ids.count(1) == 2
    assert near_dup.drop_near_duplicates(none).count() == 0
    clash = odd.withColumnRenamed("source", "gone").withColumnRenamed("lang", "_gone")
    assert near_dup.drop_near_duplicates(clash).columns == clash.columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    df = near_dup.components(spark.createDataFrame(edges, "u long, v long"), Store(spark, "test"))
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    rows = df.collect()
    assert {r.node: r.comp for r in rows} == {x: find(x) for x in nodes} and len(rows) == len(nodes)
    assert near_dup.components(spark.createDataFrame([], "u long, v long"), Store(spark, "test")).count() == 0


def test_every_text_of_an_id_has_its_links(spark):
    """Two texts under one doc_id join what is similar to either; each row keeps its own set."""
    rng = random.Random(9)
    a, b, c = ([f"{x}{rng.randrange(900)}" for _ in range(60)] for x in "abc")
    texts = [(5, a), (5, b), (1, [*b[:-1], "end"]), (9, [*a[:-1], "end"]), (3, c), (9, c[:30]), (2, [*c[:29], "tail"]), (7, None), (5, None)]
    rows = [(i, t and " ".join(t)) for i, t in texts]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), MinHash(3, 85)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        [(5, 58, 1, False), (5, 58, 1, False), (1, 58, 1, True), (9, 58, 1, False), (3, 58, 3, True), (9, 28, 1, False), (2, 28, 1, False), (7, 0, 7, True), (5, 0, 5, True)]
    )


def test_an_id_with_most_rows(spark, monkeypatch):
    """One doc_id with many different texts, its rows split off as those of a key with most rows are."""
    monkeypatch.setattr(splits, "HOT", 3)
    rows = [(4, f"text number {k} and no other like it {k * 7}") for k in range(40)] + [(k, "all alike in every word") for k in range(10, 60)] + [(3, "text number 11 and no other like it 77")]
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), MinHash(3, 85)).collect()}
    assert got == {(4, 3), (3, 3)} | {(k, 10) for k in range(10, 60)}


def test_checksum_of_many_links(spark, monkeypatch):
    """Sums of hashes that overflow a long would raise under ANSI; the state of a round takes any number of links."""
    calls = []
    put = Store.put

    def counted(self, df, name, codec="snappy"):
        calls.append(name)
        return put(self, df, name, codec)

    monkeypatch.setattr(Store, "put", counted)
    edges = spark.range(1, 3000).selectExpr("id as u", "id + (1L << 62) as v")
    assert near_dup.components(edges, Store(spark, "test")).count() == 2 * 2999 and calls.count("small-star") <= 3


@pytest.mark.parametrize("split", [False, True])
def test_texts_with_a_long_common_part(spark, monkeypatch, split):
    """Many texts just below the least similarity share buckets and link with nothing; they make no candidates but the few that do link."""
    if split:
        monkeypatch.setattr(splits, "HOT", 5)
        monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(5)
    common = [f"c{k}" for k in range(200)]
    rows = [(k, " ".join([*common, *(f"u{rng.randrange(10**9)}" for _ in range(28))])) for k in range(120)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(5)]
    spec, seen = MinHash(3, 85), []
    found_pairs = near_dup.rare_pairs

    def watched(sets, spec, store):
        pairs = found_pairs(sets, spec, store)
        seen.append((sets.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(near_dup, "rare_pairs", watched)
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spec)
    assert got == expected(rows, spec)
    assert seen and seen[0][0] >= 100 and seen[0][1] <= 20


def test_rare_pairs_against_all_pairs(spark):
    """Among sets of all sizes and similarities, no similar pair of different components is missed."""
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(rng.choice(pool[: rng.integers(5, 60)], rng.integers(1, 40))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: max(1, len(s) - 1)], rng.choice(pool, 1)])) for s in sets[:60]]
    rows = [(k, k, bytearray(s.tobytes())) for k, s in enumerate(sets)]
    spec = MinHash(3, 85)
    got = {(r.u, r.v) for r in near_dup.rare_pairs(spark.createDataFrame(rows, "node long, comp long, shingles binary"), spec, Store(spark, "test")).collect()}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if near_dup.similar(np.int64(len(np.intersect1d(sets[a], sets[b]))), len(sets[a]), len(sets[b]), 85)}
    assert want <= got and len(want) > 30


def test_join_split(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT", 10)
    left = spark.createDataFrame([(k % 7 if k < 50 else 7, k) for k in range(100)] + [(None, 1), (8, 2)], "key long, x long")
    right = left.filter("key < 8").groupBy("key").count()
    rows = splits.join_split(left, right, "key", "count", 100).collect()
    assert sorted(r.x for r in rows) == list(range(100)) and {r["count"] for r in rows if r.key == 7} == {50}


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError, match="integer"):
        near_dup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)])) for _ in range(2))
    n = 256
    assert abs(np.mean(near_dup.minima(a, n) == near_dup.minima(b, n)) - 900 / 1100) < 0.1
    assert MinHash(3, 85).minima <= 256 and MinHash(5, 80).minima <= 256
