import zlib
from collections import defaultdict

import pytest

from tarnbeck.llm import sharding


def check(rows, texts, shards):
    places = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        places[r.shard].append(r)
    assert set(places) <= set(range(shards))
    for held in places.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return {s: sum(r.size for r in held) for s, held in places.items()}


def test_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = sharding.shard_documents(documents, 8).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load = check(rows, texts, 8)
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(documents.repartition(7), 8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_copies_spread(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'same text' as text")
    counts = [r["count"] for r in sharding.shard_documents(docs, 10).groupBy("shard").count().collect()]
    assert len(counts) == 10 and max(counts) - min(counts) <= 1


def test_odd_rows(odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == 16
    check(rows, texts, 3)
    assert sharding.shard_documents(none, 3).count() == 0


def test_rebalance():
    sizes = [5, 1, 1, 1, 9, 2, 2, 3]
    first = sharding.spread(8, 3)
    second = sharding.rebalance(sizes, first, 3)
    load = [sum(z for z, s in zip(sizes, second, strict=True) if s == k) for k in range(3)]
    assert max(load) == 9 and sum(load) == 24
    assert sharding.rebalance(sizes, second, 3) == second  # level already: nothing moves
    grown = sharding.rebalance(sizes, second, 4)
    assert set(grown) == {0, 1, 2, 3} and sum(a != b for a, b in zip(second, grown, strict=True)) <= 5


def test_three_versions_of_a_stored_map(spark, documents, tmp_path):
    """Each run reads the stored map, edits it and adds a version; grown data and one more shard move few bytes."""
    path = str(tmp_path / "map")
    assert sharding.load_map(spark, path) is None
    texts = {r.doc_id: r.text for r in documents.collect()}
    runs = []
    for docs, shards in ((documents.filter("doc_id % 10 != 3"), 8), (documents, 8), (documents, 9)):
        rows = sharding.shard_documents(docs, shards, 512, path).collect()
        load = check(rows, texts, shards)
        assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
        runs.append({r.doc_id: (r.shard, r.map_version, r.vslot, r.size) for r in rows})
    assert [{v for _, v, _, _ in r.values()} for r in runs] == [{2}, {3}, {4}]
    versions = [sharding.load_map(spark, path, v)[1] for v in (1, 2, 3, 4)]
    assert versions[0] == sharding.spread(512, 8) and sharding.load_map(spark, path) == (4, versions[3])
    for run, shard in zip(runs, versions[1:], strict=True):
        assert all(s == shard[vslot] for s, _, vslot, _ in run.values())
    total = sum(size for *_, size in runs[1].values())
    moved = [sum(b[i][3] for i in a if a[i][0] != b[i][0]) for a, b in zip(runs, runs[1:], strict=False)]
    assert 0 < moved[0] < 0.35 * total and total / 9 * 0.8 < moved[1] < 0.35 * total
    with pytest.raises(Exception, match="already exists"):
        sharding.save_map(spark, path, 4, versions[3])
    with pytest.raises(ValueError, match="virtual slots"):
        sharding.edit_map(spark, path, [1, 2], 3)


def test_no_python_in_plan(documents):
    plan = sharding.shard_documents(documents, 8)._jdf.queryExecution().toString()
    for word in ("Python", "Pandas", "Arrow"):
        assert word not in plan


@pytest.mark.parametrize("shards", [1, 40])
def test_shard_counts(documents, shards):
    assert sharding.shard_documents(documents, shards).count() == documents.count()
