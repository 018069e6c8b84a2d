import pytest

import corpus_pipeline
from tarnbeck.llm.store import Store
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, small):
    """The documents that each stage was given, and what the last returned."""
    store, docs = Store(spark, "test"), spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store.put(stage(spark, out[-1], small), name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    for a, b in zip(stages, stages[1:], strict=False):
        assert ids(b) <= ids(a) and b.count() == len(ids(b))


def test_near_duplicates(stages):
    comp, _ = brute.components([(r.doc_id, r.text) for r in stages[2].collect()], 5, 80)
    assert ids(stages[3]) == {i for i, c in comp.items() if i == c}


def test_tokens(stages):
    assert ids(stages[5]) == ids(stages[4]) and stages[5].filter("not round_trip").count() == 0


def test_run(spark, small, stages):
    assert ids(corpus_pipeline.run(spark, small)) == ids(stages[5])


def test_odd_rows(spark, odd, none, small):
    docs, empty = odd.select("doc_id", "text", "lang", "source"), none.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() <= 16
        assert stage(spark, empty, small).count() == 0
