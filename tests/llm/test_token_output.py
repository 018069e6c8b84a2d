import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarnbeck.llm import rans, token_output
from tarnbeck.llm.id_table import IdTable
from tarnbeck.llm.text import pieces
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, docs):
    at, out = 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    return out


def test_documents(spark, documents, library):
    path = token_output.write_token_files(documents.repartition(5), PATH, 1, block=5000)
    got = sorted(map(tuple, token_output.read_token_files(spark, path).collect()))
    assert got == expected(library, [(r.doc_id, r.text) for r in documents.collect()])
    blocks = spark.read.parquet(f"{path}/*-blocks").orderBy("start").collect()
    assert len(blocks) > 5 and [d for b in blocks for d in b.docs] == sorted(r.doc_id for r in documents.collect())


def test_odd_rows(spark, odd, none, library):
    path = token_output.write_token_files(odd, PATH, 1)
    got = sorted(map(tuple, token_output.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(library, [(r.doc_id, r.text) for r in odd.collect()])
    path = token_output.write_token_files(none, PATH, 1)
    assert token_output.read_token_files(spark, path).count() == 0


def test_many_ranges(spark, documents, library):
    """As many ranges as the ids ask for, in the order of doc_id, whatever their number."""
    docs = documents.limit(60).repartition(3)
    path = token_output.write_token_files(docs, PATH, 1, block=200, range_ids=200)
    got = sorted(map(tuple, token_output.read_token_files(spark, path).collect()))
    assert got == expected(library, [(r.doc_id, r.text) for r in docs.collect()])
    blocks = spark.read.parquet(f"{path}/*-blocks").orderBy("part", "number").collect()
    assert len({b.part for b in blocks}) > 20 and [d for b in blocks for d in b.docs] == sorted(r.doc_id for r in docs.collect())


def test_text_ids(spark, library):
    rows = [(f"id-{k:03d}", f"text {k}" * (k % 5)) for k in range(120)] + [(None, "no id"), ("id-007", "another text"), ("id-007", "another text"), ("", None)]
    path = token_output.write_token_files(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), PATH, 1, range_ids=40)
    got = sorted(map(tuple, token_output.read_token_files(spark, path).collect()), key=lambda r: r[1])
    ids = {(i, brute.crc([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows}
    assert {(r[0], r[3]) for r in got} == ids and [r[0] or "" for r in got] == sorted(r[0] or "" for r in got) and got[0][0] is None
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]


def test_an_id_with_most_rows(spark, library):
    """Rows of one doc_id may fill several ranges."""
    rows = [(5, f"text number {k}") for k in range(400)] + [(1, "first"), (9, "last")]
    path = token_output.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 1, range_ids=100)
    got = sorted(map(tuple, token_output.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, *[5] * 400, 9] and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    assert len({b.part for b in spark.read.parquet(f"{path}/*-blocks").collect()}) > 5


def test_parts_of_words(library):
    import random

    rng = random.Random(4)
    letters = [*"abXÉéßẞİΣσς'st re ll \t\n\v\f\r\x1c\x1f\x85\xa0\u3000é\u0300<|>123٣!?%漢字🎉\u200b\x00Ã×÷ÿJ\u030cǰ*,.Ç", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "..."]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)]
    words = token_output.WordIds(PATH)
    for p in pieces(pa.array(texts), 1 << 12):
        ids, size = words(p)
        ends = np.cumsum(size)
        for t, a, b in zip(texts[p.lo : p.hi], ends - size, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_table_of_parts():
    """Grows, finds what it holds and nothing else, and is emptied."""
    rng = np.random.default_rng(0)
    table = IdTable(50_000)
    table.keys, table.codes = np.zeros(8, np.uint64), np.zeros(8, np.int32)
    hashes = np.unique(rng.integers(1, 1 << 63, 60_000).astype(np.uint64))
    for part in np.array_split(hashes, 7):
        table.add(part, np.repeat(part.astype(np.uint32), 2), np.full(len(part), 2))
    code = table.find(hashes)
    assert sorted(code.tolist()) == list(range(len(hashes))) and (table.find(hashes + np.uint64(1)) < 0).all()
    ids, size = table.ids(code[:3], np.array([0, 1, 3]))
    assert size.tolist() == [2, 4] and ids.tolist() == np.repeat(hashes[:3].astype(np.uint32), 2).tolist()
    table.room()
    assert table.used == 0 and (table.find(hashes) < 0).all()


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 600_000])
@pytest.mark.parametrize("kinds", [1, 2, 60_000])
def test_range_coder(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=1))
    payload = rans.encode(ids, table)
    assert (rans.decode(payload, n, table) == ids).all()
    assert int(table.freq.sum()) == 1 << table.bits
    if n > 1 << 18:
        step = rans.STRIDE * rans.LANES
        assert (rans.decode(payload, n, table, 1) == ids[step:]).all() and (rans.decode(payload, n, table, 1, 1) == ids[step : 2 * step]).all()
        p = np.bincount(ids) / n
        p = p[p > 0]
        assert len(payload) * 8 < -(p * np.log2(p)).sum() * n * 1.02 + 64 * rans.LANES * 5


def test_damage_is_found(spark, documents):
    path = token_output.write_token_files(documents, PATH, 1)
    blocks = spark.read.parquet(f"{path}/*-blocks")
    from pyspark.sql import functions as F

    broken = blocks.withColumn("ids_crc32", F.col("ids_crc32") + 1)
    store = path + "-broken"
    spark.read.parquet(f"{path}/*-table").write.parquet(f"{store}/001-table")
    broken.write.parquet(f"{store}/002-blocks")
    with pytest.raises(Exception, match="damaged"):
        token_output.read_token_files(spark, store).collect()
