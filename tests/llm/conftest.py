import pytest

ODD = [
    (1, "One two three four five six."), (2, "one TWO three four five six."), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "a"), (7, "a"), (8, "a b"), (9, "Ünï çödé 漢字 🎉 e\u0301 don't <|endoftext|> ʼn"),
    (10, "x " * 3000), (11, "y" * 50_000), (12, "1 22 333 $$$ *** a*b|c <tag> don't 'tis"), (13, "\x00 nul \x1c sep \x85 nel \xa0 nbsp"), (14, "line one here\nline one here\nother line\n\nline one here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null id, a repeated row, and columns whose names clash with what operators add."""
    rows = [(i, t, "en", f"s{i}", 1.5, True, 7) for i, t in ODD]
    rows += [(None, "no id here at all", None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept boolean, slot long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
