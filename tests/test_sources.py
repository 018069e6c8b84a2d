"""Readers and writers."""

import pytest

from tarnbeck.errors import EngineError
from tarnbeck.sources import from_rows, read_csv, read_json, read_parquet, write_csv, write_json, write_parquet


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_inference(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a.csv", "name,age,score,ok,note\nAlice,25,1.5,true,\nBob,,2,FALSE,\"x, \"\"y\"\"\"\n"))
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("score", "double"), ("ok", "boolean"), ("note", "string")]
    assert rows(df) == [("Alice", 25, 1.5, True, ""), ("Bob", None, 2.0, False, 'x, "y"')]


def test_csv_options(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "b.csv", "# c\n1; x\n2; y\n"), delimiter=";", comment="#", header=False, skip_initial_space=True)
    assert df.columns == ["column_0", "column_1"] and rows(df) == [(1, "x"), (2, "y")]
    df = read_csv(spark, put(tmp_path, "c.csv", "a,b\n"))
    assert df.dtypes == [("a", "string"), ("b", "string")] and df.count() == 0
    ragged = put(tmp_path, "d.csv", "a,b\n1,2\n3\n")
    assert rows(read_csv(spark, ragged, strict=False)) == [(1, 2), (3, None)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_csv(spark, ragged).collect()


def test_csv_round_trip(spark, tmp_path):
    df = from_rows(spark, [("a,b", 1, 1.5, True), ("", None, None, None), ('q"t', 3, 1e300, False)], "s string, i bigint, d double, b boolean")
    path = str(tmp_path / "out")
    write_csv(df, path, single_file=True)
    assert sorted(map(str, rows(read_csv(spark, path)))) == sorted(map(str, rows(df)))


def test_json(spark, tmp_path):
    df = read_json(spark, put(tmp_path, "a.json", '{"id": 1, "name": "Alice", "active": true}\n\n{"id": 2.5, "x": {"y": 1}, "name": null}\n'))
    assert df.columns == ["active", "id", "name", "x"]
    assert dict(df.dtypes) == {"active": "boolean", "id": "double", "name": "string", "x": "string"}
    assert rows(df) == [(True, 1.0, "Alice", None), (None, 2.5, None, '{"y": 1}')]
    mixed = read_json(spark, put(tmp_path, "b.json", '{"v": 1}\n{"v": "2"}\n'))
    assert mixed.dtypes == [("v", "string")]
    flags = read_json(spark, put(tmp_path, "c.json", '{"v": "yes"}\n{"v": "n"}\n'))
    assert rows(flags) == [(True,), (False,)]
    text = read_json(spark, put(tmp_path, "d.json", '{"v": 1}\n'), infer=False)
    assert text.dtypes == [("v", "string")]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_json(spark, put(tmp_path, "e.json", '{"v": 1}\n{"v": \n')).collect()


def test_json_array_round_trip(spark, tmp_path):
    df = from_rows(spark, [(1, "a"), (None, "b")], "i bigint, s string")
    for lines in (True, False):
        path = str(tmp_path / f"out{lines}")
        write_json(df, path, lines=lines)
        assert sorted(map(str, rows(read_json(spark, path, lines=lines)))) == sorted(map(str, rows(df)))
    write_json(df.limit(0), str(tmp_path / "none"), lines=False)
    assert read_json(spark, str(tmp_path / "none"), lines=False).count() == 0
    assert read_json(spark, str(tmp_path / "outTrue"), max_records=1).count() == 1


@pytest.mark.parametrize("codec", ["snappy", "gzip", "lz4", "zstd", "uncompressed"])
def test_parquet(spark, tmp_path, codec):
    df = from_rows(spark, [(1, "a"), (None, None)], "i bigint, s string")
    path = str(tmp_path / codec)
    write_parquet(df, path, codec, row_group_bytes=1 << 20, dictionary=False)
    assert sorted(map(str, rows(read_parquet(spark, path, ["s", "i"])))) == ["('a', 1)", "(None, None)"]
    with pytest.raises(EngineError):
        read_parquet(spark, path, ["nothing"])
    with pytest.raises(EngineError):
        write_parquet(df, path, "brotli")


def test_memory(spark):
    assert from_rows(spark, [], "a bigint").count() == 0
    with pytest.raises(EngineError):
        from_rows(spark, [(1, 2)], "a bigint")


def test_csv_files_are_split(spark, tmp_path):
    """A file is several tasks' unless cells may hold line feeds."""
    path = put(tmp_path, "long.csv", "a,b\n" + "".join(f"{k},text of row {k}\n" for k in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20000 and df.agg({"a": "sum"}).first()[0] == sum(range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    fed = put(tmp_path, "fed.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows(read_csv(spark, fed, multi_line=True)) == [(1, "x\ny"), (2, "z")]


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_json_array_of_any_size(spark, tmp_path, n):
    import json

    path = tmp_path / "out"
    df = spark.range(0, n, 1, 6).selectExpr("id", "if(id % 3 = 0, null, concat('t\"', id)) as t")
    write_json(df, str(path), lines=False)
    (part,) = path.glob("part-*")
    assert json.loads(part.read_text()) == [{"id": k, "t": None if k % 3 == 0 else f't"{k}'} for k in range(n)]
