"""SQL executor, streaming, settings, errors, metrics and the command line."""

import pytest
from pyspark.sql import functions as F

from tarnbeck.config import Config
from tarnbeck.errors import EngineError, suggest
from tarnbeck.metrics import Metrics, cached
from tarnbeck.sources import from_rows
from tarnbeck.sql import SqlExecutor
from tarnbeck.streaming import process_stream, read_stream, sessions, windowed_counts


@pytest.fixture
def sql(spark):
    ex = SqlExecutor(spark)
    ex.register("people", from_rows(spark, [("Alice", 25), ("Bob", 30), ("Charlie", 35), ("Diana", 40), ("Eve", 45)], "name string, age bigint"))
    yield ex
    ex.clear()


def test_sql(sql):
    assert sql.registered() == ["people"]
    assert [r.name for r in sql.execute("SELECT name FROM people ORDER BY age LIMIT 2 OFFSET 1").collect()] == ["Bob", "Charlie"]
    assert sql.execute("SELECT * FROM people LIMIT 0").columns == ["name", "age"]
    assert sql.prepare("SELECT name FROM people WHERE age > :least").execute(least=40).count() == 1
    assert [df.count() for df in sql.batch(["SELECT * FROM people", "SELECT 1 AS one"])] == [5, 1]
    assert "Physical Plan" in sql.explain("SELECT * FROM people")


@pytest.mark.parametrize("query", ["SELECT", "SELECT name FROM people WHERE age IN (", "DELETE FROM people", "SELECT name, sum(age) FROM people", "SELECT nothing FROM people", "SELECT name FROM people extra tokens here"])
def test_sql_errors(sql, query):
    with pytest.raises(EngineError):
        sql.validate(query)


def test_sql_suggests(sql):
    with pytest.raises(EngineError, match="did you mean people"):
        sql.validate("SELECT * FROM poeple")
    with pytest.raises(EngineError, match="query 1"):
        sql.batch(["SELECT 1", "SELECT"])
    with pytest.raises(EngineError):
        sql.register("no name", sql.tables["people"])


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(9).withColumnRenamed("id", "v").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = str(tmp_path / "out")
    stats = process_stream(read_stream(spark, src, schema, max_files=1), [lambda df: df.filter("v > 2"), None, lambda df: df.withColumn("w", F.col("v") * 2)], out, str(tmp_path / "state"), 120)
    assert stats.rows == 9 and stats.batches >= 3
    assert sorted(r.w for r in spark.read.parquet(out).collect()) == [6, 8, 10, 12, 14, 16]
    again = process_stream(read_stream(spark, src, schema), [], out, str(tmp_path / "state"), 120)
    assert again.rows == 0  # taken in before
    seen = []
    process_stream(read_stream(spark, src, schema), [], lambda df, k: seen.append(df.count()), str(tmp_path / "state2"), 120)
    assert sum(seen) == 9
    with pytest.raises(EngineError, match="operation 1"):
        process_stream(read_stream(spark, src, schema), [None, lambda df: df.select("nothing")], out, str(tmp_path / "state3"), 120)


def test_event_time_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    events = from_rows(spark, [("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 1), ("2024-01-01 02:00:00", 1)], "t string, k bigint").select(F.col("t").cast("timestamp").alias("ts"), "k")
    events.write.parquet(src)
    out = str(tmp_path / "out")
    process_stream(read_stream(spark, src, events.schema), [lambda df: windowed_counts(df, "ts", "1 hour", None, ["k"])], out, str(tmp_path / "state"), 120)
    assert [r.n for r in spark.read.parquet(out).collect()] == [2]  # the last window is still open
    assert sorted(r.n for r in sessions(events, "ts", "30 minutes", ["k"]).collect()) == [1, 2]


def test_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# settings\nshuffle_partitions: 3\nadaptive: true\n")
    (tmp_path / "c.json").write_text('{"shuffle_partitions": 3}')
    assert Config.from_file(tmp_path / "c.yaml") == Config.from_file(tmp_path / "c.json") == Config(shuffle_partitions=3)
    assert Config.from_env({"TARNBECK_BROADCAST_BYTES": "10"}).broadcast_bytes == 10
    before = spark.conf.get("spark.sql.shuffle.partitions")
    Config(shuffle_partitions=3).apply(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for bad in (lambda: Config(shuffle_partitions=0), lambda: Config(memory_fraction=2.0), lambda: Config().with_values(nothing=1)):
        with pytest.raises(EngineError):
            bad()


def test_errors_and_metrics(spark):
    assert suggest("salery", ["name", "salary", "age"]) == ["salary"]
    m = Metrics()
    with m.timed("x"):
        pass
    with cached(spark.range(3)) as df:
        assert df.count() == 3
    assert "| x |" in m.report()


def test_command_line(spark, capsys, monkeypatch):
    import tarnbeck.__main__ as cli

    monkeypatch.setattr(cli, "get_spark", lambda **k: spark)
    cli.main(["demo", "--rows", "50"])
    out = capsys.readouterr().out.splitlines()  # the demo's own gauges, each with its mean and count
    groups = [line.split() for line in out if line.startswith("g") and line[1:2].isdigit()]
    assert out[0].endswith("rows after the filter") and sum(int(n) for _, _, n in groups) == 50 and {g for g, _, _ in groups} <= {f"g{k}" for k in range(12)}


@pytest.mark.parametrize("seed", range(5))
def test_properties(spark, seed):
    import random

    from tarnbeck import operators as op

    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(-5, 6)]),) for _ in range(rng.randrange(0, 40))]
    df = from_rows(spark, rows, "v bigint")
    assert op.filter_rows(df, F.col("v") > 0).count() == sum(v is not None and v > 0 for (v,) in rows)
    assert [r.v for r in op.sort_by(df, ["v"]).collect()] == sorted((v for (v,) in rows), key=lambda v: (v is not None, v or 0))
    assert len(op.with_column(df, "w", F.col("v") + 1).columns) == 2
    assert op.group_by(df, "v").count().count() == len(set(rows))


def test_statistics_of_many_batches(spark, tmp_path):
    """More micro-batches than a query remembers are all counted."""
    src = tmp_path / "in"
    spark.range(0, 1300, 1, 130).write.parquet(str(src))
    stats = process_stream(read_stream(spark, str(src), spark.range(1).schema, max_files=1), [], lambda df, k: df.write.format("noop").mode("append").save(), str(tmp_path / "state"), 300)
    assert (stats.batches, stats.rows) == (130, 1300)


def test_frame(spark):
    from tarnbeck.frame import Frame

    f = Frame(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "x long, k string"))
    assert (f.columns, f.width, f.has_column("x"), f.type_of("x"), f.count(), f.is_empty()) == (["x", "k"], 2, True, "bigint", 3, False)
    assert [tuple(r) for r in f.filter(F.col("x") > 1).sort_by(["x"], [False]).select("k").collect()] == [("a",), ("b",)]
    assert sorted(map(tuple, f.group_by("k").agg(F.sum("x").alias("s")).collect())) == [("a", 4), ("b", 2)]
    assert f.join(f.drop("x").limit(1), "k").count() == 2 and f.concat(f).head(1, ["x"]).collect()[0].x == 1
    assert "x: bigint" in repr(f)
    with pytest.raises(EngineError):
        f.type_of("nothing")


def test_entry_without_packages_of_the_subpackage():
    """The other queries register where a package that only the optional subpackage uses is missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['zstandard'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_nested_settings(tmp_path):
    yaml, nested = tmp_path / "a.yaml", tmp_path / "b.json"
    yaml.write_text("execution:\n  shuffle_partitions: 12  # some\n  memory:\n    memory_fraction: 0.5\nansi: false\ntime_zone: 'Europe/Oslo'\nbroadcast_bytes:\n")
    nested.write_text('{"execution": {"shuffle_partitions": 12, "memory": {"memory_fraction": 0.5}}, "ansi": false, "time_zone": "Europe/Oslo"}')
    assert Config.from_file(yaml) == Config.from_file(nested) == Config(shuffle_partitions=12, memory_fraction=0.5, ansi=False, time_zone="Europe/Oslo")
    with pytest.raises(EngineError):
        yaml.write_text("a:\n  nothing: 1\n")
        Config.from_file(yaml)
    tuned = Config().tuned(100 << 30, 64)
    assert tuned.shuffle_partitions == 800 and tuned.max_partition_bytes == 128 << 20
    assert Config().tuned(0, 8).shuffle_partitions == 24 and Config().tuned(1 << 20, 8).max_partition_bytes == 4 << 20
    with pytest.raises(EngineError):
        Config().tuned(-1, 8)


def test_suite_and_plan(spark):
    from tarnbeck.metrics import Suite, plan_of

    calls, suite = [], Suite()
    suite.add("one", lambda: calls.append(1))
    assert len(suite.run(2)["one"]) == 2 and len(calls) == 3 and "| one | 2 |" in suite.report() and '"one"' in suite.to_json()
    df = spark.range(10).filter("id > 3").groupBy("id").count()
    assert any("Aggregate" in n["class"] for n in plan_of(df)) and any("Exec" in n["class"] for n in plan_of(df, physical=True))


def test_describe():
    try:
        try:
            raise KeyError("x")
        except KeyError as e:
            raise EngineError("select", "no such column", "agee", "did you mean age?") from e
    except EngineError as e:
        assert e.describe("brief") == "no such column" and "agee" in e.describe() and e.describe("full").splitlines()[-1].startswith("cause: KeyError")
        with pytest.raises(ValueError):
            e.describe("loud")
