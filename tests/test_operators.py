"""Operators on small literal frames, with nulls, ties and empty inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tarnbeck import functions as fn
from tarnbeck import operators as op
from tarnbeck.errors import EngineError
from tarnbeck.functions import CURRENT_ROW, following, over, preceding, with_window
from tarnbeck.sources import from_rows


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return from_rows(spark, [("Alice", 25, "Engineering", 100000), ("Bob", 30, "Sales", 80000), ("Charlie", 35, "Engineering", 120000), ("Diana", 28, "Marketing", 75000), (None, None, None, None)], "name string, age bigint, department string, salary bigint")


def test_select_and_drop(people):
    assert op.select(people, "age", "name").columns == ["age", "name"]
    assert op.select(people, "age", "nothing", lenient=True).columns == ["age"]
    with pytest.raises(EngineError, match="did you mean salary"):
        op.select(people, "salery")
    assert op.drop(people, "age", "nothing").columns == ["name", "department", "salary"]
    assert op.has_column(people, "age") and not op.has_column(people, "Age")


def test_filters_are_all_kept(spark):
    df = from_rows(spark, [(20, 30000), (25, 40000), (30, 50000), (35, 60000), (40, 70000), (45, 80000)], "age bigint, salary bigint")
    assert values(op.filter_rows(df, F.col("age") > 25, F.col("salary") < 70000)) == [(30, 50000), (35, 60000)]


def test_filter_drops_null_conditions(people):
    assert op.filter_rows(people, F.col("age") > 0).count() == 4
    assert op.filter_rows(people, fn.not_(F.col("age") > 28)).count() == 2


def test_filter_reaches_the_scan(spark):
    df = op.filter_rows(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), F.col("o_orderkey") > 10).select("o_orderkey")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(o_orderkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


@pytest.fixture(scope="module")
def sides(spark):
    users = from_rows(spark, [(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "Diana"), (None, "Nobody")], "id bigint, name string")
    orders = from_rows(spark, [(101, 1, 100.0), (102, 2, 200.0), (103, 1, 150.0), (104, None, 5.0)], "order_id bigint, user_id bigint, amount double")
    return users, orders


@pytest.mark.parametrize(("how", "n"), [("inner", 3), ("left", 6), ("right", 4), ("full", 7), ("semi", 2), ("anti", 3)])
@pytest.mark.parametrize("strategy", [None, "broadcast", "merge", "hash"])
def test_joins(sides, how, n, strategy):
    out = op.join(*sides, "id", "user_id", how, strategy)
    assert out.count() == n
    assert out.columns == ["id", "name"] + ([] if how in ("semi", "anti") else ["order_id", "user_id", "amount"])


def test_broadcast_only_of_a_small_side(spark, tmp_path):
    """A side that is large, or has many rows in small files, is not sent through the driver because a broadcast was asked for; a small one is, whatever the session's own bound."""
    spark.range(600_000).select(F.lit(7).cast("bigint").alias("b"), F.lit("x").alias("c")).write.parquet(str(tmp_path / "packed"))
    sides = {n: (spark.range(2_000_000), spark.range(n).select((F.col("id") * 2).alias("b"))) for n in (1_500_000, 1000)} | {"packed": (spark.range(10), spark.read.parquet(str(tmp_path / "packed")))}
    joined = lambda n: op.join(*sides[n], "id", "b", strategy="broadcast")
    plan = lambda n: joined(n)._jdf.queryExecution().executedPlan().toString()
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for own in (bound, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
        try:
            assert "Broadcast" not in plan(1_500_000) and "Broadcast" not in plan("packed")
            assert "BroadcastHashJoin" in plan(1000)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    for n, found in ((1_500_000, 1_000_000), (1000, 1000)):
        assert tuple(joined(n).agg(F.count("*"), F.sum("id"), F.sum("b")).first()) == (found, found * (found - 1), found * (found - 1))
    assert tuple(joined("packed").agg(F.count("*"), F.sum("id"), F.min("c")).first()) == (600_000, 4_200_000, "x")
    stream = spark.readStream.format("rate").load()
    assert op.join(stream, stream, "value", strategy="broadcast").isStreaming


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_broadcast_gives_the_rows_of_merge(spark, how):
    """On sides of known size, which those of literal rows are not, with null keys, twins and keys without a partner."""
    left, right = (spark.range(n).select("id", F.nullif(F.col("id") % m, F.lit(k)).alias("k")) for n, m, k in ((40, 13, 3), (30, 17, 5)))
    broadcast, merge = (op.join(left, right, "k", how=how, strategy=s) for s in ("broadcast", "merge"))
    if how not in ("right", "full"):  # where Spark cannot build the right side
        assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, broadcast.collect())) == sorted(map(str, merge.collect()))


def test_join_names_and_errors(spark, sides):
    users, orders = sides
    twin = op.join(users, users, "id")
    assert twin.columns == ["id", "name", "id_right", "name_right"] and twin.count() == 4
    left = from_rows(spark, [(1, "A", 1.0), (2, "B", 2.0), (3, "C", 3.0)], "key1 bigint, key2 string, value double")
    right = from_rows(spark, [(1, "A", 1.5), (2, "B", 2.5), (4, "D", 4.5)], "key1 bigint, key2 string, right_value double")
    assert op.join(left, right, ["key1", "key2"]).count() == 2
    for bad in (lambda: op.join(users, orders, "id", ["user_id", "amount"]), lambda: op.join(users, orders, "nothing"), lambda: op.join(users, orders, "id", "user_id", "sideways"), lambda: op.join(users, orders, [])):
        with pytest.raises(EngineError):
            bad()


def test_groups(spark):
    df = from_rows(spark, [("A", 10, 1.5), ("B", 20, 2.0), ("A", 30, 3.5), ("B", None, 4.0), (None, 50, 5.5), ("null", 1, 1.0)], "category string, value bigint, price double")
    out = op.group_by(df, "category").agg(fn.sum_("value"), fn.count("value"), fn.mean("price"), fn.count_all())
    assert out.columns == ["category", "sum_value", "count_value", "mean_price", "count_*"]
    assert values(out) == [(None, 50, 1, 5.5, 1), ("A", 40, 2, 2.5, 2), ("B", 20, 1, 3.0, 2), ("null", 1, 1, 1.0, 1)]
    assert values(op.group_by(df).agg(F.count("*").alias("n"))) == [(6,)]
    assert op.group_by(df.limit(0), "category").sum("value").count() == 0
    assert values(op.group_by(df, "category").having(lambda total: total > 40, total=F.sum("value"))) == [(None, 50)]
    assert values(op.group_by(df, "category").agg_with_having(F.abs(F.col("n")) + F.sqrt(F.col("n")) > 3, F.count("*").alias("n"))) == [("A", 2), ("B", 2)]
    for short in ("sum", "count", "mean", "min", "max"):
        assert getattr(op.group_by(df, "category"), short)("value").columns == ["category", f"{short}_value"]
    with pytest.raises(EngineError):
        op.group_by(df, "categori")
    with pytest.raises(EngineError):
        op.group_by(df, "category").agg()


def test_windows(spark):
    df = from_rows(spark, [(50000, "HR"), (60000, "HR"), (60000, "HR"), (70000, "Engineering"), (70000, "Engineering"), (80000, "Engineering")], "salary bigint, department string")
    w = over().partition_by("department").order_by("salary")
    assert [r[-1] for r in values(with_window(df, "r", "rank", spec=w))] == [1, 2, 2, 1, 1, 3]
    assert sorted(r.d for r in with_window(df, "d", "dense_rank", spec=w).collect()) == [1, 1, 1, 2, 2, 2]
    whole = with_window(df, "s", "sum", "salary", spec=over().partition_by("department")).select("department", "s").distinct()
    assert values(whole) == [("Engineering", 220000), ("HR", 170000)]
    groups = with_window(df, "s", "count", "salary", spec=w.groups(preceding(1), CURRENT_ROW))
    assert values(groups.select("department", "salary", "s")) == [("Engineering", 70000, 2), ("Engineering", 70000, 2), ("Engineering", 80000, 3), ("HR", 50000, 1), ("HR", 60000, 3), ("HR", 60000, 3)]
    assert groups.columns == ["salary", "department", "s"]
    for bad in (lambda: with_window(df, "x", "rank", spec=over()), lambda: with_window(df, "x", "nothing", spec=w), lambda: w.rows(following(1), preceding(1)), lambda: with_window(df, "x", "sum", "salary", spec=over().partition_by("dep"))):
        with pytest.raises(EngineError):
            bad()


def test_rolling_and_correlation(spark):
    df = from_rows(spark, [(k, float(k), 2.0 * k, float(6 - k), 1.0) for k in range(1, 6)], "i bigint, x double, y double, z double, one double")
    got = [r.x_mean for r in op.rolling(df, "x", 3, "mean", ["i"]).orderBy("i").collect()]
    assert all(map(math.isnan, got[:2])) and got[2:] == [2.0, 3.0, 4.0]
    assert op.rolling(df, "x", 2, "std", ["i"]).orderBy("i").collect()[-1].x_std == 0.5
    for a, b, want in (("x", "y", 1.0), ("x", "z", -1.0), ("x", "one", 0.0)):
        assert op.correlation(df, a, b).first()[0] == pytest.approx(want)
    assert op.correlation(df.limit(0), "x", "y").first()[0] == 0.0
    with pytest.raises(EngineError):
        op.rolling(df, "x", 0, "mean", ["i"])
    with pytest.raises(EngineError):
        op.rolling(df, "x", 2, "median", ["i"])


def test_eager_window_functions(spark):
    rows = list(zip(range(8), [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0], "AABBABAB"))
    df = from_rows(spark, rows, "i bigint, values double, groups string")
    got = lambda f, **k: [r[f] for r in op.window_function(df, f, "values", ["i"], **k).orderBy("i").collect()]
    assert got("row_number") == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got("rank") == [4, 1, 5, 1, 6, 8, 3, 7]
    assert got("row_number", partition_by=["groups"]) == [1, 2, 1, 2, 3, 3, 4, 4]
    assert got("lag") == [None, 3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    assert got("lead", partition_by=["groups"]) == [1.0, 5.0, 1.0, 9.0, 2.0, 6.0, None, None]
    with pytest.raises(EngineError):
        op.window_function(df, "median", "values", ["i"])


def test_ranges(spark):
    df = from_rows(spark, [(k,) for k in range(10)], "k bigint")
    assert values(op.slice_rows(df, 2, 5, ["k"])) == [(2,), (3,), (4,)]
    assert op.slice_rows(df, 5, 2, ["k"]).columns == ["k"] and op.slice_rows(df, 5, 2, ["k"]).count() == 0
    assert op.limit_offset(op.sort_by(df, ["k"]), 3, 8).count() == 2
    assert op.limit_offset(df, 0).count() == 0 and op.limit_offset(op.sort_by(df, ["k"]), offset=20).count() == 0
    assert [r.k for r in op.head(df, 2, ["k"], [False]).collect()] == [9, 8]
    with pytest.raises(EngineError):
        op.limit_offset(df, -1)
    with pytest.raises(EngineError):
        op.sort_by(df, ["k"], [True, False])


def test_concat(spark):
    df = from_rows(spark, [(1, "a")], "k bigint, s string")
    assert op.concat(df, df, df).count() == 3
    with pytest.raises(EngineError):
        op.concat(df, df.select("s", "k"))
    with pytest.raises(EngineError):
        op.concat(df, df.withColumn("k", F.lit(1.0)))


def test_scalars(spark):
    df = from_rows(spark, [(7, 2, 0, None, -1.5)], "a bigint, b bigint, z bigint, n bigint, d double")
    row = df.select(
        fn.int_div("a", "b"), fn.int_div("a", "z"), fn.safe_div("a", "z"), fn.modulo("a", "z"), fn.concat("a", F.lit("x"), "b"), fn.concat("a", "n"), fn.as_string("n"), fn.round_to(F.lit(2.5), 0), fn.round_("d"),
        fn.coalesce("n", "a"), fn.case().when(F.col("a") > 5, "big").end(), fn.cast_int64(F.lit("x")), fn.neg("d"), fn.int_div(fn.neg("a"), "b"),
    ).first()
    assert tuple(row) == (3, None, None, None, "7x2", None, "", 3.0, -2.0, 7, "big", None, 1.5, -3)
    with pytest.raises(EngineError):
        fn.case().end()


def test_dates(spark):
    rows = [("2024-01-31 12:00:00", "2024-03-01 06:00:00"), ("2024-02-15 12:00:00", "2024-02-15 15:30:00"), ("2023-01-15 00:00:00", "2024-03-10 00:00:00"), (None, "2024-01-01 00:00:00")]
    df = from_rows(spark, rows, "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    out = df.select(fn.date_add("a", fn.months(1)).cast("string"), fn.date_diff("a", "b", "days"), fn.date_diff("a", "b", "minutes"), fn.date_diff("a", "b", "months"), fn.date_diff("a", "b", "years"), fn.year("b")).collect()
    assert [tuple(r) for r in out] == [("2024-02-29 12:00:00", 29, 42840, 1, 0, 2024), ("2024-03-15 12:00:00", 0, 210, 0, 0, 2024), ("2023-02-15 00:00:00", 420, 604800, 13, 1, 2024), (None, None, None, None, None, 2024)]
    with pytest.raises(EngineError):
        fn.date_diff("a", "b", "fortnights")
