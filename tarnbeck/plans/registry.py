"""One registered query per operator, each with SQL that an independent engine can run on the same tables.

Orders that decide a result are total: o_orderkey, event_id and (conv_id, turn) are unique, and
lineitem rows are numbered by (l_orderkey, l_linenumber, l_partkey, l_suppkey). Sums of doubles are
rounded on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck import functions as fn
from tarnbeck import operators as op
from tarnbeck.frame import Frame
from tarnbeck.functions import CURRENT_ROW, UNBOUNDED_FOLLOWING, UNBOUNDED_PRECEDING, following, over, preceding, with_window
from tarnbeck.plans import round_trips
from tarnbeck.sources import read_parquet
from tarnbeck.sql import SqlExecutor

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def table(name: str, columns: str | None = None) -> Query:
    return lambda spark, d: read_parquet(spark, f"{d}/{name}.parquet", columns.split() if columns else None)


def over_table(name: str, columns: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: plan(table(name, columns)(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pricing summary: scan, filter, computed column, aggregation with HAVING, order."""
    df = op.filter_rows(table("lineitem")(spark, d), F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    df = op.with_column(df, "revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = op.group_by(df, "l_returnflag", "l_linestatus").agg_with_having(
        F.col("n") > 10, F.round(F.sum("revenue"), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.count("*").alias("n")
    )
    return op.sort_by(out, ["l_returnflag", "l_linestatus"])


add("flagship", flagship, """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean_quantity,
       min(l_extendedprice) AS least, max(l_extendedprice) AS most, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 10""")

# projection, filters, row ranges
C = "c_custkey c_name c_nationkey c_acctbal c_mktsegment"
add("scan_parquet", table("customer"), "SELECT * FROM customer")
add("select_cols", over_table("customer", C, lambda df: op.select(df, "c_name", "c_custkey")), "SELECT c_name, c_custkey FROM customer")
add("select_lenient", over_table("customer", C, lambda df: op.select(df, "c_name", "nothing", lenient=True)), "SELECT c_name FROM customer")
add("drop_cols", over_table("customer", C, lambda df: op.drop(df, "c_name", "nothing")), "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
add("with_column_arith", over_table("lineitem", "l_orderkey l_linenumber l_extendedprice l_discount l_tax", lambda df: op.with_column(df, "charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))),
    "SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem)")
add("with_column_replace", over_table("customer", "c_custkey c_acctbal", lambda df: op.with_column(df, "c_acctbal", F.col("c_acctbal") * 2)), "SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM customer")
add("mixed_type_arith", over_table("lineitem", "l_orderkey l_linenumber l_quantity", lambda df: df.select((F.col("l_orderkey") + F.col("l_linenumber")).alias("int_long"), (F.col("l_linenumber") * F.col("l_quantity")).alias("int_double"), (F.col("l_orderkey") - F.col("l_quantity")).alias("long_double"))),
    "SELECT l_orderkey + l_linenumber AS int_long, l_linenumber * l_quantity AS int_double, l_orderkey - l_quantity AS long_double FROM lineitem")
FILTERS: dict[str, tuple[str, str, str, Callable[[], list[Column]]]] = {
    "filter_cmp": ("customer", "c_custkey c_acctbal", "c_acctbal >= 5000", lambda: [F.col("c_acctbal") >= 5000]),
    "filter_string_eq": ("customer", "c_custkey c_mktsegment", "c_mktsegment = 'BUILDING'", lambda: [F.col("c_mktsegment") == "BUILDING"]),
    "filter_string_order": ("customer", "c_custkey c_mktsegment", "c_mktsegment < 'F'", lambda: [F.col("c_mktsegment") < "F"]),
    "filter_and_or": ("orders", "o_orderkey o_orderstatus o_totalprice", "(o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderkey > 100", lambda: [((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 200000)) & (F.col("o_orderkey") > 100)]),
    "filter_not": ("orders", "o_orderkey o_orderstatus", "NOT (o_orderstatus = 'F')", lambda: [fn.not_(F.col("o_orderstatus") == "F")]),
    "filter_chain": ("orders", "o_orderkey o_orderstatus o_totalprice", "o_totalprice > 50000 AND o_totalprice < 150000 AND o_orderstatus <> 'P'", lambda: [F.col("o_totalprice") > 50000, F.col("o_totalprice") < 150000, F.col("o_orderstatus") != "P"]),
    "filter_timestamp": ("orders", "o_orderkey o_orderdate", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'", lambda: [F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")]),
    "filter_in_between_like": ("part", "p_partkey p_brand p_size p_type", "p_size IN (1, 5, 9) OR (p_size BETWEEN 20 AND 25 AND p_type LIKE '%A%')", lambda: [F.col("p_size").isin(1, 5, 9) | (F.col("p_size").between(20, 25) & F.col("p_type").like("%A%"))]),
    "filter_modulo": ("orders", "o_orderkey", "o_orderkey % 7 = 3", lambda: [fn.modulo("o_orderkey", F.lit(7)) == 3]),
    "filter_bool_column": ("customer", "c_custkey c_acctbal", "c_acctbal < 0", lambda: [(F.col("c_acctbal") < 0) == F.lit(True)]),
}
for _name, (_table, _columns, _where, _conditions) in FILTERS.items():
    add(_name, over_table(_table, _columns, lambda df, cs=_conditions: op.filter_rows(df, *cs())), f"SELECT {_columns.replace(' ', ', ')} FROM {_table} WHERE {_where}")
add("is_null", lambda s, d: op.filter_rows(op.join(table("documents", "doc_id")(s, d), table("labels")(s, d), "doc_id", how="left"), F.col("quality").isNull()).select("doc_id"),
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
add("slice_rows", over_table("orders", "o_orderkey o_totalprice", lambda df: op.slice_rows(df, 10, 30, ["o_orderkey"])), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
add("int_div", over_table("lineitem", "l_orderkey l_linenumber", lambda df: df.select("l_orderkey", "l_linenumber", fn.int_div("l_orderkey", "l_linenumber").cast("bigint").alias("q"))), "SELECT l_orderkey, l_linenumber, CAST(l_orderkey // l_linenumber AS BIGINT) AS q FROM lineitem")
add("safe_div", over_table("lineitem", "l_orderkey l_linenumber l_quantity", lambda df: df.select("l_orderkey", "l_linenumber", fn.safe_div("l_quantity", F.col("l_linenumber") - 1).alias("r"))), "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS r FROM lineitem")

# joins
CU, OR = "c_custkey c_name c_nationkey", "o_orderkey o_custkey o_totalprice"
# joins over the whole tables; c_key and o_key are null once on either side, so both have rows without a partner
WHOLE = "c_custkey, c_name, c_nationkey, c_key, o_orderkey, o_custkey, o_totalprice, o_key"


def joined_whole(how: str, strategy: str | None = None) -> Query:
    return lambda s, d: op.join(op.with_column(table("customer", CU)(s, d), "c_key", F.nullif(F.col("c_custkey"), F.lit(1))), op.with_column(table("orders", OR)(s, d), "o_key", F.nullif(F.col("o_custkey"), F.lit(2))), "c_key", "o_key", how, strategy)


_WHOLE_SIDES = f"(SELECT {CU.replace(' ', ', ')}, nullif(c_custkey, 1) AS c_key FROM customer) c {{}} JOIN (SELECT {OR.replace(' ', ', ')}, nullif(o_custkey, 2) AS o_key FROM orders) o ON c_key = o_key"
for _how in ("inner", "left", "right", "full"):
    add(f"join_whole_{_how}", joined_whole(_how), f"SELECT {WHOLE} FROM {_WHOLE_SIDES.format(_how)}")
for _strategy in ("broadcast", "merge", "hash"):
    add(f"join_whole_{'shuffle_hash' if _strategy == 'hash' else _strategy}", joined_whole("inner", _strategy), f"SELECT {WHOLE} FROM {_WHOLE_SIDES.format('inner')}")
for _how in ("semi", "anti"):
    add(f"join_whole_{_how}", joined_whole(_how), f"SELECT c_custkey, c_name, c_nationkey, c_key FROM {_WHOLE_SIDES.format(_how)}")
add("join_multi_key", lambda s, d: op.join(table("supplier", "s_suppkey s_nationkey")(s, d), table("customer", "c_custkey c_nationkey")(s, d), ["s_suppkey", "s_nationkey"], ["c_custkey", "c_nationkey"]),
    "SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
add("join_dup_cols", lambda s, d: op.join(table("labels")(s, d), table("documents", "doc_id lang")(s, d), "doc_id"), "SELECT l.doc_id, quality, toxic, d.doc_id AS doc_id_right, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
add("join_three", lambda s, d: op.group_by(op.join(op.join(table("nation", "n_nationkey n_name n_regionkey")(s, d), table("region", "r_regionkey r_name")(s, d), "n_regionkey", "r_regionkey"), table("customer", "c_nationkey c_acctbal")(s, d), "n_nationkey", "c_nationkey"), "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")),
    "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name")

# aggregation
L = "l_returnflag l_linestatus l_quantity l_extendedprice l_discount l_linenumber"
AGGS = {
    "sum": (lambda: F.round(F.sum("l_quantity"), 2), "round(sum(l_quantity), 2)"), "count": (lambda: F.count("l_quantity"), "count(l_quantity)"), "mean": (lambda: F.round(F.avg("l_quantity"), 6), "round(avg(l_quantity), 6)"),
    "min": (lambda: F.min("l_quantity"), "min(l_quantity)"), "max": (lambda: F.max("l_quantity"), "max(l_quantity)"),
}
for _name, (_c, _sql) in AGGS.items():
    add(f"agg_{_name}", over_table("lineitem", L, lambda df, c=_c, n=_name: op.group_by(df, "l_returnflag").agg(c().alias(f"{n}_l_quantity"))), f"SELECT l_returnflag, {_sql} AS {_name}_l_quantity FROM lineitem GROUP BY 1")
add("agg_shortcut_names", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag").agg(fn.min_("l_quantity"), fn.max_("l_extendedprice"), fn.count("l_discount"))),
    "SELECT l_returnflag, min(l_quantity) AS min_l_quantity, max(l_extendedprice) AS max_l_extendedprice, count(l_discount) AS count_l_discount FROM lineitem GROUP BY 1")
add("agg_count_star", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag").agg(F.count("*").alias("n"))), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
add("agg_min_max_text", over_table("part", "p_brand p_name", lambda df: op.group_by(df, "p_brand").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))), "SELECT p_brand, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY 1")
add("agg_nulls", lambda s, d: op.group_by(op.join(table("documents", "doc_id lang")(s, d), table("labels")(s, d), "doc_id", how="left"), "toxic").agg(F.count("quality").alias("known"), F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality")),
    "SELECT toxic, count(quality) AS known, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")


def multi() -> list[Column]:
    return [F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count("*").alias("n")]


MULTI_SQL = "round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS discount, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n"
add("agg_multi", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag").agg(*multi())), f"SELECT l_returnflag, {MULTI_SQL} FROM lineitem GROUP BY 1")
add("agg_multi_key", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag", "l_linestatus", "l_linenumber").agg(*multi())), f"SELECT l_returnflag, l_linestatus, l_linenumber, {MULTI_SQL} FROM lineitem GROUP BY 1, 2, 3")
add("agg_global", over_table("lineitem", L, lambda df: op.group_by(df).agg(*multi())), f"SELECT {MULTI_SQL} FROM lineitem")
add("agg_sum_if", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag").agg(F.sum(fn.if_(F.col("l_discount") > 0.05, F.lit(1), F.lit(0))).alias("n"))), "SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY 1")
H = "o_custkey o_totalprice o_orderstatus"
HAVING: dict[str, tuple[Callable[[], list[Column]], Callable[[], Column], str, str]] = {
    "having_agg": (lambda: [F.count("*").alias("n")], lambda: F.col("n") > 12, "count(*) AS n", "count(*) > 12"),
    "having_alias": (lambda: [F.round(F.sum("o_totalprice"), 2).alias("total")], lambda: F.col("total") > 1_500_000, "round(sum(o_totalprice), 2) AS total", "round(sum(o_totalprice), 2) > 1500000"),
    "having_arith": (lambda: [F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")], lambda: F.col("total") / F.col("n") * 2 > 300_000, "round(sum(o_totalprice), 2) AS total, count(*) AS n", "round(sum(o_totalprice), 2) / count(*) * 2 > 300000"),
    "having_and_or": (lambda: [F.count("*").alias("n"), F.max("o_totalprice").alias("most")], lambda: ((F.col("n") > 10) & (F.col("most") > 200_000)) | (F.col("n") == 1), "count(*) AS n, max(o_totalprice) AS most", "(count(*) > 10 AND max(o_totalprice) > 200000) OR count(*) = 1"),
    "having_functions": (lambda: [F.count("*").alias("n"), F.max("o_totalprice").alias("most")], lambda: (fn.sqrt(F.col("n")) > 3) & (fn.floor(F.col("most")) > 1000), "count(*) AS n, max(o_totalprice) AS most", "sqrt(count(*)) > 3 AND floor(max(o_totalprice)) > 1000"),
}
for _name, (_aggs, _having, _list, _sql) in HAVING.items():
    add(_name, over_table("orders", H, lambda df, a=_aggs, h=_having: op.group_by(df, "o_custkey").agg_with_having(h(), *a())), f"SELECT o_custkey, {_list} FROM orders GROUP BY o_custkey HAVING {_sql}")
add("having_only", over_table("orders", H, lambda df: op.group_by(df, "o_custkey").having(lambda n, most: (n > 8) & (most < 400_000), n=F.count("*"), most=F.max("o_totalprice"))), "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1 HAVING count(*) > 8 AND max(o_totalprice) < 400000")
add("corr", over_table("lineitem", "l_quantity l_extendedprice", lambda df: op.correlation(df, "l_quantity", "l_extendedprice").select(F.round("correlation", 8).alias("correlation"))), "SELECT round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem")
add("corr_constant", over_table("lineitem", "l_quantity", lambda df: op.correlation(df.withColumn("one", F.lit(1)), "l_quantity", "one")), "SELECT 0.0::DOUBLE AS correlation")

add("having_lineitem", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag", "l_linenumber").agg_with_having(F.col("n") > 10, F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"))),
    "SELECT l_returnflag, l_linenumber, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
add("agg_own_names", over_table("lineitem", L, lambda df: op.group_by(df, "l_returnflag").agg(fn.sum_("l_linenumber"), fn.mean("l_linenumber"), fn.count("l_linenumber"), fn.count_all(), fn.min_("l_linenumber"), fn.max_("l_linenumber")).withColumn("mean_l_linenumber", F.round("mean_l_linenumber", 8))),
    'SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, round(avg(l_linenumber), 8) AS mean_l_linenumber, count(l_linenumber) AS count_l_linenumber, count(*) AS "count_*", min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem GROUP BY 1')
add("frame_chain", lambda s, d: Frame(table("orders", "o_orderkey o_custkey o_totalprice o_orderstatus")(s, d)).filter(F.col("o_totalprice") > 50000, F.col("o_orderstatus") != "P").with_column("k", F.round(F.col("o_totalprice") / 1000)).group_by("k").agg_with_having(F.col("n") > 3, F.count("*").alias("n")).sort_by(["k"]).df,
    "SELECT round(o_totalprice / 1000) AS k, count(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 3")

# windows
W, WC = over().partition_by("o_custkey").order_by("o_orderkey"), "o_custkey o_orderkey o_totalprice"
WD = over().partition_by("o_orderstatus").order_by("o_orderpriority")
PO, POD = "PARTITION BY o_custkey ORDER BY o_orderkey", "PARTITION BY o_orderstatus ORDER BY o_orderpriority"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
WINDOWS: dict[str, tuple[str, tuple, str]] = {
    "row_number": ("row_number", (), f"row_number() OVER ({PO})"), "lag": ("lag", ("o_totalprice", 1), f"lag(o_totalprice, 1) OVER ({PO})"), "lead": ("lead", ("o_totalprice", 2), f"lead(o_totalprice, 2) OVER ({PO})"),
    "first_value": ("first_value", ("o_totalprice",), f"first_value(o_totalprice) OVER ({PO} {ALL})"), "last_value": ("last_value", ("o_totalprice",), f"last_value(o_totalprice) OVER ({PO} {ALL})"),
    "nth_value": ("nth_value", ("o_totalprice", 2), f"nth_value(o_totalprice, 2) OVER ({PO} {ALL})"), "ntile": ("ntile", (4,), f"ntile(4) OVER ({PO})"),
}
for _name, (_f, _args, _sql) in WINDOWS.items():
    add(f"win_{_name}", over_table("orders", WC, lambda df, f=_f, a=_args: with_window(df, "w", f, *a, spec=W)), f"SELECT o_custkey, o_orderkey, o_totalprice, {_sql} AS w FROM orders")
for _name in ("rank", "dense_rank", "percent_rank", "cume_dist"):
    _round = _name in ("percent_rank", "cume_dist")
    add(f"win_{_name}", over_table("orders", "o_orderkey o_orderstatus o_orderpriority", lambda df, f=_name, r=_round: (lambda x: x.withColumn("w", F.round("w", 10)) if r else x)(with_window(df, "w", f, spec=WD))),
        f"SELECT o_orderkey, o_orderstatus, o_orderpriority, {f'round({_name}() OVER ({POD}), 10)' if _round else f'{_name}() OVER ({POD})'} AS w FROM orders")
for _name, _sql in (("sum", "sum"), ("count", "count"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    add(f"win_{_name}", over_table("orders", WC, lambda df, f=_name: with_window(df, "w", f, "o_totalprice", spec=over().partition_by("o_custkey")).withColumn("w", F.round("w", 2))),
        f"SELECT o_custkey, o_orderkey, o_totalprice, round({_sql}(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS w FROM orders")
FRAMES = {
    "rows": (W.rows(preceding(2), following(1)), "o_custkey o_orderkey o_totalprice", f"{PO} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"),
    "running": (W.rows(UNBOUNDED_PRECEDING, CURRENT_ROW), "o_custkey o_orderkey o_totalprice", f"{PO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
    "rest": (W.rows(CURRENT_ROW, UNBOUNDED_FOLLOWING), "o_custkey o_orderkey o_totalprice", f"{PO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
    "range": (W.range(preceding(5000), following(5000)), "o_custkey o_orderkey o_totalprice", f"{PO} RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING"),
    "groups": (over().partition_by("o_custkey").order_by("o_orderpriority").groups(preceding(1), CURRENT_ROW), "o_custkey o_orderkey o_orderpriority o_totalprice", "PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW"),
}
for _name, (_spec, _columns, _sql) in FRAMES.items():
    add(f"win_{_name}_frame", over_table("orders", _columns, lambda df, sp=_spec: with_window(df, "w", "sum", "o_totalprice", spec=sp).withColumn("w", F.round("w", 2))), f"SELECT {_columns.replace(' ', ', ')}, round(sum(o_totalprice) OVER ({_sql}), 2) AS w FROM orders")
for _name, _sql in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")):
    add(f"rolling_{_name}", over_table("events", "event_id user_id value", lambda df, f=_name: op.rolling(df, "value", 5, f, ["event_id"], ["user_id"]).withColumn(f"value_{f}", F.round(f"value_{f}", 4))),
        f"SELECT event_id, user_id, value, CASE WHEN count(value) OVER w = 5 THEN round({_sql}(value) OVER w, 4) ELSE 'nan'::DOUBLE END AS value_{_name} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
EAGER = {"row_number": "row_number() OVER (PARTITION BY user_id ORDER BY event_id)", "rank": "rank() OVER (PARTITION BY user_id ORDER BY value)", "lag": "lag(value) OVER (PARTITION BY user_id ORDER BY event_id)", "lead": "lead(value) OVER (PARTITION BY user_id ORDER BY event_id)"}
for _name, _sql in EAGER.items():
    add(f"window_function_{_name}", over_table("events", "event_id user_id value", lambda df, f=_name: op.window_function(df, f, "value", ["event_id"], ["user_id"])), f'SELECT event_id, user_id, value, {_sql} AS "{_name}" FROM events')

# windows and orders with nulls, doubles, booleans and timestamps
NULLABLE = "(SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '2-HIGH') AS p, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_totalprice END AS price, o_orderdate, o_totalprice > 150000 AS big FROM orders)"


def nullable(spark: SparkSession, d: str) -> DataFrame:
    df = table("orders", "o_orderkey o_orderstatus o_orderpriority o_totalprice o_orderdate")(spark, d)
    return df.select("o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("p"), F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice")).alias("price"), "o_orderdate", (F.col("o_totalprice") > 150000).alias("big"))


for _name, _order, _up, _sql in (("rank_null_text", "p", True, "rank() OVER (PARTITION BY o_orderstatus ORDER BY p NULLS FIRST)"), ("rank_null_double", "price", False, "rank() OVER (PARTITION BY o_orderstatus ORDER BY price DESC NULLS LAST)"),
                                 ("dense_rank_bool", "big", True, "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY big)"), ("rank_timestamp", "o_orderdate", False, "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC)")):
    add(f"win_{_name}", lambda s, d, o=_order, u=_up, f=_name.rsplit("_", 2 if _name.startswith("rank_null") else 1)[0]: with_window(nullable(s, d), "w", f, spec=over().partition_by("o_orderstatus").order_by(o, u)), f"SELECT *, {_sql} AS w FROM {NULLABLE}")
add("win_null_key", lambda s, d: with_window(nullable(s, d), "w", "sum", "price", spec=over().partition_by("p")).withColumn("w", F.round("w", 2)), f"SELECT *, round(sum(price) OVER (PARTITION BY p), 2) AS w FROM {NULLABLE}")
add("sort_bool_timestamp", lambda s, d: op.head(nullable(s, d), 200, ["big", "o_orderdate", "o_orderkey"], [False, True, True]), f"SELECT * FROM {NULLABLE} ORDER BY big DESC, o_orderdate, o_orderkey LIMIT 200")
add("sort_nulls", lambda s, d: op.head(nullable(s, d), 200, ["p", "price", "o_orderkey"], [True, False, True]), f"SELECT * FROM {NULLABLE} ORDER BY p NULLS FIRST, price DESC NULLS LAST, o_orderkey LIMIT 200")

# sorting and row counts
add("sort_single", over_table("orders", "o_orderkey o_totalprice", lambda df: op.sort_by(df, ["o_orderkey"])), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 1")
add("sort_multi", over_table("orders", "o_orderkey o_orderstatus", lambda df: op.sort_by(df, ["o_orderstatus", "o_orderkey"], [True, False])), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey DESC")
add("limit", over_table("orders", "o_orderkey o_totalprice", lambda df: op.limit_offset(op.sort_by(df, ["o_orderkey"]), 25)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
add("limit_zero", over_table("orders", "o_orderkey", lambda df: op.limit_offset(df, 0)), "SELECT o_orderkey FROM orders LIMIT 0")
add("offset", over_table("orders", "o_orderkey o_totalprice", lambda df: op.limit_offset(op.sort_by(df, ["o_orderkey"]), offset=1000)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 1000")
add("limit_offset", over_table("orders", "o_orderkey o_totalprice", lambda df: op.limit_offset(op.sort_by(df, ["o_orderkey"], [False]), 25, 10)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25 OFFSET 10")
add("topk", over_table("orders", "o_orderkey o_totalprice", lambda df: op.head(df, 10, ["o_totalprice", "o_orderkey"], [False, True])), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("concat_union_all", over_table("orders", "o_orderkey o_orderdate", lambda df: op.concat(df, df.filter("o_orderkey < 100"), df.filter("o_orderkey > 900"))), "SELECT o_orderkey, o_orderdate FROM orders UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 100 UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 900")

# scalar functions
SCALARS: dict[str, tuple[str, str, Callable[[], Column], str]] = {
    "str_upper": ("part", "p_partkey", lambda: fn.upper("p_name"), "upper(p_name)"), "str_lower": ("part", "p_partkey", lambda: fn.lower("p_type"), "lower(p_type)"), "str_length": ("part", "p_partkey", lambda: fn.length("p_name"), "length(p_name)"),
    "str_trim": ("part", "p_partkey", lambda: fn.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))), "trim('  ' || p_name || ' ')"), "str_substring": ("part", "p_partkey", lambda: fn.substring("p_name", 2, 4), "substring(p_name, 2, 4)"),
    "str_concat": ("part", "p_partkey", lambda: fn.concat("p_brand", F.lit("-"), "p_size"), "p_brand || '-' || p_size"), "str_concat_null": ("part", "p_partkey", lambda: fn.concat("p_brand", F.nullif(F.col("p_size"), F.lit(7))), "p_brand || nullif(p_size, 7)"),
    "as_string": ("part", "p_partkey", lambda: fn.as_string(F.nullif(F.col("p_size"), F.lit(7))), "coalesce(nullif(p_size, 7)::VARCHAR, '')"),
    "math_neg": ("customer", "c_custkey", lambda: fn.neg("c_acctbal"), "-c_acctbal"), "math_abs": ("customer", "c_custkey", lambda: fn.abs_("c_acctbal"), "abs(c_acctbal)"), "math_round": ("customer", "c_custkey", lambda: fn.round_("c_acctbal"), "round(c_acctbal, 0)"),
    "math_round_to": ("customer", "c_custkey", lambda: fn.round_to(F.col("c_acctbal") / 3, 3), "round(c_acctbal / 3, 3)"), "math_floor": ("customer", "c_custkey", lambda: fn.floor("c_acctbal").cast("double"), "floor(c_acctbal)"), "math_ceil": ("customer", "c_custkey", lambda: fn.ceil("c_acctbal").cast("double"), "ceil(c_acctbal)"),
    "math_sqrt": ("customer", "c_custkey", lambda: F.round(fn.sqrt(fn.abs_("c_acctbal")), 8), "round(sqrt(abs(c_acctbal)), 8)"), "math_log": ("customer", "c_custkey", lambda: F.round(fn.log(fn.abs_("c_acctbal") + 1), 8), "round(ln(abs(c_acctbal) + 1), 8)"),
    "math_sin": ("customer", "c_custkey", lambda: F.round(fn.sin("c_acctbal"), 8), "round(sin(c_acctbal), 8)"), "math_cos": ("customer", "c_custkey", lambda: F.round(fn.cos("c_acctbal"), 8), "round(cos(c_acctbal), 8)"),
    "cast_string": ("part", "p_partkey", lambda: fn.cast_string("p_size"), "CAST(p_size AS VARCHAR)"), "cast_int64": ("part", "p_partkey", lambda: fn.cast_int64(F.concat("p_size", fn.if_(F.col("p_size") > 25, F.lit("x"), F.lit("")))), "TRY_CAST(p_size || CASE WHEN p_size > 25 THEN 'x' ELSE '' END AS BIGINT)"),
    "cast_float64": ("part", "p_partkey", lambda: fn.cast_float64(F.col("p_size").cast("string")), "TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE)"), "cast_bool": ("part", "p_partkey", lambda: fn.cast_bool(fn.if_(F.col("p_size") > 25, F.lit("true"), F.lit("no way"))), "TRY_CAST(CASE WHEN p_size > 25 THEN 'true' ELSE 'no way' END AS BOOLEAN)"),
    "if": ("customer", "c_custkey", lambda: fn.if_(F.col("c_acctbal") < 0, F.lit("owes"), F.lit("owns")), "CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'owns' END"),
    "case": ("part", "p_partkey", lambda: fn.case().when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").else_("large"), "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END"),
    "coalesce": ("part", "p_partkey", lambda: fn.coalesce(F.nullif(F.col("p_size"), F.lit(7)), F.lit(-1)), "coalesce(nullif(p_size, 7), -1)"),
}
for _unit in ("year", "month", "day", "hour", "minute", "second"):
    SCALARS[f"dt_{_unit}"] = ("events", "event_id", lambda u=_unit: getattr(fn, u)("ts"), f"{_unit}(ts)")
for _unit, _n in (("days", 30), ("hours", 5), ("minutes", 90), ("months", 1), ("years", 2)):
    for _verb, _sign in (("add", "+"), ("sub", "-")):
        SCALARS[f"date_{_verb}_{_unit}"] = ("orders", "o_orderkey", lambda v=_verb, u=_unit, n=_n: getattr(fn, f"date_{v}")("o_orderdate", getattr(fn, u)(n)), f"o_orderdate {_sign} INTERVAL {_n} {_unit.upper()}")
_START_SQL = "TIMESTAMP '1996-05-15 12:30:00'"


def since(unit: str) -> Column:
    return fn.date_diff(F.lit("1996-05-15 12:30:00").cast("timestamp_ntz"), "o_orderdate", unit)


for _unit in ("days", "hours", "minutes", "seconds"):
    SCALARS[f"date_diff_{_unit}"] = ("orders", "o_orderkey", lambda u=_unit: since(u), f"datesub('{_unit[:-1]}', {_START_SQL}, o_orderdate)")
SCALARS["date_diff_months"] = ("orders", "o_orderkey", lambda: since("months"), "(year(o_orderdate) - 1996) * 12 + month(o_orderdate) - 5 - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END")
SCALARS["date_diff_years"] = ("orders", "o_orderkey", lambda: since("years"), "year(o_orderdate) - 1996 - CASE WHEN month(o_orderdate) < 5 OR (month(o_orderdate) = 5 AND day(o_orderdate) < 15) THEN 1 ELSE 0 END")
for _name, (_table, _key, _column, _sql) in SCALARS.items():
    add(_name, lambda s, d, t=_table, k=_key, c=_column: table(t)(s, d).select(k, c().alias("v")), f"SELECT {_key}, {_sql} AS v FROM {_table}")
add("constant_expression", over_table("orders", "o_orderkey", lambda df: df.select("o_orderkey", (F.lit(2) * 3 + 4).cast("bigint").alias("k"), (F.lit(1) < F.lit(2)).alias("b"))), "SELECT o_orderkey, CAST(2 * 3 + 4 AS BIGINT) AS k, 1 < 2 AS b FROM orders")


# SQL
def by_sql(tables: str, query: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ex = SqlExecutor(spark)
        for t in tables.split():
            ex.register(t, table(t)(spark, d))
        return ex.execute(query)

    return run


SQL = {
    "sql_select_where": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000 AND (c_mktsegment = 'BUILDING' OR c_nationkey < 5)"),
    "sql_group_having": ("orders", "SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING n > 11"),
    "sql_group_no_alias": ("orders", "SELECT o_orderstatus, min(o_totalprice) AS least FROM orders GROUP BY o_orderstatus HAVING max(o_totalprice) > 100"),
    "sql_order_limit_offset": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "sql_computed": ("lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity * 2 > 60"),
    "sql_join": ("customer nation", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1"),
    "sql_case": ("part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS size FROM part"),
    "sql_distinct": ("part", "SELECT DISTINCT p_brand, p_size FROM part"),
    "sql_in_between_like_null": ("part", "SELECT p_partkey FROM part WHERE p_size IN (3, 4, 5) OR p_size BETWEEN 40 AND 45 OR p_name LIKE 'a%' OR nullif(p_size, 9) IS NULL"),
    "sql_subquery": ("orders customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "sql_cte_union": ("nation region", "WITH a AS (SELECT n_name AS name FROM nation), b AS (SELECT r_name AS name FROM region) SELECT name FROM a UNION ALL SELECT name FROM b"),
    "sql_window": ("orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders"),
    "sql_global_aggregate": ("orders", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders"),
    "sql_exists": ("customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"),
    "sql_extract": ("events", "SELECT event_id, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m, CAST(extract(day FROM ts) AS INT) AS d, CAST(extract(hour FROM ts) AS INT) AS h, ts < now() AS past FROM events"),
    "sql_functions": ("customer", "SELECT c_custkey, upper(c_name) AS u, length(trim(c_mktsegment)) AS n, abs(c_acctbal) AS a, coalesce(nullif(c_nationkey, 3), -1) AS k, concat(c_mktsegment, '!') AS s, substring(c_name, 1, 4) AS b FROM customer"),
    "sql_precedence": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 250000"),
}
for _name, (_tables, _sql) in SQL.items():
    add(_name, by_sql(_tables, _sql), _sql)


def prepared(spark: SparkSession, d: str) -> DataFrame:
    """One prepared query, run with two sets of values."""
    ex = SqlExecutor(spark)
    ex.register("orders", table("orders")(spark, d))
    q = ex.prepare("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN :low AND :high")
    return op.concat(q.execute(low=10000, high=20000), q.execute(low=200000, high=210000))


add("sql_prepared", prepared, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 10000 AND 20000 OR o_totalprice BETWEEN 200000 AND 210000")


def batch(spark: SparkSession, d: str) -> DataFrame:
    ex = SqlExecutor(spark)
    ex.register("nation", table("nation")(spark, d))
    return op.concat(*ex.batch(["SELECT n_name AS v FROM nation WHERE n_regionkey = 1", "SELECT upper(n_name) AS v FROM nation"]))


add("sql_batch", batch, "SELECT n_name AS v FROM nation WHERE n_regionkey = 1 UNION ALL SELECT upper(n_name) FROM nation")

# sources, sinks and streams that go through files
for _name, (_query, _sql) in round_trips.QUERIES.items():
    add(_name, _query, _sql)
