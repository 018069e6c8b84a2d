"""Queries that write tables and read them back, and streams over files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.sources import from_rows, read_csv, read_json, read_parquet, write_csv, write_json, write_parquet
from tarnbeck.streaming import process_stream, read_stream, sessions, windowed_counts


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder among those that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tarnbeck-{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{d}/{name}.parquet", list(columns) or None)


CUSTOMER = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    write_csv(source(spark, d, "customer", *CUSTOMER), path, delimiter=";")
    return read_csv(spark, path, delimiter=";")


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    write_json(source(spark, d, "customer", *CUSTOMER), path)
    return read_json(spark, path)


def json_array(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json-array")
    write_json(source(spark, d, "nation"), path, lines=False)
    return read_json(spark, path, lines=False)


def parquet(codec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, "parquet")
        write_parquet(source(spark, d, "orders"), path, codec)
        return read_parquet(spark, path, ["o_orderkey", "o_orderdate"])

    return run


def parquet_whole(codec: str) -> Callable[[SparkSession, str], DataFrame]:
    """All columns of a table through a codec."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, "parquet")
        write_parquet(source(spark, d, "orders"), path, codec)
        return read_parquet(spark, path)

    return run


_TYPED = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, big boolean"


def typed(spark: SparkSession, d: str) -> DataFrame:
    """A column of each type."""
    df = source(spark, d, "orders", *(c.split()[0] for c in _TYPED.split(", ")[:-1])).withColumn("big", F.col("o_totalprice") > 150000)
    return df.withColumn("o_custkey", F.nullif(F.col("o_custkey"), F.lit(7))).withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))


def csv_typed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    write_csv(typed(spark, d), path)
    return read_csv(spark, path, schema=T.StructType.fromDDL(_TYPED))


def json_typed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    write_json(typed(spark, d), path)
    return read_json(spark, path, schema=T.StructType.fromDDL(_TYPED))


def csv_without_header(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    write_csv(source(spark, d, "customer", *CUSTOMER), path, header=False)
    return read_csv(spark, path, header=False)


def csv_ragged(spark: SparkSession, d: str) -> DataFrame:
    """Rows of customers in debt lack their last two fields."""
    path = scratch(spark, "csv")
    cells = source(spark, d, "customer", *CUSTOMER).select(F.concat_ws(",", "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))))
    cells.write.text(path)
    return read_csv(spark, path, header=False, strict=False)


def json_options(spark: SparkSession, d: str) -> DataFrame:
    """Words of one's own for null, and no inference."""
    path = scratch(spark, "json")
    write_json(source(spark, d, "customer", "c_custkey", "c_mktsegment"), path)
    return read_json(spark, path, infer=False, null_values=("BUILDING", "MACHINERY"))


def json_array_whole(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json-array")
    write_json(source(spark, d, "customer", *CUSTOMER), path, lines=False)
    return read_json(spark, path, lines=False)


def stream_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What a run of many micro-batches took in."""
    raw, out, check = (scratch(spark, f"stream-{k}") for k in ("in", "out", "state"))
    events = source(spark, d, "events")
    events.repartition(7).write.parquet(raw)
    stats = process_stream(read_stream(spark, raw, events.schema, max_files=1), [], out, check, 300)
    return spark.createDataFrame([(stats.batches, stats.rows)], "batches long, rows long")


def memory(spark: SparkSession, d: str) -> DataFrame:
    return from_rows(spark, [("Alice", 25), ("Bob", 30), (None, None)], "name string, age bigint")


def stream(spark: SparkSession, d: str) -> DataFrame:
    raw, out, check = (scratch(spark, f"stream-{k}") for k in ("in", "out", "state"))
    events = source(spark, d, "events")
    events.repartition(4).write.parquet(raw)
    process_stream(read_stream(spark, raw, events.schema, max_files=2), [lambda df: df.filter(F.col("event_type") == "click"), None, lambda df: df.select("event_id", "user_id", (F.col("value") * 2).alias("twice"))], out, check, 300)
    return spark.read.schema("event_id bigint, user_id bigint, twice double").parquet(out)


def windows(slide: str | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: windowed_counts(source(spark, d, "events", "ts", "event_type"), "ts", "1 hour", slide, ["event_type"])


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions(source(spark, d, "events", "ts", "user_id"), "ts", "30 minutes", ["user_id"])


_C = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"
_TYPED_SQL = "SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate, o_totalprice > 150000 AS big FROM orders"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_memory": (memory, "SELECT * FROM (VALUES ('Alice', 25::BIGINT), ('Bob', 30), (NULL, NULL)) t(name, age)"),
    "scan_csv_roundtrip": (csv, _C),
    "scan_json_lines": (json_lines, _C),
    "scan_json_array": (json_array, "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    **{f"parquet_{c}": (parquet(c), "SELECT o_orderkey, o_orderdate FROM orders") for c in ("snappy", "gzip", "lz4", "zstd", "uncompressed")},
    "scan_csv_typed": (csv_typed, _TYPED_SQL),
    "scan_json_typed": (json_typed, _TYPED_SQL),
    "scan_csv_without_header": (csv_without_header, "SELECT c_custkey AS column_0, c_name AS column_1, c_acctbal AS column_2, c_mktsegment AS column_3 FROM customer"),
    "scan_csv_ragged": (csv_ragged, "SELECT c_custkey AS column_0, c_name AS column_1, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS column_2, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS column_3 FROM customer"),
    "scan_json_options": (json_options, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS c_mktsegment FROM customer"),
    "scan_json_array_whole": (json_array_whole, _C),
    **{f"parquet_whole_{c}": (parquet_whole(c), "SELECT * FROM orders") for c in ("snappy", "gzip", "lz4", "zstd", "uncompressed")},
    "stream_statistics": (stream_statistics, "SELECT CAST(7 AS BIGINT) AS batches, count(*) AS rows FROM events"),
    "stream_stateless": (stream, "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE event_type = 'click'"),
    "window_tumbling": (windows(None), "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3"),
    "window_sliding": (
        windows("30 minutes"),
        "SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTES AS s FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2, 3",
    ),
    "window_session": (
        session_counts,
        """SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, user_id, count(*) AS n FROM (
             SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
               SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""",
    ),
}
