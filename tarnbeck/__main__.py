"""python -m tarnbeck demo | bench [--rows N] [-v]"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import count_all, mean, safe_div
from tarnbeck.metrics import Metrics
from tarnbeck.operators import filter_rows, group_by, select, with_column
from tarnbeck.session import get_spark


def readings(spark: SparkSession, rows: int) -> DataFrame:
    """Made-up gauge readings of rivers, built by the executors."""
    gauge = F.concat(F.lit("g"), F.pmod(F.xxhash64("id"), F.lit(12)).cast("string"))
    level = F.round(80 + 40 * F.sin(F.col("id") / 500) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 100, 2)
    return spark.range(rows).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 900).alias("at"), gauge.alias("gauge"), level.alias("level_cm"), (F.col("id") % 24 / 2.0).alias("rain_mm"))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tarnbeck")
    p.add_argument("what", choices=["demo", "bench"])
    p.add_argument("--rows", type=int)
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(args)
    spark, m = get_spark(master="local[*]"), Metrics()
    df = readings(spark, a.rows or (1000 if a.what == "demo" else 1_000_000))
    with m.timed("filter, with_column, select"):
        out = select(with_column(filter_rows(df, F.col("level_cm") > 100), "level_m", safe_div("level_cm", F.lit(100))), "at", "gauge", "level_m")
        n = out.count()
    with m.timed("group_by"):
        groups = group_by(df, "gauge").agg(mean("level_cm"), count_all()).orderBy("gauge")
        rows = groups.collect()
    if a.verbose:
        groups.explain("formatted")
    print(f"{n} rows after the filter")
    for r in rows:
        print(*r)
    print(m.report())


if __name__ == "__main__":
    main()
