"""Rows given in a program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnbeck.errors import EngineError


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of literal rows with a stated schema; every row has as many values as the schema has columns."""
    df = spark.createDataFrame([], schema)
    for k, row in enumerate(rows):
        if len(row) != len(df.columns):
            raise EngineError("from_rows", f"row {k} has {len(row)} values for {len(df.columns)} columns")
    return spark.createDataFrame(rows, schema)
