"""Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnbeck.errors import EngineError, require_columns

CODECS = {"snappy": "snappy", "gzip": "gzip", "lz4": "lz4_raw", "zstd": "zstd", "uncompressed": "uncompressed"}


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Reads Parquet; only the columns named, or used later, are read from the files."""
    df = spark.read.parquet(path)
    if columns is not None:
        require_columns("read_parquet", columns, df.columns)
        df = df.select(*columns)
    return df


def write_parquet(
    df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int | None = None, page_bytes: int | None = None, dictionary: bool | None = None, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    if compression not in CODECS:
        raise EngineError("write_parquet", f"{compression!r} is none of {', '.join(CODECS)}")
    writer = df.write.mode(mode).option("compression", CODECS[compression])
    for key, value in (("parquet.block.size", row_group_bytes), ("parquet.page.size", page_bytes), ("parquet.enable.dictionary", None if dictionary is None else str(dictionary).lower())):
        if value is not None:
            writer = writer.option(key, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
