"""Projection, filtering, row ranges, sorting and union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.errors import EngineError, require_columns, require_equal_length, require_not_empty


def select(df: DataFrame, *names: str, lenient: bool = False) -> DataFrame:
    """The named columns in the order given; unknown names are an error, or left out if lenient."""
    if lenient:
        names = tuple(n for n in names if n in df.columns)
    require_columns("select", names, df.columns)
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; unknown names are ignored."""
    return df.drop(*names)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column, or replaces it in its place."""
    return df.withColumn(name, value)


def filter_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold; one filter reaches the scan, however many are given."""
    for c in conditions:
        df = df.filter(c)
    return df


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def sort_by(df: DataFrame, names: list[str], ascending: list[bool] | None = None) -> DataFrame:
    """A total sort by range partitions; nulls are smallest."""
    require_not_empty("sort_by", "columns", names)
    ascending = [True] * len(names) if ascending is None else ascending
    require_equal_length("sort_by", names, ascending)
    require_columns("sort_by", names, df.columns)
    return df.orderBy(*(F.col(n).asc() if up else F.col(n).desc() for n, up in zip(names, ascending, strict=True)))


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """At most `limit` rows after the first `offset`; sort before, or the rows are any. Beyond the end, no rows but the schema."""
    if offset < 0 or (limit is not None and limit < 0):
        raise EngineError("limit", "limit and offset must not be negative")
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def slice_rows(df: DataFrame, start: int, end: int, order_by: list[str]) -> DataFrame:
    """Rows start to end, end excluded, in the order named; an empty or reversed range has no rows."""
    require_columns("slice_rows", order_by, df.columns)
    return limit_offset(df.orderBy(*order_by), max(0, end - max(start, 0)), max(start, 0))


def head(df: DataFrame, n: int, names: list[str], ascending: list[bool] | None = None) -> DataFrame:
    """The first n rows in an order: each task keeps n, and no full sort takes place."""
    return sort_by(df, names, ascending).limit(n)


def concat(df: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of frames with the same columns and types, in the same order; anything else is an error."""
    for k, other in enumerate(others):
        if other.columns != df.columns:
            raise EngineError("concat", f"frame {k + 1} has columns {other.columns}, not {df.columns}")
        for a, b in zip(df.schema, other.schema, strict=True):
            if a.dataType != b.dataType:
                raise EngineError("concat", f"frame {k + 1} has {b.dataType.simpleString()}, not {a.dataType.simpleString()}", a.name)
        df = df.union(other)
    return df
