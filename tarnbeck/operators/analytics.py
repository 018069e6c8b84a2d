"""Correlation, rolling statistics and order-dependent columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.errors import EngineError, require_columns, require_not_empty

ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, column correlation: Pearson's over rows where neither is null; 0 where either does not vary."""
    require_columns("correlation", [x, y], df.columns)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    value = F.covar_pop(F.when(both, a), F.when(both, b)) / F.nullif(spread, F.lit(0.0))
    return df.agg(F.coalesce(value, F.lit(0.0)).alias("correlation"))


def rolling(df: DataFrame, name: str, size: int, op: str, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Column <name>_<op> over the last `size` rows in an order; NaN until there are so many values. std is that of a population.

    Without partition_by all rows meet in one task, so name partitions for anything large.
    """
    if op not in ROLLING:
        raise EngineError("rolling", f"{op!r} is none of {', '.join(ROLLING)}")
    if size < 1:
        raise EngineError("rolling", "the window must hold at least one row")
    require_not_empty("rolling", "columns to order by", order_by)
    require_columns("rolling", [name, *order_by, *(partition_by or [])], df.columns)
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by).rowsBetween(1 - size, 0)
    value = F.col(name).cast("double")
    return df.withColumn(f"{name}_{op}", F.when(F.count(value).over(w) == size, ROLLING[op](value).over(w).cast("double")).otherwise(F.lit(float("nan"))))


def window_function(df: DataFrame, function: str, value: str | None, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Adds a column named after the function: row_number, lag or lead in an order, or rank by the value, ascending with gaps."""
    require_not_empty("window_function", "columns to order by", order_by)
    require_columns("window_function", [*order_by, *(partition_by or []), *([value] if value else [])], df.columns)
    part = Window.partitionBy(*(partition_by or []))
    made = {
        "row_number": lambda: F.row_number().over(part.orderBy(*order_by)).cast("bigint"),
        "rank": lambda: F.rank().over(part.orderBy(value or order_by[0])).cast("bigint"),
        "lag": lambda: F.lag(F.col(value).cast("double"), 1).over(part.orderBy(*order_by)),
        "lead": lambda: F.lead(F.col(value).cast("double"), 1).over(part.orderBy(*order_by)),
    }
    if function not in made:
        raise EngineError("window_function", f"{function!r} is none of {', '.join(made)}")
    if function in ("lag", "lead") and value is None:
        raise EngineError("window_function", f"{function} needs a column")
    return df.withColumn(function, made[function]())
