"""A chain of operations on one frame: Frame(df).filter(...).select(...).group_by(...).collect()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row

from tarnbeck import operators as op
from tarnbeck.errors import EngineError
from tarnbeck.functions.window import Over, with_window


class Frame:
    """An immutable plan; each method returns a new one, and nothing runs before collect, count or a look at the rows."""

    def __init__(self, df: DataFrame):
        self.df = df

    def select(self, *names: str, lenient: bool = False) -> Frame:
        return Frame(op.select(self.df, *names, lenient=lenient))

    def drop(self, *names: str) -> Frame:
        return Frame(op.drop(self.df, *names))

    def with_column(self, name: str, value: Column) -> Frame:
        return Frame(op.with_column(self.df, name, value))

    def filter(self, *conditions: Column) -> Frame:
        return Frame(op.filter_rows(self.df, *conditions))

    def sort_by(self, names: list[str], ascending: list[bool] | None = None) -> Frame:
        return Frame(op.sort_by(self.df, names, ascending))

    def limit(self, limit: int | None = None, offset: int = 0) -> Frame:
        return Frame(op.limit_offset(self.df, limit, offset))

    def slice(self, start: int, end: int, order_by: list[str]) -> Frame:
        return Frame(op.slice_rows(self.df, start, end, order_by))

    def head(self, n: int, names: list[str], ascending: list[bool] | None = None) -> Frame:
        return Frame(op.head(self.df, n, names, ascending))

    def concat(self, *others: Frame) -> Frame:
        return Frame(op.concat(self.df, *(f.df for f in others)))

    def join(self, right: Frame, *on, how: str = "inner", strategy: str | None = None) -> Frame:
        return Frame(op.join(self.df, right.df, *on, how=how, strategy=strategy))

    def group_by(self, *keys: str) -> FrameGroups:
        return FrameGroups(op.group_by(self.df, *keys))

    def rolling(self, name: str, size: int, how: str, order_by: list[str], partition_by: list[str] | None = None) -> Frame:
        return Frame(op.rolling(self.df, name, size, how, order_by, partition_by))

    def window(self, name: str, function: str, *args, spec: Over) -> Frame:
        return Frame(with_window(self.df, name, function, *args, spec=spec))

    def pipe(self, operation: Callable[[DataFrame], DataFrame]) -> Frame:
        return Frame(operation(self.df))

    @property
    def columns(self) -> list[str]:
        return list(self.df.columns)

    @property
    def width(self) -> int:
        return len(self.df.columns)

    def has_column(self, name: str) -> bool:
        return op.has_column(self.df, name)

    def type_of(self, name: str) -> str:
        if not self.has_column(name):
            raise EngineError("type_of", "no such column", name)
        return self.df.schema[name].dataType.simpleString()

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def collect(self) -> list[Row]:
        return self.df.collect()

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{n}: {t}' for n, t in self.df.dtypes)})"


class FrameGroups:
    """Groups of a frame; aggregates give a frame again."""

    def __init__(self, groups: op.Groups):
        self.groups = groups

    def agg(self, *aggregates: Column) -> Frame:
        return Frame(self.groups.agg(*aggregates))

    def agg_with_having(self, having: Column, *aggregates: Column) -> Frame:
        return Frame(self.groups.agg_with_having(having, *aggregates))
