"""Grouping, aggregation and HAVING."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tarnbeck.errors import require_columns, require_not_empty
from tarnbeck.functions import scalar as S


class Groups:
    """Rows grouped by columns; keys keep their types and null is a group. Without columns there is one group."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...]):
        require_columns("group_by", keys, df.columns)
        self.df, self.keys = df, keys

    def agg(self, *aggregates: Column) -> DataFrame:
        """Keys, then the aggregates in the order given."""
        require_not_empty("agg", "aggregates", aggregates)
        return self.df.groupBy(*self.keys).agg(*aggregates)

    def agg_with_having(self, having: Column, *aggregates: Column) -> DataFrame:
        """As agg, with the groups for which `having`, an expression of keys and aliases, is true."""
        return self.agg(*aggregates).filter(having)

    def having(self, predicate: Callable[..., Column], **aggregates: Column) -> DataFrame:
        """Keys and the named aggregates of the groups for which predicate(name=column...) is true."""
        from pyspark.sql import functions as F

        out = self.agg(*(c.alias(n) for n, c in aggregates.items()))
        return out.filter(predicate(**{n: F.col(n) for n in aggregates}))

    def sum(self, name: str) -> DataFrame:
        return self.agg(S.sum_(name))

    def count(self, name: str | None = None) -> DataFrame:
        return self.agg(S.count(name) if name else S.count_all())

    def mean(self, name: str) -> DataFrame:
        return self.agg(S.mean(name))

    def min(self, name: str) -> DataFrame:
        return self.agg(S.min_(name))

    def max(self, name: str) -> DataFrame:
        return self.agg(S.max_(name))


def group_by(df: DataFrame, *keys: str) -> Groups:
    return Groups(df, keys)
