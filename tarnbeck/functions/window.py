"""Window specifications and functions.

Aggregates, first_value, last_value and nth_value take the whole partition unless the specification
names a frame. GROUPS frames, which Spark lacks, become RANGE frames over the dense rank of the order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tarnbeck.errors import EngineError, require_columns

__all__ = ["CURRENT_ROW", "UNBOUNDED_FOLLOWING", "UNBOUNDED_PRECEDING", "Over", "following", "over", "preceding", "with_window"]

UNBOUNDED_PRECEDING, CURRENT_ROW, UNBOUNDED_FOLLOWING = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def preceding(n: int) -> int:
    return -n


def following(n: int) -> int:
    return n


@dataclass(frozen=True)
class Over:
    """over().partition_by("a").order_by("b", ascending=False).rows(preceding(1), CURRENT_ROW)"""

    partitions: tuple[str, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    kind: str | None = None
    low: int = UNBOUNDED_PRECEDING
    high: int = UNBOUNDED_FOLLOWING

    def partition_by(self, *names: str) -> Over:
        return replace(self, partitions=(*self.partitions, *names))

    def order_by(self, name: str, ascending: bool = True) -> Over:
        return replace(self, orders=(*self.orders, (name, ascending)))

    def _frame(self, kind: str, low: int, high: int) -> Over:
        if low > high:
            raise EngineError("window", "a frame ends before it begins")
        return replace(self, kind=kind, low=low, high=high)

    def rows(self, low: int, high: int) -> Over:
        return self._frame("rows", low, high)

    def range(self, low: int, high: int) -> Over:
        return self._frame("range", low, high)

    def groups(self, low: int, high: int) -> Over:
        return self._frame("groups", low, high)

    def order_columns(self) -> list[Column]:
        return [F.col(c).asc() if up else F.col(c).desc() for c, up in self.orders]

    def ordered(self) -> WindowSpec:
        """Partition and order, for ranking functions, lag and lead."""
        if not self.orders:
            raise EngineError("window", "this function needs an order")
        return Window.partitionBy(*self.partitions).orderBy(*self.order_columns())

    def framed(self, rank: str | None = None) -> WindowSpec:
        """With the frame, or the whole partition without one."""
        spec = Window.partitionBy(*self.partitions)
        if self.kind == "groups":
            if not rank:
                raise EngineError("window", "a GROUPS frame needs with_window")
            return spec.orderBy(rank).rangeBetween(self.low, self.high)
        if self.orders:
            spec = spec.orderBy(*self.order_columns())
        if self.kind == "range":
            return spec.rangeBetween(self.low, self.high)
        return spec.rowsBetween(self.low, self.high)


def over() -> Over:
    return Over()


_RANKING = {
    "row_number": lambda: F.row_number(), "rank": lambda: F.rank(), "dense_rank": lambda: F.dense_rank(),
    "percent_rank": lambda: F.percent_rank(), "cume_dist": lambda: F.cume_dist(), "ntile": lambda k: F.ntile(k),
}
_SHIFT = {"lag": lambda c, n=1: F.lag(c, n), "lead": lambda c, n=1: F.lead(c, n)}
_FRAMED = {
    "first_value": lambda c: F.first(c), "last_value": lambda c: F.last(c), "nth_value": lambda c, n: F.nth_value(c, n),
    "sum": lambda c: F.sum(c), "count": lambda c: F.count(c), "mean": lambda c: F.avg(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c),
}
_LONG = {"row_number", "rank", "dense_rank", "ntile"}


def with_window(df: DataFrame, name: str, function: str, *args, spec: Over) -> DataFrame:
    """The frame with column `name`: the window function `function` of `args` over `spec`."""
    require_columns("window", [*spec.partitions, *(c for c, _ in spec.orders)], df.columns)
    if function in _RANKING:
        c = _RANKING[function](*args).over(spec.ordered())
        return df.withColumn(name, c.cast("bigint") if function in _LONG else c)
    if function in _SHIFT:
        return df.withColumn(name, _SHIFT[function](*args).over(spec.ordered()))
    if function not in _FRAMED:
        raise EngineError("window", f"no such function: {function}", hint=f"known are {', '.join([*_RANKING, *_SHIFT, *_FRAMED])}")
    if spec.kind != "groups":
        return df.withColumn(name, _FRAMED[function](*args).over(spec.framed()))
    rank = "__dense_rank"
    ranked = df.withColumn(rank, F.dense_rank().over(spec.ordered()))
    return ranked.withColumn(name, _FRAMED[function](*args).over(spec.framed(rank))).drop(rank)
