"""Scalar and aggregate expressions, as thin compositions of Spark's own columns.

Everything stays inside code generation: no Python runs per row. Null follows SQL, and division by
zero is null rather than an error or an infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnbeck.errors import EngineError

__all__ = [
    "abs_", "add_interval", "agg_name", "as_string", "case", "cast_bool", "cast_float64", "cast_int64", "cast_string", "ceil", "coalesce", "col", "concat", "cos", "count", "count_all", "date_add", "date_diff",
    "date_sub", "day", "days", "floor", "hour", "hours", "if_", "int_div", "length", "lit", "log", "lower", "max_", "mean", "min_", "minute", "minutes", "modulo", "month", "months", "neg", "not_", "round_", "round_to",
    "safe_div", "second", "sin", "sqrt", "substring", "sum_", "trim", "upper", "year", "years",
]


def col(name: str) -> Column:
    return F.col(name)


def lit(value) -> Column:
    return F.lit(value)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def neg(c) -> Column:
    return -_c(c)


def not_(c) -> Column:
    return ~_c(c)


def safe_div(a, b) -> Column:
    """a / b as a double; null where b is 0."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def int_div(a, b) -> Column:
    """Division truncated towards zero; null where b is 0."""
    return F.call_function("div", _c(a), F.nullif(_c(b), F.lit(0)))


def modulo(a, b) -> Column:
    return _c(a) % F.nullif(_c(b), F.lit(0))


def if_(condition, a, b) -> Column:
    return F.when(condition, a).otherwise(b)


def coalesce(*columns) -> Column:
    return F.coalesce(*map(_c, columns))


class case:  # noqa: N801
    """case().when(condition, value)...else_(value); without else_, `end()` gives null."""

    def __init__(self):
        self._column: Column | None = None

    def when(self, condition: Column, value) -> case:
        self._column = F.when(condition, value) if self._column is None else self._column.when(condition, value)
        return self

    def end(self) -> Column:
        if self._column is None:
            raise EngineError("case", "needs a when")
        return self._column

    def else_(self, value) -> Column:
        return self.end().otherwise(value)


def upper(c) -> Column:
    return F.upper(_c(c))


def lower(c) -> Column:
    return F.lower(_c(c))


def length(c) -> Column:
    return F.length(_c(c)).cast("bigint")


def trim(c) -> Column:
    return F.trim(_c(c))


def substring(c, start: int, size: int) -> Column:
    """`size` characters from place `start`, counted from 1."""
    return F.substring(_c(c), start, size)


def concat(*columns) -> Column:
    """Text of all columns together; null if any is."""
    return F.concat(*(_c(c).cast("string") for c in columns))


def as_string(c) -> Column:
    """The value as text; null is the empty text."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def abs_(c) -> Column:
    return F.abs(_c(c))


def round_(c) -> Column:
    return F.round(_c(c), 0)


def round_to(c, places: int) -> Column:
    return F.round(_c(c), places)


def floor(c) -> Column:
    return F.floor(_c(c))


def ceil(c) -> Column:
    return F.ceil(_c(c))


def sqrt(c) -> Column:
    return F.sqrt(_c(c))


def log(c) -> Column:
    """The natural logarithm."""
    return F.log(_c(c))


def sin(c) -> Column:
    return F.sin(_c(c))


def cos(c) -> Column:
    return F.cos(_c(c))


def cast_string(c) -> Column:
    return _c(c).cast("string")


def cast_int64(c) -> Column:
    return _c(c).try_cast("bigint")


def cast_float64(c) -> Column:
    return _c(c).try_cast("double")


def cast_bool(c) -> Column:
    return _c(c).try_cast("boolean")


def year(c) -> Column:
    return F.year(_c(c)).cast("bigint")


def month(c) -> Column:
    return F.month(_c(c)).cast("bigint")


def day(c) -> Column:
    return F.dayofmonth(_c(c)).cast("bigint")


def hour(c) -> Column:
    return F.hour(_c(c)).cast("bigint")


def minute(c) -> Column:
    return F.minute(_c(c)).cast("bigint")


def second(c) -> Column:
    return F.second(_c(c)).cast("bigint")


def days(n: int) -> Column:
    return F.make_interval(days=F.lit(n))


def hours(n: int) -> Column:
    return F.make_interval(hours=F.lit(n))


def minutes(n: int) -> Column:
    return F.make_interval(mins=F.lit(n))


def months(n: int) -> Column:
    return F.make_interval(months=F.lit(n))


def years(n: int) -> Column:
    return F.make_interval(years=F.lit(n))


def date_add(c, interval: Column) -> Column:
    """Calendar addition; a day that the month lacks becomes its last."""
    return _c(c) + interval


add_interval = date_add


def date_sub(c, interval: Column) -> Column:
    return _c(c) - interval


_UNITS = {"days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND"}


def date_diff(start, end, unit: str) -> Column:
    """Whole units from start to end, towards zero. Months and years compare calendar days, not times of day."""
    a, b = _c(start), _c(end)
    if unit in _UNITS:
        return F.timestamp_diff(_UNITS[unit], a, b).cast("bigint")
    if unit not in ("months", "years"):
        raise EngineError("date_diff", f"unit {unit!r} is none of {', '.join([*_UNITS, 'months', 'years'])}")
    n = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    if unit == "months":
        return n.cast("bigint")
    before = (F.month(b) < F.month(a)) | ((F.month(b) == F.month(a)) & (F.dayofmonth(b) < F.dayofmonth(a)))
    return (F.year(b) - F.year(a) - before.cast("int")).cast("bigint")


def agg_name(kind: str, name: str) -> str:
    return f"{kind}_{name}"


def _agg(kind: str, c, out: Column) -> Column:
    return out.alias(agg_name(kind, c)) if isinstance(c, str) else out


def sum_(c) -> Column:
    """Named sum_<column> unless aliased; so are the other aggregates."""
    return _agg("sum", c, F.sum(_c(c)))


def count(c) -> Column:
    return _agg("count", c, F.count(_c(c)))


def count_all() -> Column:
    return F.count("*").alias("count_*")


def mean(c) -> Column:
    return _agg("mean", c, F.avg(_c(c)))


def min_(c) -> Column:
    return _agg("min", c, F.min(_c(c)))


def max_(c) -> Column:
    return _agg("max", c, F.max(_c(c)))
