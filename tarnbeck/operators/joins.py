"""Equi-joins with disambiguated columns and strategy hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.errors import EngineError, require_columns, require_equal_length, require_not_empty

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: The hints of the strategies that may be asked for. Without one, Spark decides from sizes, again at run time.
STRATEGY = {"broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash"}
#: The most bytes, as Spark estimates them from files, and the most rows of a right side that is broadcast. The driver builds a
#: table of all its rows; the estimate alone says little of that, as files may be packed to any degree.
BROADCAST_BYTES, BROADCAST_ROWS = 2 << 20, 1 << 18


def _small(df: DataFrame) -> bool:
    """Whether a broadcast holds the rows; a stream, or rows without statistics, may be too many. Rows of what seems small are counted, up to the bound."""
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return False
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join(left: DataFrame, right: DataFrame, left_keys: str | list[str], right_keys: str | list[str] | None = None, how: str = "inner", strategy: str | None = None, suffix: str = "_right") -> DataFrame:
    """All columns of the left and then of the right, keys of both included; a right column whose name is taken gets the suffix.

    Keys compare by type and value, and null matches nothing. `broadcast` holds where the right side is known to be
    small, which takes a job that counts its rows; a larger one might not fit the driver, and is joined by `merge`.
    """
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = left_keys if right_keys is None else [right_keys] if isinstance(right_keys, str) else list(right_keys)
    require_not_empty("join", "keys", left_keys)
    require_equal_length("join", left_keys, right_keys)
    require_columns("join", left_keys, left.columns)
    require_columns("join", right_keys, right.columns)
    if how not in HOW:
        raise EngineError("join", f"{how!r} is none of {', '.join(HOW)}")
    if strategy is not None and strategy not in STRATEGY:
        raise EngineError("join", f"{strategy!r} is none of {', '.join(STRATEGY)}")
    taken, names = set(left.columns), []
    for c in right.columns:
        while c in taken:
            c += suffix
        taken.add(c)
        names.append(c)
    renamed = dict(zip(right.columns, names, strict=True))
    right = right.toDF(*names)
    if strategy == "broadcast" and not _small(right):
        strategy = "merge"  # spills, and keeps Spark from a broadcast of either side by its estimate
    if strategy:
        right = right.hint(STRATEGY[strategy])
    on = reduce(lambda a, b: a & b, (F.col(f"l.`{a}`") == F.col(f"r.`{renamed[b]}`") for a, b in zip(left_keys, right_keys, strict=True)))
    return left.alias("l").join(right.alias("r"), on, HOW[how])
