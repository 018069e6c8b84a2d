"""Joins that split off keys with many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than rows / KEYS rows, and more than HOT, is split off; so there are fewer than KEYS of them.
KEYS, HOT = 4096, 256


def many(rows: int) -> int:
    """Beyond how many of `rows` rows a key is split off."""
    return max(HOT, rows // KEYS)


def sizes(right: DataFrame, size: str) -> tuple[int, int]:
    """The sum of a table's sizes, and the largest of them; 0 if it is empty."""
    return tuple(right.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first())


def join_split(left: DataFrame, right: DataFrame, key: str, size: str, rows: int, largest: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key, and in `size` how many rows of left that key has; rows: those of left; largest: those of the key with most, if known.

    The rows of left whose key has many of them, fewer than KEYS keys, meet theirs by broadcast and are
    never dealt out by key; all others are. Rows without a partner are left out, as are null keys.
    """
    most = many(rows)
    if largest is not None and largest <= most:  # nothing to split
        return left.join(right, key)
    hot = right.filter(F.col(size) > most)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(size) <= most), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def with_side(pairs: DataFrame, side: str, table: DataFrame, column: str, rows: int) -> DataFrame:
    """pairs (u, v) with `column` of the table (by node) for their `side`, as <column>_<side>. A node in many pairs has them dealt out under a salt, and its row of the table copied as often."""
    most = many(rows)
    hot = pairs.groupBy(side).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(side, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    hot = F.broadcast(hot)  # fewer than KEYS rows
    other = "v" if side == "u" else "u"
    left = pairs.join(hot, side, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("salts")).cast("int"))).drop("salts")
    right = table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")).join(hot, side, "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [side, "salt"]).drop("salt")
