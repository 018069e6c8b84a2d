"""JSON documents and JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.errors import EngineError
from tarnbeck.sources.inference import cast_all, infer_types

#: Texts that stand for null unless told otherwise.
NULLS = ("", "null", "NULL", "nil")
_TRUE = ["true", "t", "yes", "y"]
_FALSE = ["false", "f", "no", "n"]


def read_json(
    spark: SparkSession, path: str, lines: bool = True, infer: bool = True, null_values: tuple[str, ...] = NULLS, max_records: int | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Reads an object per line, or a whole array of objects.

    Columns are the union of all keys, by name. A column of numbers given both bare and as text, or
    with any text that is no number, is text; otherwise numbers, then booleans. Nested values are
    texts of JSON. A line that is no JSON is an error.
    """
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    if schema is not None:
        df = reader.schema(schema).json(path)
    else:
        typed = reader.json(path)
        names = sorted(typed.columns)
        if not names:
            return typed
        quoted = {f.name for f in typed.schema if isinstance(f.dataType, T.StringType)}
        text = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).json(path)
        text = text.select(*(F.when(~F.col(f"`{n}`").isin(*null_values), F.col(f"`{n}`")).alias(n) for n in names))
        if infer:
            types = infer_types(text, _TRUE + _FALSE)
            # texts are numbers only if no bare value was a number; Spark reads a mixture as text
            types = {n: "string" if n in quoted and types[n] in ("bigint", "double") else types[n] for n in names}
            df = cast_all(text, types, _TRUE)
        else:
            df = text
    return df if max_records is None else df.limit(max_records)


def write_json(df: DataFrame, path: str, lines: bool = True, mode: str = "errorifexists") -> None:
    """Writes a folder of JSON Lines, nulls included. lines=False writes one array in one file, a row to a line: the rows pass through one task, but none holds more than one of them."""
    if lines:
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
        return
    if len(df.columns) == 0:
        raise EngineError("write_json", "no columns")
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    # the first row opens the array, the others follow a comma, and a last line closes it
    rows = df.select(row.alias("value")).coalesce(1).select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(","), "value").alias("value"))
    ends = df.sparkSession.range(0, 1, 1, 1).select(F.lit("]").alias("value"))
    if rows.isEmpty():
        ends = ends.select(F.lit("[]").alias("value"))
    rows.unionByName(ends).coalesce(1).write.mode(mode).text(path)
