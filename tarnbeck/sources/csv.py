"""CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.sources.inference import cast_all, infer_types


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", comment: str | None = None, header: bool = True, skip_initial_space: bool = False, schema: T.StructType | None = None, strict: bool = True, multi_line: bool = False
) -> DataFrame:
    """Reads CSV with the given schema, or infers it in one pass over all rows.

    Without a header, columns are named column_0, column_1, ... Blank cells of typed columns are null,
    those of text columns empty. strict fails on rows with a differing number of fields; otherwise
    missing ones are blank. A file with just a header gives text columns and no rows. Files are split, a
    task to each part; with multi_line, quoted cells may hold line feeds, and a file is one task's.
    """
    reader = spark.read.options(sep=delimiter, header=header, ignoreLeadingWhiteSpace=skip_initial_space, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST" if strict else "PERMISSIVE", emptyValue="", nullValue="\u0000")
    if comment:
        reader = reader.option("comment", comment)
    if schema is not None:
        return reader.option("nullValue", "").schema(schema).csv(path)
    raw = reader.option("inferSchema", False).csv(path)
    if not header:
        raw = raw.toDF(*(f"column_{k}" for k in range(len(raw.columns))))
    return cast_all(raw, infer_types(raw), blank_text=True)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Writes a folder of CSV files; null is an empty cell and true and false are in lower case. single_file is for small results."""
    out = df.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, T.AtomicType) else F.to_json(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema))
    (out.coalesce(1) if single_file else out).write.mode(mode).options(sep=delimiter, header=header, quote='"', escape='"', emptyValue='""').csv(path)
