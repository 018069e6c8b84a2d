"""Types of text columns, found in one aggregation over all rows.

A type fits a column if every value that is not blank casts to it, and the narrowest that fits wins:
boolean, bigint, double, string. A column of blanks is text. What is collected is one row of flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INT = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _fits(c: Column, booleans: list[str]) -> dict[str, Column]:
    return {
        "boolean": F.lower(c).isin(booleans),
        "bigint": c.rlike(_INT) & c.try_cast("bigint").isNotNull(),
        "double": c.rlike(_NUMBER) | F.lower(c).isin("nan", "inf", "+inf", "-inf", "infinity", "-infinity"),
    }


def infer_types(df: DataFrame, booleans: list[str] | None = None, force_text: dict[str, Column] | None = None) -> dict[str, str]:
    """The type of each column of text. A column for which any row meets its force_text condition stays text."""
    booleans = booleans or ["true", "false"]
    if not df.columns:
        return {}
    flags = []
    for k, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        value = F.when(F.trim(c) != "", F.trim(c))
        for kind, ok in _fits(value, booleans).items():
            flags.append(F.coalesce(F.bool_and(F.when(value.isNotNull(), ok)), F.lit(False)).alias(f"{k}_{kind}"))
        flags.append(F.coalesce(F.bool_or((force_text or {}).get(name, F.lit(False))), F.lit(False)).alias(f"{k}_text"))
    found = df.agg(*flags).first()
    out = {}
    for k, name in enumerate(df.columns):
        kinds = [] if found[f"{k}_text"] else [kind for kind in ("boolean", "bigint", "double") if found[f"{k}_{kind}"]]
        out[name] = kinds[0] if kinds else "string"
    return out


def cast_all(df: DataFrame, types: dict[str, str], true_words: list[str] | None = None, blank_text: bool = False) -> DataFrame:
    """Columns of text cast to their types; blanks become null where the type is not text. With blank_text, missing texts are empty."""
    out = []
    for name in df.columns:
        c, kind = F.col(f"`{name}`"), types[name]
        value = F.when(F.trim(c) != "", F.trim(c))
        if kind == "string":
            made = F.coalesce(c, F.lit("")) if blank_text else c
        elif kind == "boolean":
            made = F.when(value.isNotNull(), F.lower(value).isin(true_words or ["true"]))
        else:
            made = value.try_cast(kind)
        out.append(made.alias(name))
    return df.select(*out)
