"""Readers and writers."""

from tarnbeck.sources.csv import read_csv, write_csv
from tarnbeck.sources.json import read_json, write_json
from tarnbeck.sources.memory import from_rows
from tarnbeck.sources.parquet import read_parquet, write_parquet

__all__ = ["from_rows", "read_csv", "read_json", "read_parquet", "write_csv", "write_json", "write_parquet"]
