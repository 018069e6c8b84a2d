"""Relational operators on DataFrames."""

from tarnbeck.operators.analytics import correlation, rolling, window_function
from tarnbeck.operators.grouping import Groups, group_by
from tarnbeck.operators.joins import join
from tarnbeck.operators.relational import concat, drop, filter_rows, has_column, head, limit_offset, select, slice_rows, sort_by, with_column

__all__ = [
    "Groups", "concat", "correlation", "drop", "filter_rows", "group_by", "has_column", "head", "join", "limit_offset", "rolling", "select", "slice_rows", "sort_by", "window_function", "with_column",
]
