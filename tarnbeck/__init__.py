"""An analytics engine declared on PySpark's DataFrame, SQL and Structured Streaming APIs."""

__version__ = "0.1.0"
