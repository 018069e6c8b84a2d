"""Streams of rows."""

from tarnbeck.streaming.processor import StreamStats, process_stream, read_stream, sessions, windowed_counts

__all__ = ["StreamStats", "process_stream", "read_stream", "sessions", "windowed_counts"]
