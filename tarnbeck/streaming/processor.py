"""Stream processing on Structured Streaming: a file source, a chain of operations, a sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from tarnbeck.errors import EngineError, require_columns


@dataclass
class StreamStats:
    """Micro-batches and rows that a run took in."""

    batches: int = 0
    rows: int = 0


class _Counter(StreamingQueryListener):
    """Counts every micro-batch of the run that `of` names; a query itself remembers the last hundred or so."""

    def __init__(self) -> None:
        self.seen: dict[str, dict[int, int]] = {}
        self.ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        self.seen.setdefault(str(event.progress.runId), {})[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()

    def of(self, run: str) -> StreamStats:
        self.ended.setdefault(run, Event()).wait(60)  # events come in order, each after its batch
        batches = self.seen.get(run, {})
        return StreamStats(len(batches), sum(batches.values()))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of the files of a folder; max_files bounds a micro-batch."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def process_stream(
    stream: DataFrame, operations: list[Callable[[DataFrame], DataFrame] | None], sink: str | Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None
) -> StreamStats:
    """Takes in what is there, applies the operations in order, and writes to a Parquet folder or a function of (frame, batch number).

    Operations that are None are skipped. An error in an operation names its place. Exactly-once with a
    folder as the sink; a function sees a batch again if a run broke off within it.
    """

    def apply(df: DataFrame, op: tuple[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
        try:
            return op[1](df)
        except Exception as e:
            raise EngineError("process_stream", f"operation {op[0]} failed: {e}") from e

    out = reduce(apply, [(k, op) for k, op in enumerate(operations) if op is not None], stream)
    counter = _Counter()
    stream.sparkSession.streams.addListener(counter)
    writer = out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        query = (writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)).start()
        try:
            if not query.awaitTermination(timeout) and timeout is not None:
                raise EngineError("process_stream", f"not done after {timeout} seconds")
        finally:
            query.stop()
        return counter.of(str(query.runId))
    finally:
        stream.sparkSession.streams.removeListener(counter)


def windowed_counts(df: DataFrame, time: str, length: str, slide: str | None, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Counts per tumbling or sliding window and key: window_start, window_end, keys, n. On a stream, rows later than `late` are left out."""
    require_columns("windowed_counts", [time, *keys], df.columns)
    if df.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Counts per session, rows of a key with no gap of `gap` between them: session_start, session_end, keys, n."""
    require_columns("sessions", [time, *keys], df.columns)
    if df.isStreaming:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
