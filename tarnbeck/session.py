"""Sessions with the settings that this library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tarnbeck.config import Config


def get_spark(config: Config | None = None, master: str | None = None, app: str = "tarnbeck") -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution. Partition counts are left to the cluster unless configured."""
    config = config or Config()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if config.memory_fraction is not None:
        builder = builder.config("spark.memory.fraction", str(config.memory_fraction))
    for key, value in config.spark_conf().items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
