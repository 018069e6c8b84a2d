"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset on one machine, as in tests, a folder of this session's own; elsewhere that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnbeck-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Store:
    """Writes tables under one fresh folder and reads them back, which cuts their lineage: an executor lost later costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tarnbeck/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.path}/{len(self.tables) + 1:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back

    def free(self, *tables: DataFrame) -> None:
        """Removes tables, as `put` returned them, that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table, path in self.tables:
            if any(table is t for t in tables):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)

    def free_but(self, *tables: DataFrame) -> None:
        """Removes all tables but these, which an operator's result reads."""
        self.free(*(t for t, _ in self.tables if not any(t is x for x in tables)))
