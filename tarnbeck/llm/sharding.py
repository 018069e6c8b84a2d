"""Sharding by fixed virtual slots, with DataFrame operations only.

Every record hashes into one of a few thousand virtual slots. Bytes are aggregated per virtual slot,
and a stored, versioned map gives each virtual slot its shard: version 1 deals the virtual slots out by
number, and each later version is the stored one before, read back and edited to level the shards. Only
the aggregated table and the map, as many rows as there are virtual slots, reach the driver.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.store import Store

#: Virtual slots; what the driver collects and what is broadcast has as many rows, whatever the input.
SLOTS = 8192
#: Bytes that a record costs besides its text.
OVERHEAD = 16


def spread(slots: int, shards: int) -> list[int]:
    """Version 1 of a map: virtual slots dealt out by number."""
    return [k % shards for k in range(slots)]


def rebalance(sizes: list[int], old: list[int], shards: int) -> list[int]:
    """An edit of the map `old` that levels the shards' bytes.

    Largest first, a virtual slot keeps its shard while that shard stays within the mean, or is the
    smallest by then; otherwise it goes to the smallest. The result depends on the arguments alone.
    """
    mean = -(-sum(sizes) // shards)
    load, new = [0] * shards, [0] * len(sizes)
    heap = [(0, s) for s in range(shards)]
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        while heap[0][0] != load[heap[0][1]]:  # the shard has grown since
            heapq.heappop(heap)
        s = old[k] if 0 <= old[k] < shards and (load[old[k]] + sizes[k] <= mean or load[old[k]] == heap[0][0]) else heap[0][1]
        new[k] = s
        load[s] += sizes[k]
        heapq.heappush(heap, (load[s], s))
    return new


def _rows(spark: SparkSession, columns: dict[str, list[int]], shape: str) -> DataFrame:
    """A row per virtual slot from lists of its columns."""
    rows = json.dumps([dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{shape}>>")))


def save_map(spark: SparkSession, path: str, version: int, shard: list[int]) -> None:
    """Stores a version of a map as a folder of its own. A version that is there already raises, so of two edits at once only one succeeds."""
    _rows(spark, {"vslot": list(range(len(shard))), "shard": shard}, "vslot:int,shard:int").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """(version, shard of each virtual slot) of the stored map, the last version unless told otherwise; None if there is no map."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    versions = [int(f.getPath().getParent().getName().partition("=")[2]) for f in found]
    if not versions:
        return None
    version = max(versions) if version is None else version
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("vslot").collect()
    return version, [r["shard"] for r in rows]


def edit_map(spark: SparkSession, path: str, sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Reads the last stored version, levels it for these sizes of the virtual slots, and stores and returns the next version, which is read back as well."""
    known = load_map(spark, path)
    if known is None:
        save_map(spark, path, 1, spread(len(sizes), shards))
        known = load_map(spark, path)
    version, old = known
    if len(old) != len(sizes):
        raise ValueError(f"the map has {len(old)} virtual slots, not {len(sizes)}")
    save_map(spark, path, version + 1, rebalance(sizes, old, shards))
    return load_map(spark, path, version + 1)


def virtual_slot(columns: list[str], slots: int = SLOTS):
    """The virtual slot of a record, by hash of these columns; nulls hash as themselves."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Deals all documents out to shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32 (null text:
    that of no bytes), law ("bytes"), shard, slot (the record's place in its shard, gapless from 0),
    grown_shard (null), vslot and map_version. A record's virtual slot depends on doc_id, so copies of a
    text spread over all shards. Null doc_ids share one virtual slot unless their texts differ; repeated
    rows each have a place; ties are ordered by text checksum and size. Texts of any length count whole, other
    columns play no part, and no documents give no rows.

    map_path is the folder of a map that earlier runs have stored: this one edits its last version and
    adds the next. Without it, the run makes a map of its own, whose second version is level.
    """
    spark = docs.sparkSession
    store = Store(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.when(F.col("doc_id").isNull(), virtual_slot(["text_crc32", "size"], slots)).otherwise(virtual_slot(["doc_id"], slots)))
    placed = store.put(placed, "placed")

    found = {r["vslot"]: (r["bytes"], r["rows"]) for r in placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    sizes, counts = ([found.get(k, (0, 0))[i] for k in range(slots)] for i in (0, 1))
    version, shard = edit_map(spark, map_path or f"{store.path}/shard-map", sizes, shards)
    held, before = [0] * shards, []  # rows that the shard holds in earlier virtual slots
    for k, s in enumerate(shard):
        before.append(held[s])
        held[s] += counts[k]
    columns = {"vslot": list(range(slots)), "shard": shard, "before": before}
    shard_map = store.put(_rows(spark, columns, "vslot:int,shard:int,before:bigint").withColumn("version", F.lit(version)).coalesce(1), "places")

    place = F.row_number().over(_by_place()) - F.lit(1)
    return (
        placed.withColumn("place", place.cast("long"))
        .join(F.broadcast(shard_map), "vslot")  # as many rows as there are virtual slots
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "vslot",
            F.col("version").alias("map_version"),
        )
    )


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
