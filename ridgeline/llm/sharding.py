"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (by id and text), bytes are
summed by slot, and a versioned map assigns slots to shards. A first map deals
slots by size, largest first, to the lightest shard; rebalancing edits the map
with as few slot moves as it can and writes a new version beside the old ones.
The law is `bytes`: shard sizes are near equal.

Scale: a slot's bytes and rows combine on the map side; the map has as many
rows as there are slots, whatever the input, and is broadcast. Rows' numbers
(no texts) are stored once with the part of the input that they came from, and
positions in a shard are numbered in three steps: offset of the slot, offset of
the part in the slot, row number in the part. So the widest window holds one part
of one slot, even where a million rows share id and text. Equal texts hash by
id as well, so a large group of copies spreads over all slots.

Defined results: null text has no bytes and CRC 0; rows with equal id and text
share a slot (and so a shard) and have their own positions; null ids hash like any value; an
empty table gives an empty result and an even map; extra columns pass through.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
OVERHEAD = 8
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(key: Column, crc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, crc), F.lit(slots)).cast("int")


def slot_loads(sized: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows), one row for each slot in use: bounded by the number of slots."""
    rows = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r["vslot"], r["bytes"], r["rows"]) for r in rows)


def first_map(loads: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: largest slots first, each to the lightest shard; empty slots go round."""
    heap = [(0, 0, shard) for shard in range(shards)]
    out = {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, count, shard = heap[0]
        heapq.heapreplace(heap, (total + size, count + 1, shard))
        out[slot] = shard
    for slot in range(slots):
        out.setdefault(slot, slot % shards)
    return out


def edited_map(old: dict[int, int], loads: list[tuple[int, int, int]], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """`old` with slots moved from heavy to light shards until all are within `tolerance` of the mean or no move helps.

    New shards start empty; shards beyond the count give up all their slots.
    """
    size = {slot: b for slot, b, _ in loads}
    new, total = dict(old), [0] * shards
    for slot, shard in old.items():
        if shard < shards:
            total[shard] += size.get(slot, 0)
    for slot in sorted((s for s, d in old.items() if d >= shards), key=lambda s: (-size.get(s, 0), s)):
        to = min(range(shards), key=lambda d: (total[d], d))
        new[slot], total[to] = to, total[to] + size.get(slot, 0)
    mean = sum(total) / shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in new.items():
        held[shard].append(slot)
    for _ in range(len(new)):
        top, low = max(range(shards), key=lambda d: (total[d], -d)), min(range(shards), key=lambda d: (total[d], d))
        if total[top] - mean <= tolerance * mean and mean - total[low] <= tolerance * mean:
            break
        room = min(total[top] - mean, mean - total[low])
        movable = [s for s in held[top] if 0 < size.get(s, 0) < total[top] - total[low]]
        if not movable:
            break
        slot = min(movable, key=lambda s: (abs(size[s] - room), s))
        held[top].remove(slot)
        held[low].append(slot)
        new[slot], total[top], total[low] = low, total[top] - size[slot], total[low] + size[slot]
    return new


def map_frame(spark: SparkSession, version: int, slot_map: dict[int, int], loads: list[tuple[int, int, int]]) -> DataFrame:
    load = {slot: (b, n) for slot, b, n in loads}
    return spark.createDataFrame([(version, s, d, *load.get(s, (0, 0))) for s, d in sorted(slot_map.items())], MAP_SCHEMA)


def save_map(frame: DataFrame, folder: str) -> None:
    """A version is a folder of its own; a version that is there already is an error, so maps are never overwritten."""
    version = frame.first()["version"]
    frame.coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={version}")


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The highest version in a folder of maps; None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(x.partition("=")[2]) for x in names if x.startswith("version=")), default=None)


def load_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    return {r["slot"]: r["shard"] for r in spark.read.parquet(f"{folder.rstrip('/')}/version={version}").collect()}


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """`docs` with size, text_crc32 and vslot."""
    out = docs.withColumns({"size": record_size(F.col(text)), "text_crc32": text_crc(F.col(text))})
    return out.withColumn("vslot", virtual_slot(F.col(key), F.col("text_crc32"), slots))


def place(rows: DataFrame, frame: DataFrame, key: str = "doc_id") -> DataFrame:
    """`rows` (of `sized`, with the stored part) with shard and slot, the gapless position in the shard. The map is broadcast: it has a row for each virtual slot."""
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = frame.select(F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("rows").over(upto("shard").orderBy("slot")), F.lit(0)).alias("_slot_at"))
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_part_at", F.coalesce(F.sum("_n").over(upto("vslot").orderBy("part")), F.lit(0))).drop("_n")
    inside = Window.partitionBy("vslot", "part").orderBy(F.col(key), F.col("text_crc32"), F.col("size"))
    numbered = rows.withColumn("_row", F.row_number().over(inside)).join(parts, ["vslot", "part"])
    out = numbered.join(F.broadcast(offsets), "vslot")
    return out.withColumn("slot", F.col("_slot_at") + F.col("_part_at") + F.col("_row") - 1).drop("_slot_at", "_part_at", "_row", "part")


def shard_documents(docs: DataFrame, shards: int, scratch, folder: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(id, size, text_crc32, vslot, shard, slot), and the version of the map in `folder` that places them.

    The folder's newest version is edited until sizes are near equal and stored
    as a new one if that moves a slot; a folder without any gets a first one.
    Rows are placed by the map as it is read back.
    """
    spark = docs.sparkSession
    rows = scratch.keep(sized(docs.select(F.col(key), F.col(text)), key, text, slots).drop(text).withColumn("part", F.spark_partition_id()))
    loads, version = slot_loads(rows), newest_version(spark, folder)
    if version is None:
        version = 1
        save_map(map_frame(spark, version, first_map(loads, shards, slots), loads), folder)
    old = load_map(spark, folder, version)
    new = edited_map(old, loads, shards)
    if new != old:
        version += 1
        save_map(map_frame(spark, version, new, loads), folder)
    return place(rows, map_frame(spark, version, load_map(spark, folder, version), loads), key), version


def write_shards(docs: DataFrame, frame: DataFrame, folder: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> None:
    """The records themselves, in one folder for each shard."""
    rows = docs.withColumn("__vslot", virtual_slot(F.col(key), text_crc(F.col(text)), slots))
    shard_of = F.broadcast(frame.select(F.col("slot").alias("__vslot"), F.col("shard").alias("_shard")))
    rows.join(shard_of, "__vslot").drop("__vslot").write.partitionBy("_shard").parquet(folder)
