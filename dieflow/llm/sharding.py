"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots once and for all.  Bytes are added
up by slot, and a small versioned table says which shard owns each slot;
rebalancing edits that table and moves whole slots, never rehashes records.
The number of slots is a parameter, so loads and map have a fixed size however
large the corpus is: those, and only those, visit the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS
from dieflow.llm.common import cut, scratch

SLOTS = 8192
OVERHEAD = 16
#: A slot with so many times the mean of rows is numbered in so many parts.
HOT, PARTS = 16, 64


@dataclass(frozen=True)
class SlotMap:
    """Version and owner shard of every slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, o) for s, o in enumerate(self.owner)], "version int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table at path; earlier versions stay readable."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        rows = spark.read.parquet(path)
        v = rows.agg(F.max("version")).first()[0] if version is None else version
        found = sorted((r.vslot, r.shard, r.shards) for r in rows.where(F.col("version") == v).collect())
        if not found:
            raise ValueError(f"no version {v} in {path}")
        return SlotMap(v, found[0][2], tuple(r[1] for r in found))

    @staticmethod
    def latest(spark: SparkSession, path: str) -> SlotMap | None:
        """The latest version, or None if nothing was saved at path."""
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return SlotMap.load(spark, path) if there else None


def assign(loads: Sequence[int], shards: int) -> SlotMap:
    """A first map: heaviest slot first, each to the lightest shard so far."""
    heap = [(0, 0, s) for s in range(shards)]
    owner = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, n, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + loads[slot], n + 1, shard))
    return SlotMap(1, shards, tuple(owner))


def rebalance(given: SlotMap, loads: Sequence[int], shards: int) -> SlotMap:
    """The next version, over `shards` shards: slots leave shards that are gone or over the mean, and only those move."""
    owner = list(given.owner)
    held: list[list[int]] = [[] for _ in range(max(shards, given.shards))]
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
    total, mean = [sum(loads[s] for s in x) for x in held], sum(loads) / shards
    loose = [s for x in held[shards:] for s in x]
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-loads[s], s)):
            if loads[slot] and total[shard] - loads[slot] >= mean:
                total[shard] -= loads[slot]
                loose.append(slot)
    heap = [(total[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-loads[s], s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + loads[slot], shard))
    return SlotMap(given.version + 1, shards, tuple(owner))


def slotted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 16), text_crc32 and vslot of every row.

    A null text has no bytes.  The slot is a hash of the id; rows without an id
    are spread by their text instead, so they make no hot slot.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id))).otherwise(F.xxhash64(body))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most `slots` rows reach the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.bytes, r.n
    return size, count


def shard(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS, maps: str | None = None, least: int = LEAST_ROWS) -> tuple[DataFrame, SlotMap]:
    """Every row with its shard, and the map used, which is the latest version in the table at `maps`.

    The first call writes version 1 there.  A later one takes the latest
    version if it has as many shards and slots, or else appends a version that
    is the latest one rebalanced over today's loads.  Rows are placed by what
    the table then holds.  Without a path the map lives in a table of its own,
    in the shared folder, until the driver ends.

    Columns: doc_id, size, text_crc32, vslot, shard and slot, the row's place
    in its shard, gapless from 0: the slots a shard owns follow one another,
    and a row's place in its slot is numbered by id, checksum and size.
    Repeated rows get places of their own.  No rows give no rows.

    A slot with over HOT times the mean of rows, as one id in a third of them
    makes it, is numbered in PARTS parts, by the partition its rows were
    written from, so that no task sorts it all.
    """
    spark = docs.sparkSession
    rows = cut(slotted(docs, text, doc_id, slots).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), "slots")
    size, count = slot_loads(rows, slots)
    at = maps or scratch(spark, "slotmap")
    before = SlotMap.latest(spark, at)
    if before is None:
        assign(size, shards).save(spark, at)
    elif before.shards != shards:
        if len(before.owner) != slots:
            raise ValueError(f"the map at {at} has {len(before.owner)} slots")
        rebalance(before, size, shards).save(spark, at)
    used = SlotMap.load(spark, at)
    hot = {s for s in range(slots) if count[s] > max(least, HOT * sum(count) // slots)}
    part = F.when(F.col("vslot").isin(*sorted(hot)), F.col("part")).otherwise(0) if hot else F.lit(0)
    parted = rows.withColumn("part", part)
    pieces = {(s, 0): count[s] for s in range(slots) if count[s] and s not in hot}
    if hot:  # fewer than slots / HOT, PARTS rows each
        pieces |= {(r.vslot, r.part): r["count"] for r in parted.where(F.col("vslot").isin(*sorted(hot))).groupBy("vslot", "part").count().collect()}
    start, offsets = [0] * shards, []
    for (s, p), n in sorted(pieces.items()):
        offsets.append((s, p, used.owner[s], start[used.owner[s]]))
        start[used.owner[s]] += n
    owners = spark.createDataFrame(offsets, "vslot int, part int, shard int, first long")
    place = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = parted.withColumn("place", place).join(F.broadcast(owners), ["vslot", "part"])
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("place") - 1).alias("slot")), used
