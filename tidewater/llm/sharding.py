"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of its key, of ``N_SLOTS`` in all, and never changes. Bytes are
summed per slot, and a small versioned map, one row a slot, says which shard holds the slot.
Rebalancing edits the map and moves whole slots, so the data are not hashed anew.

The map's law is ``bytes``: slots go, largest first, to the shard with the fewest bytes so far.
It has ``N_SLOTS`` rows whatever the input, so the driver may hold it and it may be broadcast.

Defined results: a null text has 0 bytes of its own; records of a null id are dealt by their text; rows
that repeat an id and text share a virtual slot and get adjoining places; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm.shared import stage

N_SLOTS = 8192
RECORD_BYTES = 8
MAP = "version int, virtual_slot int, shard int, bytes long"


def slotted(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of each record."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.when(docs[id_col].isNull(), F.xxhash64(text)))
    return docs.select(docs[id_col].alias(id_col), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_bytes(records: DataFrame) -> list[tuple[int, int]]:
    """(virtual slot, bytes) of the slots in use: at most ``N_SLOTS`` rows."""
    return [tuple(r) for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()]


def first_map(sizes: list[tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> list[tuple[int, int, int, int]]:
    """Version 1: largest slot first, to the shard with the fewest bytes; slots of no bytes go round."""
    known = dict(sizes)
    order = sorted(range(n_slots), key=lambda s: (-known.get(s, 0), s))
    loads = [(0, shard) for shard in range(n_shards)]
    out = []
    for turn, slot in enumerate(order):
        size = known.get(slot, 0)
        if not size:
            out.append((1, slot, turn % n_shards, 0))
            continue
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, shard))
        out.append((1, slot, shard, size))
    return sorted(out)


def rebalanced(before: list[tuple[int, int, int, int]], sizes: list[tuple[int, int]], n_shards: int, slack: float = 0.02) -> list[tuple[int, int, int, int]]:
    """The next version for new slot sizes or another number of shards, moving few bytes.

    Slots of shards that are gone move first; then shards above the mean by more than ``slack``
    give up slots, the largest that fits first, to the shard with the fewest bytes.
    """
    known, version = dict(sizes), before[0][0] + 1
    held: dict[int, list[int]] = {shard: [] for shard in range(n_shards)}
    homeless = []
    for _, slot, shard, _ in before:
        held[shard].append(slot) if shard < n_shards else homeless.append(slot)
    load = {shard: sum(known.get(s, 0) for s in slots) for shard, slots in held.items()}
    mean = sum(known.values()) / n_shards
    for shard in held:
        excess = load[shard] - mean * (1 + slack)
        for slot in sorted(held[shard], key=lambda s: (-known.get(s, 0), s)) if excess > 0 else []:
            size = known.get(slot, 0)
            if 0 < size <= load[shard] - mean:
                held[shard].remove(slot)
                homeless.append(slot)
                load[shard] -= size
    heap = [(size, shard) for shard, size in load.items()]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-known.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        held[shard].append(slot)
        heapq.heappush(heap, (size + known.get(slot, 0), shard))
    return sorted((version, slot, shard, known.get(slot, 0)) for shard, slots in held.items() for slot in slots)


def save_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str) -> None:
    """Append a version to the stored map; older versions stay readable."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """One version of the stored map, the newest unless named."""
    stored = spark.read.schema(MAP).parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return sorted(tuple(r) for r in stored.filter(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes").collect())


def place(records: DataFrame, slot_map: list[tuple[int, int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """Add shard and slot, the record's place in its shard, counted from 0 without gaps.

    Places are offsets of the virtual slots in a shard plus a rank inside the virtual slot, so no
    task holds a whole shard.
    """
    spark = records.sparkSession
    shards = F.broadcast(spark.createDataFrame([(slot, shard) for _, slot, shard, _ in slot_map], "virtual_slot int, shard int"))
    records = records.join(shards, "virtual_slot")
    counts = records.groupBy("shard", "virtual_slot").count()
    offsets = counts.select("virtual_slot", (F.sum("count").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col(id_col), "text_crc32", "size")) - 1
    return records.withColumn("_rank", rank).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).drop("_before", "_rank")


def shard(docs: DataFrame, n_shards: int, map_path: str, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Records with size, text_crc32, virtual_slot, shard and slot; version 1 of the map is stored at ``map_path``."""
    records = stage(slotted(docs, n_slots, id_col, text_col), "slotted")
    save_map(docs.sparkSession, first_map(slot_bytes(records), n_shards, n_slots), map_path)
    return place(records, load_map(docs.sparkSession, map_path, 1), id_col)
