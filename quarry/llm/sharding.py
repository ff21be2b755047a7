"""Sharding by fixed virtual slots.

A record's key is hashed into one of a few thousand slots, for ever. A versioned map, a stored table, says which shard
holds which slot. Growing or rebalancing edits the map and moves whole slots; records are never hashed anew.

Defined results: keys are integers, or are cast to them (one that can't be cast raises); a null key counts as -1; a null text has 0 bytes, so size 1, and checksum 0; repeated rows are all
kept, next to each other; an empty table gives an empty result; further columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

SLOTS = 4096
#: Multiplicative hash modulo the prime 2^31 - 1, so that any SQL engine can compute it in 64-bit integers.
PRIME, FACTORS = 2147483647, (48271, 69621)


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of an integer key, 0 to ``slots`` - 1."""
    h = F.pmod(F.coalesce(key.cast("long"), F.lit(-1)), F.lit(PRIME))
    for factor in FACTORS:
        h = ((h + 1) * factor) % PRIME
        h = h.bitwiseXOR(F.shiftright(h, 13)) % PRIME
    return (h % slots).cast("int")


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version ``shards`` of the map: grown from one shard, each step giving the new shard its fair share.

    The new shard takes slots one by one from whichever shard has most, so nothing moves between old shards.
    """
    owner = [0] * slots
    for new in range(1, shards):
        owner = grown(owner, new)
    return owner


def grown(owner: list[int], new: int) -> list[int]:
    """The map with one shard more, numbered ``new``; only slots that move into it change hands."""
    held: dict[int, list[int]] = {s: [] for s in range(new)}
    for slot, s in enumerate(owner):
        held[s].append(slot)
    heap = [(-len(v), s) for s, v in held.items()]
    heapq.heapify(heap)
    out = list(owner)
    for _ in range(len(owner) // (new + 1)):
        n, s = heapq.heappop(heap)
        out[held[s].pop()] = new
        heapq.heappush(heap, (n + 1, s))
    return out


def slot_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of each slot in use: at most ``slots`` rows, pre-aggregated before the shuffle."""
    return (
        df.select(virtual_slot(F.col(key), slots).alias("virtual_slot"), size_of(F.col(text)).alias("size"))
        .groupBy("virtual_slot")
        .agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))
    )


def rebalanced(owner: list[int], loads: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """The next version of the map: slots move from the heaviest to the lightest shard while that evens them.

    ``loads``: bytes of each slot. Stops when no shard is over the mean by more than ``tolerance``, or no slot fits.
    """
    owner, total = list(owner), {s: 0 for s in set(owner)}
    for slot, s in enumerate(owner):
        total[s] += loads.get(slot, 0)
    mean = sum(total.values()) / max(1, len(total))
    for _ in range(len(owner)):
        top, low = max(total, key=lambda s: (total[s], -s)), min(total, key=lambda s: (total[s], s))
        gap = total[top] - total[low]
        if total[top] <= mean * (1 + tolerance):
            break
        fits = [k for k, s in enumerate(owner) if s == top and 0 < loads.get(k, 0) < gap]
        if not fits:
            break
        k = min(fits, key=lambda k: (abs(gap / 2 - loads[k]), k))
        owner[k] = low
        total[top] -= loads[k]
        total[low] += loads[k]
    return owner


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """The versioned map as a table: version, virtual_slot, shard."""
    rows = [(v, k, s) for v, owner in versions.items() for k, s in enumerate(owner)]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Every record with its shard now and with one shard more, and its place in its shard.

    Returns ``key``, size, text_crc32, virtual_slot, slot_bytes, shard, place (0, 1, ... in each shard) and
    grown_shard. Places count up slot by slot: each slot is ordered by itself, and the 4096-row slot table gives
    where it starts, so no task ever holds a shard.
    """
    now = slot_map(shards, slots)
    # The map is a table of versions; a later run edits it by another version.
    versions = stored(map_table(df.sparkSession, {shards: now, shards + 1: grown(now, shards)}), "slot-map")
    held = lambda version, name: versions.where(F.col("version") == version).select("virtual_slot", F.col("shard").alias(name))
    owners = held(shards, "shard").join(F.broadcast(held(shards + 1, "grown_shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = (
        owners.join(F.broadcast(slot_bytes(df, key, text, slots)), "virtual_slot")
        .withColumn("first", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
        .select("virtual_slot", "shard", "grown_shard", "slot_bytes", "first")
    )
    rows = df.select(
        F.col(key).alias("key"),
        size_of(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(key), slots).alias("virtual_slot"),
    )
    inside = Window.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size")
    return (
        rows.withColumn("n", F.row_number().over(inside) - 1)
        .join(F.broadcast(table), "virtual_slot")
        .select(F.col("key").alias(key), "size", "text_crc32", "virtual_slot", "slot_bytes", "shard",
                (F.col("first") + F.col("n")).cast("long").alias("place"), "grown_shard")
    )
