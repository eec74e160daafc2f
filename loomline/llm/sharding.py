"""Sharding by longest-processing-time scheduling: groups that must stay together, largest first, each to the least-loaded shard.

LPT is sequential, so what it schedules has a proven bound. A group of more than 1/256 of a shard's mean load is an
item of its own: there are fewer than 256 x shards of those, as their sizes sum to at most the total. All other groups
are hashed into 256 x shards bundles, each an item. At most 512 x shards items reach the driver's heap, at any input size,
and as many rows are broadcast; more than MAX_SHARDS shards are refused.

Rows are then numbered within their shard through cells of the row's hash, so that neither a large shard nor a large
group is windowed in one task.

Cases: a null text counts no bytes and groups with the other null texts; an empty table gives no rows; repeated rows
get slots of their own; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import materialise, partitions

#: Items per shard that one kind of item has at most.
FINE = 256
#: Shards of one call: 512 items of 24 bytes each are scheduled and broadcast.
MAX_SHARDS = 10_000


def lpt(items: list[tuple[object, int]], n_shards: int) -> dict[object, int]:
    """Largest first, each item to the least-loaded shard; ties by item order and shard number."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards(rows: DataFrame, group: Column, size: Column, n_shards: int = 40) -> DataFrame:
    """Adds shard (int). group: a long, equal for rows that stay together; size: a long. rows should be materialised."""
    if not 0 < n_shards <= MAX_SHARDS:
        raise ValueError(f"1 to {MAX_SHARDS} shards")
    spark = rows.sparkSession
    keyed = rows.withColumn("__group", group).withColumn("__bundle", F.pmod(F.xxhash64("__group", F.lit(7)), F.lit(n_shards * FINE)).cast("long"))
    total = keyed.agg(F.sum(size)).first()[0] or 0
    groups = keyed.groupBy("__group", "__bundle").agg(F.sum(size).alias("bytes"))
    own = F.col("bytes") * (n_shards * FINE) > total
    items = groups.groupBy(own.alias("own"), F.when(own, F.col("__group")).otherwise(F.col("__bundle")).alias("item")).agg(F.sum("bytes").alias("bytes"))
    placed = lpt([((r.own, r.item), r.bytes) for r in items.collect()], n_shards)

    def table(kind: bool, name: str) -> DataFrame:
        # by Arrow, as a list of rows would start workers of another kind, which stay, on every executor
        found = [(k, s) for (own, k), s in placed.items() if own == kind]
        return spark.createDataFrame(pa.table({name: pa.array([k for k, _ in found], pa.int64()), f"{name}_shard": pa.array([s for _, s in found], pa.int32())}))

    out = keyed.join(F.broadcast(table(True, "__group")), "__group", "left").join(F.broadcast(table(False, "__bundle")), "__bundle", "left")
    shard = F.coalesce("__group_shard", "__bundle_shard")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], shard.alias("shard"))


def number_slots(rows: DataFrame, row_key: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, ordered by cell of the row key's hash, then row key."""
    cells = 4 * partitions(rows.sparkSession)
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64(*row_key, F.lit(11)), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "__cell").count().select("shard", "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__cell").orderBy(*row_key)
    out = rows.join(counts, ["shard", "__cell"]).withColumn("slot", (F.col("__before") + F.row_number().over(inside) - 1).cast("long"))
    return out.drop("__cell", "__before")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; equal texts share a shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    light = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("group_key"))
    light = materialise(light, "shard-sizes")
    placed = assign_shards(light, F.col("group_key"), F.col("size"), n_shards)
    out = number_slots(placed, ["doc_id", "group_key"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
