"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow. Its documents are shuffled by a keyed hash of doc_id, and each copy of a document is served in
packets of at most PACKET words. A packet's virtual finish time is the source's words up to and including it, divided by
the source's target. The packets of all sources are range-sorted by finish time into one queue, which is truncated at
the total budget, the sum of the targets; the packet in which the budget ends is cut at that word. At virtual time 1
every source has been served its target but for a packet at most, so each ends within about a packet of its target.

The running sum over a source never gathers the source in one task: documents fall into cells by their hash, cells
are summed first (with map-side combine), the sums' prefix gives each cell's offset, and only a cell is windowed. The
queue is summed by its ranges, one number a range; only the one range in which the budget ends is windowed.

Cases: a null text has size 0 and nothing of it is taken; null sources form a source of their own, last; an empty table
gives no rows; a source of size 0 gets target 0; repeated rows are packets of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise, partitions, word_count

#: Words that are served at once; sources miss their targets by about so many.
PACKET = 256
#: Ids of a table that is broadcast at most (8 bytes each).
BROADCAST_ROWS = 1_000_000


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """sources: (source_key, source_size), one row each; source_key sorts as wanted. Adds target.

    Weights repeat along the sources in order. share times the words of all sources is dealt by weight; no target
    exceeds repeats times its source, and what is cut off goes to the others by weight (water filling). The level is
    found in closed form: in the order of cap / weight, (budget - caps before) / (weights from here on) grows as long
    as sources are capped and shrinks after, so its maximum is the level. The table has a row per source, and one task
    windows it: 24 bytes a source.
    """
    all_rows = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(all_rows.orderBy("source_key")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(repeats))
    t = t.withColumn("level_cap", F.col("cap") / F.col("weight"))
    by_cap = all_rows.orderBy("level_cap", "source_key")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(all_rows) * float(share)
    t = t.withColumn("level", (budget - before) / after)
    return t.withColumn("target", F.least(F.col("cap"), F.max("level").over(all_rows) * F.col("weight"))).select("source_key", "source_size", "target")


def queue(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, repeats: int = 2, seed: int = 20240, size: Column | None = None) -> DataFrame:
    """The range-sorted queue, a row per packet: row (names a row of docs), doc_id, source_key, size, source_size, target, end, copy, part, finish, words, served.

    served is what the queue serves of the packet's words before the budget is spent. A document without words has one
    packet of none.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    light = docs.select("doc_id", key.alias("source_key"), size.alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("order_key"), F.monotonically_increasing_id().alias("row"))
    light = materialise(light, "mix-sizes")
    cells = 4 * partitions(spark)
    placed = light.withColumn("cell", F.pmod("order_key", F.lit(cells)).cast("int"))
    sums = placed.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"))
    targets = materialise(source_targets(light.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, repeats), "mix-targets")
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).join(targets, "source_key")
    inside = Window.partitionBy("source_key", "cell").orderBy("order_key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    timed = placed.join(offsets, ["source_key", "cell"]).withColumn("end", F.col("offset") + F.sum("size").over(inside))
    parts = F.greatest(F.ceil(F.col("size") / PACKET), F.lit(1)).cast("int")
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), repeats).otherwise(1)
    packets = timed.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), copies * F.col("parts") - 1)))
    packets = packets.withColumn("copy", F.floor(F.col("i") / F.col("parts")).cast("int")).withColumn("part", F.pmod("i", "parts").cast("int"))
    served_by = F.least((F.col("part") + 1) * PACKET, F.col("size"))
    words = served_by - F.col("part") * PACKET
    finish = F.when(F.col("target") > 0, (F.col("end") - F.col("size") + served_by + F.col("copy") * F.col("source_size")) / F.col("target"))
    order = ["finish", "source_key", "end", "copy", "part"]
    packets = packets.select("row", "doc_id", "source_key", "size", "source_size", "target", "end", "copy", "part", finish.alias("finish"), F.when(finish.isNull(), 0).otherwise(words).cast("long").alias("words"))
    ranged = materialise(packets.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "mix-queue")
    budget = int(targets.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)))).first()[0])
    spent, cut = 0, -1  # the range in which the budget ends, and what is spent before it
    for r in sorted(ranged.groupBy("range").agg(F.sum("words").alias("words")).collect()):
        cut = r["range"]
        if spent + r.words > budget:
            break
        spent, cut = spent + r.words, cut + 1
    earlier = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget - spent) - F.coalesce(F.sum("words").over(earlier), F.lit(0))
    whole = ranged.where(F.col("range") != cut).withColumn("served", F.when(F.col("range") < cut, F.col("words")).otherwise(F.lit(0)).cast("long"))
    last = ranged.where(F.col("range") == cut).withColumn("served", F.greatest(F.lit(0), F.least("words", left)).cast("long"))
    discard(targets, light)
    return whole.unionByName(last).drop("range")


def mix(queued: DataFrame) -> DataFrame:
    """The mixed stream: the packets that are served, in the order of the queue."""
    return queued.where("served > 0").orderBy("finish", "source_key", "end", "copy", "part")


def taken(queued: DataFrame) -> DataFrame:
    """Per row of the documents, the words that the mix takes of it, copies counted."""
    rows = queued.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("served").alias("taken"))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def keep_mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 0.9) -> DataFrame:
    """The rows of docs, all columns, that a mix without repeats serves at least half of; rows of one doc_id go or stay together.

    What goes is joined by broadcast up to BROADCAST_ROWS ids, else by shuffle. Rows without doc_id stay.
    """
    served = taken(queue(docs, weights, share, 1)).groupBy("doc_id").agg(F.max(F.col("taken") * 2 >= F.col("size")).alias("stays"))
    go = materialise(served.where("not stays and doc_id is not null").select(F.col("doc_id").alias("__id")), "mix-go")
    return docs.join(F.broadcast(go) if go.count() <= BROADCAST_ROWS else go, F.col("doc_id") == F.col("__id"), "left_anti")
