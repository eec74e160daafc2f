"""Turns, zones and eviction as window expressions over messages (conv_id, turn, role, content).

All windows of one operator share the key conv_id, so a plan has one exchange for them. Loops that drop or keep
messages until a budget fits are running sums from one end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomline.functions import tokens as K

C = F.col


def conv() -> WindowSpec:
    return Window.partitionBy("conv_id")


def in_order() -> WindowSpec:
    return conv().orderBy("turn")


def with_turns(m: DataFrame) -> DataFrame:
    """Adds turn_id (0 before the first user message, then one per user message) and complete (the turn has an assistant message)."""
    m = m.withColumn("turn_id", F.sum((C("role") == "user").cast("long")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return m.withColumn("complete", F.max((C("role") == "assistant").cast("int")).over(Window.partitionBy("conv_id", "turn_id")) == 1)


def with_tokens(m: DataFrame) -> DataFrame:
    return m.withColumn("tokens", K.of_message(C("content")))


def zoned(m: DataFrame, keep: int = 1, frozen: int = 0, first_answer: bool = False) -> DataFrame:
    """Adds zone: anchor (system messages, the first user message, frozen full turns, with first_answer also the first turn), body (older complete turns), tail (the last keep complete turns, and what is pending).

    from_end counts complete turns from the newest: 1, 2, ...
    """
    m = with_turns(m)
    turns = F.size(F.collect_set(F.when(C("complete"), C("turn_id"))).over(conv()))
    up_to = F.size(F.collect_set(F.when(C("complete"), C("turn_id"))).over(conv().orderBy("turn_id").rangeBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("from_end", turns - up_to + 1)
    anchor = (C("turn_id") == 0) | ((C("turn_id") == 1) & ((C("role") == "user") | F.lit(first_answer))) | (C("turn_id") <= frozen)
    return m.withColumn("zone", F.when(anchor, "anchor").when(C("complete") & (C("from_end") > keep), "body").otherwise("tail"))


def pair_tokens() -> Column:
    """Tokens of the body's part of a message's turn."""
    return F.sum(F.when(C("zone") == "body", C("tokens"))).over(Window.partitionBy("conv_id", "turn_id"))


def _body_after() -> Column:
    """Tokens of the body from this message's turn on."""
    later = conv().orderBy("turn_id").rangeBetween(0, Window.unboundedFollowing)
    return F.sum(F.when(C("zone") == "body", C("tokens")).otherwise(0)).over(later)


def evicted(zoned_messages: DataFrame, budget: int, low: float = 1.0, floor: int = 0, reserve: bool = False) -> DataFrame:
    """Adds kept: the oldest body turns go if the body is over budget, until max(budget x low, floor) holds.

    With reserve the budget is for the whole conversation and anchor and tail are taken off first; nothing left for
    the body means that nothing is evicted. Anchor and tail always stay.
    """
    m = with_tokens(zoned_messages)
    total = F.sum(F.when(C("zone") == "body", C("tokens")).otherwise(0)).over(conv())
    room = F.lit(budget) - F.sum(F.when(C("zone") != "body", C("tokens")).otherwise(0)).over(conv()) if reserve else F.lit(budget)
    m = m.withColumn("__total", total).withColumn("__room", room).withColumn("__after", _body_after())
    target = F.greatest(F.floor(C("__room") * low), F.lit(floor))
    stays = (C("zone") != "body") | (C("__total") <= C("__room")) | (C("__after") <= target)
    if reserve:
        stays = stays | (C("__room") <= 0)
    return m.withColumn("kept", stays).drop("__total", "__room", "__after")


def compacted(zoned_messages: DataFrame, floor: int) -> DataFrame:
    """Adds kept: body turns stay from the oldest while anchor, tail and what stays are below floor."""
    m = with_tokens(zoned_messages)
    base = F.sum(F.when(C("zone") != "body", C("tokens")).otherwise(0)).over(conv())
    earlier = conv().orderBy("turn_id").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(C("zone") == "body", C("tokens")).otherwise(0)).over(earlier), F.lit(0))
    return m.withColumn("kept", (C("zone") != "body") | (base + before < floor))


def slid(m: DataFrame, window: int, floor: int = 0) -> DataFrame:
    """Adds kept: static messages and the newest turns; oldest turns go while all are above window, but not below floor."""
    m = with_tokens(with_turns(m))
    static = (C("turn_id") == 0) | ((C("turn_id") == 1) & (C("role") == "user"))
    m = m.withColumn("__static", static)
    size = F.sum(F.when(C("__static"), C("tokens")).otherwise(0)).over(conv())
    later = conv().orderBy("turn_id").rangeBetween(0, Window.unboundedFollowing)
    after = F.sum(F.when(~C("__static"), C("tokens")).otherwise(0)).over(later)
    rest = F.coalesce(F.sum(F.when(~C("__static"), C("tokens")).otherwise(0)).over(conv().orderBy("turn_id").rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    active = C("turn_id") == F.max("turn_id").over(conv())
    # a turn goes if all from it on are above the window and what is left after it isn't below the floor
    return m.withColumn("kept", C("__static") | active | (size + after <= window) | (size + rest < floor)).drop("__static")


def front_packed(m: DataFrame, tail_turns: int, most: int) -> DataFrame:
    """Adds kept: the tail, and messages from the front while they fit beside it."""
    m = with_tokens(with_turns(m))
    in_tail = C("turn_id") > F.max("turn_id").over(conv()) - tail_turns
    m = m.withColumn("__tail", in_tail)
    tail = F.sum(F.when(C("__tail"), C("tokens")).otherwise(0)).over(conv())
    head = F.sum(F.when(~C("__tail"), C("tokens")).otherwise(0)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("kept", C("__tail") | (head <= most - tail)).drop("__tail")


def prefix_packed(m: DataFrame, most_tokens: int) -> DataFrame:
    """Adds kept: messages from the front while their characters fit four times the tokens."""
    used = F.sum(F.length("content")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("kept", used <= 4 * most_tokens)


def newest(m: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return m.withColumn("__rank", rank).where(C("__rank") <= n).drop("__rank")


def summary(kept: DataFrame) -> DataFrame:
    """Per conversation: tokens before and after, tokens saved, and the turns that are kept."""
    survives = F.when(C("kept"), C("turn"))
    return kept.groupBy("conv_id").agg(
        F.sum("tokens").alias("original_tokens"), F.coalesce(F.sum(F.when(C("kept"), C("tokens"))), F.lit(0)).alias("kept_tokens"),
        F.sum(F.when(C("kept"), 0).otherwise(C("tokens"))).alias("saved_tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(survives)), lambda t: t.cast("string")), ",").alias("kept_turns"),
    )
