"""Turns, zones, eviction and trimming (section 2.6), and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import tokens as K
from loomline.operators import zones as Z
from loomline.plans.registry import CODE, MESSAGES, STEPS, TRACES, query
from loomline.plans.text_plans import TOK, ordered_join

C = F.col

_TURNS = f"""t AS (SELECT *, {TOK} + 5 AS tokens, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_id FROM src),
    u AS (SELECT *, bool_or(role = 'assistant') OVER (PARTITION BY conv_id, turn_id) AS complete FROM t)"""


def _zones(keep: int, frozen: int = 0, answer: bool = False) -> str:
    return f"""{_TURNS}, c AS (SELECT conv_id, turn_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC) AS from_end FROM (SELECT DISTINCT conv_id, turn_id FROM u WHERE complete)),
    z AS (SELECT u.*, CASE WHEN turn_id = 0 OR (turn_id = 1 AND (role = 'user' OR {str(answer).lower()})) OR turn_id <= {frozen} THEN 'anchor' WHEN from_end > {keep} THEN 'body' ELSE 'tail' END AS zone FROM u LEFT JOIN c USING (conv_id, turn_id))"""


def _evict(zones: str, room: str, low: float, floor: int = 0, extra: str = "false") -> str:
    return f"""{zones}, p AS (SELECT *, coalesce(sum(tokens) FILTER (WHERE zone = 'body') OVER (PARTITION BY conv_id), 0) AS body, {room} AS room,
        coalesce(sum(tokens) FILTER (WHERE zone = 'body') OVER (PARTITION BY conv_id ORDER BY turn_id RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS after FROM z),
    k AS (SELECT *, zone <> 'body' OR body <= room OR after <= greatest(floor(room * {low}::DOUBLE), {floor}) OR {extra} AS kept FROM p)"""


_RESERVED = "{budget} - coalesce(sum(tokens) FILTER (WHERE zone <> 'body') OVER (PARTITION BY conv_id), 0)"
_SUMMARY = """SELECT conv_id, sum(tokens)::BIGINT AS original_tokens, coalesce(sum(tokens) FILTER (WHERE kept), 0)::BIGINT AS kept_tokens, coalesce(sum(tokens) FILTER (WHERE NOT kept), 0)::BIGINT AS saved_tokens,
    coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (WHERE kept), '') AS kept_turns FROM k GROUP BY conv_id"""


@query(MESSAGES, f"WITH {_evict(_zones(1), _RESERVED.format(budget=600), 0.8, 0, 'room <= 0')} {_SUMMARY}")
def token_savings(m: DataFrame) -> DataFrame:
    """The flagship: per conversation, what compaction to 600 tokens saves and which turns survive."""
    return Z.summary(Z.evicted(Z.zoned(m, keep=1), 600, low=0.8, reserve=True))


@query(MESSAGES, f"WITH {_TURNS} SELECT conv_id, turn, turn_id, complete FROM u")
def turn_grouping(m: DataFrame) -> DataFrame:
    return Z.with_turns(m).select("conv_id", "turn", "turn_id", "complete")


@query(MESSAGES, f"WITH {_TURNS} SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS static_end, max(turn) FILTER (WHERE turn_id <= 2) AS frozen_end, bool_and(turn_id <= 2) AS all_frozen FROM u GROUP BY conv_id")
def frozen_prefix(m: DataFrame) -> DataFrame:
    """Where the static messages end, and where the first user message's turn and one more full turn do."""
    t = Z.with_turns(m)
    return t.groupBy("conv_id").agg(F.min(F.when(C("role") == "user", C("turn"))).alias("static_end"), F.max(F.when(C("turn_id") <= 2, C("turn"))).alias("frozen_end"), F.bool_and(C("turn_id") <= 2).alias("all_frozen"))


@query(MESSAGES, f"WITH {_zones(1)} SELECT conv_id, turn, zone FROM z")
def zones(m: DataFrame) -> DataFrame:
    return Z.zoned(m, keep=1).select("conv_id", "turn", "zone")


@query(MESSAGES, f"WITH {_zones(1, 0, True)} SELECT conv_id, turn, zone FROM z")
def zones_compactor(m: DataFrame) -> DataFrame:
    return Z.zoned(m, keep=1, first_answer=True).select("conv_id", "turn", "zone")


@query(MESSAGES, f"WITH {_zones(1)} SELECT conv_id, zone, sum(tokens)::BIGINT AS tokens, count(*) AS messages FROM z GROUP BY conv_id, zone")
def zone_tokens(m: DataFrame) -> DataFrame:
    return Z.with_tokens(Z.zoned(m, keep=1)).groupBy("conv_id", "zone").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("messages"))


@query(MESSAGES, f"WITH {_evict(_zones(1), '300', 0.8)} SELECT conv_id, turn, zone, kept FROM k")
def evict_low_water(m: DataFrame) -> DataFrame:
    return Z.evicted(Z.zoned(m, keep=1), 300, low=0.8).select("conv_id", "turn", "zone", "kept")


@query(MESSAGES, f"WITH {_evict(_zones(1), '300', 1.0)} SELECT conv_id, turn, kept FROM k")
def evict_plain(m: DataFrame) -> DataFrame:
    return Z.evicted(Z.zoned(m, keep=1), 300).select("conv_id", "turn", "kept")


@query(MESSAGES, f"""WITH {_zones(1)}, p AS (SELECT *, coalesce(sum(tokens) FILTER (WHERE zone <> 'body') OVER (PARTITION BY conv_id), 0) AS base,
        coalesce(sum(tokens) FILTER (WHERE zone = 'body') OVER (PARTITION BY conv_id ORDER BY turn_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
    SELECT conv_id, turn, zone <> 'body' OR base + before < 500 AS kept FROM p""")
def compact_floor(m: DataFrame) -> DataFrame:
    return Z.compacted(Z.zoned(m, keep=1), 500).select("conv_id", "turn", "kept")


@query(MESSAGES, f"WITH {_evict(_zones(1), _RESERVED.format(budget=700), 1.0, 0, 'room <= 0')} SELECT conv_id, turn, kept FROM k")
def trim_to_budget(m: DataFrame) -> DataFrame:
    return Z.evicted(Z.zoned(m, keep=1), 700, reserve=True).select("conv_id", "turn", "kept")


@query(MESSAGES, f"WITH {_evict(_zones(1), _RESERVED.format(budget=525), 1.0, 0, 'room <= 0')} SELECT conv_id, turn, kept FROM k")
def proactive_trim(m: DataFrame) -> DataFrame:
    """The same with the lower, proactive target: three quarters of the budget."""
    return Z.evicted(Z.zoned(m, keep=1), int(700 * 0.75), reserve=True).select("conv_id", "turn", "kept")


@query(MESSAGES, f"""WITH {_TURNS}, s AS (SELECT *, turn_id = 0 OR (turn_id = 1 AND role = 'user') AS static FROM u),
    p AS (SELECT *, coalesce(sum(tokens) FILTER (WHERE static) OVER (PARTITION BY conv_id), 0) AS base, max(turn_id) OVER (PARTITION BY conv_id) AS last_turn,
        coalesce(sum(tokens) FILTER (WHERE NOT static) OVER (PARTITION BY conv_id ORDER BY turn_id RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS after,
        coalesce(sum(tokens) FILTER (WHERE NOT static) OVER (PARTITION BY conv_id ORDER BY turn_id RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM s)
    SELECT conv_id, turn, static OR turn_id = last_turn OR base + after <= 600 OR base + rest < 200 AS kept FROM p""")
def sliding_window(m: DataFrame) -> DataFrame:
    return Z.slid(m, 600, 200).select("conv_id", "turn", "kept")


@query(MESSAGES, f"""WITH {_TURNS}, s AS (SELECT *, turn_id > max(turn_id) OVER (PARTITION BY conv_id) - 1 AS in_tail FROM u),
    p AS (SELECT *, coalesce(sum(tokens) FILTER (WHERE in_tail) OVER (PARTITION BY conv_id), 0) AS tail, coalesce(sum(tokens) FILTER (WHERE NOT in_tail) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS head FROM s)
    SELECT conv_id, turn, in_tail OR head <= 800 - tail AS kept FROM p""")
def front_drop(m: DataFrame) -> DataFrame:
    return Z.front_packed(m, 1, 800).select("conv_id", "turn", "kept")


@query(MESSAGES, "SELECT conv_id, turn, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn) <= 1200 AS kept FROM src")
def prefix_pack(m: DataFrame) -> DataFrame:
    return Z.prefix_packed(m, 300).select("conv_id", "turn", "kept")


_OUTLINE = r"array_to_string([trim(x) FOR x IN string_split(content, chr(10)) IF regexp_matches(trim(x), '^(def |class |import |from )')], chr(10))"


@query(CODE, f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, {_OUTLINE} AS outline FROM src)
    SELECT conv_id, turn, CASE WHEN k <= 2 OR length(content) <= 200 THEN content ELSE outline END AS content FROM r WHERE k <= 2 OR length(content) <= 200 OR outline <> ''""")
def old_turn_outline(m: DataFrame) -> DataFrame:
    """Long messages before the last two keep only their definition and import lines; those without any go."""
    old = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) > 2
    t = m.withColumn("__old", old & (F.length("content") > 200)).withColumn("__outline", outline(C("content")))
    return t.where(~C("__old") | (C("__outline") != "")).select("conv_id", "turn", F.when(C("__old"), C("__outline")).otherwise(C("content")).alias("content"))


def outline(text):
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(def |class |import |from )"))
    return F.array_join(kept, "\n")


@query(MESSAGES, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS k FROM src) SELECT conv_id, turn, role FROM r WHERE role = 'system' OR k <= 2")
def fallback_context(m: DataFrame) -> DataFrame:
    """System messages and the last two others."""
    k = F.row_number().over(Window.partitionBy("conv_id", C("role") == "system").orderBy(F.desc("turn")))
    return m.withColumn("k", k).where((C("role") == "system") | (C("k") <= 2)).select("conv_id", "turn", "role")


_PLACED = "SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'system' ELSE role END AS role, CASE WHEN turn = 3 THEN 'Context summary (rolling): ' || text ELSE text END AS content FROM {conversations}"


@query(_PLACED, f"""WITH {_TURNS}, p AS (SELECT *, starts_with(content, 'Context summary (rolling):') AS is_summary, turn_id = 0 OR (turn_id = 1 AND role = 'user') AS anchor FROM u)
    SELECT conv_id, turn, is_summary, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN is_summary THEN 1 WHEN anchor THEN 0 ELSE 2 END, turn) - 1 AS place FROM p""")
def summary_placement(m: DataFrame) -> DataFrame:
    """Summary blocks move behind the anchor."""
    m = Z.with_turns(m).withColumn("is_summary", C("content").startswith("Context summary (rolling):"))
    anchor = (C("turn_id") == 0) | ((C("turn_id") == 1) & (C("role") == "user"))
    key = F.when(C("is_summary"), 1).when(anchor, 0).otherwise(2)
    return m.select("conv_id", "turn", "is_summary", (F.row_number().over(Window.partitionBy("conv_id").orderBy(key, "turn")) - 1).cast("long").alias("place"))


_CHAIN = "sha256(string_agg(role || chr(1) || content, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn))"


@query(MESSAGES, f"WITH h AS (SELECT *, {_CHAIN} AS chain FROM src) SELECT conv_id, turn, chain, coalesce(lag(chain) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prefix_chain FROM h")
def content_hash_chain(m: DataFrame) -> DataFrame:
    """The hash of each prefix beside that of the prefix before: a request whose prefix is unchanged has its predecessor's."""
    w = Z.in_order()
    sofar = F.collect_list(F.concat("role", F.lit("\x01"), "content")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    h = m.select("conv_id", "turn", F.sha2(F.array_join(sofar, "\x02"), 256).alias("chain"))
    return h.withColumn("prefix_chain", F.coalesce(F.lag("chain").over(w), F.lit("")))


@query(MESSAGES, """WITH r AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS n, conv_id % 4 = 0 AND turn = 1 AS changed FROM src),
    f AS (SELECT conv_id, min(turn) FILTER (WHERE changed) AS first_change, any_value(n) AS n FROM r GROUP BY conv_id)
    SELECT conv_id, least(coalesce(first_change, n - 1), n - 1) AS stable_messages, n + 1 - least(coalesce(first_change, n - 1), n - 1) AS live_messages FROM f""")
def live_zone_split(m: DataFrame) -> DataFrame:
    """The messages that equal the previous request's, up to the first that differs; the rest is live. The previous request here lacks the last two messages, and message 1 of every fourth conversation."""
    before = m.where(~((C("conv_id") % 4 == 0) & (C("turn") == 1))).withColumn("n", F.max("turn").over(Z.conv())).select("conv_id", "turn", F.sha2(F.concat_ws("|", "role", "content"), 256).alias("old"))
    last = F.max("turn").over(Z.conv())
    j = m.withColumn("last", last).join(before, ["conv_id", "turn"], "left")
    same = (C("old") == F.sha2(F.concat_ws("|", "role", "content"), 256)) & (C("turn") < C("last") - 1)
    first = F.min(F.when(~F.coalesce(same, F.lit(False)), C("turn")))
    return j.groupBy("conv_id").agg(first.alias("stable_messages"), F.max("turn").alias("n")).select("conv_id", "stable_messages", (C("n") + 1 - C("stable_messages")).alias("live_messages"))


@query(TRACES, """WITH p AS (SELECT *, lag(prompt_tokens) OVER (PARTITION BY session_id ORDER BY turn) AS last FROM src)
    SELECT session_id, turn, CASE WHEN last IS NOT NULL AND last - prompt_tokens > greatest(floor(last * 0.15::DOUBLE), 1500) THEN 'previous' ELSE 'new' END AS emitted FROM p""")
def finalise_guard(t: DataFrame) -> DataFrame:
    """An output that shrank by more than the cap is replaced by the previous one with the new suffix."""
    p = t.withColumn("last", F.lag("prompt_tokens").over(Window.partitionBy("session_id").orderBy("turn")))
    return p.select("session_id", "turn", F.when(C("last") - C("prompt_tokens") > K.shrink_cap(K.Budget(), C("last")), "previous").otherwise("new").alias("emitted"))


@query(STEPS, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step_index DESC) AS k FROM src) SELECT conv_id, step_index, CASE WHEN k <= 5 THEN 'recent' ELSE 'archived' END AS age FROM r WHERE k <= 20")
def state_prune(s: DataFrame) -> DataFrame:
    """The last 20 steps of a session stay; of these, five are recent."""
    kept = Z.newest(s, 20, order="step_index")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("step_index")))
    return kept.select("conv_id", "step_index", F.when(k <= 5, "recent").otherwise("archived").alias("age"))


@query(MESSAGES, f"""WITH {_TURNS}, b AS (SELECT *, turn_id <= 1 AS frozen, starts_with(content, 'Context summary') AS is_summary FROM u)
    SELECT conv_id, max(turn) FILTER (WHERE frozen OR is_summary) AS stable_end, count(*) FILTER (WHERE NOT frozen) AS volatile FROM b GROUP BY conv_id""")
def stable_prefix(m: DataFrame) -> DataFrame:
    t = Z.with_turns(m)
    return t.groupBy("conv_id").agg(F.max(F.when((C("turn_id") <= 1) | C("content").startswith("Context summary"), C("turn"))).alias("stable_end"), F.count_if(C("turn_id") > 1).alias("volatile"))


@query(MESSAGES, f"""WITH {_evict(_zones(1), _RESERVED.format(budget=600), 1.0, 0, 'room <= 0')}, t2 AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM k),
    q AS (SELECT *, total <= 600 OR kept AS stays FROM t2), h AS (SELECT *, zone = 'tail' AS in_tail, coalesce(sum(tokens) FILTER (WHERE stays) OVER (PARTITION BY conv_id), 0) AS left_over,
        coalesce(sum(tokens) FILTER (WHERE stays AND zone = 'tail') OVER (PARTITION BY conv_id), 0) AS tail, coalesce(sum(tokens) FILTER (WHERE stays AND zone <> 'tail') OVER (PARTITION BY conv_id ORDER BY turn), 0) AS head FROM q)
    SELECT conv_id, turn, stays AND (left_over <= 600 OR in_tail OR head <= 600 - tail) AS kept FROM h""")
def trim_composed(m: DataFrame) -> DataFrame:
    """Under budget: unchanged; else evict from the body, and if that isn't enough, pack the front beside the tail."""
    k = Z.evicted(Z.zoned(m, keep=1), 600, reserve=True).withColumn("stays", (F.sum("tokens").over(Z.conv()) <= 600) | C("kept"))
    of = lambda cond, w: F.coalesce(F.sum(F.when(C("stays") & cond, C("tokens"))).over(w), F.lit(0))
    running = Z.in_order().rowsBetween(Window.unboundedPreceding, 0)
    fits = (of(F.lit(True), Z.conv()) <= 600) | (C("zone") == "tail") | (of(C("zone") != "tail", running) <= 600 - of(C("zone") == "tail", Z.conv()))
    return k.select("conv_id", "turn", (C("stays") & fits).alias("kept"))


@query(MESSAGES, "SELECT conv_id, bool_or(length(content) > 1000) AS has_large, bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) AS has_other, bool_and(role <> 'tool') AND sum(length(content)) < 4000 AS lean FROM src GROUP BY conv_id")
def eligibility(m: DataFrame) -> DataFrame:
    roles = C("role").isin("system", "user", "assistant", "tool")
    return m.groupBy("conv_id").agg(F.bool_or(F.length("content") > 1000).alias("has_large"), F.bool_or(~roles).alias("has_other"), (F.bool_and(C("role") != "tool") & (F.sum(F.length("content")) < 4000)).alias("lean"))


@query(MESSAGES, "SELECT conv_id, string_agg(role || ':' || content, chr(10) ORDER BY turn) FILTER (WHERE turn < 2) AS head, string_agg(role || ':' || content, chr(10) ORDER BY turn) FILTER (WHERE turn >= 2) AS rest, string_agg(role || ':' || content, chr(10) ORDER BY turn) AS merged FROM src GROUP BY conv_id")
def split_merge(m: DataFrame) -> DataFrame:
    part = F.concat("role", F.lit(":"), "content")
    head, rest = m.where("turn < 2").groupBy("conv_id").agg(ordered_join(part).alias("head")), m.where("turn >= 2").groupBy("conv_id").agg(ordered_join(part).alias("rest"))
    return head.join(rest, "conv_id", "left").withColumn("merged", F.concat_ws("\n", "head", "rest"))


@query(MESSAGES, f"WITH {_TURNS}, e AS (SELECT conv_id, turn_id, sum(tokens) AS size, max(sum(tokens)) OVER (PARTITION BY conv_id) AS largest FROM u GROUP BY conv_id, turn_id) SELECT conv_id, min(turn_id) AS biggest_turn, max(size)::BIGINT AS size FROM e WHERE size = largest GROUP BY conv_id")
def biggest_turn(m: DataFrame) -> DataFrame:
    t = Z.with_tokens(Z.with_turns(m)).groupBy("conv_id", "turn_id").agg(F.sum("tokens").alias("size"))
    return t.groupBy("conv_id").agg(F.max_by("turn_id", F.struct("size", -C("turn_id"))).alias("biggest_turn"), F.max("size").alias("size"))


@query(MESSAGES, "SELECT conv_id, turn, CASE WHEN length(content) > 200 THEN substr(sha256(content), 1, 16) END AS handle FROM src")
def message_handles(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", F.when(F.length("content") > 200, T.handle(C("content"))).alias("handle"))
