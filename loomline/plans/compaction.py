"""The composed pipeline: messages in, compacted messages out, as one chain of DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import lines as L
from loomline.operators import summary as S
from loomline.operators import zones as Z
from loomline.operators.code import code_blocks, signatures, without_repeated_blocks

C = F.col


def compact_conversations(m: DataFrame, budget: int = 12_000, keep: int = 1, tool_chars: int = 4000, paste_chars: int = 8000, ledger: bool = True) -> DataFrame:
    """conv_id, place, role, content, synthetic of what is sent.

    Boundary transforms run on every message; then, on one exchange by conv_id, tool outputs seen before become
    placeholders, code blocks repeated in a message go, and zones and eviction follow. Of what is evicted, a ledger of code
    signatures and a rolling summary (pinned facts and the extracted state, within the summary's budget) stay, the
    summary behind the anchor; the quality anchor comes last, as one user message, with a warning of repeated outputs.
    The inflation guard keeps these, in that order of worth, only as far as the output isn't larger than the input.
    """
    clean = m.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("__before", F.length(F.coalesce("content", F.lit(""))))
    bounded = clean.withColumn("content", L.boundary(C("content"), C("role"), tool_chars, paste_chars, T.masked))
    last = C("turn") == F.max(F.when(C("role") == "user", C("turn"))).over(Z.conv())
    tidy = bounded.withColumn("content", F.when((C("role") == "user") & last, T.outside_fences(C("content"), T.canonical)).when(C("content").contains("```"), without_repeated_blocks(C("content"))).otherwise(C("content")))
    tidy = L.deduplicated(tidy, C("role") == "tool").withColumnRenamed("duplicate", "__duplicate")
    kept = Z.evicted(Z.zoned(tidy, keep=keep), budget, low=0.8, reserve=True)
    stays = kept.where("kept").select("conv_id", C("turn").cast("double").alias("at"), "role", "content", F.lit("").alias("synthetic"))
    gone = kept.where("not kept")
    first_request = F.min_by("content", F.when(C("role") == "user", C("turn")))
    sizes = kept.groupBy("conv_id").agg(
        F.sum("__before").alias("before"), F.sum(F.when(C("kept"), F.length("content")).otherwise(0)).alias("after"), F.max("turn").alias("end"), F.min(F.when(C("role") == "user", C("turn"))).alias("start"),
        T.compact(first_request, 300).alias("request"), T.compact(first_request, 500).alias("facts"), F.count_if("__duplicate").alias("repeats"), F.count_distinct(F.when(~C("kept"), C("turn_id"))).alias("folded"),
    )
    part = lambda worth, at, role, text, name: [F.lit(worth).alias("worth"), at.cast("double").alias("at"), F.lit(role).alias("role"), text.alias("content"), F.lit(name).alias("synthetic")]
    parts = []
    if ledger:
        sigs = gone.select("conv_id", "turn", F.explode(code_blocks(C("content"))).alias("b")).select("conv_id", "turn", F.explode(signatures(C("b.body"))).alias("sig"))
        first = sigs.groupBy("conv_id", "sig").agg(F.min("turn").alias("first"))
        k = first.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "sig"))).where("k <= 40")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sig"))), lambda s: s["sig"]), "\n")
        parts.append(k.groupBy("conv_id").agg(body.alias("c")).select("conv_id", *part(1, F.lit(0.5), "system", F.concat(F.lit("[Evicted-turn code index]\n"), "c"), "ledger")))
    warning = F.when(C("repeats") > 1, F.concat(F.lit("\nWarning: tool outputs came again "), C("repeats").cast("string"), F.lit(" times"))).otherwise("")
    anchor = F.concat(F.lit("# Conversation Quality Anchor\nOriginal request:\n"), "request", warning)
    parts.append(sizes.where(C("request").isNotNull() & (C("after") < C("before"))).select("conv_id", *part(2, C("end") + 1, "user", T.balanced_fences(anchor), "anchor")))
    state = S.state_of(gone.select("conv_id", "turn", "role", "content")).where("state <> ''").join(sizes.where("folded > 0"), "conv_id")
    block = S.block_text(C("facts"), F.array(S.truncated(C("state"), S.budget(C("folded")))))
    parts.append(state.select("conv_id", *part(3, F.coalesce(C("start"), F.lit(0)) + 0.3, "system", block, "summary")))
    added = parts[0]
    for p in parts[1:]:
        added = added.unionByName(p)
    so_far = F.sum(F.length("content")).over(Window.partitionBy("conv_id").orderBy("worth"))
    added = added.join(sizes.select("conv_id", (C("before") - C("after")).alias("room")), "conv_id").withColumn("so_far", so_far).where("so_far <= room")
    out = stays.unionByName(added.select("conv_id", "at", "role", "content", "synthetic"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "synthetic")) - 1
    return out.select("conv_id", place.alias("place"), "role", "content", "synthetic")
