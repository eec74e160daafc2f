"""Summaries of old turns: what is kept of them, and when they are folded."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.core import any_of, lines
from loomline.operators import zones as Z
from loomline.operators.code import code_blocks, signatures

C = F.col

# Marker of a summary block, hints of constraints, beginnings of plans, errors and file paths.
# The error and path patterns say what is evidently meant (the first names failures, the second a quoted or bare path).
MARKER = "Context summary (rolling):"
CONSTRAINTS = ["don't", "do not", "must not", "avoid", "never"]
PLAN = r"(?i)^(i\s+will|next,|let's|now\s+we|the\s+plan|step\s*\d)"
ERROR = r"(?i)error|exception|traceback|failed|failure|assert|raised?|\b\d{3}\b\s*(?:forbidden|not\s*found)|module\s+not\s+found|no\s+such\s+file"
PATH = r"((?:(?<![\w/:])/)?(?<![\w.\-])(?:[\w.\-]+/)+[\w.\-]+\.\w{1,6}|(?<=[\"'`])[\w.\-]+\.\w{1,6}(?=[\"'`]))"


def is_summary(content: Column) -> Column:
    return content.startswith(MARKER)


def budget(folded_turns: Column, ceiling: int = 12_000, base: int = 1500, per_turn: int = 120) -> Column:
    return F.least(F.lit(ceiling), F.lit(base) + per_turn * folded_turns).cast("long")


def truncated(text: Column, room_tokens: Column) -> Column:
    """text cut to four characters per token of room."""
    return F.when(F.length(text) <= 4 * room_tokens, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), (4 * room_tokens).cast("int"))), F.lit(" …")))


def state_of(old: DataFrame) -> DataFrame:
    """conv_id and the extracted state of the messages (conv_id, turn, role, content): files, code, errors, plans, constraints and topics.

    One pass: each message gives arrays of what it has, a session's arrays are joined in order, made distinct and cut.
    """
    trimmed = F.transform(lines(C("content")), lambda x: F.trim(x))
    sized = lambda lo, hi: lambda x: (F.length(x) > lo) & (F.length(x) < hi)
    no_code = F.regexp_replace("content", r"(?s)```.*?```", "")
    sentences = F.filter(F.transform(F.split(no_code, "[.?!]"), lambda x: F.trim(x)), sized(12, 160))
    none = F.array().cast("array<string>")
    blocks = F.transform(F.filter(code_blocks(C("content")), lambda b: (F.trim(b["body"]) != "") & (F.length(b["body"]) <= 1500)), lambda b: F.concat(F.lit("```"), F.when(F.trim(b["tag"]) == "", "text").otherwise(F.trim(b["tag"])), F.lit("\n"), F.trim(b["body"], F.lit("\n")), F.lit("\n```")))
    parts = {
        "files": F.filter(F.regexp_extract_all("content", F.lit(PATH), F.lit(1)), lambda x: F.length(x) < 120),
        "code": blocks,
        "errors": F.when(C("role").isin("tool", "assistant"), F.filter(trimmed, lambda x: sized(8, 240)(x) & x.rlike(ERROR))).otherwise(none),
        "plans": F.when(C("role") == "assistant", F.filter(trimmed, lambda x: sized(12, 200)(x) & x.rlike(PLAN))).otherwise(none),
        "rules": F.filter(trimmed, lambda x: sized(12, 200)(x) & any_of(F.lower(x).contains(w) for w in CONSTRAINTS)),
        "topics": F.when(C("role") == "user", F.slice(sentences, 1, 1)).otherwise(none),
    }
    rows = old.select("conv_id", "turn", *[v.alias(k) for k, v in parts.items()])
    ordered = lambda k: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", C(k).alias("v")))), lambda s: s["v"])))
    s = rows.groupBy("conv_id").agg(*[ordered(k).alias(k) for k in parts])
    first = lambda k, n: F.slice(k, 1, n)
    last = lambda k, n: F.slice(k, F.greatest(F.size(k) - n + 1, F.lit(1)), F.lit(n))
    line = lambda head, arr, sep: F.when(F.size(arr) > 0, F.concat(F.lit(head), F.array_join(arr, sep)))
    text = F.concat_ws("\n", line("Files touched: ", first("files", 10), ", "), line("Code:\n", last("code", 6), "\n"), line("Last errors: ", first("errors", 3), " | "), line("Plan: ", first("plans", 3), " "), line("Constraints: ", first("rules", 6), "; "), line("Topic: ", first("topics", 2), "; "))
    return s.select("conv_id", text.alias("state"))


def old_turn_summary(m: DataFrame, keep: int) -> DataFrame:
    """Of conversations whose messages after the first user message are more than keep: facts and signatures of those before the last keep."""
    t = Z.with_turns(m)
    anchor = (C("turn_id") == 0) | ((C("turn_id") == 1) & (C("role") == "user"))
    rest = t.where(~anchor).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(C("k") > keep)
    fact = F.trim(F.substring_index("content", ".", 1))
    facts = F.when((C("role") == "user") & (F.length(fact) > 10) & (F.length(fact) < 200), fact)
    sigs = F.nullif(F.array_join(F.flatten(F.transform(code_blocks(C("content")), lambda b: signatures(b["body"]))), " "), F.lit(""))
    in_order = lambda c: F.slice(F.transform(F.array_sort(F.filter(F.collect_list(F.when(c.isNotNull(), F.struct("turn", c.alias("v")))), lambda s: s.isNotNull())), lambda s: s["v"]), 1, 3)
    s = rest.groupBy("conv_id").agg(in_order(facts).alias("facts"), in_order(sigs).alias("sigs"))
    line = lambda head, arr: F.when(F.size(arr) > 0, F.concat(F.lit(head), F.array_join(arr, "; ")))
    return s.select("conv_id", F.concat_ws("\n", F.lit("[Previous conversation summary]"), line("Key topics: ", "facts"), line("Code discussed: ", "sigs")).alias("summary"))


@dataclass(frozen=True)
class Fold:
    """Options of the rolling fold: turns kept in full, first target, growth that triggers the next fold, and the summary's budget."""

    keep: int = 3
    target: int = 3000
    growth: int = 8192
    base: int = 1500
    per_turn: int = 120
    ceiling: int = 12_000
    per_fold: int = 60


def rolling_fold(turns: DataFrame, options: Fold) -> DataFrame:
    """turns: conv_id, turn_id, tokens. For each request (the turns so far): folded turns, summary tokens, emitted tokens.

    A true recursion: whether a turn is folded depends on the size after the last fold. Only numbers are folded, a row
    per turn; the texts stay where they are and are joined by the folded count.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn_id")
        sizes = pdf["tokens"].tolist()
        folded = summary = live = 0
        after: int | None = None
        out = []
        for n, size in enumerate(sizes, 1):
            live += size
            target = options.target if after is None else after
            if n - folded > options.keep and live + summary > (options.target if after is None else after + options.growth):
                while n - folded > options.keep and live + summary > target:
                    room = min(options.ceiling, options.base + options.per_turn * folded)
                    if summary + options.per_fold > room:
                        break
                    live -= sizes[folded]
                    summary += options.per_fold
                    folded += 1
                after = live + summary
            out.append((folded, summary, live + summary))
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "turn_id": pdf["turn_id"].to_numpy(), "folded": [x[0] for x in out], "summary_tokens": [x[1] for x in out], "emitted_tokens": [x[2] for x in out]})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn_id long, folded long, summary_tokens long, emitted_tokens long")


def block_text(facts: Column, texts: Column) -> Column:
    """A rolling block: marker, pinned facts, then what each fold appended, in order."""
    return F.array_join(F.concat(F.array(F.lit(MARKER)), F.when(facts.isNotNull(), F.array(F.concat(F.lit("Key facts (from original request): "), facts))).otherwise(F.array().cast("array<string>")), texts), "\n")


def pinned(m: DataFrame) -> DataFrame:
    """The first request of each conversation, compacted to 500 characters."""
    first = F.min_by("content", F.when(C("role") == "user", C("turn")))
    return m.groupBy("conv_id").agg(T.compact(first, 500).alias("facts"))
