"""Line analytics of tool outputs: filter rules, run collapse, error-aware extraction, truncation.

Everything is a per-row expression over the array of a text's lines: no shuffle, so one huge log is one row's work and
logs never mix. Positions are found first (where runs or blocks begin), then lines are sliced, which is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.core import any_of, indexes, let, lines, unlines
from loomline.functions.text import handle

# Words and frames that tell a failure, lines that tell an outcome, and noise.
FAILURE = r"(?i)\b(errors?|failed|failures?|panic|fatal|traceback|exceptions?|assert(?:ion)?error|unresolved|cannot|could not|no such|not found|permission denied|segfault|aborted|expected\b.*\bgot\b)\b|^[✗✘❌]|^(FAIL|ERROR|PANIC|FATAL)\b"
FRAME = r'^\s*File\s+"[^"]+",\s*line\s+\d+|\bat\s+\S+\s+\(?[\w./\\-]+:\d+[:\d]*\)?|^\s*[\w./\\-]+\.\w+:\d+(:\d+)?\b|^\s*[\w./\\-]+:\d+:\d+:'
STACK_FRAME = r'^\s*File\s+"[^"]+",\s*line\s+\d+,\s*in\s+\S+'
OUTCOME = r"(?i)\d+\s+(passed|failed|errors?|skipped|ignored|warnings?)|test result:|build (succeeded|failed|complete)|found \d+ (errors?|warnings?)|=+\s.*(pass|fail|error|summary).*\s=+"
NOISE = r"(?i)^\s*(?:\.{2,}|\[?\s*\d+%\]?|ok\b.*\d+(?:\.\d+)?s|running\b.*|collecting\b.*|[-_=]{3,}|)\s*$"
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
# The filter's rules in order. Those that need a failure word can't fire, as failures pass unfiltered;
# the rule for repeated lines is left out, as run collapse does what it means. A rule only has to fit somewhere, so
# what may stand repeatedly (test lines, log lines, lines of a diff's statistics) stands once here.
RULES = [
    (r"(?im)^(ok\s+\S+\s+[\d.]+s|\?\s+\S+\s+\S+|FAIL\s+\S+)", "[go test result]"),
    (r"(?im)^(=+ .+ =+$)\n.*?(\d+ passed|passed).*?(\d+ failed|failed).*?(\d+ error|error).*?(\d+ skipped|skipped)", "[pytest summary]"),
    (r"(?im)^(.*?\[100%\]|.*?passed.*?failed.*?)$", "[pytest result]"),
    (r"(?im)^(test result: ok\. \d+ passed; \d+ failed; \d+ ignored; \d+ measured; \d+ filtered out)", "[cargo test result]"),
    (r"(?im)^(Tests:\s+\d+\s+passed,\s+\d+\s+failed,\s+\d+\s+total)", "[npm test result]"),
    (r"(?im)^On branch \S+[\s\S]*?(?:Changes to be committed|Changes not staged for commit|nothing to commit|Untracked files)", "[git status]"),
    (r"(?im)^[0-9a-f]{7,40}\s+.*?\n", "[git log]"),
    (r"(?im)^(.*?\|.*?\n)(\d+ files? changed.*)$", "[git diff stat]"),
    (r"(?im)^(Build succeeded|Build complete|Compilation succeeded|Finished \w+ \[.+\] in \d+\.\d+s)", "[build success]"),
    (r"(?im)^(error(?:\[[\w\s]+\])?:.*?)$", "[build error]"),
    (r"(?im)^(Found \d+ (error|warning)s?.*?)$", "[lint summary]"),
    (r"(?im)^(Command finished successfully|Process completed|Done\.|Done in \d+\.\d+s)", "[shell ok]"),
]
AWARE = "... [error-aware compressed:"
TRUNCATED = "... [tool output truncated:"


def per_line(pattern: str) -> str:
    """A line pattern as one for a whole text."""
    return f"(?m){pattern}" if not pattern.startswith("(?i)") else f"(?im){pattern[4:]}"


def failure_signal(text: Column) -> Column:
    return text.rlike(per_line(FAILURE)) | text.rlike(per_line(FRAME))


def filtered(text: Column, rules: list[tuple[str, str]] | None = None, least: int = 200) -> Column:
    """The marker of the first rule that fits a long text without failure; else the text."""
    out = text
    for pattern, marker in reversed(RULES if rules is None else rules):
        out = F.when(text.rlike(pattern), F.lit(marker)).otherwise(out)
    return F.when((F.length(text) < least) | failure_signal(text), text).otherwise(out)


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), ANSI, "")


def collapsed_runs(text: Column) -> Column:
    """Runs of three or more equal lines that aren't empty: the line, and how often it stood."""

    def body(ls: Column) -> Column:
        starts = F.filter(indexes(ls), lambda i: (i == 1) | (ls[i - 1] == "") | (ls[i - 1] != F.get(ls, i - 2)))
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(ls) + 1))
        note = lambda n: F.concat(F.lit("... (repeated "), n.cast("string"), F.lit(" times) ..."))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.when(e - s >= 3, F.array(ls[s - 1], note(e - s))).otherwise(F.slice(ls, s, e - s))))

    return unlines(let(lines(text), body))


def collapsed_frames(text: Column) -> Column:
    """Contiguous blocks of stack frames: the first of its kind is kept, later ones become a note."""

    def body(ls: Column) -> Column:
        frame = lambda i: F.coalesce(F.get(ls, i - 1).rlike(STACK_FRAME), F.lit(False))
        starts = F.filter(indexes(ls), lambda i: ~frame(i) | (i == 1) | ~frame(i - 1))
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(ls) + 1))
        blocks = F.zip_with(starts, ends, lambda s, e: F.struct(F.slice(ls, s, e - s).alias("ls"), frame(s).alias("frame")))
        note = lambda b: F.array(F.concat(F.lit("... (stack frame block repeated; omitted "), F.size(b["ls"]).cast("string"), F.lit(" lines) ...")))
        first = lambda bs: F.transform(bs, lambda b, i: F.when(b["frame"] & (F.array_position(bs, b) <= i), note(b)).otherwise(b["ls"]))
        return F.flatten(let(blocks, first))

    return F.when(text.rlike(per_line(STACK_FRAME)), unlines(let(lines(text), body))).otherwise(text)


def error_aware(text: Column, most: int) -> Column:
    """Of a text with an outcome: the verdict alone if nothing failed, else head, tail and diagnostics with context. Null without an outcome."""

    def success(ls: Column) -> Column:
        verdict = F.trim(F.element_at(F.filter(ls, lambda x: x.rlike(OUTCOME)), 1))
        return F.concat(verdict, F.lit(f"\n{AWARE} success collapsed "), F.length(text).cast("string"), F.lit(" -> ~"), F.length(verdict).cast("string"), F.lit(" chars] ..."))

    def failure(ls: Column) -> Column:
        n = F.size(ls)
        kinds = F.transform(ls, lambda x: F.struct(x.alias("x"), x.rlike(FRAME).alias("frame"), (x.rlike(FAILURE) | x.rlike(OUTCOME)).alias("word"), x.rlike(NOISE).alias("noise")))

        def kept(ks: Column) -> Column:
            hit = lambda i, only_frame=False: F.coalesce(F.get(ks, i)["frame"] if only_frame else F.get(ks, i)["frame"] | F.get(ks, i)["word"], F.lit(False))
            near = lambda i: (i < 4) | (i >= n - 4) | hit(i) | hit(i + 1) | hit(i - 1) | hit(i - 2, True)
            noisy = lambda i: ks[i]["noise"] & ~ks[i]["word"]
            places = F.filter(F.transform(indexes(ls), lambda i: i - 1), lambda i: near(i) & ~noisy(i))
            gapped = lambda ps: F.flatten(F.transform(ps, lambda i, k: F.when((k > 0) & (i != F.get(ps, k - 1) + 1), F.array(F.lit("..."), ks[i]["x"])).otherwise(F.array(ks[i]["x"]))))
            return unlines(let(places, gapped))

        def capped(out: Column) -> Column:
            short = F.concat(out, F.lit(f"\n{AWARE} "), F.length(text).cast("string"), F.lit(" -> "), F.length(out).cast("string"), F.lit(" chars] ..."))
            long = F.concat(F.substring(out, 1, most), F.lit(f"\n{AWARE} capped at {most} chars] ..."))
            return F.when(F.length(out) > most, long).when(F.length(out) < F.length(text), short).otherwise(out)

        return let(let(kinds, kept), capped)

    # the signal is sought in the whole text first; only texts that have it are classified line by line
    whole = lambda ls: F.when(failure_signal(text), failure(ls)).otherwise(success(ls))
    return F.when(text.contains(AWARE), text).when(text.rlike(per_line(OUTCOME)), let(lines(text), whole))


def head_tail(text: Column, most: int, head: float = 0.6) -> Column:
    first = int(most * head)
    cut = F.concat(F.substring(text, 1, first), F.lit(f"\n{TRUNCATED} "), (F.length(text) - most).cast("string"), F.lit(" chars omitted] ...\n"), F.right(text, F.lit(most - first)))
    return F.when((F.length(text) <= most) | text.contains(TRUNCATED), text).otherwise(cut)


def compressed(text: Column, most: int = 4000, head: float = 0.6) -> Column:
    """The composed form, for texts above most characters: ANSI, frames, runs, error-aware extraction or truncation."""
    shorten = lambda t: F.coalesce(error_aware(t, most), head_tail(t, most, head))
    return F.when(F.length(text) <= most, text).otherwise(let(collapsed_runs(collapsed_frames(without_ansi(text))), shorten))


def boundary(text: Column, role: Column, most: int = 4000, paste: int = 8000, mask=None) -> Column:
    """What a message goes through at the boundary: tool and assistant outputs are filtered, compressed and (tools) masked, long user pastes compressed."""
    tool = let(filtered(text), lambda t: compressed(t, most))
    if mask is not None:
        tool = F.when(role == "tool", let(tool, mask)).otherwise(tool)
    return F.when(role.isin("tool", "assistant"), tool).when(role == "user", compressed(text, paste)).otherwise(text)


def packed(text: Column, most: int) -> Column:
    """Lines packed greedily into chunks of at most most characters, newlines not counted; a longer line is a chunk."""

    def step(acc: Column, line: Column) -> Column:
        fits = acc["n"] + F.length(line) <= most
        start = acc["open"] == 0
        return F.when(start, F.struct(acc["done"].alias("done"), line.alias("cur"), F.length(line).alias("n"), F.lit(1).alias("open"))).when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit("\n"), line).alias("cur"), (acc["n"] + F.length(line)).alias("n"), F.lit(1).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), line.alias("cur"), F.length(line).alias("n"), F.lit(1).alias("open")))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("open"))
    return F.aggregate(lines(text), zero, step, lambda a: F.when(a["open"] == 1, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def any_line(text: Column, patterns: list[str]) -> Column:
    return any_of(text.rlike(per_line(p)) for p in patterns)


def deduplicated(m: DataFrame, of: Column | None = None, least: int = 200) -> DataFrame:
    """conv_id, turn, content and more: a long output (of: which rows are) seen before in its session becomes a placeholder with the original's handle. Adds duplicate."""
    of = F.lit(True) if of is None else of
    k = F.row_number().over(Window.partitionBy("conv_id", F.sha2("content", 256), of).orderBy("turn"))
    text = F.col("content")
    note = F.concat(F.lit("[original retained: handle="), handle(text), F.lit(", "), F.length(text).cast("string"), F.lit(" chars; duplicate output]"))
    return m.withColumn("duplicate", of & (k > 1) & (F.length(text) >= least)).withColumn("content", F.when(F.col("duplicate"), note).otherwise(text))
