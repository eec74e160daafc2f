"""Canonical forms, hashes and small rewrites of message text, as column expressions.

Word characters, digits and spaces in patterns are ASCII. Patterns use neither look-around nor back-references.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.core import any_of, indexes, let, lines, sha16, unlines

FENCE = "```"

# The words that tell a task's class, in the order in which classes win ties.
TASK_WORDS = {
    "debug": ["error", "bug", "fix", "crash", "exception", "traceback", "fail", "broken"],
    "refactor": ["refactor", "clean", "simplify", "restructure", "optimize", "improve"],
    "feature": ["add", "implement", "create", "build", "new", "feature"],
    "test": ["test", "unit", "spec", "coverage", "assert"],
    "doc": ["document", "docstring", "comment", "explain", "readme"],
}
# Hints that seed the reasoning of a long prompt.
TASK_HINTS = {
    "debug": "Analyze the error, identify root cause, propose fix.",
    "refactor": "Review structure, identify improvements, implement changes.",
    "feature": "Plan implementation, write code, verify correctness.",
    "test": "Identify test cases, write tests, check coverage.",
    "default": "Analyze context, plan approach, implement solution.",
}
# Fields that vary between turns, and what stands for them, in order.
VOLATILE = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "[TIMESTAMP]"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[UUID]"),
    (r"\b[0-9a-f]{7,40}\b", "[SHA]"),
]


def canonical(text: Column) -> Column:
    """Unix line ends, no blanks at line ends, at most one empty line in a row."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), "\n{3,}", "\n\n")


def outside_fences(text: Column, change) -> Column:
    """change applied to every part between code fences; fenced parts stay."""
    parts = F.split(text, FENCE)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(p)), FENCE)


def sorted_imports(text: Column) -> Column:
    """The leading run of import lines, then the run of from lines, each sorted; the rest as it is."""

    def body(ls: Column) -> Column:
        def run(start: Column, word: str) -> Column:
            stop = F.array_min(F.filter(F.transform(indexes(ls), lambda i: F.when((i > start) & ~F.ltrim(ls[i - 1]).startswith(word), i)), lambda i: i.isNotNull()))
            return F.coalesce(stop, F.size(ls) + 1)

        def rest(first: Column) -> Column:
            return let(run(first - 1, "from "), lambda second: F.concat(F.array_sort(F.slice(ls, F.lit(1), first - 1)), F.array_sort(F.slice(ls, first, second - first)), F.slice(ls, second, F.size(ls) - second + 1)))

        return let(run(F.lit(0), "import "), rest)

    return unlines(let(lines(text), body))


def code_key_text(text: Column) -> Column:
    """Code as it enters a cache key: no blanks at line ends; the leading block of imports sorted, without its comments and empty lines."""

    def body(ls: Column) -> Column:
        trimmed = lambda line: F.trim(line)
        head = lambda t: t.startswith("import ") | t.startswith("from ") | t.startswith("#") | (t == "")
        stop = F.coalesce(F.array_min(F.filter(F.transform(ls, lambda line, i: F.when(~head(trimmed(line)), i + 1)), lambda i: i.isNotNull())), F.size(ls) + 1)

        def cut(n: Column) -> Column:
            block = F.slice(ls, F.lit(1), n - 1)
            of = lambda word: F.transform(F.array_sort(F.transform(F.filter(block, lambda x: F.trim(x).startswith(word)), lambda x: F.struct(F.trim(x).alias("k"), x.alias("v")))), lambda s: s["v"])
            return F.concat(of("import "), of("from "), F.slice(ls, n, F.size(ls) - n + 1))

        return let(stop, cut)

    return unlines(let(F.transform(lines(text), lambda x: F.rtrim(x)), body))


def prompt_part(role: Column, content: Column) -> Column:
    """role:content with runs of blanks and of empty lines shortened."""
    return F.concat(role, F.lit(":"), F.regexp_replace(F.regexp_replace(content, "[ \t]+", " "), "\n{3,}", "\n\n"))


def padded(text: Column, block: int = 128) -> Column:
    """text with newlines up to a multiple of block characters."""
    return F.concat(text, F.repeat(F.lit("\n"), F.pmod(F.lit(block) - F.length(text) % block, F.lit(block)).cast("int")))


def task_class(text: Column) -> Column:
    """The class with most words contained in text; the first of equals; default if none."""
    low = F.lower(text)
    scores = [sum((low.contains(w).cast("int") for w in ws), F.lit(0)) for ws in TASK_WORDS.values()]
    best = F.greatest(*scores)
    out = F.lit("default")
    for name, score in reversed(list(zip(TASK_WORDS, scores, strict=True))):
        out = F.when((best > 0) & (score == best), name).otherwise(out)
    return out


def template_version(task: Column) -> Column:
    return (F.conv(F.substring(F.md5(task), 1, 8), 16, 10).cast("long") % 1000).cast("int")


def partition_key(task: Column, static: Column) -> Column:
    return F.concat_ws(":", task, template_version(task).cast("string"), F.substring(F.md5(static), 1, 8))


def header_safe(text: Column) -> Column:
    """Typographic quotes, dashes and spaces folded to ASCII, then nothing above U+00FF."""
    folded = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.regexp_replace(F.regexp_replace(folded, "…", "..."), r"[^\x00-\xFF]", "")


def without_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>|<thinking>.*?</thinking>", ""))


def code_placeholder(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "[code block]")


def balanced_fences(text: Column) -> Column:
    """text with a closing fence if its line-start fences are odd in number."""
    odd = F.regexp_count(text, F.lit(r"(?m)^[ \t]*```")) % 2 == 1
    return F.when(odd, F.concat(text, F.when(text.endswith("\n"), "").otherwise("\n"), F.lit(FENCE))).otherwise(text)


def compact(text: Column, most: int) -> Column:
    """White space collapsed, cut to most characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def masked(text: Column) -> Column:
    for pattern, mark in VOLATILE:
        text = F.regexp_replace(text, pattern, mark)
    return text


def spaces_for_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit("    "))


def section_markers(text: Column) -> Column:
    """A marker line before each definition within fences."""

    def body(ls: Column) -> Column:
        def mark(line: Column, i: Column) -> Column:
            inside = F.size(F.filter(F.slice(ls, F.lit(1), i), lambda x: F.trim(x).startswith(FENCE))) % 2 == 1
            t = F.trim(line)
            name = F.when(t.startswith("class "), F.concat(F.lit("# SECTION: class "), F.regexp_extract(t, r"^class\s+(\w+)", 1)))
            name = F.when(t.rlike(r"^(def|function)\s+\w"), F.concat(F.lit("# SECTION: function "), F.regexp_extract(t, r"^(?:def|function)\s+(\w+)", 1))).when(t.rlike(r"^class\s+\w"), name)
            return F.when(inside & ~t.startswith(FENCE) & name.isNotNull(), F.concat(name, F.lit("\n"), line)).otherwise(line)

        return F.transform(ls, mark)

    return unlines(let(lines(text), body))


def preseeded(text: Column, task: Column) -> Column:
    """A long prompt with its task's hint opened as a thought."""
    hint = F.coalesce(F.create_map(*[F.lit(x) for kv in TASK_HINTS.items() for x in kv])[task], F.lit(TASK_HINTS["default"]))
    return F.when(F.length(text) < 200, text).otherwise(F.concat(text, F.lit("\n\n<thought>\n"), hint, F.lit("\n\n")))


def handle(content: Column) -> Column:
    return sha16(content)


def step_fingerprint(role: Column, index: Column, content: Column, call_id: Column, metadata: Column) -> Column:
    zero = F.lit("\x00")
    return F.sha2(F.concat(role, zero, index.cast("string"), zero, content, zero, F.coalesce(call_id, F.lit("")), zero, metadata), 256)


def has_marker(text: Column, markers: list[str]) -> Column:
    return any_of(text.contains(m) for m in markers)
