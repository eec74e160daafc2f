"""Retention, similarity and structure metrics of two texts, as column expressions; ROUGE-L by an Arrow UDF.

Shares are rounded to six digits. Words are those between white space, lower-cased.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.core import any_of, let, lines, words

# Markers that must not leak, negations, fact tokens, code words, and patterns of Markdown structure.
FORBIDDEN = ["[ARCHIVED", "[REASONING", "[PROGRESS", "[LOOP DETECTED"]
NEGATIONS = ["not ", "never ", "no longer", "isn't", "is not", "aren't", "are not", "don't", "do not", "doesn't", "does not", "won't", "will not", "can't", "cannot", "shouldn't", "should not", "instead of", "rather than", "contrary to"]
CODE_WORDS = ["def ", "class ", "import ", "async def ", "return ", "=>", "function ", "public ", "private ", "const ", "let ", "var ", "package ", "fn "]
STRUCTURE = {"headings": r"(?m)^#{1,6}\s", "unordered": r"(?m)^\s*[-*]\s", "ordered": r"(?m)^\s*\d+\.\s", "fences": r"(?m)^```", "quotes": r"(?m)^\s*>"}
ASSERTION = r"([A-Z][^.!?]*\b(?:is|are|was|were|must|should|will|always|never|means|equals|requires|uses|runs on|codename|owner)\b[^.!?]*[.!?])"


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(shared / (F.size(a) + F.size(b) - shared), 6))


def recall(a: Column, b: Column) -> Column:
    """The share of set a that b has; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.size(F.array_intersect(a, b)) / F.size(a), 6))


def evicted_recall(full: Column, optimised: Column) -> Column:
    """The share of the words of the first 60 % of full that optimised still has; null below 40 words."""
    early = lambda w: F.array_distinct(F.slice(w, F.lit(1), F.floor(F.size(w) * 0.6).cast("int")))
    return let(words(full), lambda w: F.when((F.size(w) >= 40) & (F.size(word_set(optimised)) > 0), F.round(F.size(F.array_intersect(early(w), word_set(optimised))) / F.size(early(w)), 6)))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters, found by one pass of a pattern: cutting each by its position would walk the text anew every time."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)(?=(...))."), F.lit(1)))


def richness(text: Column) -> Column:
    """Distinct words by words."""
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0))


def markdown_likeness(a: Column, b: Column) -> Column:
    counts = [(F.regexp_count(a, F.lit(p)), F.regexp_count(b, F.lit(p))) for p in STRUCTURE.values()]
    low, high = sum((F.least(x, y) for x, y in counts), F.lit(0)), sum((F.greatest(x, y) for x, y in counts), F.lit(0))
    return F.round(low / F.greatest(high, F.lit(1)), 6)


def has_code(text: Column) -> Column:
    return text.contains("```") | text.rlike(r"`[^`\n]{3,}`") | text.rlike(r"(?m)^ {4,}(def |class |import |from |return |async |#!|</?|func |function )") | any_of(text.contains(w) for w in CODE_WORDS)


def code_likeness(text: Column) -> Column:
    """The share of lines in fences or that look like code."""

    def body(ls: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            fence = F.trim(line).startswith("```")
            word = F.trim(line).rlike(r"=|\bif\b|\bfor\b|\bwhile\b|\bdef\b|\bclass\b|\breturn\b|\bimport\b") & (F.length(F.trim(line)) > 8)
            return F.struct((acc["n"] + F.when(fence | acc["inside"] | word, 1).otherwise(0)).alias("n"), (acc["inside"] != fence).alias("inside"))

        return F.aggregate(ls, F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step, lambda a: F.round(a["n"] / F.size(ls), 4))

    return let(lines(text), body)


def blocks(text: Column) -> Column:
    """The bodies of fenced blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1))


def blocks_preserved(a: Column, b: Column) -> Column:
    """The share of a's code blocks that b has, white space apart; 1 without blocks."""
    flat = lambda t: F.transform(blocks(t), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.when(F.size(blocks(a)) == 0, 1.0).otherwise(let(flat(b), lambda fb: F.round(F.size(F.filter(flat(a), lambda x: F.array_contains(fb, x))) / F.size(blocks(a)), 6)))


def stability(a: Column, b: Column) -> Column:
    """The mean of the kept shares of fences and thought marks."""
    share = lambda p: F.when(F.regexp_count(a, F.lit(p)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.regexp_count(b, F.lit(p)) / F.regexp_count(a, F.lit(p))))
    return F.round((share("```") + share(r"(?i)</?thought>")) / 2, 4)


def leaked(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in FORBIDDEN]), lambda m: text.contains(m))


def fact_recall(text: Column, facts: list[list[str]]) -> Column:
    """The share of facts all of whose tokens occur in the text, both without punctuation."""
    norm = F.regexp_replace(F.lower(text), r"[^a-z0-9\- ]", " ")
    clean = [re.sub(r"[^a-z0-9\- ]", " ", " ".join(f).lower()).split() for f in facts]

    def found(t: Column) -> Column:
        hits = []
        for tokens in clean:
            every = F.lit(True)
            for token in tokens:
                every = every & t.contains(token)
            hits.append(every.cast("int"))
        return F.round(sum(hits, F.lit(0)) / max(1, len(facts)), 4)

    return let(norm, found)


def assertions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSERTION), F.lit(1)), lambda s: F.trim(s))


def negated(text: Column) -> Column:
    return any_of(F.lower(text).contains(m) for m in NEGATIONS)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time: within a row, the running maximum."""
    if not a or not b:
        return 0
    ids: dict[str, int] = {}
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        k = ids.get(w)
        if k is not None:
            row[1:] = np.maximum(row[1:], row[:-1] + (y == k))
            row = np.maximum.accumulate(row)
    return int(row[-1])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1", "edit")]))
def rouge_l(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """ROUGE-L of two texts, and the longest common subsequence by the longer text."""
    for xs, ys in pairs:
        out = []
        for x, y in zip(xs, ys, strict=True):
            a, b = (x or "").lower().split(), (y or "").lower().split()
            n = _lcs(a, b)
            p, r = (n / len(a) if a else 0.0), (n / len(b) if b else 0.0)
            edit = n / max(len(a), len(b)) if a and b else float(not a and not b)
            out.append((round(p, 6), round(r, 6), round(2 * p * r / (p + r), 6) if p + r else 0.0, round(edit, 6)))
        yield pd.DataFrame(out, columns=["precision", "recall", "f1", "edit"])


@F.pandas_udf(T.DoubleType())
def python_validity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The share of fenced Python blocks that parse; 1 without any."""
    for xs in texts:
        out = []
        for x in xs:
            found = re.findall(r"```(?:python|py)\n(.*?)```", x or "", re.DOTALL)
            good = 0
            for code in found:
                try:
                    ast.parse(code)
                    good += 1
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    pass
            out.append(round(good / len(found), 6) if found else 1.0)
        yield pd.Series(out)


@F.pandas_udf(T.LongType())
def common_prefix(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The number of characters that two texts share from their start, by bisection over equal prefixes."""
    for xs, ys in pairs:
        out = []
        for x, y in zip(xs, ys, strict=True):
            a, b = x or "", y or ""
            lo, hi = 0, min(len(a), len(b))
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
            out.append(lo)
        yield pd.Series(out)
