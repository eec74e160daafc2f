"""Code blocks: extraction, chunking, skeletons, slices, symbols and deltas.

Line forms are column expressions. What needs a parser or a diff (Python's ast, difflib) is an Arrow UDF over the rows
that have such blocks, and falls back to its input when the code doesn't parse.
"""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.core import let, lines, unlines

# Fence tags and their languages, beginnings of signature lines, and symbol patterns.
LANGUAGES = {"py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript", "rs": "rust", "rust": "rust", "go": "go", "sh": "bash", "bash": "bash", "json": "json", "yaml": "yaml", "yml": "yaml"}
SKELETON = r"^(def |class |import |from |function |pub fn |fn )"
SYMBOLS = [(r"\bdef\s+(\w+)", "function_definition"), (r"\bclass\s+(\w+)", "class_definition"), (r"\bfunction\s+(\w+)", "function_declaration"), (r"\bconst\s+(\w+)", "variable_declaration"), (r"\blet\s+(\w+)", "variable_declaration")]
BLOCK = r"(?s)```([^\n`]*)\n(.*?)```"


def code_blocks(text: Column) -> Column:
    """Array of (tag, body) of fenced blocks."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all(text, F.lit(BLOCK), F.lit(2)).alias("body"))


def language(tag: Column, body: Column) -> Column:
    """By tag; without one by what the code looks like; short code is generic."""
    named = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.trim(tag))]
    guess = F.when(F.length(body) < 40, "generic").when(body.rlike(r"(?m)^\s*def \w+\(.*\):"), "python").when(body.rlike(r"\bfunction \w+\(|\bconst \w+ ="), "javascript").when(body.rlike(r"\bfn \w+\("), "rust").otherwise("generic")
    return F.coalesce(named, guess)


def skeleton(code: Column) -> Column:
    """Signature, import, comment and empty lines; every other line becomes an indented ellipsis."""

    def keep(line: Column) -> Column:
        t = F.trim(line)
        indent = F.length(line) - F.length(F.ltrim(line))
        return F.when(t.rlike(SKELETON) | (t == "") | t.startswith("#"), line).otherwise(F.concat(F.repeat(F.lit(" "), indent), F.lit("...")))

    return unlines(F.transform(lines(code), keep))


def over_fences(text: Column, change: Callable[[Column], Column]) -> Column:
    """change applied to the body of every fenced block, its tag line kept."""
    body = lambda p: F.concat(F.substring_index(p, "\n", 1), F.lit("\n"), change(F.regexp_replace(p, r"^[^\n]*\n", "")))
    return F.array_join(F.transform(F.split(text, "```"), lambda p, i: F.when((i % 2 == 1) & p.contains("\n"), body(p)).otherwise(p)), "```")


def signatures(code: Column) -> Column:
    """Definition lines up to their first colon."""
    kept = F.filter(F.transform(lines(code), lambda x: F.trim(x)), lambda x: x.rlike(r"^(def |class |function |async def )"))
    return F.array_distinct(F.transform(kept, lambda x: F.substring_index(x, ":", 1)))


def symbols(code: Column) -> Column:
    """Array of (name, type, line) by the patterns; line is counted from 1."""

    def found(kind: str, line: Column, i: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), (i + 1).alias("line")))

    def of(ls: Column) -> Column:
        return F.flatten(F.transform(ls, lambda x, i: F.flatten(F.array(*[found(t, x, i, p) for p, t in SYMBOLS]))))

    return let(lines(code), of)


def imports(code: Column) -> Column:
    """Imported modules: Python's from and import, relative JavaScript paths."""
    python = F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)"), F.lit(1))
    script = F.regexp_extract_all(code, F.lit(r"from\s+'(\.[^']+)'"), F.lit(1))
    return F.array_distinct(F.concat(python, script))


def without_repeated_blocks(text: Column) -> Column:
    """Of equal fenced blocks the first stays, with its fences; later ones are removed."""
    parts = F.split(text, "```")

    def drop(ps: Column) -> Column:
        seen = lambda p, i: F.size(F.filter(F.transform(F.slice(ps, F.lit(1), i), lambda x, j: F.when(j % 2 == 1, x)), lambda x: x == p)) > 0
        closed = F.size(ps) % 2 == 1
        return F.array_join(F.transform(ps, lambda p, i: F.when((i % 2 == 1) & (closed | (i < F.size(ps) - 1)), F.when(seen(p, i), "").otherwise(F.concat(F.lit("```"), p, F.lit("```")))).when(i % 2 == 1, F.concat(F.lit("```"), p)).otherwise(p)), "")

    return let(parts, drop)


def fence_groups(text: Column, most: int = 128) -> Column:
    """Parts between fences packed greedily into groups of at most most characters; a longer part is a group."""
    parts = F.filter(F.transform(F.split(text, "```"), lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("```"), p, F.lit("```"))).otherwise(p)), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + F.length(p) <= most)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], p).alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p.alias("cur")))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(parts, zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def _top_level(code: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(header statements, (name, source) of top-level definitions)."""
    tree = ast.parse(code)
    rows = code.split("\n")
    header, found = [], []
    for node in tree.body:
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        source = "\n".join(rows[start - 1 : node.end_lineno])
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            found.append((node.name, source))
        else:
            header.append(source)
    return header, found


def slice_to_query(code: str, query: str) -> str:
    """Definitions that the query names, and those that they use, in turn; the others become a note. Never longer than the code."""
    try:
        header, found = _top_level(code)
    except (SyntaxError, ValueError, RecursionError):
        return code
    names = {name: k for k, (name, _) in enumerate(found)}
    asked = {w.lower() for w in re.findall(r"\w+", query)}
    open_, kept = [k for n, k in names.items() if n.lower() in asked], set()
    while open_:
        k = open_.pop()
        if k not in kept:
            kept.add(k)
            open_ += [names[w] for w in re.findall(r"\w+", found[k][1]) if w in names]
    if not kept or len(kept) == len(found):
        return code
    out = "\n".join([*header, *(found[k][1] for k in sorted(kept)), f"# ... ({len(found) - len(kept)} definitions omitted)"])
    return out if len(out) < len(code) else code


def ast_chunks(code: str, most: int) -> list[str]:
    """Top-level nodes packed to most characters, each chunk with the header's first five statements; by lines if the code doesn't parse."""
    try:
        header, found = _top_level(code)
    except (SyntaxError, ValueError, RecursionError):
        return [code]
    head = "\n".join(header[:5])
    chunks, cur = [], ""
    for source in [*header[5:], *(s for _, s in found)]:
        if cur and len(cur) + len(source) + 1 > most:
            chunks.append(cur)
            cur = ""
        cur = f"{cur}\n{source}" if cur else source
    chunks += [cur] if cur else []
    return [f"{head}\n{c}" if head else c for c in chunks] or ([head] if head else [])


def ast_skeleton(code: str) -> str:
    """Functions as signature and ellipsis, classes with their members so, all else as it is."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return code

    class Hollow(ast.NodeTransformer):
        def visit_FunctionDef(self, node):  # noqa: N802
            node.body = [ast.Expr(ast.Constant(...))]
            return node

        visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    return ast.unparse(Hollow().visit(tree))


def ast_symbols(code: str) -> list[tuple[str, str, int]]:
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    found = [(n.name, kinds[type(n)], n.lineno) for n in nodes if type(n) in kinds]
    found += [(t.id, "variable", n.lineno) for n in nodes if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
    return sorted(found, key=lambda x: (x[2], x[0]))


def changed_lines(old: str, new: str) -> str:
    """The + and - lines of a diff without context."""
    diff = difflib.unified_diff(old.split("\n"), new.split("\n"), n=0, lineterm="")
    return "\n".join(x for x in diff if x[:1] in "+-" and not x.startswith(("+++", "---")))


def _series(f: Callable[[str], object], kind: T.DataType) -> Callable:
    @F.pandas_udf(kind)
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([f(x) if x is not None else None for x in xs], dtype=object)

    return run


skeleton_udf = _series(ast_skeleton, T.StringType())
chunks_udf = _series(lambda x: ast_chunks(x, 120), T.ArrayType(T.StringType()))
symbols_udf = _series(ast_symbols, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType())])))


@F.pandas_udf(T.StringType())
def slice_udf(code: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([slice_to_query(c, q or "") if c is not None else None for c, q in zip(code, query, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def delta_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([changed_lines(a, b) if a is not None and b is not None else None for a, b in zip(old, new, strict=True)], dtype=object)
