"""State graph, retrieval, similarity, loops, progress and anchors (sections 2.7 to 2.9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.core import any_of, let
from loomline.operators.vectors import nearest_rows
from loomline.plans.registry import CODE, MESSAGES, ORACLE, QUERIES, STEPS, TRACES, fixture, oracle_text, query, table
from loomline.plans.text_plans import ordered_join
from loomline.sources import messages as M

C = F.col


def steps() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("step_index")

_SUB = "coalesce(nullif(regexp_extract(content, '# Subtask: ([^\\n]+)', 1), ''), tool_name)"


def subtask() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract("content", r"# Subtask: ([^\n]+)", 1), F.lit("")), "tool_name")


@query(STEPS, f"WITH s AS (SELECT *, {_SUB} AS subtask FROM src) SELECT conv_id, 'subtask' AS kind, subtask AS key, string_agg(step_index, ',' ORDER BY step_index) AS steps FROM s WHERE subtask IS NOT NULL GROUP BY conv_id, subtask UNION ALL SELECT conv_id, 'tool', tool_name, string_agg(step_index, ',' ORDER BY step_index) FROM s WHERE tool_name IS NOT NULL GROUP BY conv_id, tool_name")
def subtask_index(s: DataFrame) -> DataFrame:
    edges = s.select("conv_id", "step_index", F.explode(F.array(F.struct(F.lit("subtask").alias("kind"), subtask().alias("key")), F.struct(F.lit("tool").alias("kind"), C("tool_name").alias("key")))).alias("e"))
    edges = edges.select("conv_id", "step_index", "e.*").where("key is not null")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list("step_index")), lambda i: i.cast("string")), ",")
    return edges.groupBy("conv_id", "kind", "key").agg(ordered.alias("steps"))


def _latest(s: DataFrame) -> DataFrame:
    """The last step of each session that has a subtask or tool, as the point of reference."""
    at = s.withColumn("subtask", subtask()).where("subtask is not null")
    return at.groupBy("conv_id").agg(F.max_by(F.struct("step_index", "subtask", "tool_name", "role"), "step_index").alias("me")).select("conv_id", C("me.step_index").alias("my_index"), C("me.subtask").alias("my_subtask"), C("me.tool_name").alias("my_tool"), C("me.role").alias("my_role"))


_ME = f"""s AS (SELECT *, {_SUB} AS subtask FROM src), me AS (SELECT conv_id, max(step_index) AS my_index FROM s WHERE subtask IS NOT NULL GROUP BY conv_id),
    m AS (SELECT s.conv_id, s.step_index AS my_index, s.subtask AS my_subtask, s.tool_name AS my_tool, s.role AS my_role FROM s JOIN me ON s.conv_id = me.conv_id AND s.step_index = me.my_index)"""


@query(STEPS, f"""WITH {_ME}, r AS (SELECT s.conv_id, s.step_index, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.step_index) AS k FROM s JOIN m USING (conv_id) WHERE s.step_index <> my_index AND (s.subtask = my_subtask OR s.tool_name = my_tool))
    SELECT conv_id, step_index FROM r WHERE k <= 12""")
def related_steps(s: DataFrame) -> DataFrame:
    """Steps of the same subtask or tool as the latest one; the first twelve by step (the operator's limit)."""
    j = s.withColumn("subtask", subtask()).join(_latest(s), "conv_id").where((C("step_index") != C("my_index")) & ((C("subtask") == C("my_subtask")) | (C("tool_name") == C("my_tool"))))
    return j.withColumn("k", F.row_number().over(steps())).where("k <= 12").select("conv_id", "step_index")


@query(STEPS, f"""WITH {_ME}, c AS (SELECT s.conv_id, s.step_index, CASE WHEN s.subtask = my_subtask THEN 10 ELSE 0 END + CASE WHEN s.tool_name = my_tool THEN 5 ELSE 0 END + CASE WHEN s.role = my_role THEN 1 ELSE 0 END + 1.0::DOUBLE / (1 + abs(my_index - s.step_index)) AS score
        FROM s JOIN m USING (conv_id) WHERE s.step_index <> my_index), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, step_index DESC) AS k FROM c)
    SELECT conv_id, step_index, round(score, 6) AS score, k AS place FROM r WHERE k <= 6""")
def structural_rank(s: DataFrame) -> DataFrame:
    """Ten for the subtask, five for the tool, one for the role and up to one for nearness; the six best."""
    j = s.withColumn("subtask", subtask()).join(_latest(s), "conv_id").where(C("step_index") != C("my_index"))
    has = lambda cond, n: F.when(cond, n).otherwise(0)
    score = has(C("subtask") == C("my_subtask"), 10) + has(C("tool_name") == C("my_tool"), 5) + has(C("role") == C("my_role"), 1) + F.lit(1.0) / (1 + F.abs(C("my_index") - C("step_index")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("step_index"))
    return j.withColumn("score", score).withColumn("place", F.row_number().over(w)).where("place <= 6").select("conv_id", "step_index", F.round("score", 6).alias("score"), "place")


def query_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{3,})"), F.lit(1)))


_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]{{3,}}'))"


@query(STEPS, f"""WITH q AS (SELECT conv_id, arg_max({_TERMS.format('content')}, step_index) AS terms, max(step_index) AS my_index FROM src WHERE role = 'user' GROUP BY conv_id),
    c AS (SELECT s.conv_id, s.step_index, s.content, len(list_intersect({_TERMS.format('s.content')}, q.terms)) AS overlap FROM src s JOIN q USING (conv_id) WHERE s.step_index <> q.my_index),
    r AS (SELECT *, max(overlap) OVER (PARTITION BY conv_id) AS best, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, step_index DESC) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY step_index DESC) AS recent FROM c),
    p AS (SELECT *, sum(length(content) + 1) OVER (PARTITION BY conv_id ORDER BY step_index) AS used FROM r WHERE (best > 0 AND k <= 6 AND overlap > 0) OR (best = 0 AND recent <= 6))
    SELECT conv_id, step_index, overlap FROM p WHERE used <= 140""")
def query_retrieval(s: DataFrame) -> DataFrame:
    """The six steps that share most terms with the latest user message, newer first; without any, the last six; in order, up to 140 characters."""
    asked = s.where("role = 'user'").groupBy("conv_id").agg(F.max_by(query_terms(C("content")), "step_index").alias("terms"), F.max("step_index").alias("my_index"))
    c = s.join(asked, "conv_id").where(C("step_index") != C("my_index")).withColumn("overlap", F.size(F.array_intersect(query_terms(C("content")), "terms")))
    conv = Window.partitionBy("conv_id")
    c = c.withColumn("best", F.max("overlap").over(conv)).withColumn("k", F.row_number().over(conv.orderBy(F.desc("overlap"), F.desc("step_index")))).withColumn("recent", F.row_number().over(conv.orderBy(F.desc("step_index"))))
    c = c.where(((C("best") > 0) & (C("k") <= 6) & (C("overlap") > 0)) | ((C("best") == 0) & (C("recent") <= 6)))
    used = F.sum(F.length("content") + 1).over(steps().rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("used", used).where("used <= 140").select("conv_id", "step_index", C("overlap").cast("long").alias("overlap"))


@query(STEPS, "SELECT conv_id, count(*) AS others FROM src s WHERE NOT EXISTS (SELECT 1 FROM (SELECT conv_id, arg_max(content, step_index) AS content FROM src GROUP BY conv_id) m WHERE m.conv_id = s.conv_id AND m.content = s.content) GROUP BY conv_id")
def exclusion(s: DataFrame) -> DataFrame:
    """Steps other than those with the current step's content: an anti join."""
    now = s.groupBy("conv_id").agg(F.max_by("content", "step_index").alias("content"))
    return s.join(now, ["conv_id", "content"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("others"))


@query(STEPS, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step_index DESC) AS k FROM src)
    SELECT conv_id, step_index, CASE WHEN k <= 5 THEN content WHEN role = 'tool' THEN '[' || coalesce(tool_name, 'tool') || '] ' || substr(content, 1, 20) WHEN role = 'thinking' THEN '[archived]' ELSE '[' || role || '] ' || substr(content, 1, 20) END AS shown FROM r""")
def compacted_history(s: DataFrame) -> DataFrame:
    """Recent steps in full, archived ones as a line."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("step_index")))
    short = F.substring("content", 1, 20)
    line = F.when(C("role") == "tool", F.concat(F.lit("["), F.coalesce("tool_name", F.lit("tool")), F.lit("] "), short)).when(C("role") == "thinking", "[archived]").otherwise(F.concat(F.lit("["), "role", F.lit("] "), short))
    return s.withColumn("k", k).select("conv_id", "step_index", F.when(C("k") <= 5, C("content")).otherwise(line).alias("shown"))


# The words of each class of goals, in order, and their subtasks.
GOALS = [
    (["website", "web app", "frontend", "ui", "html", "css", "react", "vue", "angular"], ["Design page structure and layout", "Implement HTML/CSS markup", "Add JavaScript interactivity", "Test responsiveness and cross-browser compatibility"]),
    (["api", "endpoint", "route", "rest", "graphql", "server", "backend"], ["Define API schema and data models", "Implement route handlers", "Add input validation and error handling", "Write integration tests"]),
    (["fix", "bug", "error", "crash", "issue", "problem", "broken"], ["Reproduce the issue and identify root cause", "Implement fix in relevant module", "Add test case for the bug", "Verify fix does not break existing functionality"]),
    (["refactor", "restructure", "reorganize", "cleanup", "optimize"], ["Map current code structure and dependencies", "Design new module organization", "Implement refactoring changes", "Run tests to verify behavior is preserved"]),
]
GENERIC_GOAL = ["Understand the current codebase and requirements", "Plan the implementation approach", "Implement the changes", "Verify the changes work correctly"]


def decomposed(goal: Column) -> Column:
    low = F.lower(goal)
    parts = F.split(goal, r"[.\n]")
    own = F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.concat(p, F.lit(".")))
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    out = F.when(F.size(parts) > 1, own).otherwise(literal(GENERIC_GOAL))
    for ws, tasks in reversed(GOALS):
        out = F.when(any_of(low.contains(w) for w in ws), literal(tasks)).otherwise(out)
    return out


_GOAL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(goal), '{w}')''' for w in ws)} THEN '{' | '.join(t)}'" for ws, t in GOALS)
_GOAL += f" WHEN len(regexp_split_to_array(goal, '[.\\n]')) > 1 THEN coalesce(array_to_string([trim(p) || '.' FOR p IN regexp_split_to_array(goal, '[.\\n]') IF trim(p) <> ''], ' | '), '') ELSE '{' | '.join(GENERIC_GOAL)}' END"


@query(MESSAGES, f"WITH g AS (SELECT conv_id, substr(arg_min(content, turn) FILTER (WHERE role = 'user'), 1, 500) AS goal FROM src GROUP BY conv_id) SELECT conv_id, goal, {_GOAL} AS subtasks FROM g")
def goal_decompose(m: DataFrame) -> DataFrame:
    """A session's goal is the start of its first user message."""
    g = m.groupBy("conv_id").agg(F.substring(F.min_by("content", F.when(C("role") == "user", C("turn"))), 1, 500).alias("goal"))
    return g.select("conv_id", "goal", F.array_join(decomposed(C("goal")), " | ").alias("subtasks"))


@query(STEPS, """WITH stored AS (SELECT conv_id, substr(md5(content), 1, 16) AS k, 'because ' || min(step_index) AS reasoning FROM src WHERE role = 'assistant' AND step_index % 2 = 0 GROUP BY conv_id, substr(md5(content), 1, 16))
    SELECT s.conv_id, s.step_index, coalesce(stored.reasoning, '') AS reasoning FROM src s LEFT JOIN stored ON stored.conv_id = s.conv_id AND stored.k = substr(md5(s.content), 1, 16) WHERE s.role = 'assistant'""")
def restore_thinking(s: DataFrame) -> DataFrame:
    """Reasoning stored by the content's hash, put back on messages that lost it."""
    key = F.substring(F.md5("content"), 1, 16)
    a = s.where("role = 'assistant'").withColumn("k", key)
    stored = a.where("step_index % 2 = 0").groupBy("conv_id", "k").agg(F.concat(F.lit("because "), F.min("step_index").cast("string")).alias("reasoning"))
    return a.join(stored, ["conv_id", "k"], "left").select("conv_id", "step_index", F.coalesce("reasoning", F.lit("")).alias("reasoning"))


@query(STEPS, "WITH f AS (SELECT conv_id, tool_name, arg_min(content, step_index) AS first_use FROM src WHERE tool_name IS NOT NULL GROUP BY conv_id, tool_name) SELECT conv_id, string_agg(tool_name || '=' || first_use, ';' ORDER BY tool_name) AS pinned FROM f GROUP BY conv_id")
def pin_tools(s: DataFrame) -> DataFrame:
    """Each tool as first seen, in the order of names."""
    first = s.where("tool_name is not null").groupBy("conv_id", "tool_name").agg(F.min_by("content", "step_index").alias("first_use"))
    return first.groupBy("conv_id").agg(ordered_join(F.concat("tool_name", F.lit("="), "first_use"), "tool_name", ";").alias("pinned"))


# --- similarity -----------------------------------------------------------------------------------------------------

_VEC = "SELECT vec_id, embedding, label FROM {embeddings}"


def cosine(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded; a zero vector counts as of length 1e-9."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: let(F.sqrt(dot(x, x)), lambda n: F.when(n == 0, 1e-9).otherwise(n))
    return F.round(dot(a, b) / (norm(a) * norm(b)), digits)


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5)"


def query_vectors(v: DataFrame) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50."""
    return v.where("vec_id % 50 = 0")


#: Query vectors that are broadcast at once (with 64 dimensions, 6 MB, or 10 MB as doubles).
QUERY_BLOCK = 20_000


def in_query_blocks(v: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search of the query set, in blocks of about QUERY_BLOCK by hash, each broadcast and held against every row."""
    q = query_vectors(v).withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})
    n = -(-q.count() // QUERY_BLOCK)
    found = search(q) if n <= 1 else None
    for i in range(n if n > 1 else 0):
        part = search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i))
        found = part if found is None else found.union(part)
    return found


def nearest(v: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query vector, of all vectors; the best are kept by task first."""

    def search(q: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        return nearest_rows(v, q, k, 5).withColumn("place", F.row_number().over(w)).where(C("place") <= k)

    return in_query_blocks(v, search)


@query(_VEC, f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM src a JOIN src b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, similarity, place FROM r WHERE place <= 5")
def vector_search(v: DataFrame) -> DataFrame:
    return nearest(v, 5)


@query(_VEC, f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM src a JOIN src b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label), r AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) >= 0.2 AS any_good, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, similarity, place FROM r WHERE place <= 5 AND (NOT any_good OR similarity >= 0.2)")
def rank_with_fallback(v: DataFrame) -> DataFrame:
    """Chunks (vectors of the query's label) of similarity 0.2 or more, the five best; the five best anyway if none is."""

    def search(q: DataFrame) -> DataFrame:
        s = v.join(F.broadcast(q), "label").where(C("vec_id") != C("query_id")).select("query_id", "vec_id", cosine(C("query"), C("embedding"), 5).alias("similarity"))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        # the first of the five best is the best, so whether any is good shows among them
        best = s.withColumn("place", F.row_number().over(w)).where("place <= 5")
        best = best.withColumn("any_good", F.max("similarity").over(Window.partitionBy("query_id")) >= 0.2)
        return best.where(~C("any_good") | (C("similarity") >= 0.2)).select("query_id", "vec_id", "similarity", "place")

    return in_query_blocks(v, search)


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of vectors with metadata, written in two appends and read back."""
    v, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    rows = v.join(d.select(C("doc_id").alias("vec_id"), "source"), "vec_id", "left").select(C("vec_id").alias("turn_id"), "embedding", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    path = M.shared_path(spark, "vector-index")
    for part in (0, 1):
        M.index_vectors(rows.where(F.pmod("turn_id", F.lit(2)) == part), path)
    found = M.read_vectors(spark, path)
    return found.select("turn_id", F.size("embedding").cast("long").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squared_norm"), C("metadata")["source"].alias("source"))


QUERIES["vector_index_write"] = vector_index
ORACLE["vector_index_write"] = "SELECT e.vec_id AS turn_id, CAST(len(e.embedding) AS BIGINT) AS dimensions, round(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS squared_norm, d.source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"


def embedding_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vector of each document, a zero vector where none is stored."""
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    j = d.select("doc_id").join(v.select(C("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    norm = F.aggregate(F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return j.select("doc_id", C("embedding").isNotNull().alias("found"), F.round(norm, 4).alias("squared_norm"))


QUERIES["embedding_fetch"] = embedding_fetch
ORACLE["embedding_fetch"] = "SELECT d.doc_id, e.embedding IS NOT NULL AS found, round(coalesce(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]), 0.0), 4) AS squared_norm FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"

_ENT = "least(1.0, len(list_distinct(regexp_extract_all({0}, '[a-zA-Z_][a-zA-Z0-9_]*')))::DOUBLE / greatest(1, len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))))"


def entropy_of(text: Column) -> Column:
    """Distinct identifiers by white-space tokens, at most 1."""
    symbols = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)))
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.least(F.lit(1.0), F.size(symbols) / F.greatest(F.lit(1), F.size(tokens)))


@query("documents", f"SELECT doc_id, round({_ENT.format('text')}, 6) AS entropy FROM src")
def entropy(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.round(entropy_of(C("text")), 6).alias("entropy"))


@query(MESSAGES, f"WITH a AS (SELECT conv_id, coalesce(avg({_ENT.format('content')}) FILTER (WHERE length(content) > 100), 0) AS mean FROM src GROUP BY conv_id) SELECT conv_id, CASE WHEN mean > 0.6 THEN 0.3::DOUBLE WHEN mean > 0.3 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS temperature FROM a")
def temperature(m: DataFrame) -> DataFrame:
    mean = F.coalesce(F.avg(F.when(F.length("content") > 100, entropy_of(C("content")))), F.lit(0.0))
    return m.groupBy("conv_id").agg(mean.alias("mean")).select("conv_id", F.when(C("mean") > 0.6, 0.3).when(C("mean") > 0.3, 0.5).otherwise(0.6).alias("temperature"))


# --- loops, progress, anchors ---------------------------------------------------------------------------------------


def _repeats(s: DataFrame, key: str, kind: str) -> DataFrame:
    """Steps at which some value stands three or more times among the last four that have one."""
    rows = s.where(C(key).isNotNull())
    last4 = steps().rowsBetween(-3, 0)
    seen = F.collect_list(key).over(last4)
    best = lambda xs: F.array_max(F.transform(F.array_distinct(xs), lambda v: F.struct(F.size(F.filter(xs, lambda x: x == v)).alias("n"), v.alias("v"))))
    found = rows.withColumn("best", let(seen, best)).where(C("best.n") >= 3)
    return found.select("conv_id", "step_index", F.lit(kind).alias("loop_type"), C("best.v").alias("what"), C("best.n").cast("long").alias("repeat_count"))


_REP = """r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step_index) AS k FROM v), c AS (SELECT a.conv_id, a.step_index, b.{key} AS what, count(*) AS n FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 3 AND a.k GROUP BY a.conv_id, a.step_index, b.{key})
    SELECT conv_id, step_index, '{kind}' AS loop_type, what, n AS repeat_count FROM c WHERE n >= 3"""


@query(STEPS, "WITH v AS (SELECT * FROM src WHERE tool_name IS NOT NULL), " + _REP.format(key="tool_name", kind="tool_repeat"))
def tool_repeat(s: DataFrame) -> DataFrame:
    return _repeats(s, "tool_name", "tool_repeat")


# Patterns of an assistant's action, in order, with what the name is prefixed by.
ACTIONS = [(r"(?i)(?:tool_calls|function_call|call)\s*[:=]\s*(\w+)", "call:"), (r"(?i)call\s+(\w+)\s*\(", "call:"), (r"(?i)invoke\s+(\w+)\s*\(", "call:"), (r"(?i)execute\s+(\w+)\s*\(", "call:"), (r"(?i)run\s+(\w+)\s*\(", "call:"), (r"(?i)(?:create|modify|update|delete|add|remove)\s+(\w+)", "code:"), (r"(?i)(?:search|find|query|lookup)\s+(\w+)", "search:")]


def action(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.concat(F.lit(pre), F.regexp_extract(text, p, 1))) for p, pre in ACTIONS])


_ACTION = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{pre}' || regexp_extract(content, '{p}', 1) END" for p, pre in ACTIONS) + ")"


@query(STEPS, f"WITH v AS (SELECT *, {_ACTION} AS action FROM src WHERE role = 'assistant' AND {_ACTION} IS NOT NULL), " + _REP.format(key="action", kind="action_repeat"))
def action_repeat(s: DataFrame) -> DataFrame:
    return _repeats(s.where("role = 'assistant'").withColumn("action", action(C("content"))), "action", "action_repeat")


@query(STEPS, """WITH g AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY step_index) AS block FROM src),
    n AS (SELECT *, sum(CASE WHEN role = 'thinking' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, block ORDER BY step_index) AS thoughts FROM g)
    SELECT conv_id, step_index, thoughts::BIGINT AS thoughts FROM n WHERE role = 'thinking' AND thoughts >= 3""")
def thinking_loop(s: DataFrame) -> DataFrame:
    """Three or more thinking steps since the last assistant step: islands between assistant steps."""
    running = steps().rowsBetween(Window.unboundedPreceding, 0)
    g = s.withColumn("block", F.sum((C("role") == "assistant").cast("int")).over(running))
    thoughts = F.sum((C("role") == "thinking").cast("long")).over(Window.partitionBy("conv_id", "block").orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("thoughts", thoughts).where((C("role") == "thinking") & (C("thoughts") >= 3)).select("conv_id", "step_index", "thoughts")


@query(STEPS, "WITH v AS (SELECT * FROM src WHERE tool_name IS NOT NULL), w AS (" + "WITH " + _REP.format(key="tool_name", kind="tool_repeat") + "), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step_index DESC) AS n FROM w) SELECT conv_id, string_agg('[LOOP DETECTED: ' || loop_type || '] Agent called tool ''' || what || ''' ' || repeat_count || ' times', chr(10) ORDER BY step_index) AS warnings FROM k WHERE n <= 5 GROUP BY conv_id")
def warnings_readout(s: DataFrame) -> DataFrame:
    """The last five warnings of a session, formatted."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("step_index")))
    w = tool_repeat(s).withColumn("k", k).where("k <= 5")
    line = F.format_string("[LOOP DETECTED: %s] Agent called tool '%s' %d times", "loop_type", "what", "repeat_count")
    return w.groupBy("conv_id").agg(ordered_join(line, "step_index").alias("warnings"))


# Words that complete a subtask, and that start one.
COMPLETES = ["completed", "done", "finished", "implemented", "resolved", "fixed", "deployed", "merged", "submitted", "pushed"]
STARTS = ["starting", "beginning", "now implementing", "now fixing", "now updating", "now creating", "starting to"]


def progress(s: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """A fold over each session's steps: a completion word completes the oldest open subtask, a start word opens one named by the next word.

    The state is an ordered array of (name, done); a session's steps are one row's array, so the fold has no shuffle of its own.
    """
    low = F.lower("content")
    started = F.when(any_of(low.contains(w) for w in STARTS), F.nullif(F.regexp_extract(low, r"(?:starting|beginning|now)\s+(?:to\s+)?(\w+)", 1), F.lit("")))
    rows = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("step_index", any_of(low.contains(w) for w in COMPLETES).alias("completes"), started.alias("starts")))).alias("steps"))

    def step(state: Column, x: Column) -> Column:
        open_at = lambda st: F.array_position(F.transform(st, lambda t: t["done"]), False)
        done = F.when(x["completes"], let(state, lambda st: F.transform(st, lambda t, i: F.when(i + 1 == open_at(st), F.struct(t["name"].alias("name"), F.lit(True).alias("done"))).otherwise(t)))).otherwise(state)
        known = F.exists(state, lambda t: t["name"] == x["starts"])
        return F.when(x["starts"].isNotNull() & ~known, F.concat(done, F.array(F.struct(x["starts"].alias("name"), F.lit(False).alias("done"))))).otherwise(done)

    zero = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(False).alias("done")) for n in seeds]) if seeds else F.array().cast("array<struct<name:string,done:boolean>>")
    return rows.select("conv_id", F.size("steps").alias("n_steps"), F.aggregate("steps", zero, step).alias("subtasks"))


@query(STEPS)
def progress_tracking(s: DataFrame) -> DataFrame:
    return progress(s).select("conv_id", F.explode("subtasks").alias("t")).select("conv_id", C("t.name").alias("subtask"), F.when(C("t.done"), "completed").otherwise("active").alias("status"))


@query(STEPS)
def manual_subtasks(s: DataFrame) -> DataFrame:
    """The same fold with two subtasks entered by hand as its seed."""
    return progress(s, ["plan", "review"]).select("conv_id", F.explode("subtasks").alias("t")).select("conv_id", C("t.name").alias("subtask"), C("t.done").alias("done"))


@query(STEPS)
def progress_snapshot(s: DataFrame) -> DataFrame:
    p = progress(s)
    done = F.size(F.filter("subtasks", lambda t: t["done"]))
    share = F.when(F.size("subtasks") == 0, F.least(F.lit(1.0), C("n_steps") / 20.0)).otherwise(done / F.greatest(F.size("subtasks"), F.lit(1)))
    return p.select("conv_id", C("n_steps").cast("long").alias("total_steps"), done.cast("long").alias("completed"), F.round(share, 6).alias("completion")).withColumn("is_complete", (C("completion") >= 0.9))


_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE rtrim(substr({0}, 1, {1} - 3)) || '...' END"


@query(MESSAGES, f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_FLAT.format('content')} AS flat FROM src WHERE role = 'user'),
    c AS (SELECT *, {_CUT.format('flat', 160)} AS line FROM u), d AS (SELECT conv_id, line, min(turn) AS turn FROM c WHERE k > 1 AND line <> '' GROUP BY conv_id, line),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM d), j AS (SELECT conv_id, string_agg('- ' || line, chr(10) ORDER BY turn) AS lines FROM r WHERE n <= 2 GROUP BY conv_id),
    h AS (SELECT conv_id, {_CUT.format('flat', 700)} AS head FROM u WHERE k = 1),
    a AS (SELECT h.conv_id, {_FLAT.format("'Original request:' || chr(10) || head || coalesce(chr(10) || 'Accumulated constraints:' || chr(10) || lines, '')")} AS anchor FROM h LEFT JOIN j USING (conv_id))
    SELECT conv_id, {_CUT.format('anchor', 900)} AS anchor FROM a""")
def quality_anchor(m: DataFrame) -> DataFrame:
    """The first request and the last two distinct later ones, cut to sizes."""
    users = m.where("role = 'user'").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("line", T.compact(T.code_placeholder(C("content")), 160))
    later = users.where("k > 1 and line <> ''").groupBy("conv_id", "line").agg(F.min("turn").alias("turn"))
    recent = later.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 2")
    joined = recent.groupBy("conv_id").agg(ordered_join(F.concat(F.lit("- "), "line")).alias("lines"))
    first = users.where("k = 1").select("conv_id", T.compact(T.code_placeholder(C("content")), 700).alias("head"))
    both = F.concat(F.lit("Original request:\n"), "head", F.coalesce(F.concat(F.lit("\nAccumulated constraints:\n"), "lines"), F.lit("")))
    return first.join(joined, "conv_id", "left").select("conv_id", T.compact(both, 900).alias("anchor"))


@query(MESSAGES, """WITH n AS (SELECT conv_id, sum(length(content)) AS chars, max(turn) AS last_turn FROM src GROUP BY conv_id)
    SELECT conv_id, turn, role, length(content)::BIGINT AS chars FROM src UNION ALL SELECT conv_id, last_turn + 1, 'user', length('# Conversation Quality Anchor' || chr(10) || 'conversation ' || conv_id)::BIGINT FROM n WHERE chars > 1000""")
def volatile_turn(m: DataFrame) -> DataFrame:
    """Derived context as one trailing user message of conversations above the threshold: a union of one row each."""
    text = F.concat(F.lit("# Conversation Quality Anchor\nconversation "), C("conv_id").cast("string"))
    n = m.groupBy("conv_id").agg(F.sum(F.length("content")).alias("chars"), (F.max("turn") + 1).alias("turn")).where("chars > 1000")
    return m.select("conv_id", "turn", "role", F.length("content").cast("long").alias("chars")).union(n.select("conv_id", "turn", F.lit("user"), F.length(T.balanced_fences(text)).cast("long")))


@query(TRACES, """WITH RECURSIVE h AS (SELECT session_id, turn, CASE WHEN cached_tokens > 900 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM src),
    f AS (SELECT session_id, turn, 0.7::DOUBLE + 0.3::DOUBLE * hit AS ratio FROM h WHERE turn = 1 UNION ALL SELECT h.session_id, h.turn, 0.7::DOUBLE * f.ratio + 0.3::DOUBLE * h.hit FROM f JOIN h ON h.session_id = f.session_id AND h.turn = f.turn + 1),
    e AS (SELECT *, CASE WHEN turn >= 3 AND ratio < 0.34::DOUBLE THEN 1 WHEN ratio > 0.6::DOUBLE THEN 0 END AS event FROM f)
    SELECT session_id, turn, round(ratio, 6) AS ratio, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn), 0) = 1 AS drifting FROM e""")
def drift_ema(t: DataFrame) -> DataFrame:
    """A moving average of cache hits, 0.7 old and 0.3 new from 1; drift begins below 0.34 after three turns and ends above 0.6.

    The average has a closed form over the session's hits so far; the hysteresis is the last crossing.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    hits = F.collect_list(F.when(C("cached_tokens") > 900, 1.0).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ratio = F.aggregate(hits, F.lit(1.0), lambda r, h: F.lit(0.7) * r + F.lit(0.3) * h)
    e = t.select("session_id", "turn", ratio.alias("ratio"))
    event = F.when((C("turn") >= 3) & (C("ratio") < 0.34), 1).when(C("ratio") > 0.6, 0)
    return e.select("session_id", "turn", F.round("ratio", 6).alias("ratio"), (F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)) == 1).alias("drifting"))


#: Tokens and effort by class of turn.
SHAPES = {"new_question": (4096, "high"), "tool_result": (1024, "low"), "error": (2048, "medium"), "continuation": (2048, "low")}
_CLASS = """CASE WHEN role = 'tool' THEN 'tool_result' WHEN role = 'assistant' THEN 'continuation' WHEN role <> 'user' THEN 'new_question' WHEN contains(lower(content), 'tool_result') OR regexp_matches(trim(content), '^(Output:|Result:|stdout:|stderr:)') THEN 'tool_result'
    WHEN starts_with(lower(trim(content)), 'error:') THEN 'error' WHEN prev IN ('assistant', 'tool') THEN 'continuation' ELSE 'new_question' END"""


@query(STEPS, f"""WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY step_index) AS prev FROM src), c AS (SELECT conv_id, step_index, {_CLASS} AS turn_class FROM p)
    SELECT *, CASE turn_class {' '.join(f"WHEN '{k}' THEN {v[0]}" for k, v in SHAPES.items())} END AS max_tokens, CASE turn_class {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in SHAPES.items())} END AS effort FROM c""")
def turn_class(s: DataFrame) -> DataFrame:
    """The class of each turn from its last two messages, with the limits that go with it."""
    t = s.withColumn("prev", F.lag("role").over(steps()))
    text = F.trim("content")
    user = F.when(F.lower("content").contains("tool_result") | text.rlike(r"^(Output:|Result:|stdout:|stderr:)"), "tool_result").when(F.lower(text).startswith("error:"), "error").when(C("prev").isin("assistant", "tool"), "continuation").otherwise("new_question")
    kind = F.when(C("role") == "tool", "tool_result").when(C("role") == "assistant", "continuation").when(C("role") == "user", user).otherwise("new_question")
    shape = lambda i: F.create_map(*[F.lit(x) for k, v in SHAPES.items() for x in (k, v[i])])
    return t.select("conv_id", "step_index", kind.alias("turn_class")).withColumn("max_tokens", shape(0)[C("turn_class")]).withColumn("effort", shape(1)[C("turn_class")])


@query(CODE, "SELECT id, content || chr(10) || chr(10) || 'Be brief.' AS content FROM src WHERE NOT contains(content, 'Be brief.')")
def terse_instruction(m: DataFrame) -> DataFrame:
    return m.where(~C("content").contains("Be brief.")).select("id", F.concat("content", F.lit("\n\nBe brief.")).alias("content"))


def message_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a session with tool name and call id, each once by its fingerprint: a second delivery of the same steps adds none."""
    s = fixture(spark, sf_dir, STEPS).withColumn("tool_id", F.when(C("tool_name").isNotNull(), F.concat(F.lit("call_"), C("event_id").cast("string"))))
    again = s.union(s.where("step_index % 3 = 0"))
    key = T.step_fingerprint(C("role"), C("step_index"), C("content"), C("tool_name"), F.lit("{}"))
    steps = again.withColumn("fingerprint", key).dropDuplicates(["conv_id", "fingerprint"])
    return steps.select("conv_id", "step_index", "role", "tool_name", "tool_id", "content", F.length("fingerprint").alias("fingerprint_length"))


QUERIES["step_ingest"] = message_steps
ORACLE["step_ingest"] = f"SELECT conv_id, step_index, role, tool_name, CASE WHEN tool_name IS NOT NULL THEN 'call_' || event_id END AS tool_id, content, 64 AS fingerprint_length FROM ({oracle_text(STEPS)})"
