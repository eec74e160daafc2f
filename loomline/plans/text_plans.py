"""Canonical text, hashes and token accounting (sections 2.2 and 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import tokens as K
from loomline.functions.core import lines
from loomline.plans.registry import BARE_CODE, CODE, MESSAGES, RAGGED, STEPS, TRACES, VOLATILE_TEXT, query

C = F.col
CANON = r"regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
TOK = "CASE WHEN content IS NULL OR trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' THEN 0 ELSE greatest(1, CAST(floor(length(content) / 3.5::DOUBLE) AS BIGINT)) END"


def ordered_join(value, order: str = "turn", sep: str = "\n"):
    """value joined in order within a group."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s["v"]), sep)


@query(RAGGED, f"SELECT conv_id, turn, {CANON} AS canonical FROM src")
def canonical_text(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", T.canonical(C("content")).alias("canonical"))


@query(RAGGED, f"SELECT conv_id, turn, CASE WHEN role = 'user' AND turn = max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) THEN {CANON} ELSE content END AS content FROM src")
def canonical_last_user(m: DataFrame) -> DataFrame:
    last = C("turn") == F.max(F.when(C("role") == "user", C("turn"))).over(Window.partitionBy("conv_id"))
    changed = T.outside_fences(C("content"), T.canonical)
    return m.select("conv_id", "turn", F.when((C("role") == "user") & last, changed).otherwise(C("content")).alias("content"))


@query(CODE, r"""
    WITH p AS (SELECT id, unnest(string_split(content, '```')) AS part, generate_subscripts(string_split(content, '```'), 1) AS i FROM src)
    SELECT id, string_agg(CASE WHEN i % 2 = 1 THEN regexp_replace(part, '(?m)[ \t]+$', '', 'g') ELSE part END, '```' ORDER BY i) AS content FROM p GROUP BY id""")
def canonical_outside_fences(m: DataFrame) -> DataFrame:
    return m.select("id", T.outside_fences(C("content"), lambda p: F.regexp_replace(p, r"(?m)[ \t]+$", "")).alias("content"))


@query(BARE_CODE, r"""
    WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src),
    a AS (SELECT *, coalesce(min(i) FILTER (WHERE NOT starts_with(ltrim(x), 'import ')) OVER (PARTITION BY id), 1000000) AS n1 FROM l),
    b AS (SELECT *, coalesce(min(i) FILTER (WHERE i >= n1 AND NOT starts_with(ltrim(x), 'from ')) OVER (PARTITION BY id), 1000000) AS n2 FROM a)
    SELECT id, string_agg(x, chr(10) ORDER BY CASE WHEN i < n1 THEN 0 WHEN i < n2 THEN 1 ELSE 2 END, CASE WHEN i < n2 THEN x ELSE '' END, i) AS content FROM b GROUP BY id""")
def sort_imports(m: DataFrame) -> DataFrame:
    return m.select("id", T.sorted_imports(C("content")).alias("content"))


@query(BARE_CODE, r"""
    WITH l AS (SELECT id, rtrim(unnest(string_split(content, chr(10)))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src),
    a AS (SELECT *, coalesce(min(i) FILTER (WHERE NOT (starts_with(trim(x), 'import ') OR starts_with(trim(x), 'from ') OR starts_with(trim(x), '#') OR trim(x) = '')) OVER (PARTITION BY id), 1000000) AS n FROM l),
    b AS (SELECT *, CASE WHEN i >= n THEN 2 WHEN starts_with(trim(x), 'import ') THEN 0 WHEN starts_with(trim(x), 'from ') THEN 1 END AS zone FROM a)
    SELECT id, string_agg(x, chr(10) ORDER BY zone, CASE WHEN zone < 2 THEN trim(x) ELSE '' END, i) AS content FROM b WHERE zone IS NOT NULL GROUP BY id""")
def code_key(m: DataFrame) -> DataFrame:
    return m.select("id", T.code_key_text(C("content")).alias("content"))


_PART = r"role || ':' || regexp_replace(regexp_replace(content, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query(RAGGED, f"SELECT conv_id, md5(string_agg({_PART}, chr(10) ORDER BY turn)) AS cache_key FROM src GROUP BY conv_id")
def prompt_cache_key(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id").agg(F.md5(ordered_join(T.prompt_part(C("role"), C("content")))).alias("cache_key"))


@query(MESSAGES, "SELECT conv_id, turn, content || repeat(chr(10), CAST((128 - length(content) % 128) % 128 AS INT)) AS padded, md5(role || ':' || content) AS node_hash FROM src")
def pad_and_node_hash(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", T.padded(C("content")).alias("padded"), F.md5(F.concat("role", F.lit(":"), "content")).alias("node_hash"))


_STATIC = "turn <= coalesce(min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id), 1000000)"


def static_prefix(m: DataFrame) -> DataFrame:
    """The messages up to the first user message; all if there is none."""
    first = F.min(F.when(C("role") == "user", C("turn"))).over(Window.partitionBy("conv_id"))
    return m.withColumn("__first", first).where((C("turn") <= C("__first")) | C("__first").isNull()).drop("__first")


@query(MESSAGES, f"WITH s AS (SELECT *, {_STATIC} AS keep FROM src) SELECT conv_id, string_agg(role || ':' || content, chr(10) ORDER BY turn) AS static_text, md5(string_agg(role || ':' || content, chr(10) ORDER BY turn)) AS static_key, md5(string_agg(to_json(struct_pack(role := role, content := content)), ',' ORDER BY turn)) AS signature FROM s WHERE keep GROUP BY conv_id")
def static_prefix_key(m: DataFrame) -> DataFrame:
    part = F.concat("role", F.lit(":"), "content")
    signature = ordered_join(F.to_json(F.struct("role", "content")), sep=",")
    return static_prefix(m).groupBy("conv_id").agg(ordered_join(part).alias("static_text"), F.md5(ordered_join(part)).alias("static_key"), F.md5(signature).alias("signature"))


@query(MESSAGES, r"""SELECT conv_id, substr(sha256(string_agg(role || chr(1) || content || chr(2), '' ORDER BY turn)), 1, 16) AS content_hash,
    sha1(string_agg(role || chr(31) || content || chr(30), '' ORDER BY turn)) AS list_fingerprint FROM src GROUP BY conv_id""")
def list_hashes(m: DataFrame) -> DataFrame:
    """Separators of the first are 0x01 and 0x02: the other engine's strings hold no 0x00."""
    one = F.concat("role", F.lit("\x01"), "content", F.lit("\x02"))
    two = F.concat("role", F.lit("\x1f"), "content", F.lit("\x1e"))
    return m.groupBy("conv_id").agg(F.substring(F.sha2(ordered_join(one, sep=""), 256), 1, 16).alias("content_hash"), F.sha1(ordered_join(two, sep="")).alias("list_fingerprint"))


@query("documents", "SELECT doc_id, substr(sha256(text), 1, 16) AS handle, sha256(text) AS fingerprint FROM src")
def content_handles(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.handle(C("text")).alias("handle"), F.sha2("text", 256).alias("fingerprint"))


@query(STEPS, "SELECT conv_id, step_index, sha256(role || '|' || step_index || '|' || content || '|' || coalesce(tool_name, '') || '|{}') AS fingerprint FROM src")
def step_fingerprint(s: DataFrame) -> DataFrame:
    parts = [C("role"), C("step_index").cast("string"), C("content"), F.coalesce("tool_name", F.lit("")), F.lit("{}")]
    return s.select("conv_id", "step_index", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


@query(MESSAGES, """WITH f AS (SELECT conv_id, arg_min(content, turn) FILTER (WHERE role = 'user') AS first_user, CASE WHEN conv_id % 3 = 0 THEN 's' || conv_id END AS explicit, CASE WHEN conv_id % 3 = 1 THEN 'u' || conv_id END AS who FROM src GROUP BY conv_id)
    SELECT conv_id, coalesce(explicit, 'user:' || substr(sha256(who), 1, 16) || ':' || substr(sha256(first_user), 1, 16), 'anon:' || substr(sha256(first_user), 1, 16)) AS session_id FROM f""")
def session_ids(m: DataFrame) -> DataFrame:
    """An explicit id (every third conversation here), else the user's and first message's hashes, else the latter alone."""
    first = m.groupBy("conv_id").agg(F.min_by("content", F.when(C("role") == "user", C("turn"))).alias("first_user"))
    explicit = F.when(C("conv_id") % 3 == 0, F.concat(F.lit("s"), C("conv_id").cast("string")))
    who = F.when(C("conv_id") % 3 == 1, F.concat(F.lit("u"), C("conv_id").cast("string")))
    named = F.concat(F.lit("user:"), T.handle(who), F.lit(":"), T.handle(C("first_user")))
    return first.select("conv_id", F.coalesce(explicit, named, F.concat(F.lit("anon:"), T.handle(C("first_user")))).alias("session_id"))


_SCORES = {k: " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in ws) for k, ws in T.TASK_WORDS.items()}
_TASKS = f"""WITH l AS (SELECT *, lower(content) AS low FROM src), s AS (SELECT *, {', '.join(f'{v} AS n_{k}' for k, v in _SCORES.items())} FROM l),
    t AS (SELECT *, greatest({', '.join(f'n_{k}' for k in _SCORES)}) AS best FROM s),
    k AS (SELECT *, CASE WHEN best = 0 THEN 'default' {' '.join(f"WHEN n_{k} = best THEN '{k}'" for k in _SCORES)} END AS task FROM t)"""


@query(CODE, _TASKS + " SELECT id, task, CAST(('0x' || substr(md5(task), 1, 8))::BIGINT % 1000 AS INT) AS version, task || ':' || CAST(('0x' || substr(md5(task), 1, 8))::BIGINT % 1000 AS STRING) || ':' || substr(md5(content), 1, 8) AS partition_key FROM k")
def task_class(m: DataFrame) -> DataFrame:
    task = T.task_class(C("content"))
    return m.select("id", task.alias("task"), T.template_version(task).alias("version"), T.partition_key(task, C("content")).alias("partition_key"))


@query("SELECT doc_id, '“' || text || '” – … ’x’ — ' || '€' AS content FROM {documents}", "SELECT doc_id, regexp_replace(replace(translate(content, '‘’“”–—', '''''\"\"--'), '…', '...'), '[^\\x00-\\x{FF}]', '', 'g') AS folded FROM src")
def header_safe(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.header_safe(C("content")).alias("folded"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '<think>' || substr(text, 1, 20) || chr(10) || 'x</think> ' ELSE '' END || text || CASE WHEN turn % 3 = 1 THEN ' <thinking>y</thinking>' ELSE '' END AS content FROM {conversations}", "SELECT conv_id, turn, trim(regexp_replace(content, '(?s)<think>.*?</think>|<thinking>.*?</thinking>', '', 'g')) AS content FROM src")
def strip_reasoning(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", T.without_reasoning(C("content")).alias("content"))


@query(CODE, r"""SELECT id, regexp_replace(content, '(?s)```.*?```', '[code block]', 'g') AS placeholder,
    content || CASE WHEN len(regexp_extract_all(content, '(?m)^[ \t]*```')) % 2 = 1 THEN CASE WHEN ends_with(content, chr(10)) THEN '' ELSE chr(10) END || '```' ELSE '' END AS balanced FROM src""")
def fence_repairs(m: DataFrame) -> DataFrame:
    return m.select("id", T.code_placeholder(C("content")).alias("placeholder"), T.balanced_fences(C("content")).alias("balanced"))


@query(MESSAGES, r"WITH f AS (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM src) SELECT conv_id, turn, CASE WHEN length(flat) <= 160 THEN flat ELSE rtrim(substr(flat, 1, 157)) || '...' END AS compact FROM f")
def compact_text(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", T.compact(C("content"), 160).alias("compact"))


_MASK = "content"
for _p, _m in T.VOLATILE:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_m}', 'g')"


@query(VOLATILE_TEXT, f"SELECT id, CASE WHEN role = 'tool' THEN {_MASK} ELSE content END AS content FROM src")
def volatile_mask(m: DataFrame) -> DataFrame:
    return m.select("id", F.when(C("role") == "tool", T.masked(C("content"))).otherwise(C("content")).alias("content"))


@query(CODE, r"""
    WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src),
    f AS (SELECT *, sum(CASE WHEN starts_with(trim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM l),
    m AS (SELECT *, CASE WHEN coalesce(n, 0) % 2 = 1 AND NOT starts_with(trim(x), '```') THEN CASE WHEN regexp_matches(trim(x), '^(def|function)\s+\w') THEN '# SECTION: function ' || regexp_extract(trim(x), '^(?:def|function)\s+(\w+)', 1) WHEN regexp_matches(trim(x), '^class\s+\w') THEN '# SECTION: class ' || regexp_extract(trim(x), '^class\s+(\w+)', 1) END END AS mark FROM f)
    SELECT id, string_agg(coalesce(mark || chr(10), '') || x, chr(10) ORDER BY i) AS marked, replace(string_agg(x, chr(10) ORDER BY i), chr(9), '    ') AS spaced FROM m GROUP BY id""")
def syntax_markers(m: DataFrame) -> DataFrame:
    return m.select("id", T.section_markers(C("content")).alias("marked"), T.spaces_for_tabs(C("content")).alias("spaced"))


_HINT = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TASK_HINTS.items()) + f" ELSE '{T.TASK_HINTS['default']}' END"


@query(CODE, _TASKS + f" SELECT id, CASE WHEN length(content) < 200 THEN content ELSE content || chr(10) || chr(10) || '<thought>' || chr(10) || {_HINT} || chr(10) || chr(10) END AS prompt FROM k")
def reasoning_preseed(m: DataFrame) -> DataFrame:
    return m.select("id", T.preseeded(C("content"), T.task_class(C("content"))).alias("prompt"))


@query(MESSAGES, "SELECT conv_id, string_agg('[' || role || ']' || chr(10) || content, chr(10) ORDER BY turn) AS transcript FROM src GROUP BY conv_id")
def message_text(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id").agg(ordered_join(F.concat(F.lit("["), "role", F.lit("]\n"), "content")).alias("transcript"))


@query("SELECT conv_id, turn, role, text AS content, 'x' AS _volatile_turn, turn AS _summary_id FROM {conversations}", "SELECT conv_id, turn, role, content FROM src")
def strip_flags(m: DataFrame) -> DataFrame:
    """Only the columns a message may carry; marker columns begin with an underscore."""
    return m.select(*[c for c in m.columns if not c.startswith("_")])


# --- tokens and budgets ---------------------------------------------------------------------------------------------


@query(MESSAGES, f"SELECT conv_id, turn, {TOK} AS tokens, {TOK} + 5 AS message_tokens, sum({TOK} + 5) OVER (PARTITION BY conv_id)::BIGINT AS conversation_tokens, (sum({TOK} + 5) OVER (PARTITION BY conv_id) * 4)::BIGINT AS kv_units FROM src")
def token_counts(m: DataFrame) -> DataFrame:
    n = K.of_message(C("content"))
    return m.select("conv_id", "turn", K.estimate(C("content")).alias("tokens"), n.alias("message_tokens")).withColumn("conversation_tokens", F.sum("message_tokens").over(Window.partitionBy("conv_id"))).withColumn("kv_units", C("conversation_tokens") * 4)


@query(CODE, "SELECT id, CAST(floor(coalesce(list_sum([length(b) FOR b IN regexp_extract_all(content, '(?s)```.*?```')]), 0) / 4) AS BIGINT) AS code_tokens FROM src")
def code_tokens(m: DataFrame) -> DataFrame:
    return m.select("id", K.in_fences(C("content")).alias("code_tokens"))


_RATIO = "greatest(0.5, least(2.0, prompt_tokens::DOUBLE / raw_tokens))"


@query(TRACES, f"""WITH r AS (SELECT session_id, turn, {_RATIO} AS ratio FROM src), p AS (SELECT *, lag(ratio, 1, 1.0::DOUBLE) OVER (PARTITION BY session_id ORDER BY turn) AS used FROM r)
    SELECT session_id, turn, round(ratio, 6) AS ratio, greatest(1, CAST(round_even(12000 * used, 0) AS BIGINT)) AS static_budget FROM p""")
def calibration(t: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn")
    r = t.withColumn("ratio", K.calibration(C("prompt_tokens"), C("raw_tokens"))).withColumn("used", F.lag("ratio", 1, 1.0).over(w))
    return r.select("session_id", "turn", F.round("ratio", 6).alias("ratio"), K.static_budget(K.Budget(), C("used")).alias("static_budget"))


@query(TRACES, """WITH p AS (SELECT *, lag(prompt_tokens) OVER (PARTITION BY session_id ORDER BY turn) AS last FROM src),
    b AS (SELECT *, greatest(least(12000 + 800 * turn + CAST(floor(0.25 * completion_tokens) AS BIGINT), 65536), coalesce(last, 0)) AS budget FROM p)
    SELECT session_id, turn, CAST(budget AS BIGINT) AS adaptive, CAST(CASE WHEN last IS NULL THEN budget ELSE least(budget, last + 1500) END AS BIGINT) AS enforced,
        CAST(CASE WHEN coalesce(last, 0) <= 0 THEN 1500 ELSE greatest(floor(last * 0.15::DOUBLE), 1500) END AS BIGINT) AS shrink_cap,
        CAST(CASE WHEN last IS NOT NULL THEN greatest(0, last - CASE WHEN last <= 0 THEN 1500 ELSE greatest(floor(last * 0.15::DOUBLE), 1500) END) END AS BIGINT) AS shrink_floor,
        CAST(greatest(1000, floor(budget * 0.37::DOUBLE)) AS BIGINT) AS tool_cap FROM b""")
def budgets(t: DataFrame) -> DataFrame:
    """The budget that each turn gets from its predecessor's size, its growth ceiling and shrink floor, and a sub-cap."""
    o, last = K.Budget(), C("last")
    p = t.withColumn("last", F.lag("prompt_tokens").over(Window.partitionBy("session_id").orderBy("turn")))
    p = p.withColumn("budget", K.adaptive_budget(o, C("turn"), C("completion_tokens"), last, F.lit(1.0)))
    return p.select("session_id", "turn", C("budget").alias("adaptive"), K.growth_limited(o, C("budget"), last).alias("enforced"), K.shrink_cap(o, last).alias("shrink_cap"), K.shrink_floor(o, last).alias("shrink_floor"), K.sub_cap(C("budget"), 0.37, 1000).alias("tool_cap"))


@query(TRACES, """WITH RECURSIVE s AS (SELECT * FROM src), f AS (
        SELECT session_id, turn, least(least(12000 + 800, 65536), raw_tokens * 6) AS output FROM s WHERE turn = 1
        UNION ALL SELECT s.session_id, s.turn, least(greatest(least(12000 + 800 * s.turn, 65536), f.output), f.output + 1500, s.raw_tokens * 6) FROM f JOIN s ON s.session_id = f.session_id AND s.turn = f.turn + 1)
    SELECT session_id, turn, CAST(output AS BIGINT) AS output FROM f""")
def adaptive_budget_fold(t: DataFrame) -> DataFrame:
    """The true recursion: each turn's output is its demand within a budget that depends on the output before."""
    o = K.Budget()
    sessions = t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "raw_tokens"))).alias("turns"))

    def step(done, x):
        last = F.element_at(done, -1)["output"]
        budget = K.growth_limited(o, K.adaptive_budget(o, x["turn"], F.lit(0), last, F.lit(1.0)), last)
        return F.concat(done, F.array(F.struct(x["turn"].alias("turn"), F.least(budget, x["raw_tokens"] * 6).cast("long").alias("output"))))

    first = F.element_at("turns", 1)
    start = F.array(F.struct(first["turn"].alias("turn"), F.least(F.lit(o.static() + o.growth_per_turn), first["raw_tokens"] * 6).cast("long").alias("output")))
    folded = F.aggregate(F.slice("turns", F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0))), start, step)
    return sessions.select("session_id", F.explode(folded).alias("f")).select("session_id", "f.turn", "f.output")


@query(TRACES, "WITH n AS (SELECT session_id, turn, prompt_tokens * turn AS t FROM src) SELECT session_id, turn, format('{:,}', t) || ' tokens (~' || format('{:,}', t * 4) || ' KV slots' || CASE WHEN t >= 10000 THEN ' — near context limit)' ELSE ')' END AS estimate FROM n")
def kv_estimate(t: DataFrame) -> DataFrame:
    return t.select("session_id", "turn", K.kv_estimate(C("prompt_tokens") * C("turn")).alias("estimate"))


@query(TRACES, "SELECT session_id, CAST(sum(greatest(0, raw_tokens - prompt_tokens)) AS BIGINT) AS saved, round(avg(prompt_tokens), 6) AS mean_prompt FROM src GROUP BY session_id")
def savings(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id").agg(F.sum(K.savings(C("raw_tokens"), C("prompt_tokens"))).alias("saved"), F.round(F.avg("prompt_tokens"), 6).alias("mean_prompt"))


@query(TRACES, """WITH f AS (SELECT session_id, arg_min(prompt_tokens - raw_tokens, turn) AS overhead, arg_min(prompt_tokens::DOUBLE / raw_tokens, turn) AS ratio FROM src GROUP BY session_id)
    SELECT s.session_id, s.turn, CAST(s.raw_tokens + f.overhead AS BIGINT) AS remote_estimate, CAST(round_even(s.raw_tokens * greatest(0.5, least(2.0, f.ratio)), 0) AS BIGINT) AS seeded_estimate FROM src s JOIN f USING (session_id)""")
def calibration_seed(t: DataFrame) -> DataFrame:
    """The session's first measured overhead and ratio, applied to all its turns."""
    first = t.groupBy("session_id").agg(F.min_by(C("prompt_tokens") - C("raw_tokens"), "turn").alias("overhead"), F.min_by(C("prompt_tokens") / C("raw_tokens"), "turn").alias("ratio"))
    j = t.join(first, "session_id")
    return j.select("session_id", "turn", (C("raw_tokens") + C("overhead")).alias("remote_estimate"), F.bround(C("raw_tokens") * F.greatest(F.lit(0.5), F.least(F.lit(2.0), C("ratio")))).cast("long").alias("seeded_estimate"))
