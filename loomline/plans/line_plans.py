"""Tool outputs line by line (section 2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import lines as L
from loomline.plans.registry import CODE, LOGS, MESSAGES, VOLATILE_TEXT, query

C = F.col
_q = lambda s: s.replace("'", "''")
_ml = lambda p: _q(L.per_line(p))
# Written apart from the operator's patterns: what the words, marks and rules mean, a condition each.
_FAIL_WORDS = "error errors failed failure failures panic fatal traceback exception exceptions asserterror assertionerror unresolved cannot could_not no_such not_found permission_denied segfault aborted".split()
_FAILS = "(" + " OR ".join([
    *(rf"regexp_matches(lower(text), '\b{w.replace('_', ' ')}\b')" for w in _FAIL_WORDS), r"regexp_matches(lower(text), '\bexpected\b.*\bgot\b')", "regexp_matches(chr(10) || text, '\\n[✗✘❌]')", r"regexp_matches(chr(10) || lower(text), '\n(fail|error|panic|fatal)\b')",
    f"regexp_matches(text, '{_ml(L.FRAME)}')",
]) + ")"
_RULES = "CASE " + " ".join(f"WHEN {c} THEN '{m}'" for c, m in [
    (r"regexp_matches(chr(10) || lower(text), '\n(ok\s+\S+\s+[0-9.]+s|\?\s+\S+\s+\S)')", "[go test result]"), (r"regexp_matches(text || chr(10), '(?i)(\[100%\]\n|passed[^\n]*failed)')", "[pytest result]"),
    (r"regexp_matches(chr(10) || lower(text), '\non branch \S')", "[git status]"), (r"regexp_matches(chr(10) || lower(text), '\n[0-9a-f]{7,40}\s+[^\n]*\n')", "[git log]"), (r"regexp_matches(lower(text), '\|[^\n]*\n[0-9]+ files? changed')", "[git diff stat]"),
    (r"regexp_matches(chr(10) || lower(text), '\n(build succeeded|build complete|compilation succeeded)')", "[build success]"), (r"regexp_matches(chr(10) || lower(text), '\nfound [0-9]+ warnings?')", "[lint summary]"), (r"regexp_matches(chr(10) || lower(text), '\n(command finished successfully|process completed|done\.|done in [0-9]+\.[0-9]+s)')", "[shell ok]"),
]) + " ELSE text END"
_LINES = "l AS (SELECT log_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src)"


@query(LOGS, f"SELECT log_id, {_FAILS} AS fails, CASE WHEN length(text) < 200 OR {_FAILS} THEN text ELSE {_RULES} END AS filtered FROM src")
def rule_filter(d: DataFrame) -> DataFrame:
    return d.select("log_id", L.failure_signal(C("text")).alias("fails"), L.filtered(C("text")).alias("filtered"))


@query(LOGS, f"SELECT log_id, CASE WHEN length(text) < 100 OR {_FAILS} THEN text WHEN regexp_matches(text, 'filler line d') THEN '[filler]' ELSE text END AS filtered FROM src")
def custom_rule(d: DataFrame) -> DataFrame:
    return d.select("log_id", L.filtered(C("text"), [("filler line d", "[filler]")], 100).alias("filtered"))


@query(LOGS, rf"SELECT log_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{L.ANSI}', '', 'g') AS plain FROM src")
def strip_ansi(d: DataFrame) -> DataFrame:
    return d.select("log_id", L.without_ansi(C("text")).alias("plain"))


_RUNS = """{lines},
    s AS (SELECT *, CASE WHEN x = '' OR lag(x) OVER (PARTITION BY {id} ORDER BY i) IS DISTINCT FROM x THEN 1 ELSE 0 END AS new FROM l),
    g AS (SELECT *, sum(new) OVER (PARTITION BY {id} ORDER BY i) AS run FROM s),
    r AS (SELECT {id}, run, min(i) AS i, any_value(x) AS x, count(*) AS n FROM g GROUP BY {id}, run)
    SELECT {id}, string_agg(CASE WHEN n >= 3 THEN x || chr(10) || '... (repeated ' || n || ' times) ...' WHEN n = 2 THEN x || chr(10) || x ELSE x END, chr(10) ORDER BY i) AS collapsed FROM r GROUP BY {id}"""


@query(LOGS, "WITH " + _RUNS.format(lines=_LINES, id="log_id"))
def line_runs(d: DataFrame) -> DataFrame:
    return d.select("log_id", L.collapsed_runs(C("text")).alias("collapsed"))


@query("documents", "WITH " + _RUNS.format(lines="l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src)", id="doc_id"))
def document_runs(d: DataFrame) -> DataFrame:
    return d.select("doc_id", L.collapsed_runs(C("text")).alias("collapsed"))


_FRAMES = f"""WITH {_LINES}, f AS (SELECT *, regexp_matches(x, '{_q(L.STACK_FRAME)}') AS frame FROM l),
    s AS (SELECT *, CASE WHEN frame AND lag(frame) OVER (PARTITION BY log_id ORDER BY i) IS NOT DISTINCT FROM true THEN 0 ELSE 1 END AS new FROM f),
    g AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY i) AS run FROM s),
    b AS (SELECT log_id, run, min(i) AS i, any_value(frame) AS frame, string_agg(x, chr(10) ORDER BY i) AS body, count(*) AS n FROM g GROUP BY log_id, run),
    k AS (SELECT *, row_number() OVER (PARTITION BY log_id, frame, body ORDER BY i) AS seen FROM b)
    SELECT log_id, string_agg(CASE WHEN frame AND seen > 1 THEN '... (stack frame block repeated; omitted ' || n || ' lines) ...' ELSE body END, chr(10) ORDER BY i) AS collapsed FROM k GROUP BY log_id"""


@query(LOGS, _FRAMES)
def frame_blocks(d: DataFrame) -> DataFrame:
    return d.select("log_id", L.collapsed_frames(C("text")).alias("collapsed"))


_AWARE = f"""{_LINES}, k AS (SELECT *, regexp_matches(x, '{_q(L.FRAME)}') AS frame, regexp_matches(x, '{_q(L.FAILURE)}') OR regexp_matches(x, '{_q(L.OUTCOME)}') AS word,
        regexp_matches(x, '{_q(L.FAILURE)}') OR regexp_matches(x, '{_q(L.FRAME)}') AS fail, regexp_matches(x, '{_q(L.OUTCOME)}') AS outcome, regexp_matches(x, '{_q(L.NOISE)}') AS noise FROM l),
    w AS (SELECT *, max(i) OVER p AS n, bool_or(fail) OVER p AS fails, bool_or(outcome) OVER p AS has_outcome, coalesce(lead(frame OR word) OVER o, false) AS before, coalesce(lag(frame OR word) OVER o, false) AS after1, coalesce(lag(frame, 2) OVER o, false) AS after2
        FROM k WINDOW p AS (PARTITION BY log_id), o AS (PARTITION BY log_id ORDER BY i)),
    kept AS (SELECT * FROM w WHERE (i <= 4 OR i > n - 4 OR frame OR word OR before OR after1 OR after2) AND NOT (noise AND NOT word)),
    gaps AS (SELECT *, lag(i) OVER (PARTITION BY log_id ORDER BY i) AS prev FROM kept),
    out AS (SELECT log_id, string_agg(CASE WHEN prev IS NOT NULL AND i <> prev + 1 THEN '...' || chr(10) || x ELSE x END, chr(10) ORDER BY i) AS body FROM gaps WHERE fails AND has_outcome GROUP BY log_id),
    verdict AS (SELECT log_id, trim(arg_min(x, i)) AS v FROM w WHERE has_outcome AND NOT fails AND outcome GROUP BY log_id)"""


def _extracted(most: int) -> str:
    return f"""WITH {_AWARE} SELECT s.log_id, CASE WHEN v IS NOT NULL THEN v || chr(10) || '{L.AWARE} success collapsed ' || length(text) || ' -> ~' || length(v) || ' chars] ...'
    WHEN length(body) > {most} THEN substr(body, 1, {most}) || chr(10) || '{L.AWARE} capped at {most} chars] ...' WHEN length(body) < length(text) THEN body || chr(10) || '{L.AWARE} ' || length(text) || ' -> ' || length(body) || ' chars] ...' ELSE body END AS extracted
    FROM src s LEFT JOIN out o USING (log_id) LEFT JOIN verdict v USING (log_id)"""


@query(LOGS, _extracted(160))
def error_context(d: DataFrame) -> DataFrame:
    return d.select("log_id", L.error_aware(C("text"), 160).alias("extracted"))


@query("documents", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 600) || chr(10) || '... [tool output truncated: ' || (length(text) - 1000) || ' chars omitted] ...' || chr(10) || right(text, 400) END AS cut FROM src")
def head_tail(d: DataFrame) -> DataFrame:
    return d.select("doc_id", L.head_tail(C("text"), 1000).alias("cut"))


@query("documents", "SELECT source, sum(length(text))::BIGINT AS chars_in, sum(least(length(text), 2000))::BIGINT AS chars_kept, count(*) FILTER (WHERE length(text) > 2000) AS cut FROM src GROUP BY source")
def compress_savings_by_source(d: DataFrame) -> DataFrame:
    n = F.length("text")
    return d.groupBy("source").agg(F.sum(n).alias("chars_in"), F.sum(F.least(n, F.lit(2000))).alias("chars_kept"), F.count_if(n > 2000).alias("cut"))


#: Characters that each tool may put out; the default for others.
TOOL_CAPS = {"error": 600, "view": 150, "click": 200}
_CAP = "CASE tool " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOOL_CAPS.items()) + " ELSE 300 END"


@query(LOGS, f"SELECT tool, count(*) AS outputs, sum(length(text))::BIGINT AS chars_in, sum(CASE WHEN length(text) > {_CAP} THEN 1 ELSE 0 END)::BIGINT AS over FROM src GROUP BY tool")
def tool_budget(d: DataFrame) -> DataFrame:
    """Outputs over their tool's own cap; the caps are a small fixed table."""
    caps = F.create_map(*[F.lit(x) for kv in TOOL_CAPS.items() for x in kv])
    cap = F.coalesce(caps[C("tool")], F.lit(300))
    return d.groupBy("tool").agg(F.count("*").alias("outputs"), F.sum(F.length("text")).alias("chars_in"), F.sum((F.length("text") > cap).cast("long")).alias("over"))


def _compressed(source: str, most: int) -> str:
    """A query of log_id and compressed of a table with log_id and text: the steps one after the other, each the lone operator's SQL."""
    step = lambda sql, of: f"WITH src AS (SELECT * FROM {of}), {sql.strip()[5:]}"
    runs, first = "WITH " + _RUNS.format(lines=_LINES, id="log_id"), int(most * 0.6)
    plain = rf"SELECT log_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{L.ANSI}', '', 'g') AS text FROM {source} WHERE length(text) > {most}"
    cut = f"CASE WHEN length(c2.text) <= {most} THEN c2.text ELSE substr(c2.text, 1, {first}) || chr(10) || '{L.TRUNCATED} ' || (length(c2.text) - {most}) || ' chars omitted] ...' || chr(10) || right(c2.text, {most - first}) END"
    return f"""WITH c0 AS ({plain}), c1 AS (SELECT log_id, collapsed AS text FROM ({step(_FRAMES, "c0")})), c2 AS (SELECT log_id, collapsed AS text FROM ({step(runs, "c1")})), c3 AS ({step(_extracted(most), "c2")})
        SELECT s.log_id, CASE WHEN length(s.text) <= {most} THEN s.text ELSE coalesce(c3.extracted, {cut}) END AS compressed FROM {source} s LEFT JOIN c2 ON c2.log_id = s.log_id LEFT JOIN c3 ON c3.log_id = s.log_id"""


@query(LOGS, f"WITH z AS ({_compressed('src', 200)}) SELECT log_id, tool, compressed FROM z JOIN src USING (log_id)")
def compress_tool_output(d: DataFrame) -> DataFrame:
    return d.select("log_id", "tool", L.compressed(C("text"), 200).alias("compressed"))


@query(LOGS, f"WITH z AS ({_compressed('src', 200)}) SELECT tool, sum(length(text))::BIGINT AS chars_in, sum(length(compressed))::BIGINT AS chars_out FROM z JOIN src USING (log_id) GROUP BY tool")
def tool_savings(d: DataFrame) -> DataFrame:
    """Characters in and out of compression by tool."""
    out = d.select("tool", F.length("text").alias("a"), F.length(L.compressed(C("text"), 200)).alias("b"))
    return out.groupBy("tool").agg(F.sum("a").alias("chars_in"), F.sum("b").alias("chars_out"))


_MASKED = "compressed"
for _p, _m in T.VOLATILE:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_m}', 'g')"


@query(LOGS, f"""WITH tools AS (SELECT log_id, CASE WHEN length(text) < 200 OR {_FAILS} THEN text ELSE {_RULES} END AS text FROM src WHERE log_id % 3 <> 0), users AS (SELECT log_id, text FROM src WHERE log_id % 3 = 0)
    SELECT log_id, 'tool' AS role, {_MASKED} AS content FROM ({_compressed('tools', 250)}) UNION ALL SELECT log_id, 'user', compressed FROM ({_compressed('users', 300)})""")
def boundary_pipeline(d: DataFrame) -> DataFrame:
    role = F.when(C("log_id") % 3 == 0, "user").otherwise("tool")
    return d.select("log_id", role.alias("role"), L.boundary(C("text"), role, 250, 300, T.masked).alias("content"))


@query(MESSAGES, """WITH p AS (SELECT *, CASE WHEN role = 'user' AND length(content) > 300 THEN substr(content, 1, 180) || chr(10) || '... [tool output truncated: ' || (length(content) - 300) || ' chars omitted] ...' || chr(10) || right(content, 120) ELSE content END AS short FROM src)
    SELECT conv_id, turn, length(short) AS chars FROM p""")
def paste_compress(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", F.length(F.when(C("role") == "user", L.head_tail(C("content"), 300)).otherwise(C("content"))).alias("chars"))


@query(MESSAGES, """WITH r AS (SELECT *, sum(length(content) + length(content) % 7) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM src)
    SELECT conv_id, turn, coalesce(after, 0) < 1500 AS transformed FROM r""")
def live_floor(m: DataFrame) -> DataFrame:
    """Newest first, messages are transformed until the transformed ones reach the floor: a reversed running sum."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.sum(F.length("content") + F.length("content") % 7).over(w)
    return m.select("conv_id", "turn", (F.coalesce(after, F.lit(0)) < 1500).alias("transformed"))


_DUP = "SELECT doc_id % 50 AS conv_id, doc_id AS turn, text AS content FROM {documents}"


@query(_DUP, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sha256(content) ORDER BY turn) AS k FROM src)
    SELECT conv_id, turn, CASE WHEN k > 1 AND length(content) >= 200 THEN '[original retained: handle=' || substr(sha256(content), 1, 16) || ', ' || length(content) || ' chars; duplicate output]' ELSE content END AS content FROM r""")
def dup_output(d: DataFrame) -> DataFrame:
    """A long output seen before in its session becomes a placeholder with the original's handle."""
    return L.deduplicated(d).select("conv_id", "turn", "content")


@query(_DUP, "SELECT turn, content AS original FROM src")
def handle_expand(d: DataFrame) -> DataFrame:
    """Placeholders looked up in the table of originals by the handle they carry."""
    placed = dup_output(d)
    originals = d.groupBy(T.handle(C("content")).alias("handle")).agg(F.min("content").alias("stored"))
    held = placed.withColumn("handle", F.nullif(F.regexp_extract("content", r"^\[original retained: handle=([0-9a-f]{16}),", 1), F.lit("")))
    joined = held.where("handle is not null").join(originals, "handle", "left").select("turn", F.coalesce("stored", "content").alias("original"))
    return joined.union(held.where("handle is null").select("turn", "content"))


@query(CODE, None)
def stream_split(d: DataFrame) -> DataFrame:
    """Texts split at fences, the parts packed into chunks of 256 characters by lines."""
    parts = F.transform(F.split("content", T.FENCE), lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(T.FENCE), p, F.lit(T.FENCE))).otherwise(p))
    return d.select("id", F.posexplode(F.flatten(F.transform(parts, lambda p: L.packed(p, 256)))).alias("chunk_index", "chunk"))


@query("documents", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src),
    f AS (SELECT doc_id, i, length(x) AS n, 0 AS chunk FROM l WHERE i = 1 UNION ALL
        SELECT l.doc_id, l.i, CASE WHEN f.n + length(l.x) <= 400 THEN f.n + length(l.x) ELSE length(l.x) END, CASE WHEN f.n + length(l.x) <= 400 THEN f.chunk ELSE f.chunk + 1 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
    SELECT f.doc_id, f.chunk AS chunk_index, string_agg(l.x, chr(10) ORDER BY l.i) AS chunk FROM f JOIN l USING (doc_id, i) GROUP BY f.doc_id, f.chunk""")
def line_chunks(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(L.packed(C("text"), 400)).alias("chunk_index", "chunk"))


@query("documents", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src),
    f AS (SELECT doc_id, i, length(x) AS n, 0 AS chunk FROM l WHERE i = 1 UNION ALL
        SELECT l.doc_id, l.i, CASE WHEN f.n + length(l.x) <= 400 THEN f.n + length(l.x) ELSE length(l.x) END, CASE WHEN f.n + length(l.x) <= 400 THEN f.chunk ELSE f.chunk + 1 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
    c AS (SELECT f.doc_id, f.chunk, md5(trim(string_agg(l.x, chr(10) ORDER BY l.i))) AS h FROM f JOIN l USING (doc_id, i) GROUP BY f.doc_id, f.chunk)
    SELECT doc_id, h AS chunk_hash, min(chunk) AS first_chunk, count(*) AS copies FROM c GROUP BY doc_id, h""")
def chunk_dedup(d: DataFrame) -> DataFrame:
    return line_chunks(d).groupBy("doc_id", F.md5(F.trim("chunk")).alias("chunk_hash")).agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("copies"))


@query(VOLATILE_TEXT, "SELECT count(*) FILTER (WHERE role = 'tool') AS tools, count(*) AS rows FROM src")
def tool_rows(d: DataFrame) -> DataFrame:
    return d.agg(F.count_if(C("role") == "tool").alias("tools"), F.count("*").alias("rows"))
