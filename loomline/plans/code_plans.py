"""Code blocks, symbols and deltas (sections 2.5 and parts of 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import code as K
from loomline.plans.registry import BARE_CODE, CODE, query
from loomline.plans.text_plans import ordered_join

C = F.col
_B = "b AS (SELECT *, regexp_extract_all(content, '(?s)```([^\\n`]*)\\n(.*?)```', 1) AS tags, regexp_extract_all(content, '(?s)```([^\\n`]*)\\n(.*?)```', 2) AS bodies FROM src)"
_E = f"{_B}, e AS (SELECT id, conv_id, turn, unnest(tags) AS tag, unnest(bodies) AS body, generate_subscripts(tags, 1) - 1 AS block FROM b)"


def exploded(m: DataFrame) -> DataFrame:
    """A row per fenced block."""
    return m.select("id", "conv_id", "turn", F.posexplode(K.code_blocks(C("content"))).alias("block", "b")).select("id", "conv_id", "turn", "block", C("b.tag").alias("tag"), C("b.body").alias("body"))


@query(CODE, f"WITH {_E} SELECT id, block, tag, body, strpos(body, 'def ') AS at FROM e")
def code_blocks(m: DataFrame) -> DataFrame:
    return exploded(m).select("id", "block", "tag", "body", F.instr("body", "def ").cast("long").alias("at"))


_LANG = "coalesce(CASE lower(trim(tag)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LANGUAGES.items()) + r" END, CASE WHEN length(body) < 40 THEN 'generic' WHEN regexp_matches(body, '(?m)^\s*def \w+\(.*\):') THEN 'python' WHEN regexp_matches(body, '\bfunction \w+\(|\bconst \w+ =') THEN 'javascript' WHEN regexp_matches(body, '\bfn \w+\(') THEN 'rust' ELSE 'generic' END)"


@query(CODE, f"WITH {_E} SELECT id, block, {_LANG} AS language FROM e")
def language_detect(m: DataFrame) -> DataFrame:
    return exploded(m).select("id", "block", K.language(C("tag"), C("body")).alias("language"))


_SKEL = r"array_to_string([CASE WHEN regexp_matches(trim(x), '^(def |class |import |from |function |pub fn |fn )') OR trim(x) = '' OR starts_with(trim(x), '#') THEN x ELSE repeat(' ', length(x) - length(ltrim(x))) || '...' END FOR x IN string_split(content, chr(10))], chr(10))"


@query(BARE_CODE, f"SELECT id, {_SKEL} AS skeleton, round(length({_SKEL})::DOUBLE / length(content), 2) AS ratio FROM src")
def skeleton_lines(m: DataFrame) -> DataFrame:
    s = m.select("id", "content", K.skeleton(C("content")).alias("skeleton"))
    return s.select("id", "skeleton", F.round(F.length("skeleton") / F.length("content"), 2).alias("ratio"))


@query(BARE_CODE, "SELECT id, array_to_string([trim(x) FOR x IN string_split(content, chr(10)) IF regexp_matches(trim(x), '^(def |class |import |from )')], chr(10)) AS outline FROM src")
def outline(m: DataFrame) -> DataFrame:
    kept = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(def |class |import |from )"))
    return m.select("id", F.array_join(kept, "\n").alias("outline"))


@query(CODE, f"""WITH p AS (SELECT id, string_split(content, '```') AS ps FROM src), e AS (SELECT id, i, ps[i] AS p FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
    b AS (SELECT id, i, p, i % 2 = 0 AND contains(p, chr(10)) AS fenced, string_split(regexp_replace(p, '^[^\\n]*\\n', ''), chr(10)) AS ls FROM e),
    k AS (SELECT id, i, CASE WHEN fenced THEN split_part(p, chr(10), 1) || chr(10) || array_to_string([CASE WHEN regexp_matches(trim(x), '{K.SKELETON}') OR trim(x) = '' OR starts_with(trim(x), '#') THEN x ELSE repeat(' ', length(x) - length(ltrim(x))) || '...' END FOR x IN ls], chr(10)) ELSE p END AS t FROM b)
    SELECT id, string_agg(t, '```' ORDER BY i) AS content FROM k GROUP BY id""")
def skeleton_fences(m: DataFrame) -> DataFrame:
    return m.select("id", K.over_fences(C("content"), K.skeleton).alias("content"))


@query(BARE_CODE)
def ast_skeleton(m: DataFrame) -> DataFrame:
    return m.select("id", K.skeleton_udf("content").alias("skeleton"))


@query(BARE_CODE)
def ast_chunks(m: DataFrame) -> DataFrame:
    return m.select("id", F.posexplode(K.chunks_udf("content")).alias("chunk_index", "chunk"))


@query(BARE_CODE)
def ast_symbols(m: DataFrame) -> DataFrame:
    return m.select("id", F.explode(K.symbols_udf("content")).alias("s")).select("id", "s.*")


@query(BARE_CODE)
def slice_to_query(m: DataFrame) -> DataFrame:
    asked = F.concat(F.lit("change run_"), (C("id") % 13).cast("string"))
    return m.select("id", K.slice_udf("content", asked).alias("sliced"))


@query(CODE)
def block_optimise(m: DataFrame) -> DataFrame:
    """Blocks cut at 120 characters by lines, equal chunks once, joined again; the text stays if anything would be lost."""
    from loomline.operators.lines import packed

    whole = lambda body: F.array_join(F.array_distinct(packed(body, 120)), "\n")
    e = exploded(m).withColumn("after", whole(C("body")))
    return e.select("id", "block", F.when(F.length("after") == F.length("body"), C("after")).otherwise(C("body")).alias("body"))


DOUBLED = f"SELECT id, conv_id, turn, content || chr(10) || content AS content FROM ({CODE})"


@query(DOUBLED, """WITH p AS (SELECT id, string_split(content, '```') AS ps FROM src)
    SELECT id, array_to_string([CASE WHEN i % 2 = 0 AND (len(ps) % 2 = 1 OR i < len(ps)) THEN CASE WHEN list_contains([ps[j] FOR j IN range(2, i, 2)], ps[i]) THEN '' ELSE '```' || ps[i] || '```' END WHEN i % 2 = 0 THEN '```' || ps[i] ELSE ps[i] END FOR i IN range(1, len(ps) + 1)], '') AS content FROM p""")
def dup_blocks(m: DataFrame) -> DataFrame:
    return m.select("id", K.without_repeated_blocks(C("content")).alias("content"))


@query(CODE)
def cache_chunks(m: DataFrame) -> DataFrame:
    """The last message of each conversation cut at fences into groups of 128 characters, each a message."""
    last = m.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k = 1")
    return last.select("conv_id", F.posexplode(K.fence_groups(C("content"))).alias("part", "content"))


_SIGS = r"[split_part(trim(x), ':', 1) FOR x IN string_split(body, chr(10)) IF regexp_matches(trim(x), '^(def |class |function |async def )')]"


@query(CODE, f"""WITH {_E}, s AS (SELECT conv_id, turn, block, unnest({_SIGS}) AS sig, generate_subscripts({_SIGS}, 1) AS i FROM e), f AS (SELECT conv_id, sig, min(turn * 10000 + block * 100 + i) AS first FROM s GROUP BY conv_id, sig),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS k FROM f) SELECT conv_id, '[Evicted-turn code index]' || chr(10) || string_agg(sig, chr(10) ORDER BY first) AS ledger FROM r WHERE k <= 40 GROUP BY conv_id""")
def code_ledger(m: DataFrame) -> DataFrame:
    """The distinct signatures of a conversation's code in the order of their first appearance, 40 at most (the operator's limit)."""
    s = exploded(m).select("conv_id", "turn", "block", F.posexplode(K.signatures(C("body"))).alias("i", "sig"))
    f = s.groupBy("conv_id", "sig").agg(F.min(F.struct("turn", "block", "i")).alias("first"))
    k = f.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("first"))).where("k <= 40")
    return k.groupBy("conv_id").agg(F.concat(F.lit("[Evicted-turn code index]\n"), ordered_join(C("sig"), "k")).alias("ledger"))


# Versions of files: a path and its bodies over time.
VERSIONS = "SELECT p_partkey AS id, 'src/f' || CAST(p_partkey % 60 AS STRING) || '.py' AS path, p_partkey AS version, 'x = ' || CAST(p_size AS STRING) || chr(10) || 'y = 2' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'z = 3' ELSE 'w = 4' END AS content FROM {part}"


@query(VERSIONS)
def delta_prev(m: DataFrame) -> DataFrame:
    """Changed lines against the path's previous version."""
    old = F.lag("content").over(Window.partitionBy("path").orderBy("version"))
    return m.withColumn("old", old).select("id", "path", K.delta_udf("old", "content").alias("delta"))


@query(VERSIONS, "WITH p AS (SELECT *, lag(content) OVER (PARTITION BY path ORDER BY version) AS old FROM src) SELECT id, md5(path || ':' || substr(md5(content), 1, 16)) AS snapshot_key, old IS NOT NULL AND old <> content AS has_delta FROM p")
def snapshot_keys(m: DataFrame) -> DataFrame:
    old = F.lag("content").over(Window.partitionBy("path").orderBy("version"))
    key = F.md5(F.concat("path", F.lit(":"), F.substring(F.md5("content"), 1, 16)))
    return m.withColumn("old", old).select("id", key.alias("snapshot_key"), (C("old").isNotNull() & (C("old") != C("content"))).alias("has_delta"))


@query(VERSIONS)
def delta_inject(m: DataFrame) -> DataFrame:
    """A version read again is replaced by its delta where the context still holds the version before, and the delta is shorter."""
    w = Window.partitionBy("path").orderBy("version")
    d = m.withColumn("old", F.lag("content").over(w)).withColumn("context", F.concat_ws("\n", F.lag("content", 2).over(w), F.lag("content").over(w)))
    d = d.withColumn("delta", K.delta_udf("old", "content"))
    use = C("old").isNotNull() & C("context").contains(C("old")) & (F.length("delta") < F.length("content"))
    return d.select("id", F.when(use, F.concat(F.lit("[delta] "), "path", F.lit("\n"), "delta")).otherwise(C("content")).alias("content"))


@query(VERSIONS)
def snapshot_stats(m: DataFrame) -> DataFrame:
    """Characters of deltas and of full bodies by path, over the last 100 snapshots of each (the store's limit)."""
    w = Window.partitionBy("path")
    d = m.withColumn("old", F.lag("content").over(w.orderBy("version"))).withColumn("k", F.row_number().over(w.orderBy(F.desc("version")))).where("k <= 100")
    d = d.withColumn("delta", K.delta_udf("old", "content"))
    return d.groupBy("path").agg(F.sum(F.length("delta")).alias("delta_chars"), F.sum(F.length("content")).alias("full_chars"), F.count("*").alias("snapshots"))


_SYM = " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(x, '{p}', 1)) AS name, '{t}' AS type, i AS line FROM l" for p, t in K.SYMBOLS)
_SYMS = f"l AS (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src), s AS ({_SYM})"


def symbol_table(m: DataFrame) -> DataFrame:
    return m.select("id", F.explode(K.symbols(C("content"))).alias("s")).select("id", "s.*")


@query(BARE_CODE, f"WITH {_SYMS} SELECT id, name, type, line::INT AS line FROM s")
def symbols(m: DataFrame) -> DataFrame:
    return symbol_table(m)


@query(BARE_CODE, f"WITH {_SYMS}, r AS (SELECT *, row_number() OVER (ORDER BY id, line) AS k FROM s WHERE lower(name) = 'run_3') SELECT id, name, line::INT AS line FROM r WHERE k <= 10")
def symbol_exact(m: DataFrame) -> DataFrame:
    """Symbols named run_3, cases apart; the first ten (the operator's limit)."""
    return symbol_table(m).where(F.lower("name") == "run_3").orderBy("id", "line").limit(10).select("id", "name", "line")


@query(BARE_CODE, f"""WITH {_SYMS}, r AS (SELECT *, CASE WHEN contains(lower(name), 'run_1') THEN 0 WHEN levenshtein(lower(name), 'run_1') <= 2 THEN 1 END AS rank FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY rank, CASE type WHEN 'class_definition' THEN 0 ELSE 1 END, name, id, line) AS k FROM r WHERE rank IS NOT NULL) SELECT id, name, rank::INT AS rank FROM o WHERE k <= 10""")
def symbol_fuzzy(m: DataFrame) -> DataFrame:
    """Symbols that contain run_1, then those within two edits of it; the ten best (the operator's limit)."""
    low = F.lower("name")
    rank = F.when(low.contains("run_1"), 0).when(F.levenshtein(low, F.lit("run_1")) <= 2, 1)
    r = symbol_table(m).withColumn("rank", rank).where(C("rank").isNotNull())
    return r.orderBy("rank", F.when(C("type") == "class_definition", 0).otherwise(1), "name", "id", "line").limit(10).select("id", "name", "rank")


@query(BARE_CODE, f"WITH {_SYMS}, c AS (SELECT s.id, s.name, s.line, string_agg(l.x, chr(10) ORDER BY l.i) AS context FROM s JOIN l ON l.id = s.id AND l.i BETWEEN s.line - 2 AND s.line + 2 GROUP BY s.id, s.name, s.line) SELECT id, name, line::INT AS line, context FROM c")
def symbol_context(m: DataFrame) -> DataFrame:
    """Two lines on either side of each symbol."""
    s = m.select("id", F.split("content", "\n").alias("ls"), F.explode(K.symbols(C("content"))).alias("s"))
    first = F.greatest(C("s.line") - 2, F.lit(1))
    around = F.array_join(F.slice("ls", first, C("s.line") + 3 - first), "\n")
    return s.select("id", C("s.name").alias("name"), C("s.line").alias("line"), around.alias("context"))


@query(BARE_CODE, f"WITH {_SYMS} SELECT type, count(*) AS n, count(DISTINCT name) AS names, count(DISTINCT id) AS files FROM s GROUP BY type")
def symbol_lookups(m: DataFrame) -> DataFrame:
    return symbol_table(m).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("id").alias("files"))


_IMP = r"list_distinct(list_concat(regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)', 1), regexp_extract_all(content, 'from\s+''(\.[^'']+)''', 1)))"


@query(CODE, f"SELECT id, unnest({_IMP}) AS dep FROM src")
def import_edges(m: DataFrame) -> DataFrame:
    return m.select("id", F.explode(K.imports(C("content"))).alias("dep"))


@query(CODE, f"WITH d AS (SELECT id, unnest({_IMP}) AS dep FROM src), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dep) AS k FROM d) SELECT id, string_agg(dep, ',' ORDER BY dep) AS deps FROM r WHERE k <= 3 GROUP BY id")
def dependency_context(m: DataFrame) -> DataFrame:
    """Up to three dependencies of a file, in the order of names (the operator's limit)."""
    k = F.row_number().over(Window.partitionBy("id").orderBy("dep"))
    return import_edges(m).withColumn("k", k).where("k <= 3").groupBy("id").agg(ordered_join(C("dep"), "dep", ",").alias("deps"))


@query(VERSIONS, "WITH l AS (SELECT path, max(version) AS version FROM src GROUP BY path), r AS (SELECT *, row_number() OVER (ORDER BY version DESC) AS k FROM l) SELECT path, version FROM r WHERE k <= 5")
def active_files(m: DataFrame) -> DataFrame:
    """The five files read last (the operator's limit)."""
    return m.groupBy("path").agg(F.max("version").alias("version")).orderBy(F.desc("version")).limit(5)


@query(CODE, "SELECT id, contains(content, '```') AND regexp_matches(content, '(?s)```.*?```') AS has_block, substr(sha256(content), 1, 16) AS handle FROM src")
def has_block(m: DataFrame) -> DataFrame:
    return m.select("id", C("content").rlike(r"(?s)```.*?```").alias("has_block"), T.handle(C("content")).alias("handle"))


HTML = "SELECT page_id, html FROM {pages}"


@query(HTML, "SELECT page_id, len(regexp_extract_all(html, '<(h1|p|li|div|article|nav)[ >]', 1)) AS blocks, md5(array_to_string(regexp_extract_all(html, '<([a-z0-9]+)[ >/]', 1), ' ')) AS signature FROM src")
def html_signatures(p: DataFrame) -> DataFrame:
    blocks = F.size(F.regexp_extract_all("html", F.lit("<(h1|p|li|div|article|nav)[ >]"), F.lit(1)))
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >/]"), F.lit(1))
    return p.select("page_id", blocks.cast("long").alias("blocks"), F.md5(F.array_join(tags, " ")).alias("signature"))
