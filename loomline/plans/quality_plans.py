"""Evaluation metrics (section 2.11) and statistics and gates (section 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import quality as Q
from loomline.plans.registry import CODE, MESSAGES, ORACLE, QUERIES, TRACES, fixture, query, table
from loomline.plans.text_plans import ordered_join

C = F.col

# Consecutive messages of a conversation as a pair of texts.
PAIRS = "SELECT conv_id, turn, text AS b, prev AS a FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {conversations}) WHERE prev IS NOT NULL"
# A conversation's whole text, and the same without its second and third message.
COMPACTED = """SELECT conv_id, string_agg(text, ' ') AS full_text, string_agg(CASE WHEN turn IN (1, 2) THEN '' ELSE text END, ' ') AS optimised FROM (SELECT conv_id, turn, text FROM {conversations}) GROUP BY conv_id"""
_WS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
_SET = "list_distinct(" + _WS + ")"
_INTER = "len(list_intersect({a}, {b}))::DOUBLE"
_SA, _SB = _SET.format("a"), _SET.format("b")


@query(PAIRS, f"""WITH s AS (SELECT conv_id, turn, {_SA} AS sa, {_SB} AS sb FROM src), i AS (SELECT *, {_INTER.format(a='sa', b='sb')} AS n FROM s)
    SELECT conv_id, turn, CASE WHEN len(sa) > 0 AND len(sb) > 0 THEN round(n / (len(sa) + len(sb) - n), 6) END AS jaccard, CASE WHEN len(sa) > 0 AND len(sb) > 0 THEN round(n / len(sa), 6) END AS recall FROM i""")
def token_overlap(p: DataFrame) -> DataFrame:
    a, b = Q.word_set(C("a")), Q.word_set(C("b"))
    return p.withColumn("sa", a).withColumn("sb", b).select("conv_id", "turn", Q.jaccard(C("sa"), C("sb")).alias("jaccard"), Q.recall(C("sa"), C("sb")).alias("recall"))


@query(PAIRS, f"""WITH w AS (SELECT conv_id, turn, {_WS.format('a')} AS wa, {_SB} AS sb FROM src), e AS (SELECT *, list_distinct(wa[1:CAST(floor(len(wa) * 0.6::DOUBLE) AS BIGINT)]) AS early FROM w)
    SELECT conv_id, turn, CASE WHEN len(wa) >= 40 AND len(sb) > 0 THEN round({_INTER.format(a='early', b='sb')} / len(early), 6) END AS evicted_recall FROM e""")
def evicted_recall(p: DataFrame) -> DataFrame:
    return p.select("conv_id", "turn", Q.evicted_recall(C("a"), C("b")).alias("evicted_recall"))


@query("SELECT d.doc_id, b.item_id, d.text AS a, b.text AS b FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM {benchmark}) AS k FROM {documents}) d JOIN {benchmark} b ON b.item_id = d.k", f"""WITH s AS (SELECT doc_id, item_id, {_SA} AS sa, {_SB} AS sb FROM src)
    SELECT doc_id, item_id, CASE WHEN len(sa) > 0 AND len(sb) > 0 THEN round({_INTER.format(a='sa', b='sb')} / len(sb), 6) END AS source_recall FROM s""")
def source_recall(p: DataFrame) -> DataFrame:
    return p.select("doc_id", "item_id", Q.recall(Q.word_set(C("b")), Q.word_set(C("a"))).alias("source_recall"))


@query("documents", """SELECT doc_id, round((CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) + CAST(contains(lower(text), '@') AS INT)) / 3.0::DOUBLE, 6) AS anchor_recall FROM src""")
def anchor_recall(d: DataFrame) -> DataFrame:
    """Explicit anchors: the share that the text has."""
    low = F.lower("text")
    return d.select("doc_id", F.round(sum((low.contains(a).cast("int") for a in ("license", "token", "@")), F.lit(0)) / 3, 6).alias("anchor_recall"))


_KINDS = [(0.4, r"\b([\w.-]+(?:/[\w.-]+)+)\b"), (0.3, r"\b(?:def|class|function|method|symbol)\s+([a-z_]\w*)"), (0.2, r"(?m)^(.*\b(?:error|failed|assert|exception)\b.*)$"), (0.1, r"(?m)^(.*\b(?:must|should|required|ensure|acceptance)\b.*)$"), (0.1, r"(```[^\n]*\n)")]
_FOUND = [f"[x FOR x IN regexp_extract_all(low, '{p}', 1) IF trim(x) <> '']" for _, p in _KINDS]


@query(CODE, f"""WITH t AS (SELECT id, lower(content) AS low, lower(split_part(content, '```js', 1)) AS short FROM src),
    f AS (SELECT id, {', '.join(f'CASE WHEN len({x}) > 0 THEN {w} ELSE 0.0 END::DOUBLE AS t{i}, CASE WHEN len({x}) > 0 AND len([y FOR y IN {x} IF NOT contains(short, trim(y))]) = 0 THEN {w} ELSE 0.0 END::DOUBLE AS k{i}' for i, ((w, _), x) in enumerate(zip(_KINDS, _FOUND, strict=True)))} FROM t)
    SELECT id, CASE WHEN {' + '.join(f't{i}' for i in range(5))} > 0 THEN round(({' + '.join(f'k{i}' for i in range(5))}) / ({' + '.join(f't{i}' for i in range(5))}), 6) END AS anchor_recall FROM f""")
def anchor_categories(m: DataFrame) -> DataFrame:
    """Without explicit anchors: paths 0.4, symbols 0.3, failures 0.2, rules 0.1, fences 0.1, each all or nothing, against the text without its second block."""
    short = F.lower(F.element_at(F.split("content", "```js"), 1))
    low = F.lower("content")
    find = lambda p: F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x: F.trim(x) != ""))
    total, kept = F.lit(0.0), F.lit(0.0)
    for weight, pattern in _KINDS:
        has = F.size(find(pattern)) > 0
        total = total + F.when(has, weight).otherwise(0.0)
        kept = kept + F.when(has & F.forall(find(pattern), lambda x: F.col("short").contains(F.trim(x))), weight).otherwise(0.0)
    return m.withColumn("short", short).select("id", F.when(total > 0, F.round(kept / total, 6)).alias("anchor_recall"))


@query(PAIRS)
def rouge_l(p: DataFrame) -> DataFrame:
    return p.select("conv_id", "turn", Q.rouge_l(C("a"), C("b")).alias("r")).select("conv_id", "turn", "r.*")


_TRI = "list_distinct([substr({0}, i, 3) FOR i IN range(1, length({0}) - 1)])"


@query(PAIRS, f"""WITH t AS (SELECT conv_id, turn, {_TRI.format('a')} AS ta, {_TRI.format('b')} AS tb FROM src), i AS (SELECT *, {_INTER.format(a='ta', b='tb')} AS n FROM t)
    SELECT conv_id, turn, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN round(n / (len(ta) + len(tb) - n), 6) END AS overlap FROM i""")
def trigram_overlap(p: DataFrame) -> DataFrame:
    return p.withColumn("ta", Q.trigrams(C("a"))).withColumn("tb", Q.trigrams(C("b"))).select("conv_id", "turn", Q.jaccard(C("ta"), C("tb")).alias("overlap"))


_TTR = "CASE WHEN len({0}) > 0 THEN len(list_distinct({0}))::DOUBLE / len({0}) ELSE 0.0 END"


@query(PAIRS, f"WITH w AS (SELECT *, {_WS.format('a')} AS wa, {_WS.format('b')} AS wb FROM src) SELECT conv_id, turn, round(greatest(length(b), 1)::DOUBLE / greatest(length(a), 1), 4) AS length_ratio, round(abs({_TTR.format('wa')} - {_TTR.format('wb')}), 6) AS vocabulary_delta FROM w")
def vocab_delta(p: DataFrame) -> DataFrame:
    ratio = F.greatest(F.length("b"), F.lit(1)) / F.greatest(F.length("a"), F.lit(1))
    return p.select("conv_id", "turn", F.round(ratio, 4).alias("length_ratio"), F.round(F.abs(Q.richness(C("a")) - Q.richness(C("b"))), 6).alias("vocabulary_delta"))


# Two texts with Markdown structure for each document.
MARKED = "SELECT doc_id, '# Head' || chr(10) || replace(text, '. ', chr(10) || '- ') || chr(10) || '> q' AS a, '## Other' || chr(10) || replace(text, '. ', chr(10) || '1. ') || chr(10) || '- x' AS b FROM {documents}"
_CNT = lambda col, p: f"len(regexp_extract_all({col}, '{p}'))"
_MD_LOW = " + ".join(f"least({_CNT('a', p)}, {_CNT('b', p)})" for p in Q.STRUCTURE.values())
_MD_HIGH = " + ".join(f"greatest({_CNT('a', p)}, {_CNT('b', p)})" for p in Q.STRUCTURE.values())


@query(MARKED, f"SELECT doc_id, round(({_MD_LOW})::DOUBLE / greatest({_MD_HIGH}, 1), 6) AS likeness FROM src")
def markdown_structure(p: DataFrame) -> DataFrame:
    return p.select("doc_id", Q.markdown_likeness(C("a"), C("b")).alias("likeness"))


# A text with code, and the same with less of it.
CODE_PAIRS = f"SELECT id, content AS a, CASE WHEN id % 2 = 0 THEN replace(content, '    size', '  size') ELSE replace(content, 'class Box', 'class Bag') END AS b FROM ({CODE})"
_BLOCKS = "regexp_extract_all({0}, '(?s)```[^\\n`]*\\n(.*?)```', 1)"
_FLATB = "[trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN " + _BLOCKS + "]"


@query(CODE_PAIRS, f"SELECT id, CASE WHEN len({_BLOCKS.format('a')}) = 0 THEN 1.0 ELSE round(len(list_filter({_FLATB.format('a')}, lambda x: list_contains({_FLATB.format('b')}, x)))::DOUBLE / len({_BLOCKS.format('a')}), 6) END AS preserved FROM src")
def code_block_preservation(p: DataFrame) -> DataFrame:
    return p.select("id", Q.blocks_preserved(C("a"), C("b")).alias("preserved"))


@query(CODE)
def code_validity(m: DataFrame) -> DataFrame:
    return m.select("id", Q.python_validity(C("content")).alias("validity"))


_HAS = "(contains(t, '```') OR regexp_matches(t, '`[^`\\n]{3,}`') OR regexp_matches(t, '(?m)^ {4,}(def |class |import |from |return |async |#!|</?|func |function )') OR " + " OR ".join(f"contains(t, '{w}')" for w in Q.CODE_WORDS) + ")"
PAGE_TEXT = "SELECT page_id, html AS t FROM {pages}"


@query(PAGE_TEXT, f"SELECT page_id, {_HAS} AS has_code FROM src")
def code_presence(p: DataFrame) -> DataFrame:
    return p.select("page_id", Q.has_code(C("t")).alias("has_code"))


@query(CODE, r"""WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src),
    f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(trim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM l)
    SELECT id, round(avg(CASE WHEN starts_with(trim(x), '```') OR n % 2 = 1 OR (regexp_matches(trim(x), '=|\bif\b|\bfor\b|\bwhile\b|\bdef\b|\bclass\b|\breturn\b|\bimport\b') AND length(trim(x)) > 8) THEN 1.0 ELSE 0.0 END), 4) AS likeness FROM f GROUP BY id""")
def code_likeness(m: DataFrame) -> DataFrame:
    return m.select("id", Q.code_likeness(C("content")).alias("likeness"))


@query(CODE_PAIRS, "SELECT id, round((CASE WHEN len(regexp_extract_all(a, '```')) = 0 THEN 1.0 ELSE least(1.0, len(regexp_extract_all(b, '```'))::DOUBLE / len(regexp_extract_all(a, '```'))) END + 1.0) / 2, 4) AS stability FROM src")
def response_stability(p: DataFrame) -> DataFrame:
    return p.select("id", Q.stability(C("a"), C("b")).alias("stability"))


_KW = ["def ", "class ", "import ", "return ", "if ", "for ", "while "]
_KWS = lambda c: "list_filter([" + ", ".join(f"'{k}'" for k in _KW) + f"], lambda k: contains(array_to_string({_BLOCKS.format(c)}, chr(10)), k))"


@query(CODE_PAIRS, f"""WITH k AS (SELECT id, {_KWS('a')} AS ka, {_KWS('b')} AS kb FROM src), n AS (SELECT *, len(list_intersect(ka, kb)) AS n FROM k)
    SELECT id, CASE WHEN len(ka) = 0 THEN 1.0 ELSE round(n::DOUBLE / greatest(len(ka) + len(kb) - n, 1), 4) END AS consistency FROM n""")
def code_structure(p: DataFrame) -> DataFrame:
    """Jaccard likeness of the keywords in the code of two texts; 1 if the first has none."""
    found = lambda c: F.filter(F.array(*[F.lit(k) for k in _KW]), lambda k: F.array_join(Q.blocks(C(c)), "\n").contains(k))
    k = p.select("id", found("a").alias("ka"), found("b").alias("kb")).withColumn("n", F.size(F.array_intersect("ka", "kb")))
    return k.select("id", F.when(F.size("ka") == 0, 1.0).otherwise(F.round(C("n") / F.greatest(F.size("ka") + F.size("kb") - C("n"), F.lit(1)), 4)).alias("consistency"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[ARCHIVED x] ' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '[PROGRESS 1]' ELSE '' END || text AS t FROM {documents}", "SELECT doc_id, coalesce(array_to_string(list_filter(['[ARCHIVED', '[REASONING', '[PROGRESS', '[LOOP DETECTED'], lambda m: contains(t, m)), ','), '') AS leaked FROM src")
def foreign_markers(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.array_join(Q.leaked(C("t")), ",").alias("leaked"))


#: Facts of the probe, as their distinctive tokens.
FACTS = [["ATLAS"], ["Python", "3.11"], ["Postgres"], ["retry", "3"], ["platform-infra"]]
PROBES = "SELECT event_id, 'We use ' || CASE WHEN event_id % 2 = 0 THEN 'Python 3.11' ELSE 'Ruby' END || ' and ' || CASE WHEN event_id % 3 = 0 THEN 'Postgres; retry: 3.' ELSE 'a file.' END || CASE WHEN event_id % 5 = 0 THEN ' Team platform-infra, ATLAS' ELSE '' END AS t FROM {events}"


@query(PROBES, "WITH n AS (SELECT event_id, regexp_replace(lower(t), '[^a-z0-9\\- ]', ' ', 'g') AS x FROM src) SELECT event_id, round((CAST(contains(x, 'atlas') AS INT) + CAST(contains(x, 'python') AND contains(x, '3') AND contains(x, '11') AS INT) + CAST(contains(x, 'postgres') AS INT) + CAST(contains(x, 'retry') AND contains(x, '3') AS INT) + CAST(contains(x, 'platform-infra') AS INT)) / 5.0::DOUBLE, 4) AS recall FROM n")
def fact_recall(d: DataFrame) -> DataFrame:
    return d.select("event_id", Q.fact_recall(C("t"), FACTS).alias("recall"))


#: Words of a claim whose pairs are listed: 2016 pairs at most.
PAIRED = 64
# Replies that assert things, sometimes negated.
CLAIMS = "SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, 'The ' || event_type || ' service' || CASE WHEN event_id % 3 = 0 THEN ' does not' ELSE '' END || ' always use port ' || CAST(event_id % 4 AS STRING) || '.' AS t FROM {events}"
_NEG = "(" + " OR ".join(f"contains(lower(s), '{m.replace(chr(39), chr(39) * 2)}')" for m in Q.NEGATIONS) + ")"


@query(CLAIMS, f"""WITH a AS (SELECT conv_id, turn, trim(unnest(regexp_extract_all(t, '{Q.ASSERTION}', 1))) AS s FROM src), w AS (SELECT *, {_NEG} AS neg, list_distinct(regexp_extract_all(lower(s), '[a-z]{{4,}}')) AS ws FROM a)
    SELECT conv_id, count(*) AS contradictions FROM w x WHERE EXISTS (SELECT 1 FROM w y WHERE y.conv_id = x.conv_id AND y.turn < x.turn AND y.neg <> x.neg AND len(list_intersect(x.ws, y.ws)) >= 2) GROUP BY conv_id""")
def contradictions(p: DataFrame) -> DataFrame:
    """Assertions that an earlier one contradicts: exactly one negated, two shared words of four letters.

    A claim of PAIRED words or fewer stands under each pair of them. Of a pair's claims only the first turn matters, so a
    conversation with many claims isn't joined with itself: its pairs are, once each. Longer claims, whose pairs would
    be too many, are compared one by one with the claims of their conversation.
    """
    a = p.select("conv_id", "turn", F.posexplode(Q.assertions(C("t"))).alias("k", "s"))
    w = a.select("conv_id", "turn", "k", Q.negated(C("s")).alias("neg"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("ws"))
    w, long = w.where(F.size("ws") > 1), F.size("ws") > PAIRED
    two = F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda y: F.concat_ws(" ", x, y))))
    pairs = w.where(~long).select("conv_id", "turn", "k", "neg", F.explode(two).alias("pair"))
    first = pairs.groupBy("conv_id", "pair").agg(F.min(F.when(C("neg"), C("turn"))).alias("denied"), F.min(F.when(~C("neg"), C("turn"))).alias("said")).where("denied is not null and said is not null")
    against = pairs.join(first, ["conv_id", "pair"]).where(F.when(C("neg"), C("said")).otherwise(C("denied")) < C("turn"))
    other = w.where(long).select("conv_id", C("turn").alias("turn2"), C("k").alias("k2"), C("neg").alias("neg2"), C("ws").alias("ws2"))
    beside = w.join(other, "conv_id").where((C("neg") != C("neg2")) & (C("turn") != C("turn2")) & (F.size(F.array_intersect("ws", "ws2")) >= 2))
    beside = beside.select("conv_id", F.greatest("turn", "turn2").alias("turn"), F.when(C("turn") > C("turn2"), C("k")).otherwise(C("k2")).alias("k"))
    return against.select("conv_id", "turn", "k").union(beside).distinct().groupBy("conv_id").agg(F.count("*").alias("contradictions"))


@query(TRACES, """WITH h AS (SELECT *, turn >= 5 AND (code_ratio < 0.5 OR quality < 0.3) AS bad FROM src), g AS (SELECT *, turn - row_number() OVER (PARTITION BY session_id, bad ORDER BY turn) AS island FROM h),
    r AS (SELECT session_id, island, min(turn) AS start, count(*) AS n FROM g WHERE bad GROUP BY session_id, island) SELECT session_id, min(start) AS wall FROM r WHERE n >= 2 GROUP BY session_id""")
def quality_wall(t: DataFrame) -> DataFrame:
    """The first turn, from the fifth on, of two or more bad ones in a row."""
    bad = (C("turn") >= 5) & ((C("code_ratio") < 0.5) | (C("quality") < 0.3))
    b = t.where(bad).withColumn("island", C("turn") - F.row_number().over(Window.partitionBy("session_id").orderBy("turn")))
    return b.groupBy("session_id", "island").agg(F.min("turn").alias("start"), F.count("*").alias("n")).where("n >= 2").groupBy("session_id").agg(F.min("start").alias("wall"))


_GROWING = "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 3 THEN 'changed ' ELSE '' END || string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt FROM {conversations}"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each turn: all messages up to it, with a changed head at turn 3 of every third conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when((C("conv_id") % 3 == 0) & (C("turn") == 3), "changed ").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.array_join(F.collect_list("text").over(w), "|")).alias("prompt"))


def prefix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts(spark, sf_dir).withColumn("previous", F.lag("prompt").over(Window.partitionBy("conv_id").orderBy("turn")))
    kind = F.when(C("previous").isNull(), "(first)").when(C("prompt") == C("previous"), "STABLE").when(C("prompt").startswith(C("previous")) | C("previous").startswith(C("prompt")), "APPEND-ONLY").otherwise("CHANGED")
    return p.select("conv_id", "turn", kind.alias("kind"))


QUERIES["prefix_class"] = prefix_class
ORACLE["prefix_class"] = f"""WITH src AS ({_GROWING.replace('{', '').replace('}', '')}), p AS (SELECT *, lag(prompt) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM src)
    SELECT conv_id, turn, CASE WHEN previous IS NULL THEN '(first)' WHEN prompt = previous THEN 'STABLE' WHEN starts_with(prompt, previous) OR starts_with(previous, prompt) THEN 'APPEND-ONLY' ELSE 'CHANGED' END AS kind FROM p"""


def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters shared with the previous prompt, and whether that reuses four fifths of it."""
    p = prompts(spark, sf_dir).withColumn("previous", F.coalesce(F.lag("prompt").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    n = p.withColumn("common", Q.common_prefix(C("previous"), C("prompt")))
    return n.select("conv_id", "turn", "common", F.when(C("common") >= 0.8 * F.length("previous"), "REUSED").otherwise("BREAK").alias("kind"))


QUERIES["common_prefix"] = common_prefix
ORACLE["common_prefix"] = f"""WITH RECURSIVE src AS ({_GROWING.replace('{', '').replace('}', '')}), p AS (SELECT *, coalesce(lag(prompt) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous FROM src),
    b(conv_id, turn, x, y, lo, hi) AS (SELECT conv_id, turn, previous, prompt, CAST(0 AS BIGINT), least(length(previous), length(prompt)) FROM p
        UNION ALL SELECT conv_id, turn, x, y, CASE WHEN left(x, mid) = left(y, mid) THEN mid ELSE lo END, CASE WHEN left(x, mid) = left(y, mid) THEN hi ELSE mid - 1 END FROM (SELECT *, (lo + hi + 1) // 2 AS mid FROM b WHERE lo < hi))
    SELECT conv_id, turn, lo AS common, CASE WHEN lo >= 0.8 * length(x) THEN 'REUSED' ELSE 'BREAK' END AS kind FROM b WHERE lo >= hi"""


@query(TRACES, """WITH p AS (SELECT *, lag(raw_tokens) OVER w AS pr, lag(prompt_tokens) OVER w AS po FROM src WINDOW w AS (PARTITION BY session_id ORDER BY turn)), d AS (SELECT *, raw_tokens - prompt_tokens AS saved, pr - po AS was FROM p)
    SELECT session_id, turn, array_to_string(list_filter([CASE WHEN saved < 0 THEN 'INFLATION' WHEN raw_tokens >= 4000 AND saved = 0 AND was > 0 THEN 'NO SAVINGS' END, CASE WHEN was >= 0 AND saved < 0 THEN 'SAVINGS CLIFF' WHEN pr IS NOT NULL AND raw_tokens::DOUBLE / pr <= 1.2 AND prompt_tokens::DOUBLE / po >= 1.35 THEN 'OPTIMIZED CLIFF' END], lambda x: x IS NOT NULL), ',') AS issues
    FROM d WHERE saved < 0 OR (raw_tokens >= 4000 AND saved = 0 AND was > 0) OR (pr IS NOT NULL AND raw_tokens::DOUBLE / pr <= 1.2 AND prompt_tokens::DOUBLE / po >= 1.35)""")
def cliff_flags(t: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn")
    p = t.withColumn("pr", F.lag("raw_tokens").over(w)).withColumn("po", F.lag("prompt_tokens").over(w)).withColumn("saved", C("raw_tokens") - C("prompt_tokens")).withColumn("was", C("pr") - C("po"))
    first = F.when(C("saved") < 0, "INFLATION").when((C("raw_tokens") >= 4000) & (C("saved") == 0) & (C("was") > 0), "NO SAVINGS")
    second = F.when((C("was") >= 0) & (C("saved") < 0), "SAVINGS CLIFF").when((C("raw_tokens") / C("pr") <= 1.2) & (C("prompt_tokens") / C("po") >= 1.35), "OPTIMIZED CLIFF")
    return p.select("session_id", "turn", F.concat_ws(",", first, second).alias("issues")).where("issues <> ''")


# --- statistics and gates -------------------------------------------------------------------------------------------


@query(TRACES, "SELECT session_id, count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt, sum(cached_tokens)::BIGINT AS cached, sum(prompt_tokens - cached_tokens)::BIGINT AS fresh, round(sum(cached_tokens)::DOUBLE / sum(prompt_tokens), 6) AS reuse, round(avg(latency_ms), 4) AS mean_latency, round(1000 * sum(completion_tokens) / sum(latency_ms), 6) AS tokens_per_second FROM src GROUP BY session_id")
def session_metrics(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id").agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt"), F.sum("cached_tokens").alias("cached"), F.sum(C("prompt_tokens") - C("cached_tokens")).alias("fresh"),
        F.round(F.sum("cached_tokens") / F.sum("prompt_tokens"), 6).alias("reuse"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(1000 * F.sum("completion_tokens") / F.sum("latency_ms"), 6).alias("tokens_per_second"),
    )


@query(TRACES, "SELECT count(*) AS requests, round(avg(CASE WHEN cached_tokens > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(sum(cached_tokens)::DOUBLE / sum(cached_tokens + (prompt_tokens - cached_tokens)), 6) AS reuse, round(1 - sum(prompt_tokens)::DOUBLE / sum(raw_tokens), 6) AS savings_ratio, round(avg(ttft_ms), 4) AS mean_ttft FROM src")
def metrics_snapshot(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("requests"), F.round(F.avg((C("cached_tokens") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.sum("cached_tokens") / F.sum("prompt_tokens"), 6).alias("reuse"), F.round(1 - F.sum("prompt_tokens") / F.sum("raw_tokens"), 6).alias("savings_ratio"), F.round(F.avg("ttft_ms"), 4).alias("mean_ttft"))


@query(TRACES, "SELECT session_id, sum(completion_tokens % 50)::BIGINT AS drafted, sum(completion_tokens % 20)::BIGINT AS accepted, round(sum(completion_tokens % 20)::DOUBLE / greatest(sum(completion_tokens % 50), 1), 6) AS acceptance, count(*) FILTER (WHERE completion_tokens % 50 = 0) AS fallbacks FROM src GROUP BY session_id")
def spec_counters(t: DataFrame) -> DataFrame:
    drafted, accepted = F.sum(C("completion_tokens") % 50), F.sum(C("completion_tokens") % 20)
    return t.groupBy("session_id").agg(drafted.alias("drafted"), accepted.alias("accepted"), F.round(accepted / F.greatest(drafted, F.lit(1)), 6).alias("acceptance"), F.count_if(C("completion_tokens") % 50 == 0).alias("fallbacks"))


@query(TRACES, "SELECT stage, count(*) AS degradations, count(DISTINCT session_id) AS sessions FROM src GROUP BY stage")
def degradations(t: DataFrame) -> DataFrame:
    return t.groupBy("stage").agg(F.count("*").alias("degradations"), F.count_distinct("session_id").alias("sessions"))


@query(TRACES, "SELECT request_id, session_id FROM src ORDER BY request_id DESC LIMIT 512")
def trace_ring(t: DataFrame) -> DataFrame:
    """The last 512 traces (the operator's limit), by a top-k that keeps 512 rows a partition."""
    return t.select("request_id", "session_id").orderBy(F.desc("request_id")).limit(512)


@query(TRACES, "SELECT stage, round(avg(latency_ms), 4) AS mean, round(quantile_cont(latency_ms, 0.5), 4) AS median, round(quantile_cont(latency_ms, 0.25), 4) AS q1, round(quantile_cont(latency_ms, 0.75), 4) AS q3, round(quantile_cont(latency_ms, 0.9), 4) AS p90, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99, min(latency_ms) AS least, max(latency_ms) AS most FROM src GROUP BY stage")
def dist_stats(t: DataFrame) -> DataFrame:
    """Exact percentiles with linear interpolation; the aggregate keeps counts of distinct values."""
    names = [("median", 0.5), ("q1", 0.25), ("q3", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
    p = t.groupBy("stage").agg(F.avg("latency_ms").alias("mean"), F.percentile("latency_ms", F.array(*[F.lit(q) for _, q in names])).alias("p"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"))
    return p.select("stage", F.round("mean", 4).alias("mean"), *[F.round(C("p")[i], 4).alias(n) for i, (n, _) in enumerate(names)], "least", "most")


@query(TRACES, "WITH u AS (SELECT 'quality' AS metric, quality AS v FROM src UNION ALL SELECT 'code_ratio', CASE WHEN code_ratio > 0.9 THEN NULL ELSE code_ratio END FROM src) SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS least, max(v) AS most, count(v) AS n FROM u GROUP BY metric")
def quality_aggregation(t: DataFrame) -> DataFrame:
    u = t.select(F.explode(F.array(F.struct(F.lit("quality").alias("metric"), C("quality").alias("v")), F.struct(F.lit("code_ratio").alias("metric"), F.when(C("code_ratio") <= 0.9, C("code_ratio")).alias("v")))).alias("m")).select("m.*")
    return u.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n"))


@query(TRACES, "SELECT count(*) FILTER (WHERE quality < 0.75) AS low_semantic, count(*) FILTER (WHERE code_ratio < 0.4) AS low_jaccard, count(*) FILTER (WHERE prompt_tokens::DOUBLE / raw_tokens < 0.5 OR prompt_tokens::DOUBLE / raw_tokens > 2) AS odd_length, count(*) FILTER (WHERE code_ratio < 1) AS code_loss FROM src")
def threshold_counts(t: DataFrame) -> DataFrame:
    ratio = C("prompt_tokens") / C("raw_tokens")
    return t.agg(F.count_if(C("quality") < 0.75).alias("low_semantic"), F.count_if(C("code_ratio") < 0.4).alias("low_jaccard"), F.count_if((ratio < 0.5) | (ratio > 2)).alias("odd_length"), F.count_if(C("code_ratio") < 1).alias("code_loss"))


@query(TRACES, "SELECT session_id, round(corr(quality, prompt_tokens), 4) AS correlation, round(regr_slope(quality, prompt_tokens::DOUBLE), 8) AS slope FROM src GROUP BY session_id")
def trend(t: DataFrame) -> DataFrame:
    """Correlation and slope of quality on utilisation."""
    return t.groupBy("session_id").agg(F.round(F.corr("quality", "prompt_tokens"), 4).alias("correlation"), F.round(F.regr_slope("quality", C("prompt_tokens").cast("double")), 8).alias("slope"))


@query(TRACES, "SELECT stage, round(corr(prompt_tokens - cached_tokens, ttft_ms), 4) AS pearson FROM src GROUP BY stage")
def pearson(t: DataFrame) -> DataFrame:
    return t.groupBy("stage").agg(F.round(F.corr(C("prompt_tokens") - C("cached_tokens"), C("ttft_ms")), 4).alias("pearson"))


@query(TRACES)
def bootstrap_ci(t: DataFrame) -> DataFrame:
    """A 95 % interval of each stage's mean latency from 200 Poisson resamples: every row weighs a keyed-hash Poisson(1) draw in each, so resampling is one aggregation."""
    n = 200
    u = lambda i: (F.pmod(F.xxhash64("request_id", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0)
    cuts = [0.36788, 0.73576, 0.9197, 0.98101, 0.99634, 0.99941, 0.99992]
    draw = lambda i: sum(((u(i) >= c).cast("int") for c in cuts), F.lit(0))
    r = t.select("stage", "latency_ms", "request_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).withColumn("w", draw(C("i")))
    means = r.groupBy("stage", "i").agg((F.sum(C("w") * C("latency_ms")) / F.sum("w")).alias("mean"))
    return means.groupBy("stage").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


@query(TRACES, "WITH d AS (SELECT *, latency_ms - lag(latency_ms) OVER (PARTITION BY session_id ORDER BY turn) AS diff FROM src) SELECT session_id, count(*) FILTER (WHERE diff > 0) AS positive, count(*) FILTER (WHERE diff < 0) AS negative FROM d GROUP BY session_id")
def sign_test(t: DataFrame) -> DataFrame:
    d = t.withColumn("diff", C("latency_ms") - F.lag("latency_ms").over(Window.partitionBy("session_id").orderBy("turn")))
    return d.groupBy("session_id").agg(F.count_if(C("diff") > 0).alias("positive"), F.count_if(C("diff") < 0).alias("negative"))


@query(TRACES, "WITH r AS (SELECT session_id, avg(latency_ms) AS m, count(*) AS n FROM src GROUP BY session_id) SELECT count(*) AS rounds, round(avg(m), 4) AS mean_of_means, round(min(m), 4) AS least, round(max(m), 4) AS most, sum(n)::BIGINT AS turns FROM r")
def pooled_means(t: DataFrame) -> DataFrame:
    r = t.groupBy("session_id").agg(F.avg("latency_ms").alias("m"), F.count("*").alias("n"))
    return r.agg(F.count("*").alias("rounds"), F.round(F.avg("m"), 4).alias("mean_of_means"), F.round(F.min("m"), 4).alias("least"), F.round(F.max("m"), 4).alias("most"), F.sum("n").alias("turns"))


def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens x price / 1e6 over orders and their lines: quantities as tokens, a price by return flag."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    price = F.when(C("l_returnflag") == "R", 3.0).when(C("l_returnflag") == "A", 2.0).otherwise(1.0)
    return l.join(o, C("l_orderkey") == C("o_orderkey")).groupBy("o_orderpriority").agg(F.round(F.sum(C("l_quantity") * price) / 1e6, 6).alias("cost"), F.count("*").alias("n"))


QUERIES["cost_model"] = cost_model
ORACLE["cost_model"] = "SELECT o_orderpriority, round(sum(l_quantity * CASE l_returnflag WHEN 'R' THEN 3.0 WHEN 'A' THEN 2.0 ELSE 1.0 END) / 1e6, 6) AS cost, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"


@query(TRACES, "SELECT session_id, coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (WHERE raw_tokens > 4000 AND prompt_tokens < raw_tokens), '') AS evicted_turns FROM src GROUP BY session_id")
def eviction_tracking(t: DataFrame) -> DataFrame:
    hit = F.when((C("raw_tokens") > 4000) & (C("prompt_tokens") < C("raw_tokens")), C("turn"))
    return t.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x.cast("string")), ",").alias("evicted_turns"))


@query(TRACES, "WITH a AS (SELECT * FROM src WHERE session_id % 2 = 0), b AS (SELECT *, session_id - 1 AS other FROM src WHERE session_id % 2 = 1) SELECT coalesce(a.session_id, b.other) AS round, coalesce(a.turn, b.turn) AS turn, b.latency_ms - a.latency_ms AS latency_delta, b.prompt_tokens - a.prompt_tokens AS token_delta, a.turn IS NULL OR b.turn IS NULL AS unpaired FROM a FULL JOIN b ON a.session_id = b.other AND a.turn = b.turn")
def paired_join(t: DataFrame) -> DataFrame:
    """Two sides (even and odd sessions) paired by round and turn; a turn that only one side has is marked."""
    a = t.where("session_id % 2 = 0").select(C("session_id").alias("round"), "turn", C("latency_ms").alias("la"), C("prompt_tokens").alias("pa"))
    b = t.where("session_id % 2 = 1").select((C("session_id") - 1).alias("round"), "turn", C("latency_ms").alias("lb"), C("prompt_tokens").alias("pb"))
    j = a.join(b, ["round", "turn"], "full")
    return j.select("round", "turn", (C("lb") - C("la")).alias("latency_delta"), (C("pb") - C("pa")).alias("token_delta"), (C("la").isNull() | C("lb").isNull()).alias("unpaired"))


@query(MESSAGES, "SELECT conv_id, count(*) = max(turn) + 1 AS complete, count(DISTINCT turn) = count(*) AS distinct_turns, min(turn) = 0 AS from_zero FROM src GROUP BY conv_id")
def conversation_invariant(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id").agg((F.count("*") == F.max("turn") + 1).alias("complete"), (F.count_distinct("turn") == F.count("*")).alias("distinct_turns"), (F.min("turn") == 0).alias("from_zero"))


@query(TRACES, "SELECT stage, round(avg(quality), 6) AS quality, round(avg(latency_ms), 4) AS latency FROM src WHERE stage <> 'error' GROUP BY stage")
def cross_scenario(t: DataFrame) -> DataFrame:
    """Means by scenario, stress excluded."""
    return t.where("stage <> 'error'").groupBy("stage").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("latency_ms"), 4).alias("latency"))


_METRICS = "SELECT stage AS metric, avg(CASE WHEN session_id % 2 = 0 THEN quality END) AS current_value, avg(CASE WHEN session_id % 2 = 1 THEN quality END) AS baseline FROM src GROUP BY stage"


@query(TRACES, f"WITH m AS ({_METRICS}) SELECT metric, round(baseline - current_value, 6) AS drop, baseline - current_value > 0.002 AS regressed, current_value < 0.5 AS below_floor FROM m")
def gate_drop(t: DataFrame) -> DataFrame:
    """Current (even sessions) against baseline (odd): drops beyond the tolerance, and values below the hard floor."""
    m = t.groupBy(C("stage").alias("metric")).agg(F.avg(F.when(C("session_id") % 2 == 0, C("quality"))).alias("cur"), F.avg(F.when(C("session_id") % 2 == 1, C("quality"))).alias("base"))
    return m.select("metric", F.round(C("base") - C("cur"), 6).alias("drop"), (C("base") - C("cur") > 0.002).alias("regressed"), (C("cur") < 0.5).alias("below_floor"))


@query(TRACES, "SELECT request_id, round(coalesce(CASE WHEN request_id % 4 = 0 THEN quality END, CASE WHEN request_id % 4 = 1 THEN code_ratio END, (quality + code_ratio) / 2), 6) AS gate_value FROM src")
def gate_value(t: DataFrame) -> DataFrame:
    """The first measure that is there: faithfulness, evicted recall, a composite."""
    return t.select("request_id", F.round(F.coalesce(F.when(C("request_id") % 4 == 0, C("quality")), F.when(C("request_id") % 4 == 1, C("code_ratio")), (C("quality") + C("code_ratio")) / 2), 6).alias("gate_value"))


@query("SELECT event_id, user_id % 3 AS round, event_type AS phase, 'draft acceptance rate = 0.' || CAST(10 + event_id % 90 AS STRING) || ' ( ' || CAST(event_id % 50 AS STRING) || ' accepted / ' || CAST(50 + event_id % 50 AS STRING) || ' generated)' AS line FROM {events}", "WITH p AS (SELECT round, phase, CAST(regexp_extract(line, 'acceptance rate = ([0-9.]+)', 1) AS DOUBLE) AS rate, CAST(regexp_extract(line, '([0-9]+) accepted', 1) AS BIGINT) AS accepted FROM src) SELECT round, phase, round(avg(rate), 6) AS rate, sum(accepted)::BIGINT AS accepted FROM p GROUP BY round, phase")
def draft_log(d: DataFrame) -> DataFrame:
    p = d.select("round", "phase", F.regexp_extract("line", r"acceptance rate = ([0-9.]+)", 1).cast("double").alias("rate"), F.regexp_extract("line", r"([0-9]+) accepted", 1).cast("long").alias("accepted"))
    return p.groupBy("round", "phase").agg(F.round(F.avg("rate"), 6).alias("rate"), F.sum("accepted").alias("accepted"))


def quality_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(Q.richness(C("text"))), 6).alias("richness"), F.round(F.avg(F.length("text")), 4).alias("length"))


QUERIES["quality_by_label"] = quality_by_label
ORACLE["quality_by_label"] = f"WITH w AS (SELECT quality, text, {_WS.format('text')} AS ws FROM documents JOIN labels USING (doc_id)) SELECT quality, count(*) AS n, round(avg({_TTR.format('ws')}), 6) AS richness, round(avg(length(text)), 4) AS length FROM w GROUP BY quality"


@query(MESSAGES, None)
def compaction_quality(m: DataFrame) -> DataFrame:
    """Retention of each conversation's text after dropping its second and third message."""
    both = m.groupBy("conv_id").agg(ordered_join(C("content"), sep=" ").alias("a"), ordered_join(F.when(C("turn").isin(1, 2), "").otherwise(C("content")), sep=" ").alias("b"))
    return both.select("conv_id", Q.jaccard(Q.word_set(C("a")), Q.word_set(C("b"))).alias("faithfulness"), Q.recall(Q.word_set(C("a")), Q.word_set(C("b"))).alias("recall"), Q.evicted_recall(C("a"), C("b")).alias("evicted_recall"))
