"""Summaries (2.10), sources and sinks (2.1), caches, prediction and keyed state (2.13), and the composed pipeline (2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import summary as S
from loomline.operators import zones as Z
from loomline.plans.registry import CODE, LOGS, MESSAGES, ORACLE, QUERIES, STEPS, TRACES, fixture, query, table
from loomline.plans.text_plans import _TASKS as TASKS
from loomline.plans.text_plans import TOK, ordered_join, static_prefix
from loomline.plans.zone_plans import _TURNS
from loomline.sources import messages as M

C = F.col

# --- summaries ------------------------------------------------------------------------------------------------------


@query(STEPS)
def state_extraction(s: DataFrame) -> DataFrame:
    return S.state_of(s.withColumnRenamed("step_index", "turn"))


@query(CODE)
def code_state(m: DataFrame) -> DataFrame:
    return S.state_of(m.withColumn("role", F.when(C("turn") % 2 == 0, "user").otherwise("assistant")))


@query(MESSAGES, f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM u WHERE NOT (turn_id = 0 OR (turn_id = 1 AND role = 'user'))), o AS (SELECT *, trim(split_part(content, '.', 1)) AS fact FROM r WHERE k > 3),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM o WHERE role = 'user' AND length(fact) > 10 AND length(fact) < 200)
    SELECT c.conv_id, '[Previous conversation summary]' || coalesce(chr(10) || 'Key topics: ' || string_agg(fact, '; ' ORDER BY turn) FILTER (WHERE n <= 3), '') AS summary FROM (SELECT DISTINCT conv_id FROM o) c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id""")
def old_turn_summary(m: DataFrame) -> DataFrame:
    return S.old_turn_summary(m, 3)


@query(TRACES, "SELECT session_id, max(turn) AS turns, least(12000, 1500 + 120 * max(turn))::BIGINT AS budget FROM src GROUP BY session_id")
def summary_budget(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id").agg(F.max("turn").alias("turns")).select("session_id", "turns", S.budget(C("turns")).alias("budget"))


@query(MESSAGES, "SELECT conv_id, turn, CASE WHEN length(content) <= 80 THEN content ELSE rtrim(substr(content, 1, 80)) || ' …' END AS content FROM src")
def append_truncation(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "turn", S.truncated(C("content"), F.lit(20)).alias("content"))


_PIN = r"trim(regexp_replace(arg_min(content, turn) FILTER (WHERE role = 'user'), '\s+', ' ', 'g'))"


@query(MESSAGES, f"WITH f AS (SELECT conv_id, {_PIN} AS flat FROM src GROUP BY conv_id) SELECT conv_id, CASE WHEN length(flat) <= 500 THEN flat ELSE rtrim(substr(flat, 1, 497)) || '...' END AS facts FROM f")
def pinned_facts(m: DataFrame) -> DataFrame:
    return S.pinned(m)


@query(MESSAGES, f"WITH f AS (SELECT conv_id, {_PIN} AS flat, string_agg(content, chr(10) ORDER BY turn) AS texts FROM src GROUP BY conv_id) SELECT conv_id, 'Context summary (rolling):' || chr(10) || 'Key facts (from original request): ' || CASE WHEN length(flat) <= 500 THEN flat ELSE rtrim(substr(flat, 1, 497)) || '...' END || chr(10) || texts AS block FROM f")
def rolling_block_text(m: DataFrame) -> DataFrame:
    texts = m.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("content").alias("v")))), lambda s: s["v"]).alias("texts"))
    return texts.join(S.pinned(m), "conv_id").select("conv_id", S.block_text(C("facts"), C("texts")).alias("block"))


@query(TRACES)
def rolling_fold(t: DataFrame) -> DataFrame:
    return S.rolling_fold(t.select(C("session_id").alias("conv_id"), C("turn").alias("turn_id"), C("completion_tokens").alias("tokens")), S.Fold())


@query(STEPS, "SELECT conv_id, count(*) AS steps, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools, count(*) FILTER (WHERE role = 'user') AS requests FROM src GROUP BY conv_id")
def recall_summary(s: DataFrame) -> DataFrame:
    return s.groupBy("conv_id").agg(F.count("*").alias("steps"), F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools"), F.count_if(C("role") == "user").alias("requests"))


# --- sources and sinks ----------------------------------------------------------------------------------------------

GAPPY = "SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 6 = 0 THEN NULL ELSE text END AS content FROM {conversations}"


@query(GAPPY, "SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN coalesce(content, '') ELSE content END AS content, role <> 'assistant' AND content IS NULL AS was_missing FROM src")
def message_ingest(m: DataFrame) -> DataFrame:
    return M.filled(m)


@query(GAPPY, "SELECT conv_id, count(*) AS rejected FROM src WHERE role <> 'assistant' AND content IS NULL GROUP BY conv_id")
def message_rejects(m: DataFrame) -> DataFrame:
    return M.rejects(m).groupBy("conv_id").agg(F.count("*").alias("rejected"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'broken{{' WHEN event_id % 10 = 1 THEN '{{\"id\": 1}}' ELSE props END AS line FROM {events}", None)
def jsonl_reader(d: DataFrame) -> DataFrame:
    """Lines of JSON in lenient mode: those that don't parse and those without the field are marked."""
    parsed = d.select("event_id", F.from_json("line", "k BIGINT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    return parsed.select("event_id", C("j.k").alias("k"), C("j._corrupt").isNotNull().alias("corrupt"), (C("j.k").isNull() & C("j._corrupt").isNull()).alias("incomplete"))


ORACLE["jsonl_reader"] = "SELECT event_id, CASE WHEN event_id % 10 > 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 0 AS corrupt, event_id % 10 = 1 AS incomplete FROM events"


@query("events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM src")
def json_field(d: DataFrame) -> DataFrame:
    return d.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(STEPS, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step_index DESC) AS k FROM src) SELECT conv_id, string_agg(to_json(struct_pack(step_index := step_index, role := role, content := content)), chr(10) ORDER BY step_index) AS state FROM r WHERE k <= 3 GROUP BY conv_id")
def session_state_json(s: DataFrame) -> DataFrame:
    """The last three steps of each session as JSON lines; read back and written again, the same."""
    last = Z.newest(s, 3, order="step_index")
    line = F.to_json(F.struct("step_index", "role", "content"))
    again = F.to_json(F.from_json(line, "step_index BIGINT, role STRING, content STRING"))
    return last.groupBy("conv_id").agg(ordered_join(again, "step_index").alias("state"))


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by stage written as JSON to the shared folder and read back with a schema."""
    t = fixture(spark, sf_dir, TRACES).groupBy("stage").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("tokens"))
    return M.json_round_trip(t)


QUERIES["report_round_trip"] = report_round_trip
ORACLE["report_round_trip"] = "SELECT event_type AS stage, count(*) AS n, sum(400 + event_id % 2500)::BIGINT AS tokens FROM events GROUP BY event_type"


def fixture_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of an agentic scenario: thirty turns of request, call, result, call, result."""
    return M.scenario(spark)


QUERIES["fixture_scenario"] = fixture_scenario


def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries by key saved as Parquet and merged with the session's next ones."""
    t = fixture(spark, sf_dir, TRACES)
    entry = lambda x: x.groupBy(C("session_id").cast("string").alias("key")).agg(F.count_if(C("cached_tokens") > 0).alias("hits"), F.count_if(C("cached_tokens") == 0).alias("misses"))
    saved = M.parquet_round_trip(entry(t.where("turn % 2 = 0")), "registry")
    return saved.union(entry(t.where("turn % 2 = 1"))).groupBy("key").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


QUERIES["registry_round_trip"] = registry_round_trip
ORACLE["registry_round_trip"] = "SELECT CAST(user_id AS VARCHAR) AS key, (count(*) FILTER (WHERE (event_id * 37) % (400 + event_id % 2500) > 0))::BIGINT AS hits, (count(*) FILTER (WHERE (event_id * 37) % (400 + event_id % 2500) = 0))::BIGINT AS misses FROM events GROUP BY user_id"

# --- caches and prediction ------------------------------------------------------------------------------------------


@query(TRACES, "WITH l AS (SELECT session_id, max(request_id) AS last_used, count(*) AS uses FROM src GROUP BY session_id), r AS (SELECT *, row_number() OVER (ORDER BY last_used DESC) AS recency FROM l) SELECT session_id, uses, recency FROM r WHERE recency <= 64")
def lru_recency(t: DataFrame) -> DataFrame:
    """The 64 keys used last (the cache's limit)."""
    last = t.groupBy("session_id").agg(F.max("request_id").alias("last_used"), F.count("*").alias("uses")).orderBy(F.desc("last_used")).limit(64)
    return last.select("session_id", "uses", F.row_number().over(Window.orderBy(F.desc("last_used"))).alias("recency"))


@query("documents", "SELECT doc_id, length(text) % 97 AS value FROM src")
def chunk_cache(d: DataFrame) -> DataFrame:
    """Computed once for each distinct fingerprint, then joined back."""
    keyed = d.select("doc_id", F.sha2("text", 256).alias("fp"), "text")
    once = keyed.groupBy("fp").agg((F.length(F.first("text")) % 97).cast("long").alias("value"))
    return keyed.select("doc_id", "fp").join(once, "fp").select("doc_id", "value")


_KEYED = "SELECT session_id % 20 AS key, session_id % 5 AS prefix, request_id, cached_tokens FROM ({})"


@query(_KEYED.format(TRACES), """WITH e AS (SELECT key, any_value(prefix) AS prefix, sum(CASE WHEN cached_tokens > 900 THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM src GROUP BY key), p AS (SELECT prefix, sum(CASE WHEN cached_tokens > 900 THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM src GROUP BY prefix)
    SELECT e.key, e.hits::BIGINT AS hits, (e.n - e.hits)::BIGINT AS misses, round(p.hits::DOUBLE / p.n, 6) AS prefix_rate, round(greatest(e.hits::DOUBLE / e.n, p.hits::DOUBLE / p.n), 6) AS predicted FROM e JOIN p USING (prefix)""")
def predicted_hit_rate(t: DataFrame) -> DataFrame:
    """Measured hits by key and by static prefix, and the larger rate."""
    hit = F.sum((C("cached_tokens") > 900).cast("long"))
    e = t.groupBy("key", "prefix").agg(hit.alias("hits"), F.count("*").alias("n"))
    p = e.groupBy("prefix").agg(F.sum("hits").alias("ph"), F.sum("n").alias("pn"))
    rate = C("ph") / C("pn")
    return e.join(p, "prefix").select("key", "hits", (C("n") - C("hits")).alias("misses"), F.round(rate, 6).alias("prefix_rate"), F.round(F.greatest(C("hits") / C("n"), rate), 6).alias("predicted"))


@query(_KEYED.format(TRACES), "SELECT count(DISTINCT key) AS entries, (count(*) FILTER (WHERE cached_tokens > 900))::BIGINT AS hits, (count(*) FILTER (WHERE cached_tokens <= 900))::BIGINT AS misses, round((count(*) FILTER (WHERE cached_tokens > 900))::DOUBLE / greatest(count(*), 1), 6) AS hit_rate FROM src")
def cache_stats(t: DataFrame) -> DataFrame:
    hits = F.count_if(C("cached_tokens") > 900)
    return t.agg(F.count_distinct("key").alias("entries"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(hits / F.greatest(F.count("*"), F.lit(1)), 6).alias("hit_rate"))


_FEAT = f"WITH t AS (SELECT *, {TOK} AS tokens, turn <= coalesce(min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id), 1000000) AS static FROM src), f AS (SELECT conv_id, sum(tokens)::BIGINT AS total_tokens, (coalesce(sum(tokens) FILTER (WHERE static), 0))::BIGINT AS static_tokens, count(*) AS message_count, avg(length(content)) AS mean_length, count(*) FILTER (WHERE role = 'user') AS turn_count FROM t GROUP BY conv_id)"


@query(MESSAGES, _FEAT + " SELECT conv_id, total_tokens, static_tokens, round(static_tokens::DOUBLE / greatest(total_tokens, 1), 6) AS static_ratio, message_count, round(mean_length, 4) AS mean_length, turn_count, round(0.7::DOUBLE * static_tokens / greatest(total_tokens, 1) + 0.3::DOUBLE * (1 - least(total_tokens / 4000.0::DOUBLE, 1.0)), 6) AS predicted FROM f")
def hit_features(m: DataFrame) -> DataFrame:
    """Features of all messages (not only up to the first user message), and the heuristic prediction."""
    return features(m)


def features(m: DataFrame) -> DataFrame:
    from loomline.functions.tokens import estimate

    first = F.min(F.when(C("role") == "user", C("turn"))).over(Z.conv())
    t = m.withColumn("tokens", estimate(C("content"))).withColumn("static", F.coalesce(C("turn") <= first, F.lit(True)))
    f = t.groupBy("conv_id").agg(F.sum("tokens").alias("total_tokens"), F.coalesce(F.sum(F.when(C("static"), C("tokens"))), F.lit(0)).alias("static_tokens"), F.count("*").alias("message_count"), F.avg(F.length("content")).alias("mean_length"), F.count_if(C("role") == "user").alias("turn_count"))
    ratio = C("static_tokens") / F.greatest(C("total_tokens"), F.lit(1))
    heuristic = 0.7 * ratio + 0.3 * (1 - F.least(C("total_tokens") / 4000.0, F.lit(1.0)))
    return f.select("conv_id", "total_tokens", "static_tokens", F.round(ratio, 6).alias("static_ratio"), "message_count", F.round("mean_length", 4).alias("mean_length"), "turn_count", F.round(heuristic, 6).alias("predicted"))


@query(MESSAGES, _FEAT + ", p AS (SELECT conv_id, 0.7::DOUBLE * static_tokens / greatest(total_tokens, 1) + 0.3::DOUBLE * (1 - least(total_tokens / 4000.0::DOUBLE, 1.0)) AS p FROM f) SELECT conv_id, CASE WHEN p >= 0.85 THEN 'early exit' WHEN p <= 0.3 THEN 'aggressive trim' ELSE 'normal' END AS route FROM p")
def hit_route(m: DataFrame) -> DataFrame:
    f = features(m)
    return f.select("conv_id", F.when(C("predicted") >= 0.85, "early exit").when(C("predicted") <= 0.3, "aggressive trim").otherwise("normal").alias("route"))


def hit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees (20 of depth 3) on the recorded outcomes of all turns but each session's last three, which are predicted.

    A turn's outcome is a hit if half of its prompt or more came from the cache. Its features are its size and what was
    recorded of the session before it.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    r = recorded_outcomes(fixture(spark, sf_dir, TRACES))
    data = VectorAssembler(inputCols=["raw_tokens", "prompt_tokens", "turn", "last_hit", "hit_rate", "last_cached"], outputCol="features").transform(r)
    model = GBTClassifier(maxIter=20, maxDepth=3, seed=7).fit(data.where("left > 3"))
    return model.transform(data.where("left <= 3")).select("session_id", "turn", "label", "prediction")


@query(TRACES, """WITH h AS (SELECT *, CASE WHEN cached_tokens * 2 >= prompt_tokens THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM src)
    SELECT session_id, turn, label, coalesce(lag(label) OVER w, 0.0::DOUBLE) AS last_hit, round(coalesce(avg(label) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 6) AS hit_rate, count(*) OVER (PARTITION BY session_id) - turn + 1 AS left FROM h WINDOW w AS (PARTITION BY session_id ORDER BY turn)""", name="record_outcome")
def record_outcome(t: DataFrame) -> DataFrame:
    return recorded_outcomes(t).select("session_id", "turn", "label", "last_hit", F.round("hit_rate", 6).alias("hit_rate"), "left")


def recorded_outcomes(t: DataFrame) -> DataFrame:
    """Each turn's outcome (label), what was recorded of its session before it, and how many turns are left with it."""
    w = Window.partitionBy("session_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("label", (C("cached_tokens") * 2 >= C("prompt_tokens")).cast("double"))
    t = t.withColumn("last_hit", F.coalesce(F.lag("label").over(w), F.lit(0.0))).withColumn("last_cached", F.coalesce(F.lag("cached_tokens").over(w), F.lit(0)))
    return t.withColumn("hit_rate", F.coalesce(F.avg("label").over(before), F.lit(0.0))).withColumn("left", F.count("*").over(Window.partitionBy("session_id")) - C("turn") + 1)


QUERIES["hit_classifier"] = hit_classifier


@query(MESSAGES, "WITH s AS (SELECT *, turn <= coalesce(min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id), 1000000) AS keep FROM src), p AS (SELECT conv_id, md5(string_agg(role || ':' || content, chr(10) ORDER BY turn)) AS k FROM s WHERE keep GROUP BY conv_id) SELECT k AS prefix_key, min(conv_id) AS first_seen, count(*) AS uses FROM p GROUP BY k")
def prefix_memo(m: DataFrame) -> DataFrame:
    """Static prefixes by first appearance."""
    p = static_prefix(m).groupBy("conv_id").agg(F.md5(ordered_join(F.concat("role", F.lit(":"), "content"))).alias("prefix_key"))
    return p.groupBy("prefix_key").agg(F.min("conv_id").alias("first_seen"), F.count("*").alias("uses"))


@query("events", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM src), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, session""")
def session_ttl(e: DataFrame) -> DataFrame:
    """Sessions end after an hour of silence."""
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events")).select("user_id", C("w.start").alias("started"), "events")


@query("events", "WITH l AS (SELECT user_id, max(ts) AS last_active, count(*) AS events FROM src GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY last_active DESC, user_id) AS k FROM l) SELECT user_id, events FROM r WHERE k <= 256")
def session_cap(e: DataFrame, most: int = 256) -> DataFrame:
    """The sessions active last, as many as the manager keeps; 0: all."""
    sessions = e.groupBy("user_id").agg(F.max("ts").alias("last_active"), F.count("*").alias("events"))
    kept = sessions.orderBy(F.desc("last_active"), "user_id").limit(most) if most else sessions
    return kept.select("user_id", "events")


@query("events", "SELECT user_id, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen, round(sum(value), 4) AS total FROM src GROUP BY user_id")
def session_list(e: DataFrame) -> DataFrame:
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.round(F.sum("value"), 4).alias("total"))


@query(TRACES, "SELECT session_id, max(turn) AS turns, sum(prompt_tokens)::BIGINT AS prompt, round(sum(cached_tokens)::DOUBLE / sum(prompt_tokens), 6) AS reuse, (sum(greatest(0, raw_tokens - prompt_tokens)))::BIGINT AS saved, count(*) FILTER (WHERE stage = 'error') AS degradations FROM src GROUP BY session_id")
def debug_snapshot(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id").agg(F.max("turn").alias("turns"), F.sum("prompt_tokens").alias("prompt"), F.round(F.sum("cached_tokens") / F.sum("prompt_tokens"), 6).alias("reuse"), F.sum(F.greatest(F.lit(0), C("raw_tokens") - C("prompt_tokens"))).alias("saved"), F.count_if(C("stage") == "error").alias("degradations"))


@query(MESSAGES, "SELECT conv_id, string_agg(role || ':' || content, chr(10) ORDER BY turn) AS context, sum(length(content))::BIGINT AS size FROM src GROUP BY conv_id")
def context_serialise(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id").agg(ordered_join(F.concat("role", F.lit(":"), "content")).alias("context"), F.sum(F.length("content")).alias("size"))


@query("SELECT conv_id, turn, role, text AS content, map('a', 'x', '_session', 'y') AS extra FROM {conversations}", None)
def request_hygiene(m: DataFrame) -> DataFrame:
    """Extra fields without the internal ones."""
    return m.select("conv_id", "turn", F.map_filter("extra", lambda k, v: ~k.startswith("_"))["a"].alias("a"), F.size(F.map_filter("extra", lambda k, v: ~k.startswith("_"))).alias("n_extra"))


ORACLE["request_hygiene"] = "SELECT conv_id, turn, 'x' AS a, 1 AS n_extra FROM conversations"

# --- streams --------------------------------------------------------------------------------------------------------


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.streaming import traces

    return traces.window_counts(spark, f"{sf_dir}/events.parquet")


QUERIES["stream_counts"] = stream_counts
ORACLE["stream_counts"] = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.streaming import traces

    return traces.expired_sessions(spark, f"{sf_dir}/events.parquet")


QUERIES["stream_sessions"] = stream_sessions
# The input is one file, hence one batch: what is silent for an hour before the watermark has ended when the stream does.
ORACLE["stream_sessions"] = """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e),
    g AS (SELECT user_id, k, count(*) AS events, sum(value ORDER BY ts) AS total, max(ts) AS last FROM s GROUP BY user_id, k)
    SELECT user_id, events, total, k < max(k) OVER (PARTITION BY user_id) OR last + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) AS ended FROM g"""

# --- the composed pipeline ------------------------------------------------------------------------------------------


@query(LOGS, None)
def log_pipeline(d: DataFrame) -> DataFrame:
    """Tool logs as conversations of tool messages through the composed pipeline."""
    from loomline.plans.compaction import compact_conversations

    m = d.select("conv_id", C("log_id").alias("turn"), F.when(C("log_id") % 4 == 0, "user").when(C("log_id") % 4 == 1, "assistant").otherwise("tool").alias("role"), C("text").alias("content"))
    return compact_conversations(m, budget=2000)


@query(MESSAGES, None)
def main_pipeline(m: DataFrame) -> DataFrame:
    from loomline.plans.compaction import compact_conversations

    return compact_conversations(m, budget=600)


@query(MESSAGES, "WITH f AS (SELECT conv_id, coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), '') AS content FROM src GROUP BY conv_id), " + TASKS.replace("FROM src", "FROM f", 1)[5:] + " SELECT conv_id, task, task || ':' || CAST(('0x' || substr(md5(task), 1, 8))::BIGINT % 1000 AS STRING) || ':' || substr(md5(content), 1, 8) AS partition_key FROM k")
def template_partition(m: DataFrame) -> DataFrame:
    first = m.groupBy("conv_id").agg(F.coalesce(F.min_by("content", F.when(C("role") == "user", C("turn"))), F.lit("")).alias("c"))
    return first.select("conv_id", T.task_class(C("c")).alias("task"), T.partition_key(T.task_class(C("c")), C("c")).alias("partition_key"))
