"""The training-data operators' queries, one per operator with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontamination, jaccard_join, language_id, mixing, pii, sharding, spotsigs, token_count, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("path", "offset")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints_and_edits(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabulary files

    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = language_id.sample(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), texts)
    return found.select("doc_id", language_id.held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.queue(_table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


#: The key of the query's surrogates; a production run passes a secret of its own.
PII_KEY = b"loomline surrogates"


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(_table(spark, sf_dir, "documents"), PII_KEY)


QUERIES: dict[str, Query] = {"op1_decontamination": op1_decontamination, "op2_warc": op2_warc, "op3_spotsigs": op3_spotsigs, "op4_url_filter": op4_url_filter, "op5_token_counts": op5_token_counts, "op6_language_id": op6_language_id, "op7_mixing": op7_mixing, "op8_sharding": op8_sharding, "op9_jaccard_join": op9_jaccard_join, "op10_pii_surrogates": op10_pii_surrogates}

_HOST = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = lambda rule: f"(host = '{rule.partition('/')[0]}' OR host LIKE '%.{rule.partition('/')[0]}') AND starts_with(path, '/{rule.partition('/')[2]}')"
_RULE = "CASE " + " ".join(f"WHEN {_FITS(r)} THEN '{r}'" for r, _ in sorted(URL_RULES, key=lambda x: -len(x[0]))) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in URL_RULES) + " ELSE 'allow' END"

ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
            CASE WHEN n >= 1000 AND last_id > page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND last_id > page_id THEN last_id END AS refers_to
        FROM r""",
    "op4_url_filter": f"""
        WITH parts AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        judged AS (SELECT *, {_RULE} AS rule FROM parts)
        SELECT page_id, host, path, rule, {_VERDICT} AS verdict FROM judged""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
            FROM words),
        nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
        shingles AS (SELECT node, n, unnest(s) AS x FROM nodes),
        links AS (
            SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node <> b.node
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach(node, root) AS (SELECT node, node FROM nodes WHERE n > 0 UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
        labels AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id
        FROM sets d LEFT JOIN nodes n ON n.s = list_sort(d.s) AND n.n > 0 LEFT JOIN labels l ON l.node = n.node""",
}
