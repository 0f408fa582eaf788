"""The queries opN_*: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, gif, html_text, langid, mixing, mtree, sharding, simhash, toxicity, url_filter
from quillgraph.llm.common import table

#: The rules that op10 judges by (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: The rank file that op9 encodes by.
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that give every language the same number of expected tokens."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a GIF and read back."""
    return gif.text_media(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the table labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of all documents, near equal in bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP6_SQL = """
WITH e AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT id, min(v) AS v FROM e WHERE id % 50 = 0 GROUP BY id) AS q JOIN e AS c ON q.id <> c.id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, t, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT host, path, arg_max({'rule': h || t, 'verdict': v}, length(h) + length(t)) AS b
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY host, path
)
SELECT page_id, p.host, p.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": op2_mixing,
        "op3_gif": op3_gif,
        "op4_toxicity": op4_toxicity,
        "op5_sharding": op5_sharding,
        "op6_topk": op6_topk,
        "op7_simhash": op7_simhash,
        "op8_html": op8_html,
        "op9_bpe": op9_bpe,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express on whole tables."""
    return {"op6_topk": OP6_SQL, "op10_url_filter": OP10_SQL}
