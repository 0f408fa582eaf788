"""URL filter: host-suffix and path-prefix expressions, hash-prefix join, digest check, precedence.

A rule names a host and the start of a path. It fits a URL whose host is the rule's host or
a subdomain of it and whose path begins with the rule's path. Each URL is expanded only into
the shapes (labels in the suffix, characters in the prefix) that the rules have, so the number
of expressions for a URL is bounded by the rule set and never by the URL's length.

Expressions and rules meet on a short prefix of their digests alone; the full digests are compared
where the rules met are ranked, which no optimizer can move into the join's keys.

Defined results: a null URL or one without ``://`` has an empty host and an empty path; an empty
host fits no rule. Repeated rows are all returned. Columns besides id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that serve as the join key.
PREFIX_DIGITS = 8
#: Keys that rows without a host, which no rule fits, are spread over.
HOSTLESS_KEYS = 1 << 12


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with shapes, digests and join keys; of equal rules a block stays."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    return (
        rules.where("host is not null and path is not null and verdict is not null and host <> ''")
        .select(host.alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.length("host").alias("host_length"),
            F.size(F.split("host", "[.]")).alias("labels"),
            F.length("path").alias("path_length"),
            F.sha2(F.concat("host", "path"), 256).alias("digest"),
        )
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for every row: the longest fitting rule's, else ``default``.

    Length is that of host and path together; between rules of one length the one with the
    longer host wins, then the smaller text. Returns id, host, path, rule, verdict.
    """
    spark = pages.sparkSession
    ready = prepare_rules(rules)
    shapes = sorted((r.labels, r.path_length) for r in ready.select("labels", "path_length").distinct().collect())
    urls = pages.select(F.col(f"`{id_col}`").alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shapes:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = ", ".join(f"named_struct('n', {n}, 'l', {k})" for n, k in shapes)
    expressions = F.expr(
        f"transform(filter(array({listed}), s -> s.n <= size(labels) and s.l <= length(path)), "
        "s -> concat(array_join(slice(labels, -s.n, s.n), '.'), substring(path, 1, s.l)))"
    )
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    expanded = distinct.withColumn("labels", F.split("host", "[.]")).select("host", "path", F.explode(expressions).alias("expression"))
    keyed = expanded.select("host", "path", F.sha2("expression", 256).alias("full")).withColumn("key", F.substring("full", 1, PREFIX_DIGITS))
    met = keyed.join(ready, "key")
    confirmed = F.col("full") == F.col("digest")
    order = F.struct((F.col("host_length") + F.col("path_length")).alias("a"), F.col("host_length").alias("b"), F.col("rule").alias("c"))
    ranked = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.when(confirmed, order)).alias("best"))
    best = ranked.select(F.concat_ws("\n", F.lit("u"), "host", "path").alias("at"), "best")
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(HOSTLESS_KEYS)).cast("string")
    at = F.when(F.col("host") == "", F.concat_ws("\n", F.lit("none"), spread)).otherwise(F.concat_ws("\n", F.lit("u"), "host", "path"))
    out = urls.withColumn("at", at).join(best, "at", "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
