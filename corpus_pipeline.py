"""The corpus pipeline: toxicity, language, near-duplicates, mixing, tokens. Counted as part of the subpackage llm.

``run`` chains the stages lazily; a driver may also write each stage's result and pass on what it
has read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, langid, mixing, near, toxicity
from quillgraph.llm.common import checkpoint, table
from quillgraph.llm.queries import VOCABULARY

#: How far from chance to certainty the best language of a document must be; chance is one over the languages learned.
ABOVE_CHANCE = 0.2
#: The power that the languages' shares of tokens are raised to; 1 would leave them as they are.
FLATTEN = 0.8
#: Tokens after mixing, as a multiple of those before; every document stays, so the languages with few tokens are repeated.
GROWTH = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict toxic."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, carry=docs.columns)


def least_language_score(languages: int) -> float:
    """The least probability of the best of so many languages; with one, there is nothing to tell it from."""
    return 1 / languages + ABOVE_CHANCE * (1 - 1 / languages) if languages > 1 else 0.0


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the language operator knows."""
    net = langid.learn(docs)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least_language_score(len(net.languages) if net else 1))
    return langid.identify(docs, net, carry=docs.columns, keep=known)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, texts of 5-word Jaccard 0.8 at least: the one with the smallest id.

    Rows that share an id are told apart by the text: of those in one group the one whose text has the smallest hash
    stays, and those in different groups all stay. Rows without an id all stay.
    """
    text_key = F.xxhash64(F.col("text").cast("binary")).alias("text_key")
    found = near.near_duplicates(docs).where("doc_id = component_id")
    kept = found.groupBy("component", "doc_id").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    rows = docs.select("doc_id", text_key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept, ["doc_id", "text_key"], "left_semi")
    once = rows.groupBy("doc_id", "text_key").agg(F.min("row").alias("row")).select("row.*")
    return once.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' shares of tokens come nearer to each other; every document stays."""
    rates = mixing.mix(docs, least_rate=1.0, flatten=FLATTEN, growth=GROWTH)
    return mixing.apply_rates(docs, rates)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", tokens),
]
#: SQL cannot express learned models and connected components.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table documents; what a stage keeps is checkpointed, as the next reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
