"""Two levels: seed nodes from a precise codec, others from the general one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def self_features(nodes: DataFrame, seed_features: DataFrame, all_features: DataFrame) -> DataFrame:
    """(node_id, feat): the seed codec's value where there is one, else the general one's."""
    first = seed_features.select("node_id", F.col("feat").alias("a"))
    rest = all_features.select("node_id", F.col("feat").alias("b"))
    return nodes.select("node_id").join(first, "node_id", "left").join(rest, "node_id", "left").select("node_id", F.coalesce("a", "b").alias("feat"))


def concat_decode(seed_part: DataFrame, rest: DataFrame) -> DataFrame:
    """(node_id, feat): decoded seeds and the decoded rest."""
    return seed_part.select("node_id", "feat").unionByName(rest.select("node_id", "feat"))
