"""Hotness and cache planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import cut
from quillgraph.functions.planning import allocate
from quillgraph.operators.graph import in_degree, prefix_sum
from quillgraph.operators.sampling import positions


def presample(seeds: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(node_id, seed_h, sampling_h, feature_h): accesses in one dry epoch.

    A seed counts once. In each hop the frontier's nodes count once a batch for sampling; the nodes
    of a batch's last frontier count once for features.
    """
    frontier = seeds.select("batch_id", "node_id").distinct()
    sampled = frontier
    for n, block in enumerate(blocks):
        frontier = frontier.union(block.select("batch_id", F.col("src").alias("node_id"))).distinct()
        if n < len(blocks) - 1:
            sampled = sampled.union(frontier)
    one = lambda df, name: df.groupBy("node_id").agg(F.count("*").alias(name))
    a = seeds.select("node_id").distinct().withColumn("seed_h", F.lit(1).cast("long"))
    out = a.join(one(sampled, "sampling_h"), "node_id", "full").join(one(frontier, "feature_h"), "node_id", "full")
    return out.select("node_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("seed_h", "sampling_h", "feature_h")])


def cost_weights(hotness: DataFrame, degrees: DataFrame, element_bytes: int, dim: int, fanout: int) -> DataFrame:
    """(feature_weight, graph_weight): mean costs of an access among nodes that are accessed."""
    hot = hotness.join(degrees, "node_id", "left").where("h > 0")
    entry = F.least(F.coalesce(F.col("deg"), F.lit(0)).cast("double"), F.lit(fanout * 1.3)) * element_bytes + element_bytes
    return hot.agg((F.avg(F.col("h").cast("double")) * element_bytes * dim).alias("feature_weight"), F.avg(entry * F.col("h")).alias("graph_weight"))


def feature_cache(hotness: DataFrame, row_bytes: int, capacity: int) -> DataFrame:
    """(node_id, h) of the rows to cache: all that fit whole, else the hottest; an entry takes 10 bytes besides its row."""
    if capacity <= 0:
        return hotness.limit(0)
    if hotness.count() * row_bytes <= capacity:
        return hotness.select("node_id", "h")
    k = capacity // (row_bytes + 10)
    return positions(hotness.select("node_id", "h"), [F.desc("h"), F.asc("node_id")], "_at").where(F.col("_at") < k).select("node_id", "h")


def graph_cache(hotness: DataFrame, degrees: DataFrame, element_bytes: int, capacity: int) -> DataFrame:
    """(node_id, h, size, cum): adjacency to cache: all of it if it fits whole, else hottest first while the running size is under the capacity."""
    sized = hotness.join(degrees, "node_id").select("node_id", "h", (F.col("deg") * element_bytes + element_bytes + 10).alias("size"))
    if capacity <= 0:
        return sized.withColumn("cum", F.col("size")).limit(0)
    summed = prefix_sum(sized, [F.desc("h"), F.asc("node_id")], "size", "cum")
    whole = degrees.agg(F.sum(F.col("deg") * element_bytes + element_bytes)).first()[0] or 0
    return summed if whole + element_bytes <= capacity else summed.where(F.col("cum") < capacity)


def cached_edges(edges: DataFrame, cache: DataFrame) -> DataFrame:
    """The edges of the cached nodes."""
    return edges.join(cache.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def hit_ratio(hotness: DataFrame, cache: DataFrame) -> DataFrame:
    """(ratio): the share of accesses that the cache serves."""
    met = hotness.join(cache.select("node_id", F.lit(1).alias("hit")), "node_id", "left")
    return met.agg((F.sum(F.when(F.col("hit") == 1, F.col("h")).otherwise(0)) / F.sum("h")).alias("ratio"))


def create_caches(seeds: DataFrame, edges: DataFrame, blocks: list[DataFrame], capacity: int, element_bytes: int, fanout: int, row_bytes: int, seed_row_bytes: int = 0) -> dict[str, DataFrame]:
    """The caches ``graph``, ``features`` and, with ``seed_row_bytes``, ``seeds`` under one capacity.

    Hotness is counted in one dry epoch; the capacity is split by the mean cost of an access to each, none above its full size.
    """
    hot = cut(presample(seeds, blocks))
    degrees = in_degree(edges)
    by = {name: hot.select("node_id", F.col(f"{name}_h").alias("h")).where("h > 0") for name in ("sampling", "feature", "seed")}
    sizes = degrees.agg(F.sum(F.col("deg") * element_bytes + element_bytes).alias("g")).first()["g"] or 0
    graph_weight = cost_weights(by["sampling"], degrees, element_bytes, 1, fanout).first()["graph_weight"] or 0.0
    mean = lambda name, size: (by[name].agg(F.avg("h")).first()[0] or 0.0) * size
    rows = {name: by[name].count() for name in ("feature", "seed")}
    weights, limits = [graph_weight, mean("feature", row_bytes)], [sizes + element_bytes, rows["feature"] * row_bytes]
    if seed_row_bytes:
        weights.append(mean("seed", seed_row_bytes))
        limits.append(rows["seed"] * seed_row_bytes)
    shares = allocate(capacity, weights, limits)
    out = {"graph": graph_cache(by["sampling"], degrees, element_bytes, shares[0]), "features": feature_cache(by["feature"], row_bytes, shares[1])}
    if seed_row_bytes:
        out["seeds"] = feature_cache(by["seed"], seed_row_bytes, shares[2])
    return out
