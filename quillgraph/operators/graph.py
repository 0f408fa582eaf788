"""Edge lists, degrees, offsets, splits and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.lineage import cut


def bidirect(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, parallel ones collapsed."""
    both = edges.select("dst", "src").union(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")))
    return both.distinct()


def hetero_union(relations: list[tuple[DataFrame, int, int, bool]]) -> DataFrame:
    """Relations (edges, dst offset, src offset, both ways) in one id space, as a bag."""
    out = None
    for edges, dst_at, src_at, both in relations:
        moved = edges.select((F.col("dst") + dst_at).alias("dst"), (F.col("src") + src_at).alias("src"))
        if both:
            moved = moved.union(moved.select(F.col("src").alias("dst"), F.col("dst").alias("src")))
        out = moved if out is None else out.union(moved)
    return out


def in_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, deg); with ``nodes``, also those without edges, as 0."""
    deg = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("deg"))
    return deg if nodes is None else nodes.select("node_id").join(deg, "node_id", "left").select("node_id", F.coalesce("deg", F.lit(0)).alias("deg"))


def prefix_sum(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` up to and with each row: range partitions, their totals, and a sum within each."""
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = cut(rows.repartitionByRange(*sort).withColumn("_p", F.spark_partition_id()))
    starts, total = [], 0
    for r in parts.groupBy("_p").agg(F.sum(value).alias("s")).orderBy("_p").collect():  # a row a partition
        starts.append((r["_p"], int(total)))
        total += r["s"] or 0
    table = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    within = Window.partitionBy("_p").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_sum", F.sum(value).over(within)).join(F.broadcast(table), "_p").withColumn(name, F.col("_start") + F.col("_sum")).drop("_p", "_start", "_sum")


def indptr(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, beg, end): each node's slice of the edges in the order of dst."""
    ends = prefix_sum(in_degree(edges, nodes), ["node_id"], "deg", "end")
    return ends.select("node_id", (F.col("end") - F.col("deg")).alias("beg"), "end")


def split_ids(nodes: DataFrame, shares: dict[str, tuple[int, int]], seed_col: str = "bucket") -> DataFrame:
    """(node_id, split) by ranges [low, high) of one bucket column, so that splits never overlap."""
    split = F.lit(None).cast("string")
    for name, (low, high) in shares.items():
        split = F.when((F.col(seed_col) >= low) & (F.col(seed_col) < high), name).otherwise(split)
    return nodes.select("node_id", split.alias("split")).where("split is not null")


def seeds_union(splits: DataFrame, names: list[str]) -> DataFrame:
    """(node_id, part): the splits one after the other, duplicates kept."""
    out = None
    for at, name in enumerate(names):
        one = splits.where(F.col("split") == name).select("node_id", F.lit(at).alias("part"))
        out = one if out is None else out.union(one)
    return out


def num_classes(labels: DataFrame, column: str = "label") -> DataFrame:
    """The largest label that is neither null nor NaN, plus 1."""
    known = labels.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return known.agg((F.max(F.col(column)).cast("int") + 1).alias("num_classes"))


def two_tier_gather(keys: DataFrame, cache: DataFrame, base: DataFrame, value: str = "feat") -> DataFrame:
    """Values from the cache or else from the base; the same as from the base alone."""
    hit = cache.select("node_id", F.col(value).alias("_c"))
    rest = base.select("node_id", F.col(value).alias("_b"))
    return keys.join(hit, "node_id", "left").join(rest, "node_id", "left").select("node_id", F.coalesce("_c", "_b").alias(value), F.col("_c").isNotNull().alias("hit"))


def remote_access(seeds: DataFrame, blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """(rank, remote_seeds, remote_neighbours): ids outside of the range [lo, hi) that their rank owns."""
    own = F.broadcast(bounds)  # a row a rank
    outside = lambda c: ((F.col(c) < F.col("lo")) | (F.col(c) >= F.col("hi"))).cast("long")
    a = seeds.join(own, "rank").groupBy("rank").agg(F.sum(outside("node_id")).alias("remote_seeds"))
    b = blocks.join(own, "rank").groupBy("rank").agg(F.sum(outside("src")).alias("remote_neighbours"))
    return a.join(b, "rank", "full").select("rank", F.coalesce("remote_seeds", F.lit(0)).alias("remote_seeds"), F.coalesce("remote_neighbours", F.lit(0)).alias("remote_neighbours"))


def local_ids(ids: DataFrame, owned: DataFrame) -> DataFrame:
    """The distinct ids (node_id) that are among those owned."""
    return ids.select("node_id").distinct().join(owned.select("node_id"), "node_id", "left_semi")


def epoch_means(epochs: DataFrame, values: list[str], skip: int = 1, last: int = 5) -> DataFrame:
    """Means of values over epochs from ``skip`` on, and of accuracy over the last epochs; rows are (epoch, accuracy, values...)."""
    end = epochs.agg(F.max("epoch")).first()[0]
    means = [F.avg(F.when(F.col("epoch") >= skip, F.col(v))).alias(v) for v in values]
    return epochs.agg(*means, F.avg(F.when(F.col("epoch") > (end if end is not None else 0) - last, F.col("accuracy"))).alias("accuracy"))


def remote_totals(counts: DataFrame, skip: int = 1) -> DataFrame:
    """(remote_seeds, remote_neighbours) of rows (epoch, rank, ...): each rank's mean over epochs from ``skip`` on, summed over ranks."""
    kept = counts.where(F.col("epoch") >= skip).groupBy("rank").agg(F.avg("remote_seeds").alias("a"), F.avg("remote_neighbours").alias("b"))
    return kept.agg(F.sum("a").alias("remote_seeds"), F.sum("b").alias("remote_neighbours"))
