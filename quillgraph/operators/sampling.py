"""Deterministic sampling by hash order, neighbour sampling, relabelling and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from quillgraph.functions.lineage import cut


def hash_text(seed: str, *cols: str) -> Column:
    """md5 of the seed and the columns, joined by ``|``: a random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def hash_unit(seed: str, *cols: str) -> Column:
    """A number in (0, 1) from the first 52 bits of the hash."""
    return (F.conv(F.substring(hash_text(seed, *cols), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def uniform(rows: DataFrame, n: int, seed: str = "u", key: str = "node_id") -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    return _least(rows, hash_text(seed, key), key, n)


def _least(rows: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The n rows of the least (order, key), all if there are fewer. Only orders and keys are ranked; the rows themselves are filtered in place."""
    at = F.struct(order.alias("o"), F.col(key).alias("k"))
    last = rows.select(at.alias("at")).orderBy("at").limit(n).agg(F.max("at").alias("at"), F.count("*").alias("n")).first()
    if last["n"] < n:
        return rows
    known = rows.withColumn("_at", at).join(F.broadcast(rows.sparkSession.createDataFrame([(last["at"],)], rows.select(at.alias("_last")).schema)), F.col("_at") <= F.col("_last"))  # one row
    return known.drop("_at", "_last")


def weighted(rows: DataFrame, n: int, seed: str = "w", key: str = "node_id", weight: str = "h") -> DataFrame:
    """n rows without replacement by weight: the least -ln(u) / weight. Rows of no weight take no part."""
    return _least(rows.where(F.col(weight) > 0), -F.log(hash_unit(seed, key)) / F.col(weight), key, n)


def neighbours(edges: DataFrame, k: int, seed: str = "n", dst: str = "dst", keys: tuple[str, ...] = ()) -> DataFrame:
    """At most k neighbours of every dst (and of the further keys), without replacement."""
    order = Window.partitionBy(*keys, dst).orderBy(hash_text(seed, *keys, dst, "src"), "src")
    return edges.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k).drop("pick")


def neighbours_replaced(edges: DataFrame, k: int, seed: str = "r") -> DataFrame:
    """(dst, draw, src): k draws with replacement for every dst that has neighbours."""
    order = Window.partitionBy("dst").orderBy("src")
    placed = edges.withColumn("place", F.row_number().over(order) - 1)
    sizes = edges.groupBy("dst").agg(F.count("*").alias("deg"))
    draws = sizes.select("dst", "deg", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    draws = draws.withColumn("place", F.least(F.floor(hash_unit(seed, "dst", "draw") * F.col("deg")), F.col("deg") - 1).cast("int"))
    return draws.join(placed, ["dst", "place"]).select("dst", "draw", "src")


def relabel(seeds: DataFrame, sampled: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch_id, node_id, local_id): dense ids of each batch's nodes, seeds first in their order, then others by id."""
    first = seeds.groupBy(batch, "node_id").agg(F.min("pos").alias("pos"))
    others = sampled.select(batch, F.col("src").alias("node_id")).distinct().join(first, [batch, "node_id"], "left_anti")
    both = first.select(batch, "node_id", F.lit(0).alias("new"), "pos").union(others.select(batch, "node_id", F.lit(1), F.col("node_id")))
    order = Window.partitionBy(batch).orderBy("new", "pos", "node_id")
    return both.select(batch, "node_id", (F.row_number().over(order) - 1).cast("int").alias("local_id"))


def batches(seeds: DataFrame, size: int, drop_last: bool = False, pos: str = "pos") -> DataFrame:
    """``seeds`` with a batch_id by position; ``drop_last`` leaves out an unfinished batch."""
    out = seeds.withColumn("batch_id", F.floor(F.col(pos) / size).cast("int"))
    return out.where(F.col("batch_id") < seeds.count() // size) if drop_last else out


def positions(rows: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """Rows with a gapless position in a global order: a range partitioning, the partitions' counts, and the place in each."""
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = cut(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for r in parts.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a partition
        starts.append((r["p"], total))
        total += r["count"]
    table = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return parts.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, place + F.col("_start")).drop("_p", "_start", "_id")


def swap_seeds(seeds: DataFrame, size: int, ranks: int = 1, rank: int = 0, drop_last: bool = False) -> tuple[DataFrame, int]:
    """Another seed set (node_id) for a loader: its batches of one rank, and how many there are."""
    placed = positions(seeds.select("node_id"), ["node_id"])
    own = rank_partition(placed, ranks).where(F.col("rank") == rank).drop("rank")
    first = own.agg(F.min("pos")).first()[0] or 0
    out = batches(own.withColumn("pos", F.col("pos") - first), size, drop_last)
    n = own.count()
    return out, n // size if drop_last else -(-n // size)


def unique_inverse(rows: DataFrame, value: str, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Distinct values (value, at, n) numbered in their order, with counts; and (key, at) for every row."""
    distinct = positions(rows.groupBy(value).agg(F.count("*").alias("n")), [value], "at")
    return distinct, rows.join(distinct.drop("n"), value).select(key, "at")


def loader(seeds: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], seed: str = "k") -> tuple[list[DataFrame], DataFrame]:
    """Mini-batches whole: the blocks (batch_id, dst, src) of every hop in local ids, seeds' hop first, and (batch_id, local_id, node_id, hop, feat) of all nodes.

    A batch's ids grow with the hops: seeds first, then what each hop adds by id. ``hop`` is the number of hops after which a
    node is known, so the destinations of block h are the nodes of hop h and less, with or without sampled neighbours.
    """
    ids = relabel(seeds.select("batch_id", "node_id", "pos"), seeds.select("batch_id", F.col("node_id").alias("src"))).withColumn("hop", F.lit(0))
    blocks = khop(seeds, edges, fanouts, seed)
    for n, block in enumerate(blocks, 1):
        more = relabel(ids.select("batch_id", "node_id", F.col("local_id").alias("pos")), block)
        ids = cut(more.join(ids.select("batch_id", "node_id", "hop"), ["batch_id", "node_id"], "left").withColumn("hop", F.coalesce("hop", F.lit(n))))
    dst = ids.select("batch_id", F.col("node_id").alias("dst"), F.col("local_id").alias("d"))
    src = ids.select("batch_id", F.col("node_id").alias("src"), F.col("local_id").alias("s"))
    local = [b.join(dst, ["batch_id", "dst"]).join(src, ["batch_id", "src"]).select("batch_id", F.col("d").alias("dst"), F.col("s").alias("src")) for b in blocks]
    return local, ids.join(features.select("node_id", "feat"), "node_id").select("batch_id", "local_id", "node_id", "hop", "feat")


def rank_partition(rows: DataFrame, ranks: int, pos: str = "pos") -> DataFrame:
    """Rows with the rank that owns their position: contiguous ranges of ceil(n / ranks)."""
    width = max(1, -(-rows.count() // ranks))
    return rows.withColumn("rank", F.floor(F.col(pos) / width).cast("int"))


def khop(seeds: DataFrame, edges: DataFrame, fanouts: list[int], seed: str = "k") -> list[DataFrame]:
    """Sampled blocks (batch_id, dst, src), seeds' hop first. The next hop's frontier is every node met so far in the batch."""
    frontier = seeds.select("batch_id", F.col("node_id").alias("dst")).distinct()
    blocks = []
    for hop, k in enumerate(fanouts):
        met = frontier.join(edges, "dst")
        block = neighbours(met, k, f"{seed}{hop}", keys=("batch_id",)).select("batch_id", "dst", "src")
        blocks.append(block)
        frontier = frontier.union(block.select("batch_id", F.col("src").alias("dst"))).distinct()
    return blocks
