"""Sharding by a k-d tree over metadata: weighted medians along the widest dimension.

A document's metadata are its bytes, spaces and lines, on a logarithmic scale. The root holds all
documents; a node is split along the dimension in which it is widest, at the point that divides
its bytes in the proportion of the leaves on either side, until every leaf holds the target.
The points of all nodes of a level are found together: a pass adds up the bytes in
``BUCKETS`` intervals of every node's key and only the interval around the point is divided
again, so a pass returns a bounded number of sums and no document is moved. The key is
the coordinate, then the text's crc32, so equal texts stay together; only a group of equal texts
that would move a split by over ``KEEP_TOGETHER`` of a leaf is divided, by the hash of the ids.

Defined results: a null text has size 1. An empty table gives an empty result. Repeated rows are
placed like any others; rows equal in id and text lie in one shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint

#: Intervals that a pass divides a node's key into.
BUCKETS = 2048
#: Share of a node's bytes within which a split is near enough.
TOLERANCE = 0.0005
#: Share of a leaf's bytes by which a split may miss so as to keep equal texts together.
KEEP_TOGETHER = 0.05
DIMENSIONS = ("size", "spaces", "lines")


@dataclass
class Split:
    """The search for one node's split: the interval [low, high] of its key, the bytes left of it, and where it ends up."""

    node: int
    dimension: int
    total: int
    leaf: float
    aim: float
    low: int
    high: int
    base: int = 0
    tie: int | None = None  # once set, the interval is one of hashes among the rows whose key is ``tie``
    cut: tuple[int, int] | None = None  # rows whose (key, hash) is less go left


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, crc, h, keys): the narrow rows that the search reads; keys has one number a dimension."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    crc = F.crc32(F.col("text").cast("binary"))
    measures = (F.octet_length("text"), F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    keys = [F.shiftleft(F.floor(F.log2(m.cast("double") + 1) * (1 << 20)).cast("long"), 32) + crc for m in measures]
    return given.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), crc.alias("crc"), F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).alias("h"), F.array(*keys).alias("keys"))


def _descend(rows: DataFrame, cuts: list[Split]) -> DataFrame:
    """Rows with their node one level further down; nodes without a cut stay."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(c.node, c.dimension, *c.cut) for c in cuts], "node int, dimension int, cut_key long, cut_hash long")
    met = rows.join(F.broadcast(table), "node", "left")  # as many rows as nodes of the level
    key = F.element_at("keys", F.col("dimension") + 1)
    right = (key > F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("h") >= F.col("cut_hash")))
    node = F.when(F.col("cut_key").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))
    return met.select("doc_id", "size", "crc", "h", "keys", node.cast("int").alias("node"))


def _search(rows: DataFrame, splits: list[Split]) -> None:
    """Find the cuts of all splits, a level of intervals at a time."""
    spark = rows.sparkSession
    while open_ := [s for s in splits if s.cut is None]:
        table = spark.createDataFrame(
            [(s.node, s.dimension, s.tie is not None, s.tie or 0, s.low, s.high, -(-(s.high - s.low + 1) // BUCKETS)) for s in open_],
            "node int, dimension int, tied boolean, tie long, low long, high long, width long",
        )
        met = rows.join(F.broadcast(table), "node").withColumn("key", F.element_at("keys", F.col("dimension") + 1))
        at = F.when(F.col("tied"), F.col("h")).otherwise(F.col("key"))
        inside = met.where((~F.col("tied") | (F.col("key") == F.col("tie"))) & at.between(F.col("low"), F.col("high")))
        sums = inside.groupBy("node", F.floor((at - F.col("low")) / F.col("width")).cast("int").alias("bucket")).agg(F.sum("size").alias("w"))
        by_node: dict[int, list[tuple[int, int]]] = {}
        for r in sums.collect():  # at most BUCKETS sums a node
            by_node.setdefault(r["node"], []).append((r["bucket"], r["w"]))
        for s in open_:
            _narrow(s, sorted(by_node[s.node]))


def _narrow(s: Split, sums: list[tuple[int, int]]) -> None:
    width = -(-(s.high - s.low + 1) // BUCKETS)
    left = s.base
    for bucket, w in sums:
        if left + w >= s.aim or (bucket, w) == sums[-1]:
            break
        left += w
    start, end = s.low + bucket * width, min(s.high, s.low + (bucket + 1) * width - 1)
    near_left = s.aim - left <= left + w - s.aim
    miss = min(abs(s.aim - left), abs(left + w - s.aim))
    point = start if near_left else end + 1
    if s.tie is None:
        if w <= TOLERANCE * s.total or (start == end and miss <= KEEP_TOGETHER * s.leaf):
            s.cut = (point, 0)
        elif start == end:
            s.tie, s.low, s.high, s.base = start, 0, (1 << 62) - 1, left
        else:
            s.low, s.high, s.base = start, end, left
    elif start == end or miss <= TOLERANCE * s.total:
        s.cut = (s.tie, point)
    else:
        s.low, s.high, s.base = start, end, left


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a leaf of the tree and a gapless place in it for every row."""
    base = checkpoint(metadata(docs, id_col, text_col))
    rows = base.withColumn("node", F.lit(1))
    leaves, done = {1: shards}, {}
    while leaves:
        done |= {n: m for n, m in leaves.items() if m == 1}
        leaves = {n: m for n, m in leaves.items() if m > 1}
        if not leaves:
            break
        spans = [f(F.element_at("keys", i + 1)).alias(f"{f.__name__}{i}") for i in range(len(DIMENSIONS)) for f in (F.min, F.max)]
        splits = []
        for r in rows.where(F.col("node").isin(list(leaves))).groupBy("node").agg(F.sum("size").alias("w"), *spans).collect():
            wide = max(range(len(DIMENSIONS)), key=lambda i: ((r[f"max{i}"] >> 32) - (r[f"min{i}"] >> 32), -i))
            aim = r["w"] * (leaves[r["node"]] // 2) / leaves[r["node"]]
            splits.append(Split(r["node"], wide, r["w"], r["w"] / leaves[r["node"]], aim, r[f"min{wide}"], r[f"max{wide}"]))
        if not splits:
            break
        _search(rows, splits)
        rows = _descend(rows, splits)
        halves = {n: m for n, m in leaves.items() if any(s.node == n for s in splits)}
        leaves = {2 * n + side: m // 2 if side == 0 else m - m // 2 for n, m in halves.items() for side in (0, 1)}
    order = sorted(set(done) | set(leaves), key=lambda n: bin(n)[3:])
    named = docs.sparkSession.createDataFrame(list(zip(order, range(len(order)), strict=True)), "node int, shard int")
    placed = rows.join(F.broadcast(named), "node").select("doc_id", "size", "crc", "shard", "h")  # a row a shard
    dealt = placed.repartitionByRange(F.col("shard"), F.col("h")).sortWithinPartitions("shard", "h", "doc_id")
    numbered = checkpoint(dealt.withColumn("place", F.monotonically_increasing_id()))
    part, index = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    runs = numbered.groupBy("shard", part.alias("part")).agg(F.min(index).alias("first"), F.count("*").alias("n")).orderBy("shard", "part").collect()  # a row a partition and shard
    offsets, total = [], {}
    for r in runs:
        offsets.append((r["shard"], r["part"], total.get(r["shard"], 0) - r["first"]))
        total[r["shard"]] = total.get(r["shard"], 0) + r["n"]
    starts = docs.sparkSession.createDataFrame(offsets, "shard int, part long, shift long")
    out = numbered.withColumn("part", part).join(F.broadcast(starts), ["shard", "part"])  # as many rows as partitions and shards
    return out.select(F.col("doc_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (index + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
