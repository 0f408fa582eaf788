"""Compressed features: planned, encoded level by level, stored as Parquet and opened again."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.planning import PACKED_BITS, CodecLevel, plan_codec
from quillgraph.functions.vectors import dimension
from quillgraph.operators import bitpack, sq, twolevel, vq


@dataclass
class Level:
    """One level: its plan, codes (node_id, codes) and codebook, scalar or of centers."""

    plan: CodecLevel
    codes: DataFrame
    book: sq.Codebook | DataFrame


@dataclass
class Codec:
    """Levels of one feature table; with two, the first holds the seeds."""

    dim: int
    levels: list[Level]

    def decode(self, at: int) -> DataFrame:
        """(node_id, feat) of one level."""
        level = self.levels[at]
        if level.plan.method == "vq":
            long = level.codes.select("node_id", F.posexplode("codes").alias("cb", "code"))
            return vq.decode(long, level.book, self.dim)
        bits = level.plan.bits
        codes = bitpack.unpack(F.col("codes"), self.dim, bits) if bits in PACKED_BITS else F.col("codes")
        return sq.decode(level.codes.select("node_id", codes.alias("codes")), level.book, bits)

    def features(self, nodes: DataFrame) -> DataFrame:
        """(node_id, feat) of nodes (node_id): from the seeds' level where they are in it, else from the general one."""
        rest = self.decode(len(self.levels) - 1)
        if len(self.levels) == 1:
            return nodes.select("node_id").join(rest, "node_id")
        return twolevel.self_features(nodes, self.decode(0), rest)


def compress(features: DataFrame, element_bits: int, ratio: int, n_clusters: int = 128, groups: int = 1, seeds: DataFrame | None = None, hotness: DataFrame | None = None, **training) -> Codec:
    """Plan the levels for a ratio and encode them: seeds (node_id) precisely, all rows by scalar codes or by cluster ids."""
    dim = dimension(features)
    levels = []
    for plan in plan_codec(dim, element_bits, ratio, n_clusters, groups, seeds is not None):
        own = seeds is not None and plan.level == 0
        rows = features.join(seeds.select("node_id"), "node_id", "left_semi") if own else features
        hot = None if own else hotness
        if plan.method == "sq":
            book = sq.codebook(rows, plan.column_slice, hotness=hot)
            codes = sq.encode_expr(F.col("feat"), book, plan.bits)
            packed = bitpack.pack(codes, dim, plan.bits) if plan.bits in PACKED_BITS else codes
            coded = rows.select("node_id", packed.cast(f"array<{sq.storage_type(plan.bits)}>").alias("codes"))
        else:
            book = vq.codebook(rows, plan.column_slice, plan.n_clusters, hot, **training)
            long = vq.encode(rows, book, plan.column_slice)
            kept = F.transform(F.sort_array(F.collect_list(F.struct("cb", "code"))), lambda s: s["code"])
            coded = long.groupBy("node_id").agg(kept.cast(f"array<{vq.code_type(plan.n_clusters)}>").alias("codes"))
        levels.append(Level(plan, coded, book))
    return Codec(dim, levels)


def write(codec: Codec, folder: str, parts: int = 1) -> None:
    """Codes of each level, dealt to ``parts`` folders by id, their codebooks, and the table ``codec_meta``."""
    spark = codec.levels[0].codes.sparkSession
    meta = []
    for level in codec.levels:
        name = f"level{level.plan.level}"
        dealt = level.codes.withColumn("part", F.pmod(F.xxhash64("node_id"), F.lit(parts)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}_codes.parquet")
        if level.plan.method == "sq":
            book = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(level.book.rows)], "cb int, fmin double, fmax double, emin double, emax double, mean double")
        else:
            book = level.book.select("cb", "code", "center")
        book.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}_codebook.parquet")
        meta.append((codec.dim, *asdict(level.plan).values()))
    spark.createDataFrame(meta, "dim int, level int, method string, column_slice int, bits int, n_clusters int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codec_meta.parquet")


def read(spark: SparkSession, folder: str) -> Codec:
    """A stored codec; scalar codebooks come to the driver, a row a slice."""
    levels, dim = [], 0
    for r in spark.read.parquet(f"{folder}/codec_meta.parquet").orderBy("level").collect():  # a row a level
        dim, name = r["dim"], f"level{r['level']}"
        book = spark.read.parquet(f"{folder}/{name}_codebook.parquet")
        if r["method"] == "sq":
            book = sq.Codebook(r["column_slice"], tuple(tuple(x)[1:] for x in book.orderBy("cb").collect()))
        kind = "array<tinyint>" if r["method"] == "sq" and r["bits"] == 8 else "array<int>" if r["method"] == "vq" and r["n_clusters"] > 32767 else "array<smallint>"
        codes = spark.read.schema(f"node_id bigint, codes {kind}").parquet(f"{folder}/{name}_codes.parquet").select("node_id", F.col("codes").cast("array<int>").alias("codes"))
        levels.append(Level(CodecLevel(r["level"], r["method"], r["column_slice"], r["bits"], r["n_clusters"]), codes, book))
    return Codec(dim, levels)
