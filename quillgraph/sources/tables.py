"""Readers and writers: edge lists, Parquet tables, manifests, compressed data, synthetic sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.sampling import hash_unit

def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_edge_list(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """(dst, src) of one tab-separated file of src and dst, gzip or plain, without its first ``skip`` lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n"))
    kept = lines.where((F.col("at") > 0) | (F.col("n") >= skip)).where("value <> ''")  # the first block of a single file begins a partition
    parts = F.split("value", "\t")
    return kept.select(parts[1].cast("bigint").alias("dst"), parts[0].cast("bigint").alias("src"))


def write_partitioned_edges(edges: DataFrame, folder: str, parts: int) -> None:
    """Edges by ranges of dst: part p holds the dsts of [p, p + 1) times the width that the table ``bounds`` names."""
    top = edges.agg(F.max(F.greatest("dst", "src"))).first()[0]
    width = max(1, -(-((top if top is not None else 0) + 1) // parts))
    own = F.floor(F.col("dst") / width).cast("int")
    edges.select("dst", "src", own.alias("part")).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/edges.parquet")
    rows = [(p, p * width, (p + 1) * width) for p in range(parts)]
    edges.sparkSession.createDataFrame(rows, "rank int, lo long, hi long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds.parquet")


def open_partitioned_edges(spark: SparkSession, folder: str, rank: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (dst, src), of one part alone if a rank is given, which prunes the others' files; and the bounds (rank, lo, hi)."""
    edges = spark.read.schema("dst bigint, src bigint, part int").parquet(f"{folder}/edges.parquet")
    own = edges if rank is None else edges.where(F.col("part") == rank)
    return own.select("dst", "src"), spark.read.parquet(f"{folder}/bounds.parquet")


def check_schema(df: DataFrame, manifest: dict[str, str]) -> DataFrame:
    """The table if it has the manifest's columns and types."""
    found = dict(df.dtypes)
    if wrong := {c: (t, found.get(c)) for c, t in manifest.items() if found.get(c) != t}:
        raise ValueError(f"columns differ from the manifest: {wrong}")
    return df


def write_dataset(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table a name, and a table ``meta`` of their columns and types."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, c, t) for name, df in tables.items() for c, t in df.dtypes]
    spark.createDataFrame(rows, "name string, column string, type string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta.parquet")


def read_dataset(spark: SparkSession, folder: str, without: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables that ``meta`` names, each checked against it; ``without`` leaves tables out."""
    manifest: dict[str, dict[str, str]] = {}
    for r in read_table(spark, folder, "meta").collect():  # a row a column
        manifest.setdefault(r["name"], {})[r["column"]] = r["type"]
    return {n: check_schema(read_table(spark, folder, n), columns) for n, columns in manifest.items() if n not in without}


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, feat, label) of the table embeddings."""
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("feat"), "label")


def synthetic(spark: SparkSession, n: int, dim: int, classes: int, seed: int = 1) -> DataFrame:
    """(node_id, feat, label): normal features and even labels that depend on the seed alone."""
    u = lambda tag, *c: hash_unit(f"{seed}{tag}", *c)
    base = spark.range(n).select(F.col("id").alias("node_id"), F.floor(u("l", "id") * classes).cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("j"))
    normal = F.sqrt(-2 * F.log(u("a", "node_id", "j"))) * F.cos(2 * F.pi() * u("b", "node_id", "j"))
    packed = base.select("node_id", "label", F.struct("j", normal.alias("x")).alias("s")).groupBy("node_id", "label").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return packed.select("node_id", F.transform("s", lambda s: s["x"]).alias("feat"), "label")
