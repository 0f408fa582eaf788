"""Vector quantization: a k-means codebook for each column slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import cut
from quillgraph.functions.vectors import dimension, l2_norm
from quillgraph.operators import kmeans, sampling

#: Rows that codebooks are learned from.
SAMPLE_ROWS = 150_000


def rim_filter(rows: DataFrame, width: int) -> DataFrame:
    """Points whose length is at least the quantile 0.00625 * width / 8 of their slice."""
    sized = rows.withColumn("n", l2_norm(F.col("v")))
    cut = sized.groupBy("cb").agg(F.percentile("n", F.lit(min(1.0, 0.00625 * (width / 8)))).alias("cut"))
    return sized.join(F.broadcast(cut), "cb").where(F.col("n") >= F.col("cut")).drop("n", "cut")


def codebook(features: DataFrame, width: int, n_clusters: int, hotness: DataFrame | None = None, tol: float = 5e-2, max_iter: int = 300, seed: str = "vq") -> DataFrame:
    """(cb, code, center): trained on a bounded sample without the rim, at even length."""
    chosen = sampling.uniform(features, SAMPLE_ROWS, seed) if hotness is None else sampling.weighted(features.join(hotness, "node_id"), SAMPLE_ROWS, seed)
    rows = cut(rim_filter(kmeans.points(chosen, dimension(features), width), width))
    return sound(kmeans.normalize_centers(kmeans.KMeans(n_clusters, "cosine", max_iter, tol, seed=seed, init="rows").fit(rows).get_centers()))


def sound(book: DataFrame) -> DataFrame:
    """The codebook if no component is null or NaN."""
    if not book.where(F.exists("center", lambda x: x.isNull() | F.isnan(x))).isEmpty():
        raise ValueError("a codebook has components that are no numbers")
    return book


def code_type(n_clusters: int) -> str:
    """The column type of cluster ids: one byte's worth up to 256, two up to 32767, else four."""
    return "smallint" if n_clusters <= 32767 else "int"


def encode(features: DataFrame, book: DataFrame, width: int) -> DataFrame:
    """(node_id, cb, code): the nearest center by cosine distance."""
    return kmeans.assign(kmeans.points(features, dimension(features), width), book).select("node_id", "cb", "code")


def decode(codes: DataFrame, book: DataFrame, dim: int) -> DataFrame:
    """(node_id, feat): the codes' centers, one after the other, cut to ``dim``."""
    met = codes.join(F.broadcast(book), ["cb", "code"]).select("node_id", F.struct("cb", "center").alias("s"))  # n_clusters rows a slice
    return met.groupBy("node_id").agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["center"])), 1, dim).alias("feat"))
