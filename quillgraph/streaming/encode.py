"""Vectors that arrive as a stream, encoded with a frozen codebook; and counts of accesses in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.sq import Codebook, encode_expr


def encode_stream(stream: DataFrame, book: Codebook, bits: int) -> DataFrame:
    """(node_id, codes) of a stream (node_id, feat): a stateless projection."""
    return stream.select("node_id", encode_expr(F.col("feat"), book, bits).alias("codes"))


def write_codes(codes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to Parquet and stop; a restart goes on where the checkpoint ends."""
    return codes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_hotness(accesses: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, node_id, h) of accesses (node_id, ts): counts in windows of event time, closed by a watermark."""
    return accesses.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "node_id").agg(F.count("*").alias("h")).select(F.col("w.start").alias("start"), "node_id", "h")
