"""Mean of in-neighbours' features: plain, and fused with decoding, so that only codes are shuffled.

Parallel edges count with their number; a dst without edges has zeros. Edges are first counted by
(dst, src), so a feature row meets each dst once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.operators.bitpack import unpack
from quillgraph.operators.sq import Codebook, decode_expr, decode_table, decode_value

#: Dimensions up to which the sums of a vector are separate buffers of one aggregate.
WIDE = 256


def edge_counts(edges: DataFrame) -> DataFrame:
    """(dst, src, n): parallel edges collapsed to their number."""
    return edges.groupBy("dst", "src").agg(F.count("*").alias("n"))


def _zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def spmm_mean(edges: DataFrame, features: DataFrame, dim: int, dsts: DataFrame | None = None) -> DataFrame:
    """(dst, feat): the mean over in-neighbours; with ``dsts`` (dst), zeros for those without."""
    met = edge_counts(edges).join(features.select(F.col("node_id").alias("src"), "feat"), "src")
    if dim <= WIDE:
        sums = met.groupBy("dst").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.element_at("feat", j + 1).cast("double")).alias(f"s{j}") for j in range(dim)])
        out = sums.select("dst", F.array(*[F.col(f"s{j}") / F.col("n") for j in range(dim)]).alias("feat"))
    else:
        each = met.select("dst", "n", F.posexplode("feat").alias("j", "x")).groupBy("dst", "j").agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("m"))
        out = each.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("feat"))
    return out if dsts is None else dsts.select("dst").join(out, "dst", "left").select("dst", F.coalesce("feat", _zeros(dim)).alias("feat"))


def spmm_vq(edges: DataFrame, codes: DataFrame, book: DataFrame, dim: int, width: int) -> DataFrame:
    """(dst, j, x): codes are counted by (dst, cb, code), then each counted code is decoded once."""
    counts = edge_counts(edges).join(codes.withColumnRenamed("node_id", "src"), "src").groupBy("dst", "cb", "code").agg(F.sum("n").alias("n"))
    met = counts.join(F.broadcast(book), ["cb", "code"]).select("dst", "cb", "n", F.posexplode("center").alias("off", "v"))
    j = F.col("cb") * width + F.col("off")
    return met.where(j < dim).groupBy("dst", j.cast("int").alias("j")).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("x"))


def spmm_sq(edges: DataFrame, packed: DataFrame, book: Codebook, bits: int, dim: int) -> DataFrame:
    """(dst, feat) from packed bytes (bits < 8) or codes: what is shuffled is packed, and each component is decoded where it is summed."""
    met = edge_counts(edges).join(packed.select(F.col("node_id").alias("src"), "packed"), "src")
    per = 8 // bits if bits < 8 else 1

    def value(j: int) -> Column:
        byte = F.element_at("packed", j // per + 1)
        code = F.shiftright(byte, bits * (j % per)).bitwiseAND(F.lit((1 << bits) - 1)) if per > 1 else byte
        if bits >= 8:
            return decode_value(code, F.lit(j), book, bits)
        return F.element_at(F.array(*map(F.lit, decode_table(book, j // book.column_slice, bits))), code + 1)

    if dim <= WIDE:
        sums = met.groupBy("dst").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * value(j)).alias(f"s{j}") for j in range(dim)])
        return sums.select("dst", F.array(*[F.col(f"s{j}") / F.col("n") for j in range(dim)]).alias("feat"))
    codes = unpack(F.col("packed"), dim, bits) if per > 1 else F.col("packed")
    decoded = met.select("dst", "n", F.posexplode(decode_expr(codes, book, bits)).alias("j", "x"))
    each = decoded.groupBy("dst", "j").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"))
    return each.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("feat"))
