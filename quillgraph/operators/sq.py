"""Scalar quantization on a logarithmic scale, one codebook a column slice."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.functions.planning import check_bits
from quillgraph.functions.vectors import dimension, doubles, to_long
from quillgraph.operators import sampling

#: Rows that a codebook is learned from.
SAMPLE_ROWS = 250_000


@dataclass(frozen=True)
class Codebook:
    """The rows (fmin, fmax, emin, emax, mean) of the column slices, a driver-side table of ceil(dim / column_slice) rows."""

    column_slice: int
    rows: tuple[tuple[float, float, float, float, float], ...]

    def at(self, j: Column, field: int) -> Column:
        """A field of the slice of component j."""
        values = F.array(*[F.lit(r[field]) for r in self.rows])
        return F.element_at(values, F.floor(j / self.column_slice).cast("int") + 1)


def codebook_table(features: DataFrame, column_slice: int, hotness: DataFrame | None = None, sample: int = SAMPLE_ROWS, seed: str = "cb") -> DataFrame:
    """(cb, fmin, fmax, emin, emax, mean) of all slices in one aggregate over a bounded sample.

    The sample is uniform, or weighted by ``hotness`` (node_id, h) without replacement.
    """
    chosen = sampling.uniform(features, sample, seed) if hotness is None else sampling.weighted(features.join(hotness, "node_id"), sample, seed).drop("h")
    magnitude = F.abs(F.col("x").cast("double"))
    cuts = (
        to_long(chosen)
        .groupBy(F.floor(F.col("j") / column_slice).cast("int").alias("cb"))
        .agg(F.percentile(magnitude, F.array(F.lit(0.005), F.lit(0.995))).alias("p"), F.avg(magnitude).alias("m"))
        .select("cb", F.greatest(F.col("p")[0], F.lit(1e-5)).alias("fmin"), F.greatest(F.col("p")[1], F.lit(2e-5)).alias("fmax"), "m")
    )
    mean = F.when(F.col("m") < 0.1, F.col("m") + 0.1).otherwise(F.col("m"))
    return cuts.select("cb", "fmin", "fmax", F.log2("fmin").alias("emin"), (F.log2("fmax") + 1e-5).alias("emax"), mean.alias("mean"))


def codebook(features: DataFrame, column_slice: int, **how) -> Codebook:
    """The codebook table brought to the driver."""
    rows = codebook_table(features, column_slice, **how).orderBy("cb").collect()
    return Codebook(column_slice, tuple((r.fmin, r.fmax, r.emin, r.emax, r.mean) for r in rows))


def encode_expr(v: Column, book: Codebook, bits: int) -> Column:
    """Array of integer codes of a vector; zero counts as negative."""
    check_bits(bits)
    half = 1 << (bits - 1)

    def code(x: Column, j: Column) -> Column:
        if bits == 1:
            return F.when(x <= 0, 0).otherwise(1)
        held = F.least(F.greatest(F.abs(x), book.at(j, 0)), book.at(j, 1))
        emin, emax = book.at(j, 2), book.at(j, 3)
        e = F.floor((F.log2(held) - emin) / (emax - emin) * half).cast("int")
        return F.when(x <= 0, -1 - e).otherwise(e) + (half if bits < 8 else 0)

    return F.transform(doubles(v), code)


def decode_value(q: Column, j: Column, book: Codebook, bits: int) -> Column:
    """The value of one code of component j."""
    check_bits(bits)
    half = 1 << (bits - 1)
    if bits == 1:
        return (q - F.lit(0.5)) * 2 * book.at(j, 4)
    v = q.cast("double") - (half if bits < 8 else 0) + 0.5
    emin, emax = book.at(j, 2), book.at(j, 3)
    return F.signum(v) * F.pow(F.lit(2.0), F.abs(v) * (emax - emin) / half + emin)


def decode_table(book: Codebook, cb: int, bits: int) -> list[float]:
    """The values of all codes of a slice, from the least code."""
    _, _, emin, emax, mean = book.rows[cb]
    half = 1 << (bits - 1)
    if bits == 1:
        return [-mean, mean]
    steps = [q - half + 0.5 for q in range(2 * half)]
    return [math.copysign(2.0 ** (abs(v) * (emax - emin) / half + emin), v) for v in steps]


def decode_expr(codes: Column, book: Codebook, bits: int) -> Column:
    """Vector of an array of codes."""
    return F.transform(codes, lambda q, j: decode_value(q, j, book, bits))


def encode(features: DataFrame, book: Codebook, bits: int) -> DataFrame:
    """(node_id, codes): a narrow projection, no shuffle."""
    return features.select("node_id", encode_expr(F.col("feat"), book, bits).alias("codes"))


def decode(codes: DataFrame, book: Codebook, bits: int) -> DataFrame:
    """(node_id, feat) from (node_id, codes)."""
    return codes.select("node_id", decode_expr(F.col("codes"), book, bits).alias("feat"))


def storage_type(bits: int) -> str:
    """The smallest column type that holds codes of this width, or bytes of packed ones."""
    return "smallint" if bits != 8 else "tinyint"


def compress(features: DataFrame, column_slice: int, bits: int, **how) -> tuple[Codebook, DataFrame, int]:
    """Codebook, codes and dimension of a feature table."""
    book = codebook(features, column_slice, **how)
    return book, encode(features, book, bits), dimension(features)
