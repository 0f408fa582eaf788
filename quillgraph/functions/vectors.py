"""Column expressions over dense vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def doubles(v: Column) -> Column:
    """The vector with double components."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two double vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l0_norm(a: Column) -> Column:
    """Number of components that are not zero."""
    return F.size(F.filter(a, lambda x: x != 0))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine similarity; 1 where a vector is zero."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, F.lit(1.0) - dot(a, b) / norms).otherwise(1.0)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Cosine distance, or the squared Euclidean distance for any other metric."""
    return cosine_distance(a, b) if metric == "cosine" else squared_l2(a, b)


def padded(v: Column, width: int) -> Column:
    """The vector with zeros up to ``width`` components."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(v))))


def slices(v: Column, dim: int, width: int) -> Column:
    """An array of structs (cb, v): the vector cut into sub-vectors of ``width``, the last zero-padded."""
    parts = [F.struct(F.lit(c).alias("cb"), padded(F.slice(v, c * width + 1, width), width).alias("v")) for c in range(-(-dim // width))]
    return F.array(*parts)


def dimension(features: DataFrame, column: str = "feat") -> int:
    """Components of a vector column, from one row."""
    row = features.select(F.size(column).alias("n")).where("n > 0").first()
    return row["n"] if row else 0


def to_long(features: DataFrame, column: str = "feat", value: str = "x", key: str = "node_id") -> DataFrame:
    """(node_id, j, x): one row a component, j from 0."""
    return features.select(key, F.posexplode(column).alias("j", value))


def to_array(rows: DataFrame, value: str = "x", key: str = "node_id", out: str = "feat") -> DataFrame:
    """(node_id, feat): components put together in the order of j."""
    packed = F.sort_array(F.collect_list(F.struct("j", value)))
    return rows.groupBy(key).agg(F.transform(packed, lambda s: s[value]).alias(out))
