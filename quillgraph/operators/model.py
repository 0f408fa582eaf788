"""Mean-aggregation layers, attention, predictions and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.functions.vectors import dot


def activated(x: Column, activation: str | None) -> Column:
    """relu, elu or nothing, for every component."""
    if activation == "relu":
        return F.transform(x, lambda y: F.greatest(y, F.lit(0.0)))
    if activation == "elu":
        return F.transform(x, lambda y: F.when(y > 0, y).otherwise(F.exp(y) - 1))
    return x


def _with_table(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Rows with a table of a layer's size as one array, in the order of its first column."""
    listed = table.agg(F.sort_array(F.collect_list(F.struct(*table.columns))).alias(name)).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").drop("_one")


def linear(rows: DataFrame, weights: DataFrame, out: str = "y") -> DataFrame:
    """Rows with the product of ``feat`` with weights (o, w): a projection, no shuffle."""
    met = _with_table(rows, weights.select("o", "w"), "_w")
    return met.withColumn(out, F.transform("_w", lambda r: dot(r["w"], F.col("feat")))).drop("_w")


def sage_layer(selves: DataFrame, layer: DataFrame, activation: str | None = "relu") -> DataFrame:
    """``feat`` of rows with ``feat`` and ``mean``: W_self feat + b + W_neigh mean, of a layer (o, own, neigh, b). A projection, no shuffle."""
    met = _with_table(selves, layer.select("o", "own", "neigh", "b"), "_w")
    value = F.transform("_w", lambda r: dot(r["own"], F.col("feat")) + r["b"] + dot(r["neigh"], F.col("mean")))
    return met.withColumn("feat", activated(value, activation)).drop("_w", "mean")


def neighbour_means(block: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(batch_id, local_id, mean) of a block (batch_id, dst, src) in local ids."""
    met = block.join(nodes.select("batch_id", F.col("local_id").alias("src"), "feat"), ["batch_id", "src"])
    sums = met.groupBy("batch_id", F.col("dst").alias("local_id")).agg(*[F.avg(F.element_at("feat", j + 1)).alias(f"m{j}") for j in range(dim)])
    return sums.select("batch_id", "local_id", F.array(*[F.col(f"m{j}") for j in range(dim)]).alias("mean"))


def sage_stack(blocks: list[DataFrame], nodes: DataFrame, layers: list[DataFrame], dims: list[int], activation: str = "relu") -> DataFrame:
    """(batch_id, local_id, node_id, feat) of the seeds after all layers, the last without activation.

    ``blocks`` and ``nodes`` are a loader's: the first layer reads the outermost block. ``dims`` are the layers' inputs.
    A destination without neighbours has a mean of zeros.
    """
    h = nodes
    for n, (layer, dim) in enumerate(zip(layers, dims, strict=True)):
        hop = len(layers) - 1 - n
        mean = neighbour_means(blocks[hop], h, dim)
        known = h.where(F.col("hop") <= hop).join(mean, ["batch_id", "local_id"], "left")
        h = sage_layer(known.withColumn("mean", F.coalesce("mean", F.array_repeat(F.lit(0.0), dim))), layer, activation if hop else None)
    return h.select("batch_id", "local_id", "node_id", "feat")


def gat_layer(block: DataFrame, nodes: DataFrame, dsts: DataFrame, layer: DataFrame, heads: int, width: int, slope: float = 0.2) -> DataFrame:
    """``dsts`` with ``feat`` as heads * width components: attention over sampled neighbours, a residual and a bias.

    ``layer`` has a row (o, w, to, at, rest, b) for each component o of head o // width: weights, attention of source and
    destination, residual weights and bias. A destination without neighbours has the residual and bias alone.
    """
    z = linear(nodes, layer.select("o", "w"), "z").select("batch_id", "local_id", "z")
    score = lambda name: F.array(*[F.aggregate(F.slice("_p", h * width + 1, width), F.lit(0.0), lambda a, x: a + x) for h in range(heads)]).alias(name)
    parts = lambda field: F.transform(F.zip_with("z", "_w", lambda x, r: x * r[field]), lambda x: x)
    held = _with_table(z, layer.select("o", "to", "at"), "_w")
    src = held.withColumn("_p", parts("to")).select("batch_id", F.col("local_id").alias("src"), "z", score("es"))
    dst = held.withColumn("_p", parts("at")).select("batch_id", F.col("local_id").alias("dst"), score("ed"))
    leaky = F.zip_with("es", "ed", lambda a, b: F.when(a + b > 0, a + b).otherwise(slope * (a + b)))
    met = block.join(src, ["batch_id", "src"]).join(dst, ["batch_id", "dst"]).select("batch_id", "dst", "z", leaky.alias("e"))
    top = met.groupBy("batch_id", "dst").agg(F.array(*[F.max(F.element_at("e", h + 1)) for h in range(heads)]).alias("m"))
    raised = met.join(top, ["batch_id", "dst"]).select("batch_id", "dst", "z", F.zip_with("e", "m", lambda a, b: F.exp(a - b)).alias("p"))
    sums = raised.groupBy("batch_id", F.col("dst").alias("local_id")).agg(
        *[(F.sum(F.element_at("p", o // width + 1) * F.element_at("z", o + 1)) / F.sum(F.element_at("p", o // width + 1))).alias(f"a{o}") for o in range(heads * width)]
    )
    seen = sums.select("batch_id", "local_id", F.array(*[F.col(f"a{o}") for o in range(heads * width)]).alias("seen"))
    out = _with_table(dsts.join(seen, ["batch_id", "local_id"], "left"), layer.select("o", "rest", "b"), "_w")
    seen = F.coalesce("seen", F.array_repeat(F.lit(0.0), heads * width))
    return out.withColumn("feat", F.zip_with(seen, F.transform("_w", lambda r: dot(r["rest"], F.col("feat")) + r["b"]), lambda a, b: a + b)).drop("seen", "_w")


def head_mean(x: Column, heads: int, width: int) -> Column:
    """The mean over heads of an array of heads * width components."""
    return F.array(*[sum((F.element_at(x, h * width + j + 1) for h in range(heads)), F.lit(0.0)) / heads for j in range(width)])


def gat_stack(blocks: list[DataFrame], nodes: DataFrame, first: DataFrame, layers: list[DataFrame], dim: int, heads: list[int], widths: list[int]) -> DataFrame:
    """(batch_id, local_id, node_id, feat) of the seeds: a mean layer, then attention layers, elu between them, and the mean over heads at the end."""
    last = len(layers)
    mean = neighbour_means(blocks[last], nodes, dim)
    known = nodes.where(F.col("hop") <= last).join(mean, ["batch_id", "local_id"], "left")
    h = sage_layer(known.withColumn("mean", F.coalesce("mean", F.array_repeat(F.lit(0.0), dim))), first, "elu" if layers else None)
    for n, layer in enumerate(layers):
        hop = last - 1 - n
        h = gat_layer(blocks[hop], h, h.where(F.col("hop") <= hop), layer, heads[n + 1], widths[n + 1])
        h = h.withColumn("feat", activated(F.col("feat"), "elu") if hop else head_mean(F.col("feat"), heads[n + 1], widths[n + 1]))
    return h.select("batch_id", "local_id", "node_id", "feat")


def edge_softmax(scores: DataFrame) -> DataFrame:
    """(dst, src, a): exp(score) over the sum at each dst, shifted by the greatest score."""
    top = scores.groupBy("dst").agg(F.max("e").alias("m"))
    raised = scores.join(top, "dst").withColumn("p", F.exp(F.col("e") - F.col("m")))
    total = raised.groupBy("dst").agg(F.sum("p").alias("t"))
    return raised.join(total, "dst").select("dst", "src", (F.col("p") / F.col("t")).alias("a"))


def predict(outputs: DataFrame) -> DataFrame:
    """(node_id, pred): the output of the greatest value, ties to the smaller."""
    best = F.max(F.struct("y", (-F.col("o")).alias("o")))
    return outputs.groupBy("node_id").agg(best.alias("s")).select("node_id", (-F.col("s.o")).cast("int").alias("pred"))


def accuracy(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(accuracy): the share of rows whose prediction is the label."""
    met = predictions.join(labels, "node_id")
    return met.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def accuracy_rank_mean(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(accuracy): the mean over ranks of each rank's accuracy."""
    met = predictions.join(labels, "node_id").groupBy("rank").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("a"))
    return met.agg(F.avg("a").alias("accuracy"))


def errors(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest, least and mean absolute difference of two tables of values x."""
    met = a.select(*keys, F.col("x").alias("p")).join(b.select(*keys, F.col("x").alias("q")), keys)
    d = F.abs(F.col("p") - F.col("q"))
    return met.agg(F.max(d).alias("max_err"), F.min(d).alias("min_err"), F.avg(d).alias("mae"))
