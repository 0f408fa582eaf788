"""k-means over column slices: all slices at once, keyed by cb. Points are (node_id, cb, v), centers (cb, code, center)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from quillgraph.functions.lineage import cut
from quillgraph.functions.vectors import distance, dot, doubles, l0_norm, l2_norm, slices, squared_l2
from quillgraph.operators.sampling import hash_text, hash_unit


def points(features: DataFrame, dim: int, width: int) -> DataFrame:
    """(node_id, cb, v): sub-vectors of every row."""
    parts = features.select("node_id", F.explode(slices(doubles(F.col("feat")), dim, width)).alias("s"))
    return parts.select("node_id", F.col("s.cb").alias("cb"), F.col("s.v").alias("v"))


def pairwise_distance(x: DataFrame, y: DataFrame, metric: str) -> DataFrame:
    """(x_id, y_id, d) of two tables (id, v), or of each slice (cb, id, v) if both have one. y is the small side, the caller's k: its rows ride along with x as one array."""
    by = ["cb"] if "cb" in x.columns and "cb" in y.columns else []
    listed = y.groupBy(*by).agg(F.collect_list(F.struct(F.col("id").alias("y_id"), F.col("v").alias("b"))).alias("all"))
    met = x.join(F.broadcast(listed), by) if by else x.withColumn("one", F.lit(1)).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one")
    each = met.select(*by, F.col("id").alias("x_id"), F.col("v").alias("a"), F.explode("all").alias("y"))
    return each.select(*by, "x_id", F.col("y.y_id").alias("y_id"), distance(F.col("a"), F.col("y.b"), metric).alias("d"))


def _nearest(rows: DataFrame, centers: DataFrame, metric: str) -> DataFrame:
    """Rows with code and d of the nearest center: a projection over the slice's centers as one array, a row a slice."""
    listed = F.sort_array(F.collect_list(F.struct("code", "center", l2_norm(F.col("center")).alias("length")))).alias("all")
    book = centers.groupBy("cb").agg(listed)

    def one(x: Column, c: Column) -> Column:
        if metric == "cosine":
            d = F.when(x["length"] * c["length"] > 0, F.lit(1.0) - dot(x["v"], c["center"]) / (x["length"] * c["length"])).otherwise(1.0)
        else:
            d = squared_l2(x["v"], c["center"])
        return F.struct(F.coalesce(F.nanvl(d, F.lit(1.0)), F.lit(1.0)).alias("d"), c["code"].alias("code"))

    point = F.struct(F.col("v").alias("v"), l2_norm(F.col("v")).alias("length"))
    best = F.transform(F.array(point), lambda x: F.array_min(F.transform("all", lambda c: one(x, c))))[0]
    met = rows.join(F.broadcast(book), "cb").select(*rows.columns, best.alias("s"))  # as many centers as the caller's k
    return met.select(*rows.columns, F.col("s.code").alias("code"), F.col("s.d").alias("d"))


def assign(rows: DataFrame, centers: DataFrame, metric: str = "cosine") -> DataFrame:
    """(node_id, cb, code, d): the nearest center of each point; ties to the smaller code. No shuffle and no row for each center."""
    return _nearest(rows, centers, metric).select("node_id", "cb", "code", "d")


def lloyd_step(rows: DataFrame, centers: DataFrame, metric: str = "cosine") -> DataFrame:
    """The centers' means of their points; an empty cluster keeps its center. One aggregate, whose buffers are the centers."""
    width = centers.select(F.max(F.size("center"))).first()[0] or 0
    own = _nearest(rows, centers, metric)
    means = own.groupBy("cb", "code").agg(*[F.avg(F.get("v", F.lit(j))).alias(f"m{j}") for j in range(width)]).select("cb", "code", F.array(*[F.col(f"m{j}") for j in range(width)]).alias("new"))
    return centers.select("cb", "code", "center").join(F.broadcast(means), ["cb", "code"], "left").select("cb", "code", F.coalesce("new", "center").alias("center"))


def center_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cb, shift): the sum over centers of how far each moved."""
    met = old.select("cb", "code", F.col("center").alias("a")).join(new.select("cb", "code", F.col("center").alias("b")), ["cb", "code"])
    return met.groupBy("cb").agg(F.sum(F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))).alias("shift"))


def normalize_centers(centers: DataFrame) -> DataFrame:
    """Each center at the mean length of its slice's centers."""
    sized = centers.withColumn("n", l2_norm(F.col("center")))
    mean = sized.groupBy("cb").agg(F.avg("n").alias("mean"))
    return sized.join(F.broadcast(mean), "cb").select("cb", "code", F.when(F.col("n") > 0, F.transform("center", lambda x: x / F.col("n") * F.col("mean"))).otherwise(F.col("center")).alias("center"))


def inertia(assigned: DataFrame) -> DataFrame:
    """(cb, inertia): the sum of the distances to the nearest centers."""
    return assigned.groupBy("cb").agg(F.sum("d").alias("inertia"))


def initial_centers(rows: DataFrame, k: int, seed: str = "c") -> DataFrame:
    """k non-zero points of each slice in hash order. Only k rows a task reach the ranking."""
    ranked = rows.where(l0_norm(F.col("v")) > 0).select("cb", F.struct(hash_text(seed, "node_id", "cb").alias("h"), "node_id", "v").alias("s"))
    order = Window.partitionBy("cb").orderBy("s")
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("cb", (F.col("r") - 1).cast("int").alias("code"), F.col("s.v").alias("center"))


def circle_centers(spark: SparkSession, k: int, dim: int, slices_: int, seed: str = "o") -> DataFrame:
    """Random centers for the cosine metric: the cosines of some angles, then the sines; with an odd dimension one sine more, and all scaled by a random radius."""
    n = dim // 2
    base = spark.range(k * slices_).select((F.col("id") / k).cast("int").alias("cb"), (F.col("id") % k).cast("int").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("j"))
    paired = base.withColumn("pair", F.when(F.col("j") < n, F.col("j")).otherwise(F.col("j") - n))
    angle = 2 * F.pi() * hash_unit(seed, "cb", "code", "pair")
    radius = hash_unit(seed + "r", "cb", "code") if dim % 2 else F.lit(1.0)
    value = F.when(F.col("j") < n, F.cos(angle)).otherwise(F.sin(angle)) * radius
    packed = paired.select("cb", "code", F.struct("j", value.alias("x")).alias("s")).groupBy("cb", "code").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return packed.select("cb", "code", F.transform("s", lambda s: s["x"]).alias("center"))


class KMeans:
    """Lloyd's iterations; ``fit`` settles when the squared shift is under the tolerance, which grows by a fifth each time.

    They start from ``centers``, or from rows (``init="rows"``) or points on circles (``init="circle"``, the default for
    the cosine metric). Of ``n_init`` starts the one of the least inertia stays.
    """

    def __init__(self, n_clusters: int, metric: str = "cosine", max_iter: int = 300, tol: float = 1e-4, centers: DataFrame | None = None, seed: str = "c", init: str | None = None, n_init: int = 1) -> None:
        self.n_clusters, self.metric, self.max_iter, self.tol, self.centers, self.seed, self.n_init = n_clusters, metric, max_iter, tol, centers, seed, n_init
        self.init = init or ("circle" if metric == "cosine" else "rows")
        self.inertia_, self.n_iter_ = None, 0

    def _start(self, rows: DataFrame, seed: str) -> DataFrame:
        if self.init == "rows":
            return initial_centers(rows, self.n_clusters, seed)
        about = rows.agg((F.max("cb") + 1).alias("slices"), F.max(F.size("v")).alias("dim")).first()
        return circle_centers(rows.sparkSession, self.n_clusters, about["dim"] or 0, about["slices"] or 0, seed)

    def _moved(self, rows: DataFrame, centers: DataFrame) -> tuple[DataFrame, int]:
        """Settled centers and the iterations taken; the driver sees one number a slice in each, and each result is written."""
        tol, centers = self.tol, cut(centers)
        for n in range(1, self.max_iter + 1):
            new = cut(lloyd_step(rows, centers, self.metric))
            shift = center_shift(centers, new).agg(F.max(F.col("shift") * F.col("shift"))).first()[0]
            centers = new
            if shift is None or shift < tol:
                return centers, n
            tol *= 1.2
        return centers, self.max_iter

    def fit(self, rows: DataFrame) -> KMeans:
        """Move the centers; the best of several starts stays."""
        starts = [self.centers] if self.centers is not None else [self._start(rows, self.seed + "'" * n) for n in range(self.n_init)]
        for start in starts:
            centers, taken = self._moved(rows, start)
            loss = inertia(assign(rows, centers, self.metric)).agg(F.sum("inertia")).first()[0] if len(starts) > 1 else None
            if self.inertia_ is None or (loss is not None and loss < self.inertia_):
                self.centers, self.n_iter_, self.inertia_ = centers, taken, loss
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """(node_id, cb, code, d)."""
        return assign(rows, self.centers, self.metric)

    def get_centers(self) -> DataFrame:
        """(cb, code, center)."""
        return self.centers
