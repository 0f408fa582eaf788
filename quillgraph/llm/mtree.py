"""Exact top-k by inner product: best-first search in paged M-trees.

Vectors are dealt to pages by the nearest of a bounded sample of pivots, and a large pivot's vectors
over several pages. A page has its pivot as centre, a covering radius and an M-tree: a node has
routing pivots with covering radii and their distances to the parent's pivot; a leaf has vectors with
their distances to the leaf's pivot. With a query q, a pivot p and radius r, every vector x below p has
``q.x = q.p + q.(x - p) <= q.p + |q| r``. A child pivot c at stored distance d from p satisfies
``q.c <= q.p + |q| d``, so a child whose radius cannot lift that bound to the k-th best score is
dropped without computing ``q.c``; leaf vectors are dropped by their stored distances alike.
Nodes are visited in the order of their bounds until no bound reaches the k-th best score.
Bounds equal to it are visited too, so ties go to the smaller id.

A query first searches the page whose centre suits it best. Its k-th best score there goes with it to
the other pages, of which only those are searched whose bound reaches it. Queries meet a page in
blocks of bounded size. Vectors of different lengths are never compared.

Scores are exact integers: where a product could pass 2^53 it is computed in whole numbers.

Defined results: rows whose id or vector is null, or whose vector has a null or non-finite
component, take no part. Of several vectors of one id the least in array order asks; rows with the query's
id are the query's own, and a candidate's repeated rows are ranked each. A query with no other
vector of its length has no rows. A component or a score that no 64-bit integer holds raises an error.
Columns besides id and vector are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from quillgraph.llm.common import checkpoint

#: Vectors that a page aims at, pages at most (beyond, pages grow instead), queries in a block.
PAGE, MOST_PAGES, BLOCK = 8192, 2048, 8192
#: Vectors in a leaf and children of a node, at most.
LEAF, FANOUT = 512, 16
#: Up to here, sums of products of whole numbers are exact in floating point.
EXACT = float(1 << 52)


class MTree:
    """An M-tree over integer vectors, loaded in bulk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order]
        self.vectors = self.whole.astype(np.float64)
        self.longest = float(np.sqrt((self.vectors**2).sum(axis=1).max())) if ids.size else 0.0
        #: A node is (pivots, radii, distances to the parent's pivot, children) or a leaf (rows, vectors, distances to its pivot).
        self.nodes: list[tuple] = []
        self.computed = 0
        self.centre = self.vectors.mean(axis=0) if ids.size else None
        self.root = self._build(np.arange(ids.size), self.centre)

    def _build(self, rows: np.ndarray, parent: np.ndarray) -> int:
        if rows.size <= LEAF:
            return self._leaf(rows, parent)
        picks = rows[np.linspace(0, rows.size - 1, min(FANOUT, -(-rows.size // LEAF) + 1)).astype(int)]
        pivots = np.unique(self.vectors[picks], axis=0)
        own = self.vectors[rows]
        if len(pivots) > 1:
            to = ((pivots**2).sum(axis=1)[None, :] - 2 * own @ pivots.T).argmin(axis=1)
            if np.bincount(to).max() == rows.size:
                pivots = pivots[:1]
        if len(pivots) < 2:  # copies: cut into leaves of equal size
            parts = np.array_split(rows, -(-rows.size // LEAF))
        else:
            parts = [rows[to == i] for i in range(len(pivots))]
            parts = [p for p in parts if p.size]
        children, kept, radii = [], [], []
        for part in parts:
            pivot = self.vectors[part].mean(axis=0)
            kept.append(pivot)
            radii.append(np.sqrt(((self.vectors[part] - pivot) ** 2).sum(axis=1).max()))
            children.append(self._build(part, pivot) if part.size < rows.size else self._leaf(part, pivot))
        kept = np.array(kept)
        self.nodes.append((kept, np.array(radii), np.sqrt(((kept - parent) ** 2).sum(axis=1)), children))
        return len(self.nodes) - 1

    def _leaf(self, rows: np.ndarray, pivot: np.ndarray) -> int:
        away = np.sqrt(((self.vectors[rows] - pivot) ** 2).sum(axis=1)) if rows.size else np.empty(0)
        order = np.argsort(-away, kind="stable")
        self.nodes.append((rows[order], self.vectors[rows[order]], away[order]))
        return len(self.nodes) - 1

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) but those of the id ``own``, ties to the smaller id; scores under ``floor`` may be missing."""
        whole, query = query, query.astype(np.float64)
        length = float(np.sqrt(query @ query))
        exact = length * self.longest < EXACT
        slack = 1e-6 * (1.0 + length) + 1e-12 * length * self.longest
        top = float(query @ self.centre) if self.ids.size else 0.0
        queue: list[tuple[float, int, float]] = [(-np.inf, self.root, top)]
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        start = -np.inf if floor is None else float(floor)
        while queue:
            bound, node, at_pivot = heapq.heappop(queue)
            least = max(start, best[0][0]) if len(best) == k else start
            if -bound + slack < least:
                break
            if len(self.nodes[node]) == 3:
                rows, vectors, away = self.nodes[node]
                near = int(np.searchsorted(-away, -(least - slack - at_pivot) / length, side="right")) if length and least > -np.inf else rows.size
                self.computed += near
                scores = vectors[:near] @ query
                keep = np.flatnonzero((scores > least - (0.5 if exact else slack)) & (self.ids[rows[:near]] != own))
                ids = self.ids[rows[keep]]
                scores = np.rint(scores[keep]).astype(np.int64) if exact else self.whole[rows[keep]].astype(object) @ whole.astype(object)
                if exact and scores.size > k:
                    pick = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[pick], ids[pick]
                for item in zip(scores.tolist(), (-ids).tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            pivots, radii, apart, children = self.nodes[node]
            maybe = np.flatnonzero(at_pivot + length * (apart + radii) + slack >= least)
            self.computed += maybe.size
            products = pivots[maybe] @ query
            bounds = products + length * radii[maybe]
            for i, p, b in zip(maybe.tolist(), products.tolist(), bounds.tolist(), strict=True):
                if b + slack >= least:
                    heapq.heappush(queue, (-b, children[i], p))
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if any component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < float(1 << 63), F.floor(x)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return F.when(sound, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def _matrix(lists: pa.ListArray, kind: type = np.int64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


class Pages:
    """Centres, radii and numbers of all pages, by vector length; as many rows as pages."""

    def __init__(self, stats: list, pivots: list[tuple], page_rows: int) -> None:
        self.start: list[tuple[int, int, int, int]] = []
        found: dict[int, list[tuple]] = {}
        for r in sorted(stats, key=lambda r: (r["size"], r["pivot"])):
            first, parts = sum(x[3] for x in self.start), -(-r["n"] // page_rows)
            self.start.append((r["size"], r["pivot"], first, parts))
            known = r["pivot"] >= 0
            found.setdefault(r["size"], []).extend((first + i, pivots[r["pivot"]] if known else (0,) * r["size"], r["away"] if known else np.inf) for i in range(parts))
        self.by_size = {n: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows], dtype=np.float64).reshape(len(rows), n), np.array([x[2] for x in rows])) for n, rows in found.items()}

    def first(self, queries: np.ndarray) -> np.ndarray:
        """For every query the page whose centre has the greatest product with it."""
        numbers, centres, radii = self.by_size[queries.shape[1]]
        products = queries.astype(np.float64) @ centres.T
        return numbers[np.where(np.isfinite(radii)[None, :], products, -np.inf).argmax(axis=1)]

    def reached(self, query: np.ndarray, floor: float) -> np.ndarray:
        """The pages that may hold a score of ``floor`` or more."""
        numbers, centres, radii = self.by_size[query.size]
        query = query.astype(np.float64)
        length = float(np.sqrt(query @ query))
        lengths = np.sqrt((centres**2).sum(axis=1))
        with np.errstate(invalid="ignore"):
            bound = centres @ query + np.where(np.isfinite(radii), length * radii, np.inf) + 1e-6 * (1.0 + length) + 1e-12 * length * (lengths + np.where(np.isfinite(radii), radii, 0))
        return numbers[~(bound < floor)]


def _deal(pivots: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to (id, v, q) each vector's nearest pivot of its length and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            to, away = np.full(len(lists), -1, dtype=np.int32), np.zeros(len(lists))
            for n in np.unique(lengths):
                same = [i for i, p in enumerate(pivots) if len(p) == n]
                rows = np.flatnonzero(lengths == n)
                if same and n:
                    own = flat[(ends[rows] - n)[:, None] + np.arange(n)].astype(np.float64)
                    at = np.array([pivots[i] for i in same], dtype=np.float64)
                    best = ((at**2).sum(axis=1)[None, :] - 2 * own @ at.T).argmin(axis=1)
                    to[rows] = np.array(same)[best]
                    away[rows] = np.sqrt(((own - at[best]) ** 2).sum(axis=1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(away)], names=["id", "v", "q", "pivot", "away"])

    return run


def _meet(paged: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each asked (id, v, page, floor) finds in its page."""
    spark = paged.sparkSession
    loads = [(r["page"], -(-r["count"] // BLOCK)) for r in asked.groupBy("page").count().collect()]  # a row a page
    blocks = F.broadcast(spark.createDataFrame(loads, "page int, blocks int"))
    stored = paged.join(blocks, "page").select("page", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("floor"))
    given = asked.join(blocks, "page").select("page", F.pmod(F.xxhash64("id", F.lit(13)), F.col("blocks").cast("long")).cast("int").alias("block"), "id", "v", F.lit(True).alias("asks"), "floor")

    def search(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        rows = _matrix(table.column("v").combine_chunks())
        floors = table.column("floor").to_pylist()
        found: list[tuple[int, int, int]] = []
        if asks.any() and not asks.all():
            tree = MTree(ids[~asks], rows[~asks])
            for i in np.flatnonzero(asks):
                found += [(int(ids[i]), x, s) for s, x in tree.search(rows[i], int(ids[i]), k, floors[i])]
        return pa.table({n: pa.array([f[j] for f in found], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return stored.union(given).groupBy("page", "block").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects, the k rows of the largest inner product."""
    spark = vectors.sparkSession
    sound = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantize(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where("v is not null")
    about = sound.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x)))).alias("most")).first()
    if not about["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    kind = "int" if about["most"] is not None and 0 <= about["most"] < 1 << 31 else "bigint"
    page_rows = max(PAGE, -(-about["n"] // MOST_PAGES))
    # A bounded sample of pivots: the first by hash, two for each page.
    sample = sound.select("v").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(max(8, 2 * -(-about["n"] // page_rows))).collect()
    pivots = sorted({tuple(r.v) for r in sample})
    given = sound.select("id", F.col("v").cast(f"array<{kind}>").alias("v"), "q")
    dealt = checkpoint(given.mapInArrow(_deal(pivots), f"id bigint, v array<{kind}>, q boolean, pivot int, away double").withColumn("size", F.size("v")))
    pages = Pages(dealt.groupBy("size", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect(), pivots, page_rows)  # a row a pivot and length
    plan = spark.createDataFrame(pages.start, "size int, pivot int, start int, parts int")
    place = (F.col("start") + F.pmod(F.xxhash64("id", F.lit(11)), F.col("parts").cast("long"))).cast("int")
    paged = dealt.join(F.broadcast(plan), ["size", "pivot"]).select(place.alias("page"), "id", "v")
    asking = dealt.where("q").groupBy("id").agg(F.min("v").alias("v"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, to = b.column(1).value_lengths().to_numpy(zero_copy_only=False), np.zeros(b.num_rows, dtype=np.int32)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                to[rows] = pages.first(_matrix(b.column(1).take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to)], names=["id", "v", "page"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(1).to_pylist()
            floors, homes = b.column(3).to_pylist(), b.column(2).to_pylist()
            to = [[int(p) for p in pages.reached(np.array(v, dtype=np.int64), -np.inf if f is None else f) if p != h] for v, f, h in zip(cells, floors, homes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int32())), b.column(3)], names=["id", "v", "pages", "floor"])

    homes = checkpoint(asking.mapInArrow(first, f"id bigint, v array<{kind}>, page int"))
    near = checkpoint(_meet(paged, homes.withColumn("floor", F.lit(None).cast("long")), k))
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = homes.join(floors, homes.id == floors.query_id, "left").select("id", "v", "page", "floor")
    far = known.mapInArrow(others, f"id bigint, v array<{kind}>, pages array<int>, floor bigint").select("id", "v", F.explode("pages").alias("page"), "floor")
    met = near.union(_meet(paged, checkpoint(far), k))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
