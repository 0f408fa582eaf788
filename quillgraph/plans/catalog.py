"""Registered queries of the graph-feature engine and DuckDB SQL for the same rows.

Features are the table embeddings, edges come from lineitem (supplier or its number modulo the
vectors as dst, part modulo the vectors as src), labels are the vectors' labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import planning
from quillgraph.functions import vectors as vec
from quillgraph.functions.lineage import cut, shared_folder
from quillgraph.operators import aggregate, bitpack, caching, graph, kmeans, model, sampling, sq, twolevel, vq
from quillgraph.sources import codec, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DIM, SLICE, K = 64, 32, 16


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL under a name."""

    def put(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql.replace("round(", "0::DOUBLE + round(")  # no negative zero, as in Spark
        return query

    return put


def queries() -> dict[str, Query]:
    """Every query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the query's name."""
    return dict(_SQL)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return tables.vectors(spark, d).select("node_id", "feat")


def _edges(spark: SparkSession, d: str, parallel: bool = False) -> DataFrame:
    n = tables.read_table(spark, d, "embeddings").count()
    edges = tables.read_table(spark, d, "lineitem").select((F.col("l_suppkey") % n).alias("dst"), (F.col("l_partkey") % n).alias("src"))
    return edges if parallel else edges.distinct()


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seed nodes with their position: every fifth vector by id."""
    chosen = tables.read_table(spark, d, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("node_id"))
    return sampling.positions(chosen, ["node_id"])


def _hotness(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_edges(spark, d).select(F.col("src").alias("dst"))).withColumnRenamed("deg", "h")


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c), n).alias(c)


FEAT = "feat AS (SELECT vec_id AS node_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"
NUM = "num AS (SELECT count(*) AS n FROM embeddings)"
MULTI = f"{NUM}, multi AS (SELECT l_suppkey % n AS dst, l_partkey % n AS src FROM lineitem, num)"
EDGES = f"{MULTI}, edges AS (SELECT DISTINCT dst, src FROM multi)"
BOOK = f"""{FEAT}, raw AS (
  SELECT (j // {SLICE})::INTEGER AS cb, greatest(quantile_cont(abs(x), 0.005), 1e-5) AS fmin, greatest(quantile_cont(abs(x), 0.995), 2e-5) AS fmax, avg(abs(x)) AS m FROM feat GROUP BY 1
), book AS (SELECT cb, fmin, fmax, log2(fmin) AS emin, log2(fmax) + 1e-5 AS emax, CASE WHEN m < 0.1 THEN m + 0.1 ELSE m END AS mean FROM raw)"""


def _code_sql(bits: int) -> str:
    half = 1 << (bits - 1)
    if bits == 1:
        return f"{BOOK}, codes AS (SELECT node_id, j, cb, CASE WHEN x <= 0 THEN 0 ELSE 1 END AS q, x FROM feat JOIN book ON cb = j // {SLICE})"
    shift = half if bits < 8 else 0
    e = f"floor((log2(least(greatest(abs(x), fmin), fmax)) - emin) / (emax - emin) * {half})::INTEGER"
    return f"{BOOK}, codes AS (SELECT node_id, j, cb, (CASE WHEN x <= 0 THEN -1 - {e} ELSE {e} END + {shift})::INTEGER AS q, x FROM feat JOIN book ON cb = j // {SLICE})"


def _value_sql(bits: int) -> str:
    half = 1 << (bits - 1)
    if bits == 1:
        return "(q - 0.5::DOUBLE) * 2 * mean"
    v = f"(q - {half if bits < 8 else 0} + 0.5::DOUBLE)"
    return f"sign({v}) * pow(2::DOUBLE, abs({v}) * (emax - emin) / {half} + emin)"


def _decoded_sql(bits: int) -> str:
    return f"{_code_sql(bits)}, decoded AS (SELECT node_id, j, cb, q, codes.x AS was, {_value_sql(bits)} AS x FROM codes JOIN book USING (cb))"


@register("sq_codebook", f"WITH {BOOK} SELECT cb, round(fmin, 6) AS fmin, round(fmax, 6) AS fmax, round(emin, 6) AS emin, round(emax, 6) AS emax, round(mean, 6) AS mean FROM book")
def _sq_codebook(spark: SparkSession, d: str) -> DataFrame:
    return sq.codebook_table(_features(spark, d), SLICE).select("cb", *[_r(c) for c in ("fmin", "fmax", "emin", "emax", "mean")])


def _coded(spark: SparkSession, d: str, bits: int) -> tuple[sq.Codebook, DataFrame]:
    features = _features(spark, d)
    book = sq.codebook(features, SLICE)
    return book, sq.encode(features, book, bits)


def _sq_queries(bits: int) -> None:
    @register(f"sq_encode_b{bits}", f"WITH {_code_sql(bits)} SELECT node_id, j, q::INTEGER AS q FROM codes")
    def encode(spark: SparkSession, d: str) -> DataFrame:
        return vec.to_long(_coded(spark, d, bits)[1], "codes", "q")

    @register(f"sq_decode_b{bits}", f"WITH {_decoded_sql(bits)} SELECT node_id, j, round(x, 6) AS x FROM decoded")
    def decode(spark: SparkSession, d: str) -> DataFrame:
        book, codes = _coded(spark, d, bits)
        return vec.to_long(sq.decode(codes, book, bits)).select("node_id", "j", _r("x"))

    per = 8 // bits if bits < 8 else 1

    @register(f"spmm_sq_fused_b{bits}", f"WITH {_decoded_sql(bits)}, {MULTI} SELECT dst, j, round(avg(x), 6) AS x FROM multi JOIN decoded ON node_id = src GROUP BY dst, j")
    def fused(spark: SparkSession, d: str) -> DataFrame:
        book, codes = _coded(spark, d, bits)
        packed = codes.select("node_id", (bitpack.pack(F.col("codes"), DIM, bits) if per > 1 else F.col("codes")).alias("packed"))
        return vec.to_long(aggregate.spmm_sq(_edges(spark, d, parallel=True), packed, book, bits, DIM), key="dst").select("dst", "j", _r("x"))

    if bits not in planning.PACKED_BITS:
        return

    @register(f"packbits_b{bits}", f"WITH {_code_sql(bits)} SELECT node_id, (j // {per})::INTEGER AS b, sum(q << ({bits} * (j % {per})))::INTEGER AS byte FROM codes GROUP BY 1, 2")
    def pack(spark: SparkSession, d: str) -> DataFrame:
        codes = _coded(spark, d, bits)[1]
        return codes.select("node_id", F.posexplode(bitpack.pack(F.col("codes"), DIM, bits)).alias("b", "byte"))

    @register(f"unpackbits_b{bits}", f"WITH {_code_sql(bits)} SELECT node_id, j, q::INTEGER AS q FROM codes")
    def unpack(spark: SparkSession, d: str) -> DataFrame:
        codes = _coded(spark, d, bits)[1]
        packed = codes.select("node_id", bitpack.pack(F.col("codes"), DIM, bits).alias("p"))
        return vec.to_long(packed.select("node_id", bitpack.unpack(F.col("p"), DIM, bits).alias("codes")), "codes", "q")


for _bits in planning.CODE_BITS:
    _sq_queries(_bits)


@register(
    "sq_roundtrip_error",
    f"WITH {_decoded_sql(4)} SELECT cb, round(max(abs(x - was)), 6) AS max_err, round(avg(abs(x - was)), 6) AS mae, count(*) AS n FROM decoded GROUP BY cb",
)
def _sq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    features = _features(spark, d)
    book = sq.codebook(features, SLICE)
    back = sq.decode_expr(sq.encode_expr(F.col("feat"), book, 4), book, 4)
    gaps = F.zip_with("feat", back, lambda a, b: F.abs(a - b))
    rows = features.select(F.posexplode(gaps).alias("j", "e"))
    return rows.groupBy(F.floor(F.col("j") / SLICE).cast("int").alias("cb")).agg(F.round(F.max("e"), 6).alias("max_err"), F.round(F.avg("e"), 6).alias("mae"), F.count("*").alias("n"))


def _unit(seed: str, *cols: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"{c}::VARCHAR" for c in cols]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496"


def _text(seed: str, *cols: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{seed}'", *[f"{c}::VARCHAR" for c in cols]]) + ")"


HOT = f"{EDGES}, hot AS (SELECT src AS node_id, count(*) AS h FROM edges GROUP BY src)"


@register(
    "sq_hotness_sampled_codebook",
    f"""WITH {FEAT}, {HOT}, pick AS (SELECT node_id FROM hot WHERE node_id IN (SELECT vec_id FROM embeddings) ORDER BY -ln({_unit('cb', 'node_id')}) / h, node_id LIMIT 200),
raw AS (SELECT (j // {SLICE})::INTEGER AS cb, greatest(quantile_cont(abs(x), 0.005), 1e-5) AS fmin, greatest(quantile_cont(abs(x), 0.995), 2e-5) AS fmax, avg(abs(x)) AS m FROM feat JOIN pick USING (node_id) GROUP BY 1)
SELECT cb, round(fmin, 6) AS fmin, round(fmax, 6) AS fmax, round(CASE WHEN m < 0.1 THEN m + 0.1 ELSE m END, 6) AS mean FROM raw""",
)
def _sq_hot_codebook(spark: SparkSession, d: str) -> DataFrame:
    return sq.codebook_table(_features(spark, d), SLICE, _hotness(spark, d), sample=200).select("cb", _r("fmin"), _r("fmax"), _r("mean"))


SUB = f"""sub AS (SELECT vec_id AS node_id, c::INTEGER AS cb, list_transform(embedding[c * {SLICE} + 1 : (c + 1) * {SLICE}], lambda x: x::DOUBLE) AS v FROM embeddings, range({DIM // SLICE}) AS t(c))"""
CENTERS = f"{SUB}, centers AS (SELECT cb, node_id::INTEGER AS code, v AS center FROM sub WHERE node_id < {K})"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
COS = "(1 - " + DOT.format(a="a.v", b="c.center") + " / (sqrt(" + DOT.format(a="a.v", b="a.v") + ") * sqrt(" + DOT.format(a="c.center", b="c.center") + ")))"
L2 = "list_sum(list_transform(list_zip(a.v, c.center), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _assign_sql(centers: str, metric: str = COS, out: str = "assigned") -> str:
    return f"{out} AS (SELECT node_id, cb, s.code AS code, s.d AS d FROM (SELECT a.node_id AS node_id, a.cb AS cb, min({{'d': round({metric}, 12), 'code': c.code}}) AS s FROM sub AS a JOIN {centers} AS c ON a.cb = c.cb GROUP BY 1, 2))"


def _step_sql(centers: str, out: str, metric: str = COS) -> str:
    return f"""{_assign_sql(centers, metric, out + '_a')}, {out}_m AS (
  SELECT cb, code, list(m ORDER BY j) AS center FROM (SELECT s.cb AS cb, a.code AS code, j, avg(v[j]) AS m FROM sub AS s JOIN {out}_a AS a USING (node_id, cb), range(1, {SLICE + 1}) AS t(j) GROUP BY 1, 2, 3) GROUP BY 1, 2
), {out} AS (SELECT c.cb AS cb, c.code AS code, coalesce(m.center, c.center) AS center FROM {centers} AS c LEFT JOIN {out}_m AS m USING (cb, code))"""


NORMED = """normed AS (SELECT cb, code, list_transform(center, lambda x: x / n * avg_n) AS center FROM (
  SELECT *, avg(n) OVER (PARTITION BY cb) AS avg_n FROM (SELECT *, sqrt(list_sum(list_transform(center, lambda x: x * x))) AS n FROM {0})))"""
LONG_CENTERS = "SELECT cb, code, (j - 1)::INTEGER AS off, round(center[j], 6) AS v FROM {0}, range(1, " + str(SLICE + 1) + ") AS t(j)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.points(_features(spark, d), DIM, SLICE)


def _centers(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).where(F.col("node_id") < K).select("cb", F.col("node_id").cast("int").alias("code"), F.col("v").alias("center"))


def _long_centers(centers: DataFrame) -> DataFrame:
    return centers.select("cb", "code", F.posexplode("center").alias("off", "v")).select("cb", "code", "off", _r("v"))


for _name, _metric, _sql in (("cosine", "cosine", COS), ("l2", "l2", L2)):

    @register(f"pairwise_{_name}", f"WITH {CENTERS} SELECT a.cb AS cb, a.node_id AS x_id, c.code AS y_id, round({_sql}, 6) AS d FROM sub AS a JOIN centers AS c ON a.cb = c.cb")
    def _pairwise(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        x = _points(spark, d).select("cb", F.col("node_id").alias("id"), "v")
        y = _centers(spark, d).select("cb", F.col("code").alias("id"), F.col("center").alias("v"))
        return kmeans.pairwise_distance(x, y, metric).select("cb", "x_id", "y_id", _r("d"))

    @register(f"kmeans_assign_{_name}", f"WITH {CENTERS}, {_assign_sql('centers', _sql)} SELECT node_id, cb, code FROM assigned")
    def _assigned(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        return kmeans.assign(_points(spark, d), _centers(spark, d), metric).select("node_id", "cb", "code")


@register("kmeans_lloyd_step", f"WITH {CENTERS}, {_step_sql('centers', 's1')} {LONG_CENTERS.format('s1')}")
def _lloyd(spark: SparkSession, d: str) -> DataFrame:
    return _long_centers(kmeans.lloyd_step(_points(spark, d), _centers(spark, d)))


@register("kmeans_fit_3", f"WITH {CENTERS}, {_step_sql('centers', 's1')}, {_step_sql('s1', 's2')}, {_step_sql('s2', 's3')} {LONG_CENTERS.format('s3')}")
def _fit(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d)
    return _long_centers(kmeans.KMeans(K, max_iter=3, tol=0.0, centers=_centers(spark, d)).fit(rows).get_centers())


TOL = 0.05
SHIFT = "(SELECT max(s) * max(s) FROM (SELECT sum(sqrt(list_sum(list_transform(list_zip(a.center, b.center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS s FROM {0} AS a JOIN {1} AS b USING (cb, code) GROUP BY a.cb))"
STEPS = ", ".join([f"WITH {CENTERS}, {_step_sql('centers', 's1')}", *[_step_sql(f"s{n}", f"s{n + 1}") for n in range(1, 6)]])
STOP = "least(" + ", ".join(f"CASE WHEN {SHIFT.format('centers' if n == 1 else f's{n - 1}', f's{n}')} < {TOL * 1.2 ** (n - 1)!r} THEN {n} ELSE 6 END" for n in range(1, 7)) + ")"


@register("kmeans_fit_tol", f"{STEPS}, stop AS (SELECT {STOP} AS n), reached AS (" + " UNION ALL ".join(f"SELECT cb, code, center FROM s{n}, stop WHERE n = {n}" for n in range(1, 7)) + f") {LONG_CENTERS.format('reached')}")
def _fit_tol(spark: SparkSession, d: str) -> DataFrame:
    return _long_centers(kmeans.KMeans(K, max_iter=6, tol=TOL, centers=_centers(spark, d)).fit(_points(spark, d)).get_centers())


@register("kmeans_center_shift", f"WITH {CENTERS}, {_step_sql('centers', 's1')} SELECT cb, round(sum(sqrt(list_sum(list_transform(list_zip(c.center, s.center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))), 6) AS shift FROM centers AS c JOIN s1 AS s USING (cb, code) GROUP BY cb")
def _shift(spark: SparkSession, d: str) -> DataFrame:
    old = _centers(spark, d)
    return kmeans.center_shift(old, kmeans.lloyd_step(_points(spark, d), old)).select("cb", _r("shift"))


@register("vq_normalize", f"WITH {CENTERS}, {NORMED.format('centers')} {LONG_CENTERS.format('normed')}")
def _normalize(spark: SparkSession, d: str) -> DataFrame:
    return _long_centers(kmeans.normalize_centers(_centers(spark, d)))


@register(
    "vq_rim_filter",
    f"WITH {SUB}, sized AS (SELECT *, sqrt({DOT.format(a='v', b='v')}) AS n FROM sub), cut AS (SELECT cb, quantile_cont(n, {0.00625 * SLICE / 8}) AS q FROM sized GROUP BY cb) SELECT node_id, cb FROM sized JOIN cut USING (cb) WHERE n >= q",
)
def _rim(spark: SparkSession, d: str) -> DataFrame:
    return vq.rim_filter(_points(spark, d), SLICE).select("node_id", "cb")


VQ = f"{CENTERS}, {_step_sql('centers', 's1')}, {NORMED.format('s1')}, {_assign_sql('normed', COS, 'codes')}"


def _vq_coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _points(spark, d)
    book = cut(kmeans.normalize_centers(kmeans.lloyd_step(rows, _centers(spark, d))))
    return book, vq.encode(_features(spark, d), book, SLICE)


@register("vq_encode", f"WITH {VQ} SELECT node_id, cb, code FROM codes")
def _vq_encode(spark: SparkSession, d: str) -> DataFrame:
    return _vq_coded(spark, d)[1]


@register("vq_decode", f"WITH {VQ} SELECT node_id, (cb * {SLICE} + j - 1)::INTEGER AS j, round(center[j], 6) AS x FROM codes JOIN normed USING (cb, code), range(1, {SLICE + 1}) AS t(j)")
def _vq_decode(spark: SparkSession, d: str) -> DataFrame:
    book, codes = _vq_coded(spark, d)
    return vec.to_long(vq.decode(codes, book, DIM)).select("node_id", "j", _r("x"))


@register("vq_codebook")
def _vq_codebook(spark: SparkSession, d: str) -> DataFrame:
    """A codebook learned whole: sample, rim, iterations to the tolerance, even length; tested against a twin."""
    return _long_centers(vq.codebook(_features(spark, d), SLICE, K))


@register("vq_inertia", f"WITH {CENTERS}, {_assign_sql('centers')} SELECT cb, round(sum(d), 6) AS inertia FROM assigned GROUP BY cb")
def _inertia(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.inertia(kmeans.assign(_points(spark, d), _centers(spark, d))).select("cb", _r("inertia"))


@register("spmm_mean", f"WITH {FEAT}, {MULTI} SELECT dst, j, round(avg(x), 6) AS x FROM multi JOIN feat ON node_id = src GROUP BY dst, j")
def _spmm(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.spmm_mean(_edges(spark, d, parallel=True), _features(spark, d), DIM)
    return vec.to_long(out, key="dst").select("dst", "j", _r("x"))


@register(
    "spmm_mean_isolated",
    f"WITH {FEAT}, {MULTI}, mean AS (SELECT dst, j, avg(x) AS x FROM multi JOIN feat ON node_id = src GROUP BY dst, j) SELECT f.node_id AS dst, f.j AS j, round(coalesce(m.x, 0), 6) AS x FROM feat AS f LEFT JOIN mean AS m ON f.node_id = m.dst AND f.j = m.j",
)
def _spmm_isolated(spark: SparkSession, d: str) -> DataFrame:
    features = _features(spark, d)
    out = aggregate.spmm_mean(_edges(spark, d, parallel=True), features, DIM, features.select(F.col("node_id").alias("dst")))
    return vec.to_long(out, key="dst").select("dst", "j", _r("x"))


@register("spmm_vq_fused", f"WITH {VQ}, {MULTI} SELECT dst, (cb * {SLICE} + j - 1)::INTEGER AS j, round(avg(center[j]), 6) AS x FROM multi JOIN codes ON node_id = src JOIN normed USING (cb, code), range(1, {SLICE + 1}) AS t(j) GROUP BY 1, 2")
def _spmm_vq(spark: SparkSession, d: str) -> DataFrame:
    book, codes = _vq_coded(spark, d)
    return aggregate.spmm_vq(_edges(spark, d, parallel=True), codes, book, DIM, SLICE).select("dst", "j", _r("x"))


RATIOS = [(r, k, g, t) for r in (2, 4, 8, 32, 64, 128) for k in (128, 512) for g in (1, 3) for t in (False, True)]


@register(
    "twolevel_plan",
    f"""WITH dim AS (SELECT max(len(embedding)) AS dim FROM embeddings), asked(plan, ratio, k, g, two) AS (VALUES {", ".join(f"({i}, {r}, {k}, {g}, {t})" for i, (r, k, g, t) in enumerate(RATIOS))}),
wide AS (SELECT *, ceil(ceil(dim / g) / 8)::INTEGER * 8 AS slice8, (ratio // 4) * CASE WHEN k > 256 THEN 2 ELSE 1 END AS width FROM asked, dim),
levels AS (
  SELECT plan, 0 AS level, 'sq' AS method, slice8 AS column_slice, 4 AS bits, 0 AS n_clusters, ceil(dim * 4 / 8) AS row_bytes FROM wide WHERE two
  UNION ALL SELECT plan, two::INTEGER, 'sq', slice8, 32 // ratio, 0, ceil(dim * (32 // ratio) / 8) FROM wide WHERE ratio <= 32
  UNION ALL SELECT plan, two::INTEGER, 'vq', width, 0, k, ceil(dim / width) * CASE WHEN k > 256 THEN 2 ELSE 1 END FROM wide WHERE ratio > 32
) SELECT plan::INTEGER AS plan, level::INTEGER AS level, method, column_slice::INTEGER AS column_slice, bits::INTEGER AS bits, n_clusters::INTEGER AS n_clusters, row_bytes::INTEGER AS row_bytes FROM levels""",
)
def _plan(spark: SparkSession, d: str) -> DataFrame:
    dim = vec.dimension(_features(spark, d))
    rows = [(i, x.level, x.method, x.column_slice, x.bits or 0, x.n_clusters or 0, planning.compressed_bytes(dim, x)) for i, (r, k, g, t) in enumerate(RATIOS) for x in planning.plan_codec(dim, 32, r, k, g, t)]
    return spark.createDataFrame(rows, "plan int, level int, method string, column_slice int, bits int, n_clusters int, row_bytes int")


TWO = f"{_decoded_sql(4)}, low AS (SELECT node_id, j, CASE WHEN q1 = 0 THEN -mean ELSE mean END AS x FROM (SELECT node_id, j, (j // {SLICE})::INTEGER AS cb, CASE WHEN x <= 0 THEN 0 ELSE 1 END AS q1 FROM feat) JOIN book USING (cb))"


def _two_levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    features = _features(spark, d)
    book = sq.codebook(features, SLICE)
    seeds = features.where("node_id % 5 = 0")
    return features, sq.decode(sq.encode(seeds, book, 4), book, 4), sq.decode(sq.encode(features, book, 1), book, 1)


@register("twolevel_decode", f"WITH {TWO} SELECT l.node_id AS node_id, l.j AS j, round(CASE WHEN l.node_id % 5 = 0 THEN d.x ELSE l.x END, 6) AS x FROM low AS l JOIN decoded AS d ON l.node_id = d.node_id AND l.j = d.j")
def _two_decode(spark: SparkSession, d: str) -> DataFrame:
    nodes, first, rest = _two_levels(spark, d)
    return vec.to_long(twolevel.self_features(nodes, first, rest)).select("node_id", "j", _r("x"))


@register("concat_decode", f"WITH {TWO} SELECT node_id, j, round(x, 6) AS x FROM decoded WHERE node_id % 5 = 0 UNION ALL SELECT node_id, j, round(x, 6) FROM low WHERE node_id % 5 <> 0")
def _concat(spark: SparkSession, d: str) -> DataFrame:
    _, first, rest = _two_levels(spark, d)
    return vec.to_long(twolevel.concat_decode(first, rest.where("node_id % 5 <> 0"))).select("node_id", "j", _r("x"))


def _book_sql(name: str, rows: str) -> str:
    return f"""{name}_raw AS (SELECT (j // {SLICE})::INTEGER AS cb, greatest(quantile_cont(abs(x), 0.005), 1e-5) AS fmin, greatest(quantile_cont(abs(x), 0.995), 2e-5) AS fmax, avg(abs(x)) AS m FROM {rows} GROUP BY 1),
{name} AS (SELECT cb, fmin, fmax, log2(fmin) AS emin, log2(fmax) + 1e-5 AS emax, CASE WHEN m < 0.1 THEN m + 0.1 ELSE m END AS mean FROM {name}_raw)"""


@register(
    "codec_roundtrip",
    f"""WITH {FEAT}, own AS (SELECT * FROM feat WHERE node_id % 5 = 0), {_book_sql('fine', 'own')}, {_book_sql('rough', 'feat')},
coded AS (SELECT node_id, j, emin, emax, (CASE WHEN x <= 0 THEN -1 - e ELSE e END) + 0.5 AS v FROM (SELECT *, floor((log2(least(greatest(abs(x), fmin), fmax)) - emin) / (emax - emin) * 8) AS e FROM own JOIN fine ON cb = j // {SLICE}))
SELECT node_id, j, round(sign(v) * pow(2::DOUBLE, abs(v) * (emax - emin) / 8 + emin), 6) AS x FROM coded
UNION ALL SELECT node_id, j, round(CASE WHEN x <= 0 THEN -mean ELSE mean END, 6) FROM feat JOIN rough ON cb = j // {SLICE} WHERE node_id % 5 <> 0""",
)
def _codec(spark: SparkSession, d: str) -> DataFrame:
    """Two levels planned for a ratio of 32, encoded, packed, stored, opened again and decoded."""
    features = _features(spark, d)
    folder = f"{shared_folder(spark)}/codec-{uuid.uuid4().hex}"
    codec.write(codec.compress(features, 32, 32, groups=2, seeds=features.where("node_id % 5 = 0")), folder, parts=4)
    return vec.to_long(codec.read(spark, folder).features(features)).select("node_id", "j", _r("x"))


@register("graph_bidirect", f"WITH {MULTI} SELECT dst, src FROM multi UNION SELECT src, dst FROM multi")
def _bidirect(spark: SparkSession, d: str) -> DataFrame:
    return graph.bidirect(_edges(spark, d, parallel=True))


@register(
    "graph_hetero_union",
    "SELECT o_custkey AS dst, o_orderkey + 1000000 AS src FROM orders UNION ALL SELECT o_orderkey + 1000000, o_custkey FROM orders UNION ALL SELECT s_suppkey + 9000000, s_nationkey + 9900000 FROM supplier",
)
def _hetero(spark: SparkSession, d: str) -> DataFrame:
    a = tables.read_table(spark, d, "orders").select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("src"))
    b = tables.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("src"))
    return graph.hetero_union([(a, 0, 1_000_000, True), (b, 9_000_000, 9_900_000, False)])


DEG = f"{EDGES}, deg AS (SELECT vec_id AS node_id, count(dst) AS deg FROM embeddings LEFT JOIN edges ON dst = vec_id GROUP BY vec_id)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"))


@register("graph_degree", f"WITH {DEG} SELECT node_id, deg FROM deg")
def _degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_edges(spark, d), _nodes(spark, d))


_QUERIES["hotness_static"], _SQL["hotness_static"] = _QUERIES["graph_degree"], _SQL["graph_degree"]


@register("graph_indptr", f'WITH {DEG} SELECT node_id, ("end" - deg)::BIGINT AS beg, "end"::BIGINT AS "end" FROM (SELECT *, sum(deg) OVER (ORDER BY node_id) AS "end" FROM deg)')
def _indptr(spark: SparkSession, d: str) -> DataFrame:
    return graph.indptr(_edges(spark, d), _nodes(spark, d))


SPLITS = {"train": (0, 6), "valid": (6, 8), "test": (8, 10)}
SPLIT = "split AS (SELECT vec_id AS node_id, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM embeddings)"


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return graph.split_ids(_nodes(spark, d).withColumn("bucket", F.col("node_id") % 10), SPLITS)


@register("split_ids", f"WITH {SPLIT} SELECT node_id, split FROM split")
def _split_ids(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


@register("seeds_union", f"WITH {SPLIT} SELECT node_id, CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END::INTEGER AS part FROM split")
def _seeds_union(spark: SparkSession, d: str) -> DataFrame:
    return graph.seeds_union(_splits(spark, d), ["train", "valid", "test"])


@register("num_classes", "SELECT (max(label) + 1)::INTEGER AS num_classes FROM embeddings WHERE label IS NOT NULL")
def _num_classes(spark: SparkSession, d: str) -> DataFrame:
    return graph.num_classes(tables.read_table(spark, d, "embeddings"))


@register("sample_uniform", f"SELECT vec_id AS node_id FROM embeddings ORDER BY {_text('u', 'vec_id')}, vec_id LIMIT 100")
def _uniform(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(_nodes(spark, d), 100)


@register("sample_weighted", f"WITH {HOT} SELECT node_id FROM hot ORDER BY -ln({_unit('w', 'node_id')}) / h, node_id LIMIT 50")
def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted(_hotness(spark, d), 50).select("node_id")


@register("neighbor_sample_k", f"WITH {EDGES} SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY {_text('n', 'dst', 'src')}, src) AS r FROM edges) WHERE r <= 20")
def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return sampling.neighbours(_edges(spark, d), 20)


@register(
    "neighbor_sample_replace",
    f"""WITH {EDGES}, placed AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS place, count(*) OVER (PARTITION BY dst) AS deg FROM edges),
draws AS (SELECT dst, draw::INTEGER AS draw, least(floor({_unit('r', 'dst', 'draw')} * deg), deg - 1)::BIGINT AS place FROM (SELECT DISTINCT dst, deg FROM placed), range(10) AS t(draw))
SELECT dst, draw, src FROM draws JOIN placed USING (dst, place)""",
)
def _neighbours_replaced(spark: SparkSession, d: str) -> DataFrame:
    return sampling.neighbours_replaced(_edges(spark, d), 10)


SEEDS = "seeds AS (SELECT vec_id AS node_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE vec_id % 5 = 0), batched AS (SELECT *, (pos // 16)::INTEGER AS batch_id FROM seeds)"


def _hop_sql(frontier: str, out: str, k: int, seed: str) -> str:
    return f"""{out} AS (SELECT batch_id, dst, src FROM (SELECT batch_id, e.dst AS dst, e.src AS src, row_number() OVER (PARTITION BY batch_id, e.dst ORDER BY {_text(seed, 'batch_id', 'e.dst', 'e.src')}, e.src) AS r
  FROM {frontier} AS f JOIN edges AS e ON f.node_id = e.dst) WHERE r <= {k}), {out}_f AS (SELECT batch_id, node_id FROM {frontier} UNION SELECT batch_id, src FROM {out})"""


HOPS = f"{EDGES}, {SEEDS}, front AS (SELECT DISTINCT batch_id, node_id FROM batched), {_hop_sql('front', 'b0', 5, 'k0')}, {_hop_sql('b0_f', 'b1', 3, 'k1')}"


def _batched(spark: SparkSession, d: str, drop_last: bool = False) -> DataFrame:
    return sampling.batches(_seeds(spark, d), 16, drop_last)


def _blocks(spark: SparkSession, d: str) -> list[DataFrame]:
    return sampling.khop(_batched(spark, d), _edges(spark, d), [5, 3])


@register("khop_blocks", f"WITH {HOPS} SELECT 0 AS hop, batch_id, dst, src FROM b0 UNION ALL SELECT 1, batch_id, dst, src FROM b1")
def _khop(spark: SparkSession, d: str) -> DataFrame:
    a, b = _blocks(spark, d)
    return a.withColumn("hop", F.lit(0)).unionByName(b.withColumn("hop", F.lit(1))).select("hop", "batch_id", "dst", "src")


@register(
    "relabel",
    f"""WITH {HOPS}, nodes AS (SELECT batch_id, node_id, 0 AS new, pos FROM batched UNION ALL
  SELECT DISTINCT batch_id, src, 1, src FROM b0 WHERE (batch_id, src) NOT IN (SELECT (batch_id, node_id) FROM batched))
SELECT batch_id, node_id, (row_number() OVER (PARTITION BY batch_id ORDER BY new, pos, node_id) - 1)::INTEGER AS local_id FROM nodes""",
)
def _relabel(spark: SparkSession, d: str) -> DataFrame:
    seeds = _batched(spark, d)
    return sampling.relabel(seeds, sampling.khop(seeds, _edges(spark, d), [5])[0])


@register("batches", f"WITH {SEEDS} SELECT node_id, batch_id FROM batched")
def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d).select("node_id", "batch_id")


@register("batches_drop_last", f"WITH {SEEDS} SELECT node_id, batch_id FROM batched WHERE batch_id < (SELECT count(*) // 16 FROM seeds)")
def _batches_dropped(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, True).select("node_id", "batch_id")


@register("rank_partition", f"WITH {SEEDS} SELECT node_id, (pos // ((SELECT count(*) + 2 FROM seeds) // 3))::INTEGER AS rank FROM seeds")
def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rank_partition(_seeds(spark, d), 3).select("node_id", "rank")


LOCAL = f"""{HOPS}, n1 AS (SELECT batch_id, src AS node_id FROM b0 EXCEPT SELECT batch_id, node_id FROM batched), n2 AS (SELECT batch_id, src AS node_id FROM b1 EXCEPT SELECT batch_id, node_id FROM b0_f),
locals AS (SELECT batch_id, node_id, hop::INTEGER AS hop, (row_number() OVER (PARTITION BY batch_id ORDER BY hop, place) - 1)::INTEGER AS local_id FROM (
  SELECT batch_id, node_id, 0 AS hop, pos AS place FROM batched UNION ALL SELECT batch_id, node_id, 1, node_id FROM n1 UNION ALL SELECT batch_id, node_id, 2, node_id FROM n2))"""


def _loaded(spark: SparkSession, d: str) -> tuple[list[DataFrame], DataFrame]:
    return sampling.loader(_batched(spark, d), _edges(spark, d), _features(spark, d), [5, 3])


@register("loader_nodes", f"WITH {LOCAL} SELECT batch_id, local_id, node_id, hop, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM locals JOIN embeddings ON vec_id = node_id")
def _loader_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _loaded(spark, d)[1]
    return nodes.select("batch_id", "local_id", "node_id", "hop", F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register(
    "loader_blocks",
    f"WITH {LOCAL} SELECT hop::INTEGER AS hop, b.batch_id AS batch_id, d.local_id AS dst, s.local_id AS src FROM (SELECT 0 AS hop, * FROM b0 UNION ALL SELECT 1, * FROM b1) AS b JOIN locals AS d ON b.batch_id = d.batch_id AND b.dst = d.node_id JOIN locals AS s ON b.batch_id = s.batch_id AND b.src = s.node_id".replace("SELECT hop::INTEGER AS hop, b.", "SELECT b.hop::INTEGER AS hop, b."),
)
def _loader_blocks(spark: SparkSession, d: str) -> DataFrame:
    a, b = _loaded(spark, d)[0]
    return a.withColumn("hop", F.lit(0)).unionByName(b.withColumn("hop", F.lit(1))).select("hop", "batch_id", "dst", "src")


def _stack_sql(block: str, h: str, out: str, dim: int, outs: int, hop: int, last: bool) -> str:
    y = "sum(((o * 7 + j * 3) % 11 - 5)::DOUBLE / 10 * x + ((o * 5 + j * 2) % 13 - 6)::DOUBLE / 10 * coalesce(m, 0)) + (o - 4)::DOUBLE / 20"
    return f"""{out}_m AS (SELECT b.batch_id AS batch_id, b.dst AS node_id, j, avg(x) AS m FROM {block} AS b JOIN {h} AS h ON b.batch_id = h.batch_id AND b.src = h.node_id GROUP BY 1, 2, 3),
{out} AS (SELECT batch_id, node_id, hop, o AS j, {y if last else f"greatest({y}, 0)"} AS x FROM (SELECT h.*, m FROM {h} AS h LEFT JOIN {out}_m AS n ON h.batch_id = n.batch_id AND h.node_id = n.node_id AND h.j = n.j WHERE hop <= {hop}), range({outs}) AS t(o) GROUP BY batch_id, node_id, hop, o)"""


@register(
    "sage_stack",
    f"WITH {LOCAL}, {FEAT}, h0 AS (SELECT batch_id, node_id, hop, j, x FROM locals JOIN feat USING (node_id)), {_stack_sql('b1', 'h0', 'h1', DIM, 12, 1, False)}, {_stack_sql('b0', 'h1', 'h2', 12, 10, 0, True)} SELECT batch_id, node_id, j::INTEGER AS o, round(x, 5) AS y FROM h2",
)
def _sage_stack(spark: SparkSession, d: str) -> DataFrame:
    blocks, nodes = _loaded(spark, d)
    out = model.sage_stack(blocks, nodes, [_weights_table(spark, 12), _weights_table(spark, 10, 12)], [DIM, 12])
    return out.select("batch_id", "node_id", F.posexplode("feat").alias("o", "y")).select("batch_id", "node_id", "o", _r("y", 5))


PRE = f"""{HOPS}, sampled AS (SELECT node_id, count(*) AS c FROM (SELECT * FROM front UNION ALL SELECT * FROM b0_f) GROUP BY 1), used AS (SELECT node_id, count(*) AS c FROM b1_f GROUP BY 1),
pre AS (SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM seeds) THEN 1 ELSE 0 END::BIGINT AS seed_h, coalesce(s.c, 0) AS sampling_h, u.c AS feature_h FROM used AS u LEFT JOIN sampled AS s USING (node_id))"""


@register("hotness_presample", f"WITH {PRE} SELECT node_id, seed_h, sampling_h, feature_h FROM pre")
def _presample(spark: SparkSession, d: str) -> DataFrame:
    return caching.presample(_batched(spark, d), _blocks(spark, d))


WEIGHTS = f"{HOT}, deg AS (SELECT dst AS node_id, count(*) AS deg FROM edges GROUP BY dst), cost AS (SELECT avg(h::DOUBLE) * 4 * {DIM} AS feature_weight, avg((least(coalesce(deg, 0)::DOUBLE, 26.0::DOUBLE) * 8 + 8) * h) AS graph_weight FROM hot LEFT JOIN deg USING (node_id))"


@register("cache_weights", f"WITH {WEIGHTS} SELECT round(feature_weight, 6) AS feature_weight, round(graph_weight, 6) AS graph_weight FROM cost")
def _weights(spark: SparkSession, d: str) -> DataFrame:
    out = caching.cost_weights(_hotness(spark, d), graph.in_degree(_edges(spark, d)), 8, DIM, 20)
    return out.select((F.round(F.col("feature_weight") / 2, 6)).alias("feature_weight"), _r("graph_weight"))


CAPACITIES = (0, 1000, 20_000, 60_000, 300_000, 100_000_000)


@register(
    "cache_allocate",
    f"""WITH RECURSIVE {WEIGHTS}, asked AS (SELECT unnest([{", ".join(map(str, CAPACITIES))}])::DOUBLE AS capacity),
given AS (SELECT capacity, feature_weight / 2 AS wf, graph_weight AS wg, (SELECT count(*) FROM hot) * 4.0 * {DIM} / capacity AS cf, (SELECT sum(deg) * 8 + 8 * count(*) + 8 FROM deg) / capacity AS cg FROM asked, cost WHERE capacity > 0),
dealt(capacity, wf, wg, cf, cg, sf, sg, shut_f, shut_g, round) AS (
  SELECT capacity, wf, wg, cf, cg, 0::DOUBLE, 0::DOUBLE, false, false, 0 FROM given
  UNION ALL
  SELECT capacity, wf, wg, cf, cg,
    CASE WHEN shut_f THEN sf WHEN sf + (1 - sf - sg) * wf / (wf + wg) < cf THEN sf + (1 - sf - sg) * wf / (wf + wg) ELSE cf END,
    CASE WHEN shut_g THEN sg WHEN sg + (1 - sf - sg) * wg / (wf + wg) < cg THEN sg + (1 - sf - sg) * wg / (wf + wg) ELSE cg END,
    shut_f OR sf + (1 - sf - sg) * wf / (wf + wg) >= cf, shut_g OR sg + (1 - sf - sg) * wg / (wf + wg) >= cg, round + 1
  FROM dealt WHERE round < 11 AND 1 - sf - sg > 1e-5 AND NOT (shut_f AND shut_g)
), last AS (SELECT capacity, arg_max(sf, round) AS sf, arg_max(sg, round) AS sg FROM dealt GROUP BY capacity)
SELECT a.capacity::BIGINT AS capacity, coalesce(floor(a.capacity * sf) + 4, 0)::BIGINT AS features, coalesce(floor(a.capacity * sg) + 4, 0)::BIGINT AS graph FROM asked AS a LEFT JOIN last USING (capacity)""".replace("avg(h::DOUBLE) * 4 *", "avg(h::DOUBLE) * 8 *"),
)
def _allocate(spark: SparkSession, d: str) -> DataFrame:
    hot, deg = _hotness(spark, d), graph.in_degree(_edges(spark, d))
    cost = caching.cost_weights(hot, deg, 8, DIM, 20).first()
    limits = [hot.count() * 4.0 * DIM, float(deg.agg(F.sum("deg") * 8 + 8 * F.count("*") + 8).first()[0])]
    rows = [(c, *planning.allocate(c, [cost.feature_weight / 2, cost.graph_weight], limits)) for c in CAPACITIES]
    return spark.createDataFrame(rows, "capacity long, features long, graph long")


TOP = f"{HOT}, cache AS (SELECT node_id, h FROM hot ORDER BY h DESC, node_id LIMIT {20_000 // (DIM * 4 + 10)})"


def _feature_cache(spark: SparkSession, d: str) -> DataFrame:
    return caching.feature_cache(_hotness(spark, d), DIM * 4, 20_000)


@register("cache_features_topk", f"WITH {TOP} SELECT node_id, h FROM cache")
def _cache_features(spark: SparkSession, d: str) -> DataFrame:
    return _feature_cache(spark, d)


@register(
    "cache_graph_prefix",
    f"""WITH {HOT}, deg AS (SELECT dst AS node_id, count(*) AS deg FROM edges GROUP BY dst), sized AS (SELECT node_id, h, deg * 8 + 18 AS size FROM hot JOIN deg USING (node_id))
SELECT node_id, h, size, cum::BIGINT AS cum FROM (SELECT *, sum(size) OVER (ORDER BY h DESC, node_id ROWS UNBOUNDED PRECEDING) AS cum FROM sized) WHERE cum < 40000""",
)
def _cache_graph(spark: SparkSession, d: str) -> DataFrame:
    return caching.graph_cache(_hotness(spark, d), graph.in_degree(_edges(spark, d)), 8, 40_000)


@register("cache_hit_ratio", f"WITH {TOP} SELECT round((SELECT sum(h) FROM cache) / (SELECT sum(h) FROM hot), 6)::DOUBLE AS ratio")
def _hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    return caching.hit_ratio(_hotness(spark, d), _feature_cache(spark, d)).select(_r("ratio"))


@register("gather_cached", f"WITH {FEAT}, {TOP} SELECT s.vec_id AS node_id, j, round(x, 6) AS x, s.vec_id IN (SELECT node_id FROM cache) AS hit FROM embeddings AS s JOIN feat ON feat.node_id = s.vec_id WHERE s.vec_id % 5 = 0")
def _gather(spark: SparkSession, d: str) -> DataFrame:
    features = _features(spark, d)
    cache = features.join(_feature_cache(spark, d).select("node_id"), "node_id", "left_semi")
    out = graph.two_tier_gather(features.where("node_id % 5 = 0").select("node_id"), cache, features)
    return out.select("node_id", F.posexplode("feat").alias("j", "x"), "hit").select("node_id", "j", _r("x"), "hit")


@register(
    "remote_access_count",
    f"""WITH {HOPS}, bounds(rank, lo, hi) AS (VALUES (0, 0, 150), (1, 150, 300), (2, 300, 1000000)), ranked AS (SELECT *, (batch_id % 3)::INTEGER AS rank FROM batched), hop AS (SELECT *, (batch_id % 3)::INTEGER AS rank FROM b0)
SELECT b.rank::INTEGER AS rank, (SELECT count(*) FROM ranked AS s WHERE s.rank = b.rank AND (node_id < lo OR node_id >= hi)) AS remote_seeds, (SELECT count(*) FROM hop AS s WHERE s.rank = b.rank AND (src < lo OR src >= hi)) AS remote_neighbours FROM bounds AS b""",
)
def _remote(spark: SparkSession, d: str) -> DataFrame:
    seeds = _batched(spark, d).withColumn("rank", (F.col("batch_id") % 3).cast("int"))
    block = _blocks(spark, d)[0].withColumn("rank", (F.col("batch_id") % 3).cast("int"))
    bounds = spark.createDataFrame([(0, 0, 150), (1, 150, 300), (2, 300, 1_000_000)], "rank int, lo long, hi long")
    return graph.remote_access(seeds, block, bounds)


W_SELF, W_NEIGH, BIAS = "((o * 7 + j * 3) % 11 - 5)::DOUBLE / 10", "((o * 5 + j * 2) % 13 - 6)::DOUBLE / 10", "(o - 4)::DOUBLE / 20"
LAYER = f"""{FEAT}, {MULTI}, mean AS (SELECT dst, j, avg(x) AS m FROM multi JOIN feat ON node_id = src GROUP BY dst, j),
layer AS (SELECT f.node_id AS node_id, o::INTEGER AS o, sum({W_SELF} * x + {W_NEIGH} * coalesce(m, 0)) + any_value({BIAS}) AS y FROM feat AS f LEFT JOIN mean ON f.node_id = dst AND f.j = mean.j, range(10) AS t(o) WHERE true GROUP BY f.node_id, o)""".replace("o * 7 + j * 3", "o * 7 + f.j * 3").replace("o * 5 + j * 2", "o * 5 + f.j * 2")


def _weights_table(spark: SparkSession, outs: int = 10, dim: int = DIM) -> DataFrame:
    j = F.sequence(F.lit(0), F.lit(dim - 1))
    own, neigh = F.transform(j, lambda j: ((F.col("o") * 7 + j * 3) % 11 - 5) / 10.0), F.transform(j, lambda j: ((F.col("o") * 5 + j * 2) % 13 - 6) / 10.0)
    return spark.range(outs).select(F.col("id").cast("int").alias("o")).select("o", own.alias("own"), neigh.alias("neigh"), ((F.col("o") - 4) / 20.0).alias("b"))


def _layer(spark: SparkSession, d: str, activation: str | None) -> DataFrame:
    features = _features(spark, d)
    mean = aggregate.spmm_mean(_edges(spark, d, parallel=True), features, DIM, features.select(F.col("node_id").alias("dst")))
    met = features.join(mean.select(F.col("dst").alias("node_id"), F.col("feat").alias("mean")), "node_id")
    out = model.sage_layer(met, _weights_table(spark), activation)
    return out.select("node_id", F.posexplode("feat").alias("o", "y"))


@register("sage_layer", f"WITH {LAYER} SELECT node_id, o, round(greatest(y, 0), 6) AS y FROM layer")
def _sage(spark: SparkSession, d: str) -> DataFrame:
    return _layer(spark, d, "relu").select("node_id", "o", _r("y"))


@register("sage_predict", f"WITH {LAYER} SELECT node_id, (-s.o)::INTEGER AS pred FROM (SELECT node_id, max({{'y': y, 'o': -o}}) AS s FROM layer GROUP BY node_id)")
def _predict(spark: SparkSession, d: str) -> DataFrame:
    return model.predict(_layer(spark, d, None))


PRED = f"{LAYER}, pred AS (SELECT node_id, (-s.o)::INTEGER AS pred FROM (SELECT node_id, max({{'y': y, 'o': -o}}) AS s FROM layer GROUP BY node_id))"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return tables.vectors(spark, d).select("node_id", "label")


@register("accuracy_global", f"WITH {PRED} SELECT round(avg((pred = label)::INTEGER), 6) AS accuracy FROM pred JOIN embeddings ON vec_id = node_id")
def _accuracy(spark: SparkSession, d: str) -> DataFrame:
    return model.accuracy(model.predict(_layer(spark, d, None)), _labels(spark, d)).select(_r("accuracy"))


@register("accuracy_rank_mean", f"WITH {PRED} SELECT round(avg(a), 6) AS accuracy FROM (SELECT avg((pred = label)::INTEGER) AS a FROM pred JOIN embeddings ON vec_id = node_id GROUP BY node_id % 3)")
def _accuracy_ranks(spark: SparkSession, d: str) -> DataFrame:
    ranked = model.predict(_layer(spark, d, None)).withColumn("rank", F.col("node_id") % 3)
    return model.accuracy_rank_mean(ranked, _labels(spark, d)).select(_r("accuracy"))


@register(
    "gat_edge_softmax",
    f"WITH {EDGES}, scored AS (SELECT dst, src, ((dst * 3 + src * 7) % 19)::DOUBLE / 10 AS e FROM edges), top AS (SELECT dst, max(e) AS m FROM scored GROUP BY dst), p AS (SELECT s.dst, src, exp(e - m) AS p FROM scored AS s JOIN top USING (dst)) SELECT dst, src, round(p / sum(p) OVER (PARTITION BY dst), 6) AS a FROM p",
)
def _softmax(spark: SparkSession, d: str) -> DataFrame:
    scores = _edges(spark, d).withColumn("e", ((F.col("dst") * 3 + F.col("src") * 7) % 19) / 10.0)
    return model.edge_softmax(scores).select("dst", "src", _r("a"))
