"""Twins in plain Python, edge cases and identities that fixed tables do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import planning
from quillgraph.functions import vectors as vec
from quillgraph.operators import aggregate, bitpack, caching, graph, kmeans, model, sampling, sq, vq
from quillgraph.sources import codec, tables
from quillgraph.streaming import encode as stream


def twin_encode(x, book, bits, width):
    out = []
    half = 1 << (bits - 1)
    for j, v in enumerate(x):
        fmin, fmax, emin, emax, _ = book.rows[j // width]
        if bits == 1:
            out.append(0 if v <= 0 else 1)
            continue
        e = math.floor((math.log2(min(max(abs(v), fmin), fmax)) - emin) / (emax - emin) * half)
        out.append((-1 - e if v <= 0 else e) + (half if bits < 8 else 0))
    return out


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (40, 11))
    x[0, :4] = [0.0, -0.0, 50.0, 1e-9]
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, feat array<double>")


@pytest.mark.parametrize("bits", planning.CODE_BITS)
def test_scalar_codes_against_twin(features, bits):
    x, df = features
    book = sq.codebook(df, 6)
    assert len(book.rows) == 2  # the last slice is shorter
    got = {r.node_id: r.codes for r in sq.encode(df, book, bits).collect()}
    for i, r in enumerate(x):
        assert got[i] == twin_encode(r, book, bits, 6)
    low, high = (0, (1 << bits) - 1) if bits < 8 else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    assert all(low <= q <= high for r in got.values() for q in r)


@pytest.mark.parametrize("bits", planning.PACKED_BITS)
def test_unpack_reverses_pack_with_a_tail(spark, bits):
    dim = 11
    codes = [[(i * 7 + j * 3) % (1 << bits) for j in range(dim)] for i in range(9)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "node_id long, codes array<int>")
    packed = df.select("node_id", bitpack.pack(F.col("codes"), dim, bits).alias("p"))
    for r in packed.collect():
        assert len(r.p) == -(-dim * bits // 8)
        assert r.p[0] == sum(codes[r.node_id][i] << (bits * i) for i in range(8 // bits))
    back = packed.select("node_id", bitpack.unpack(F.col("p"), dim, bits).alias("codes"))
    assert {r.node_id: r.codes for r in back.collect()} == dict(enumerate(codes))


def test_widths_outside_are_refused():
    for bits in (3, 8, 16):
        with pytest.raises(ValueError):
            bitpack.pack(F.lit(None), 8, bits)
    with pytest.raises(ValueError):
        planning.plan_codec(64, 32, 10)
    with pytest.raises(ValueError):
        planning.plan_codec(64, 32, 64, n_clusters=40000)


def test_mean_of_neighbours_counts_parallel_edges_and_isolated(spark):
    edges = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (2, 2), (2, 2), (2, 0)], "dst long, src long")
    f = {0: [1.0, 2.0], 1: [3.0, 5.0], 2: [7.0, 11.0]}
    features = spark.createDataFrame(list(f.items()), "node_id long, feat array<double>")
    dsts = spark.createDataFrame([(i,) for i in range(4)], "dst long")
    for wide in (aggregate.WIDE, 1):
        aggregate.WIDE, was = wide, aggregate.WIDE
        try:
            got = {r.dst: r.feat for r in aggregate.spmm_mean(edges, features, 2, dsts).collect()}
        finally:
            aggregate.WIDE = was
        assert got[0] == f[0] and got[1] == f[1] and got[3] == [0.0, 0.0]
        assert got[2] == pytest.approx([5.0, 8.0])


def test_fused_equals_plain(spark, features):
    _, df = features
    edges = spark.createDataFrame([(i % 5, (i * 7) % 40) for i in range(90)], "dst long, src long")
    book = sq.codebook(df, 8)
    for bits in planning.CODE_BITS:
        codes = sq.encode(df, book, bits)
        plain = vec.to_long(aggregate.spmm_mean(edges, sq.decode(codes, book, bits), 11), key="dst")
        packed = codes.select("node_id", (bitpack.pack(F.col("codes"), 11, bits) if bits < 8 else F.col("codes")).alias("packed"))
        for wide in (256, 1):
            aggregate.WIDE, was = wide, aggregate.WIDE
            try:
                fused = vec.to_long(aggregate.spmm_sq(edges, packed, book, bits, 11), key="dst").cache()
                assert model.errors(plain, fused, ["dst", "j"]).first().max_err < 1e-12 and fused.count() == plain.count()
            finally:
                aggregate.WIDE = was
        assert model.errors(plain, fused, ["dst", "j"]).first().max_err < 1e-12
    centers = vq.codebook(df, 4, 5, max_iter=3)
    codes = vq.encode(df, centers, 4)
    plain = vec.to_long(aggregate.spmm_mean(edges, vq.decode(codes, centers, 11), 11), key="dst")
    assert model.errors(plain, aggregate.spmm_vq(edges, codes, centers, 11, 4), ["dst", "j"]).first().max_err < 1e-12


def test_clusters_empty_ties_and_zero_vectors(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0])], "node_id long, cb int, v array<double>")
    centers = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [3.0, 0.0]), (0, 2, [0.0, -1.0])], "cb int, code int, center array<double>")
    got = {r.node_id: (r.code, r.d) for r in kmeans.assign(rows, centers).collect()}
    assert got[1] == (0, 0.0) and got[2] == (0, 0.0) and got[0] == (0, 1.0)
    moved = {r.code: r.center for r in kmeans.lloyd_step(rows, centers).collect()}
    assert moved[0] == [1.0, 0.0] and moved[1] == [3.0, 0.0] and moved[2] == [0.0, -1.0]
    assert kmeans.circle_centers(spark, 3, 5, 2).count() == 6


def test_circle_centers_by_dimension(spark):
    """Cosines first, then sines of the same angles; an odd dimension has one sine more and scales all components."""
    for r in kmeans.circle_centers(spark, 5, 6, 2).collect():
        assert np.allclose(np.square(r.center[:3]) + np.square(r.center[3:]), 1)
    norms = set()
    for r in kmeans.circle_centers(spark, 5, 5, 1).collect():
        sums = np.square(r.center[:2]) + np.square(r.center[2:4])
        assert np.allclose(sums, sums[0]) and sums[0] < 1 and r.center[4] ** 2 <= sums[0] + 1e-12
        norms.add(round(sums[0], 9))
    assert len(norms) == 5


def test_starts_and_odd_codebooks(spark, features):
    _, df = features
    points = kmeans.points(df, 11, 4)
    fit = kmeans.KMeans(3, "l2", max_iter=5, n_init=2).fit(points)
    assert fit.get_centers().count() == 9 and fit.inertia_ > 0 and 1 <= fit.n_iter_ <= 5
    assert kmeans.KMeans(3, max_iter=2).fit(points).get_centers().count() == 9
    with pytest.raises(ValueError, match="no numbers"):
        vq.sound(spark.createDataFrame([(0, 0, [1.0, float("nan")])], "cb int, code int, center array<double>"))
    assert (vq.code_type(256), vq.code_type(32767), vq.code_type(40000)) == ("smallint", "smallint", "int")


def test_learned_codebook_against_a_twin(spark):
    """Sample, rim, iterations to the growing tolerance and even length, again in numpy from the same first centers."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, feat array<double>").repartition(3)
    got = {(r.cb, r.code): np.array(r.center) for r in vq.codebook(df, 2, 3, tol=1e-2).collect()}
    data, centers = {}, {}
    for cb in (0, 1):
        own = x[:, 2 * cb : 2 * cb + 2]
        norms = np.linalg.norm(own, axis=1)
        ids = np.flatnonzero(norms >= np.quantile(norms, 0.00625 * 2 / 8))
        points = spark.createDataFrame([(int(i), cb, [float(v) for v in own[i]]) for i in ids], "node_id long, cb int, v array<double>")
        data[cb], centers[cb] = own[ids], np.array([r.center for r in kmeans.initial_centers(points, 3, "vq").orderBy("code").collect()])
    tol, settled = 1e-2, False
    while not settled:
        moved = 0.0
        for cb, rows in data.items():
            c = centers[cb]
            code = (1 - (rows @ c.T) / (np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(c, axis=1))).argmin(axis=1)
            centers[cb] = np.array([rows[code == k].mean(axis=0) if (code == k).any() else c[k] for k in range(3)])
            moved = max(moved, np.linalg.norm(centers[cb] - c, axis=1).sum() ** 2)
        settled, tol = moved < tol, tol * 1.2
    for cb, c in centers.items():
        want = c / np.linalg.norm(c, axis=1)[:, None] * np.linalg.norm(c, axis=1).mean()
        assert np.allclose(np.array([got[cb, k] for k in range(3)]), want)


def test_caches_share_a_capacity(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))], "dst long, src long").distinct()
    seeds = sampling.batches(sampling.positions(spark.range(0, 40, 4).withColumnRenamed("id", "node_id"), ["node_id"]), 4)
    blocks = sampling.khop(seeds, edges, [3, 2])
    small = caching.create_caches(seeds, edges, blocks, 2000, 8, 2, 64, 16)
    assert set(small) == {"graph", "features", "seeds"}
    assert small["graph"].agg(F.sum("size")).first()[0] + 74 * small["features"].count() <= 2100
    whole = caching.create_caches(seeds, edges, blocks, 10**7, 8, 2, 64)
    hot = caching.presample(seeds, blocks)
    assert whole["features"].count() == hot.where("feature_h > 0").count()
    assert whole["graph"].count() == hot.where("sampling_h > 0").join(graph.in_degree(edges), "node_id").count()
    kept = caching.cached_edges(edges, small["graph"])
    nodes = {r.node_id for r in small["graph"].collect()}
    assert {tuple(r) for r in kept.collect()} == {(r.dst, r.src) for r in edges.collect() if r.dst in nodes}


def test_a_graph_that_fits_is_cached_whole(spark):
    hot = spark.createDataFrame([(i, 9 - i) for i in range(10)], "node_id long, h long")
    deg = spark.createDataFrame([(i, 2) for i in range(10)], "node_id long, deg long")
    assert caching.graph_cache(hot, deg, 8, 248).count() == 10  # 10 * (16 + 8) + 8 bytes, though entries with overhead take 340
    assert caching.graph_cache(hot, deg, 8, 247).count() == 7


def test_caches_at_their_limits(spark):
    hot = spark.createDataFrame([(i, i % 7) for i in range(30)], "node_id long, h long")
    assert caching.feature_cache(hot, 8, 0).count() == 0
    assert caching.feature_cache(hot, 8, 10_000).count() == 30
    assert [r.h for r in caching.feature_cache(hot, 8, 72).orderBy(F.desc("h")).collect()] == [6, 6, 6, 6]
    assert planning.allocate(0, [1.0], [5.0]) == [0]


def test_prefix_sums_and_positions(spark):
    rows = spark.createDataFrame([(i, (i * 13) % 17) for i in range(200)], "node_id long, deg long").repartition(5)
    got = {r.node_id: r.end for r in graph.prefix_sum(rows, ["node_id"], "deg", "end").collect()}
    total = 0
    for i in range(200):
        total += (i * 13) % 17
        assert got[i] == total
    placed = sampling.positions(rows, [F.desc("deg"), F.asc("node_id")]).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(200))
    assert [(r.deg, r.node_id) for r in placed] == sorted(((r.deg, r.node_id) for r in placed), key=lambda x: (-x[0], x[1]))


def test_samples_never_exceed_what_there_is(spark):
    few = spark.createDataFrame([(i, 1.0 if i else 0.0) for i in range(5)], "node_id long, h double")
    assert sampling.uniform(few, 9).count() == 5
    assert sorted(r.node_id for r in sampling.weighted(few, 9).collect()) == [1, 2, 3, 4]
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "dst long, src long")
    assert sampling.neighbours(edges, 5).count() == 3
    assert sampling.neighbours_replaced(edges, 4).count() == 8


def test_sources_and_stream(spark, tmp_path, features):
    _, df = features
    (tmp_path / "e.tsv").write_text("# a\n# b\n# c\n# d\n1\t2\n3\t4\n")
    assert sorted(map(tuple, tables.read_edge_list(spark, str(tmp_path / "e.tsv")).collect())) == [(2, 1), (4, 3)]
    tables.write_dataset({"features": df, "ids": df.select("node_id")}, str(tmp_path / "set"))
    back = tables.read_dataset(spark, str(tmp_path / "set"), without=("ids",))
    assert list(back) == ["features"] and back["features"].count() == 40
    with pytest.raises(ValueError):
        tables.check_schema(df, {"node_id": "int"})
    assert tables.synthetic(spark, 20, 4, 42).where("size(feat) = 4 and label between 0 and 41").count() == 20
    book = sq.codebook(df, 6)
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "set" / "features.parquet"))
    stream.write_codes(stream.encode_stream(source, book, 4), str(tmp_path / "codes"), str(tmp_path / "ck")).awaitTermination()
    once = sorted(map(repr, spark.read.parquet(str(tmp_path / "codes")).collect()))
    assert once == sorted(map(repr, sq.encode(df, book, 4).collect()))


def test_edge_lists_skip_lines_and_partitions_open(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("0\t0\n9\t9\n" + "".join(f"{i}\t{i + 1}\n" for i in range(50)) + "\n")
    edges = tables.read_edge_list(spark, str(tmp_path / "e.tsv"), skip=2)
    assert sorted(map(tuple, edges.collect())) == [(i + 1, i) for i in range(50)]
    tables.write_partitioned_edges(edges, str(tmp_path / "g"), 3)
    whole, bounds = tables.open_partitioned_edges(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, whole.collect())) == [(i + 1, i) for i in range(50)]
    ranges = {r["rank"]: (r["lo"], r["hi"]) for r in bounds.collect()}
    for rank, (lo, hi) in ranges.items():
        own = tables.open_partitioned_edges(spark, str(tmp_path / "g"), rank)[0]
        assert {r.dst for r in own.collect()} == {i for i in range(1, 51) if lo <= i < hi}
    assert sorted(r.node_id for r in graph.local_ids(spark.createDataFrame([(3,), (3,), (70,)], "node_id long"), spark.range(9).withColumnRenamed("id", "node_id")).collect()) == [3]


def test_codecs_come_back_as_they_were_stored(spark, features, tmp_path):
    x, df = features
    for name, given in (("sq", {"ratio": 8}), ("wide", {"ratio": 2}), ("byte", {"ratio": 4}), ("two", {"ratio": 64, "n_clusters": 4, "seeds": df.where("node_id < 7"), "max_iter": 2})):
        made = codec.compress(df, 32, given.pop("ratio"), **given)
        codec.write(made, str(tmp_path / name), parts=3)
        back = codec.read(spark, str(tmp_path / name))
        assert [v.plan for v in back.levels] == [v.plan for v in made.levels] and back.dim == 11
        got = {r.node_id: r.feat for r in back.features(df).collect()}
        want = {r.node_id: r.feat for r in made.features(df).collect()}
        assert len(got) == 40 and all(got[i] == pytest.approx(want[i]) for i in got)
        if name == "two":
            fine = {r.node_id: r.feat for r in back.decode(0).collect()}
            assert len(fine) == 7 and all(got[i] == fine[i] for i in fine)


def test_seed_sets_uniques_and_epoch_means(spark):
    ids = spark.range(10, 33).withColumnRenamed("id", "node_id")
    for rank, size in ((0, 12), (1, 11)):
        own, n = sampling.swap_seeds(ids, 5, ranks=2, rank=rank)
        assert own.count() == size and n == 3 and own.agg(F.max("batch_id")).first()[0] == 2
        assert sampling.swap_seeds(ids, 5, 2, rank, drop_last=True)[1] == 2
    distinct, inverse = sampling.unique_inverse(spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, 9)], "node_id long, v long"), "v")
    assert sorted(map(tuple, distinct.select("v", "at", "n").collect())) == [(3, 0, 1), (5, 1, 2), (9, 2, 1)]
    assert dict(map(tuple, inverse.collect())) == {0: 1, 1: 0, 2: 1, 3: 2}
    epochs = spark.createDataFrame([(e, 0.1 * e, 10.0 + e) for e in range(8)], "epoch int, accuracy double, t double")
    row = graph.epoch_means(epochs, ["t"]).first()
    assert row.t == pytest.approx(14.0) and row.accuracy == pytest.approx(0.5)
    counts = spark.createDataFrame([(e, r, 100 * (e == 0) + r, 2 * r) for e in range(3) for r in range(2)], "epoch int, rank int, remote_seeds long, remote_neighbours long")
    assert tuple(graph.remote_totals(counts).first()) == (1.0, 2.0)


def test_attention_stack_against_a_twin(spark):
    """One batch: a mean layer of two heads, an attention layer of two heads, an attention layer of one."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (12, 3))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in {tuple(v) for v in rng.integers(0, 12, (40, 2)).tolist()}], "dst long, src long")
    features = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, feat array<double>")
    seeds = sampling.batches(sampling.positions(spark.createDataFrame([(2,), (7,)], "node_id long"), ["node_id"]), 4)
    blocks, nodes = sampling.loader(seeds, edges, features, [3, 3, 2])
    table = {r.local_id: r for r in nodes.collect()}
    local = [[(r.dst, r.src) for r in b.collect()] for b in blocks]
    weights = lambda *shape: rng.normal(0, 0.5, shape)
    own, neigh, b0 = weights(4, 3), weights(4, 3), weights(4)
    later = [(weights(o, i), weights(o), weights(o), weights(o, i), weights(o)) for o, i in ((6, 4), (3, 6))]
    first = spark.createDataFrame([(o, own[o].tolist(), neigh[o].tolist(), float(b0[o])) for o in range(4)], "o int, own array<double>, neigh array<double>, b double")
    tables_ = [spark.createDataFrame([(o, w[o].tolist(), float(t[o]), float(a[o]), rest[o].tolist(), float(b[o])) for o in range(len(w))], "o int, w array<double>, to double, at double, rest array<double>, b double") for w, t, a, rest, b in later]
    got = {r.local_id: r.feat for r in model.gat_stack(blocks, nodes, first, tables_, 3, [2, 2, 1], [2, 3, 3]).collect()}
    elu = lambda v: np.where(v > 0, v, np.exp(np.minimum(v, 0)) - 1)
    h = {i: np.array(r.feat) for i, r in table.items()}
    means = {d: np.mean([h[s] for dd, s in local[2] if dd == d], axis=0) if any(dd == d for dd, _ in local[2]) else np.zeros(3) for d, r in table.items() if r.hop <= 2}
    h = {d: elu(own @ h[d] + neigh @ m + b0) for d, m in means.items()}
    for hop, (w, to, at, rest, b), heads in ((1, later[0], 2), (0, later[1], 1)):
        z, new = {i: w @ v for i, v in h.items()}, {}
        for d in (i for i, r in table.items() if r.hop <= hop):
            near = [s for dd, s in local[hop] if dd == d]
            seen = np.zeros(len(w))
            for head in range(heads):
                part = slice(head * 3, head * 3 + 3)
                e = np.array([z[s][part] @ to[part] + z[d][part] @ at[part] for s in near])
                p = np.exp(np.where(e > 0, e, 0.2 * e))
                if near:
                    seen[part] = sum(a * z[s][part] for a, s in zip(p / p.sum(), near, strict=True))
            new[d] = seen + rest @ h[d] + b
        h = {d: elu(v) if hop else v for d, v in new.items()}
    assert set(got) == set(h) == {0, 1} and all(np.allclose(got[i], h[i]) for i in got)
    assert spark.range(1).select(model.head_mean(F.array(*map(F.lit, [1.0, 2.0, 3.0, 6.0])), 2, 2).alias("m")).first().m == [2.0, 4.0]


def test_attention_and_accuracy(spark):
    scores = spark.createDataFrame([(0, 1, 900.0), (0, 2, 900.0), (1, 1, -5.0)], "dst long, src long, e double")
    assert {(r.dst, r.src): r.a for r in model.edge_softmax(scores).collect()} == {(0, 1): 0.5, (0, 2): 0.5, (1, 1): 1.0}
    y = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 2.0)], "node_id long, o int, y double")
    assert {r.node_id: r.pred for r in model.predict(y).collect()} == {0: 0, 1: 1}
