import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklore.functions import bits
from ranklore.functions import vectors as V
from ranklore.operators import centroids as C
from ranklore.operators import evaluation as E
from ranklore.operators import graphs as G
from ranklore.operators import indexes as IX
from ranklore.operators import search as S
from ranklore.operators import selection as SN
from ranklore.operators import selector as SEL
from ranklore.operators import transforms as TR
from ranklore.operators import vector_hash as VH
from ranklore.sources import reports as RP


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).normal(size=(200, 8))
    return x, frame(spark, x).cache()


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_block_form_equals_column_form(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.uniform(0.05, 1, (6, 5))
    if metric == "nan_euclidean":
        x[1, 2] = np.nan
    df = frame(spark, x)
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "left_id bigint, right_id bigint")
    block = V.METRICS[metric].block(x, x)
    for r in S.distances_by_pairs(pairs, df, df, metric).collect():
        assert r["distance"] == pytest.approx(block[r["left_id"], r["right_id"]], rel=1e-12, abs=1e-12)


def test_knn_and_range(spark, cloud):
    x, df = cloud
    d = ((x[:20, None] - x[None]) ** 2).sum(-1)
    found = {}
    for r in S.knn(df.filter("vec_id < 20"), df, 5, exclude_self=True).collect():
        found.setdefault(r["query_id"], {})[r["nn_rank"]] = r["base_id"]
    for q in range(20):
        order = [int(i) for i in np.argsort(d[q], kind="stable") if i != q][:5]
        assert [found[q][k] for k in range(1, 6)] == order
    assert S.range_search(df.filter("vec_id < 20"), df, 4.0).count() == (d < 4.0).sum()
    assert S.knn(df.limit(0), df, 3).count() == 0
    with pytest.raises(ValueError):
        S.knn(df, df, 0)


def test_lower_bound_and_selectors(spark):
    base = spark.createDataFrame([(0, 5), (1, 7), (2, 7), (3, 9)], "id bigint, h bigint")
    q = spark.createDataFrame([(10, 4), (11, 7), (12, 8), (13, 99)], "id bigint, h bigint")
    got = {r["query_id"]: r["pos"] for r in S.lower_bound_positions(base, q, "h", "id", "id").collect()}
    assert got == {10: 0, 11: 1, 12: 3, 13: 3}
    ids = spark.range(20)
    assert [r[0] for r in ids.filter(S.ids_in_bitmap("id", bytes([0b101, 1]))).collect()] == [0, 2, 8]
    assert [r[0] for r in ids.filter(S.ids_xor(S.ids_between("id", 0, 3), S.ids_in("id", [2, 5]))).collect()] == [0, 1, 5]


def test_bits(spark):
    df = spark.createDataFrame([([float(x) for x in np.where(np.arange(70) % 3 == 0, -1, 1)],)], "v array<double>")
    words = bits.sign_words(F.col("v"), 70)
    row = df.select(words.alias("w"), bits.to_signs(words, 70).alias("s"), bits.hamming(words, words).alias("h")).first()
    assert row["s"] == [-1.0 if i % 3 == 0 else 1.0 for i in range(70)] and row["h"] == 0 and len(row["w"]) == 2
    packed = spark.createDataFrame([([3, 0, 15, 9],)], "c array<int>").select(bits.pack_codes(F.col("c"), 4, 4).alias("p"))
    assert packed.select(bits.unpack_codes(F.col("p"), 4, 4)).first()[0] == [3, 0, 15, 9]


def test_router_and_kmeans(spark, cloud):
    c = np.array([[0.0, 0], [1, 0], [0, 1]])
    assert C.assign(frame(spark, [[0.9, 0.1]]), c).first()["centroid_id"] == 1
    assert C.assign(frame(spark, [[0.5, 0.0]]), c).first()["centroid_id"] == 0  # ties go to the lower id
    two = frame(spark, np.concatenate([np.zeros((4, 2)), np.full((4, 2), 10.0)]) + np.arange(8)[:, None] * 0.01)
    centroids, objectives = C.kmeans(two, 2, 10)
    assert sorted(np.round(centroids[:, 0]).tolist()) == [0.0, 10.0] and objectives == sorted(objectives, reverse=True)
    assert C.mass(C.assign(two, centroids)).agg(F.sum("mass")).first()[0] == 8
    with pytest.raises(ValueError):
        C.kmeans(two, 9)
    with pytest.raises(ValueError):
        C.kmeans(frame(spark, [[float("nan")], [1.0]]), 1)
    assert C.split_empty(np.array([[1.0, 1], [5, 5]]), np.array([10, 0])).shape == (2, 2)
    assert C.kmeans_1d(np.array([1, 1.1, 5, 5.1, 9]), 3).round(2).tolist() == [1.05, 5.05, 9.0]
    assert len(C.plus_plus_init(cloud[1], 3)) == 3


def test_ranges(spark):
    r = C.allocate_ranges([10, 20, 30], [0, 1, 2], 32)
    assert sum(x.size for x in r) == 2**32 and r[1].start == r[0].size and r[2].start == r[0].size + r[1].size
    assert C.allocate_ranges([100], [0], 256)[0].full
    for masses, order in (([1, 2], [0, 0]), ([1, 2], [0, 2]), ([0, 0], [0, 1]), ([2**63, 2**63], [0, 1])):
        with pytest.raises(ValueError):
            C.allocate_ranges(masses, order, 32)
    df = spark.createDataFrame([(i, m, o) for i, (m, o) in enumerate([(7, 2), (11, 0), (13, 1)])], "centroid_id bigint, mass bigint, ord bigint")
    told = {x["centroid_id"]: (int(x["range_start"]), int(x["range_size"])) for x in C.ranges_frame(df, 64).collect()}
    assert told == {i: (x.start, x.size) for i, x in enumerate(C.allocate_ranges([7, 11, 13], [1, 2, 0], 64))}


def test_order_pivots_affinity(spark, cloud):
    x, df = cloud
    order = C.centroid_order(x[:40], 4, 8)
    assert sorted(order) == list(range(40))
    apart = np.array([[0.0, 0], [0, 0.1], [50, 0], [50, 0.1]])
    assert {tuple(sorted(C.centroid_order(apart, 1)[:2])), tuple(sorted(C.centroid_order(apart, 1)[2:]))} == {(0, 1), (2, 3)}
    ids, table = C.pivots(x[:40], 5)
    assert len(ids) == 5
    for q in x[50:60]:
        best, d, _ = C.pruned_nearest(q, x[:40], ids, table)
        exact = ((x[:40] - q) ** 2).sum(1)
        assert best == exact.argmin() and d == pytest.approx(exact.min())
    four = frame(spark, [[0, 0], [0.1, 0], [10, 0], [10.1, 0]])
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 3), (3, 1), (3, 2)], "src bigint, dst bigint")
    got = C.graph_affinity(edges, C.assign(four, np.array([[0.0, 0], [10, 0]]))).collect()
    assert {(r["from_id"], r["to_id"], r["count"], r["weight"]) for r in got} == {(0, 1, 4, 1.0), (1, 0, 4, 1.0)}
    model = VH.fit_vector_hash(four, 2, 32, graph=edges, centroids=np.array([[0.0, 0], [10, 0]]), leaves=2)
    assert sum(r.size for r in model.ranges) == 2**32


def golden(bits=64):
    leaf = [[[0.0, 1.0], [0.0, 1.0]]] * 3
    ranges = [C.Range(0, 1024), C.Range(1024, 2048), C.Range(4096, 4096)]
    return VH.VectorHash(bits, ["linear", "linear"], np.array([[0.0, 0], [2, 0], [0, 2]]), [0, 1, 2], [1, 2, 4], ranges, [0.0] * 3, [1.0] * 3, [2] * 3, [[0.0, 1.0]] * 3, leaf)


def test_golden_vector_model(spark):
    rows = golden().apply(frame(spark, [[0.5, 0], [2.5, 0], [0, 2.75]])).orderBy("vec_id").collect()
    assert [(r["centroid_id"], r["d2"], r["cdf"], int(r["hash"]), r["hash_hex"]) for r in rows] == [
        (0, 0.25, 0.25, 256, "0000000000000100"),
        (1, 0.25, 0.25, 1536, "0000000000000600"),
        (2, 0.5625, 0.5625, 6400, "0000000000001900"),
    ]


def test_full_256_bit_owner(spark):
    one = VH.VectorHash(256, ["linear", "linear"], np.array([[0.0, 0]]), [0], [1], [C.Range(0, 0, True)], [0.0], [1.0], [2], [[0.0, 0.0]], [[[0.0, 0.0]]])
    row = one.apply(frame(spark, [[0.5, 0]])).first()
    assert int(row["hash_hex"][:16], 16) == int(0.25 * 2**64)


def test_training_policies(spark, cloud):
    x, df = cloud
    eight = frame(spark, np.concatenate([np.zeros((4, 2)), np.full((4, 2), 10.0)]) + np.arange(8)[:, None] * 0.01)
    some = spark.createDataFrame([(i,) for i in (0, 1, 4, 5)], "vec_id bigint")
    for kw, total in (({}, 8), ({"sample_limit": 6}, 6), ({"assignment": "skeleton"}, 4)):
        model = VH.fit_vector_hash(eight, 2, 32, skeleton=some, leaves=2, iterations=3, **kw)
        assert sum(model.masses) == total
    flat = VH.fit_vector_hash(frame(spark, np.zeros((64, 4))), 1, 32)
    assert flat.apply(frame(spark, np.zeros((2, 4)))).filter(F.col("hash") >= 2**32).isEmpty()
    model = VH.fit_vector_hash(df, 8, 64, leaves=8, iterations=4)
    again = VH.fit_vector_hash(df, 8, 64, leaves=8, iterations=4)
    assert model.order == again.order and model.ranges == again.ranges and sorted(model.order) == list(range(8))
    hashed = model.apply(df).select("vec_id", "centroid_id", "hash").collect()
    for r in hashed:
        own = model.ranges[r["centroid_id"]]
        assert own.start <= int(r["hash"]) < own.start + own.size


def test_evaluation_shares(spark, cloud):
    x, df = cloud
    model = VH.fit_vector_hash(df, 4, 32, leaves=4, iterations=3)
    base = model.apply(df).select("vec_id", F.col("hash").cast("bigint").alias("hash"))
    truth = S.knn(df.filter("vec_id < 30"), df, 5, exclude_self=True)
    row = E.evaluate(base, base.filter("vec_id < 30"), truth, 32, [5, 199], [16, 32]).first().asDict()
    assert all(0.0 <= v <= 1.0 for v in row.values())
    ladder = E.recall_by_window(E.neighbour_table(base, base.filter("vec_id < 30"), truth), [5, 50, 199]).orderBy("window").collect()
    assert [r["recall"] for r in ladder] == sorted(r["recall"] for r in ladder) and ladder[-1]["recall"] == 1.0


@pytest.mark.parametrize(
    ("text", "floor"),
    [("Flat", 1.0), ("SQ8", 0.9), ("SQ6", 0.8), ("SQ4", 0.5), ("SQfp16", 0.95), ("SQbf16", 0.9), ("MinMax", 0.9), ("PQ4x6", 0.5), ("RQ6x5", 0.5), ("LSQ3x5", 0.35),
     ("PRQ2x3x5", 0.5), ("PLSQ2x2x5", 0.4), ("RaBitQ", 0.3), ("ZnLattice30", 0.5), ("PCA8,Flat", 1.0), ("RR8,SQ8", 0.9), ("OPQ4,PQ4x6", 0.5), ("IVF4,Flat", 0.7),
     ("IVF4r,SQ8", 0.7), ("Refine(PQ4x6)", 0.9), ("HNSW8", 0.9), ("NSG8", 0.9)],
)
def test_index_recall(spark, cloud, text, floor):
    x, df = cloud
    q = df.filter("vec_id % 8 = 0")
    index = IX.index_factory(text).fit(df).add(df)
    found = (index.search(q, 5, probes=2) if text.startswith("IVF") else index.search(q, 5)).select("query_id", "base_id")
    truth = S.knn(q, df, 5).select("query_id", "base_id")
    assert found.join(truth, ["query_id", "base_id"]).count() / truth.count() >= floor


def test_factory_errors():
    for bad in ("", "PQ", "HNSW8,Flat", "PCA8", "what"):
        with pytest.raises(ValueError):
            IX.index_factory(bad)


def test_maps_shards_and_windows(spark, cloud):
    x, df = cloud
    q = df.filter("vec_id < 5")
    exact = {(r["query_id"], r["base_id"]) for r in S.knn(q, df, 3).collect()}
    halves = [IX.index_factory("Flat").fit(df).add(df.filter(F.col("vec_id") % 2 == i)) for i in (0, 1)]
    assert {(r["query_id"], r["base_id"]) for r in IX.Shards(halves).search(q, 3).collect()} == exact
    whole = IX.index_factory("Flat").fit(df).add(df)
    assert {(r["query_id"], r["base_id"]) for r in IX.Shards([whole, whole], replicas=True).search(q, 3).collect()} == exact
    names = spark.range(200).select(F.col("id").alias("vec_id"), (F.col("id") * 10).alias("external_id"))
    assert all(r["external_id"] == r["base_id"] * 10 for r in IX.IdMap(whole, names).search(q, 3).collect())
    assert whole.decode().count() == 200 and whole.size_bytes() == 200 * 40
    points = IX.explore(whole, q, S.knn(q, df, 3), 3, {"probes": [1]})
    assert points[0][1] == 1.0
    assert IX.operating_points([("a", 0.5, 1.0), ("b", 0.4, 2.0), ("c", 0.9, 3.0)]) == [("a", 0.5, 1.0), ("c", 0.9, 3.0)]


def test_transforms(spark, cloud):
    x, df = cloud
    pca = TR.Pca(8).fit(df)
    y = pca.apply(x)
    assert np.allclose(pca.reverse(y), x) and np.allclose(np.cov(y.T, bias=True), np.diag(np.var(y, 0)), atol=1e-9)
    assert np.allclose(TR.Center().fit(df).apply(x).mean(0), 0)
    assert np.allclose(np.linalg.norm(TR.Normalize().apply(x), axis=1), 1)
    remap = TR.Remap([3, -1, 0])
    assert np.allclose(remap.apply(x)[:, [0, 2]], x[:, [3, 0]]) and not remap.apply(x)[:, 1].any()
    for t in (TR.Itq(5), TR.Opq(4, 4, 2), TR.RandomRotation(8)):
        m = t.fit(df).matrix
        assert np.allclose(m @ m.T, np.eye(8), atol=1e-9)
    assert np.allclose(TR.Chain([TR.Center(), TR.Pca(4)]).fit(df).transform(df).first()["embedding"], TR.Pca(4).fit(df).apply(x)[0])


def test_graph_parts(spark, cloud):
    x, df = cloud
    near = G.nn_descent(x, 8)
    exact = G.knn_lists(x, 8)
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(near.tolist(), exact.tolist(), strict=True)]) > 0.9
    nodes, edges = G.skeleton(df, 4, 40)
    ids = {r["vec_id"] for r in nodes.collect()}
    assert len(ids) >= 40 and all(r["src"] in ids and r["dst"] in ids for r in edges.collect())
    assert G.restricted(edges, nodes.limit(0)).count() == 0
    sharded = G.GraphIndex(8, shard_rows=80).add(df)
    q = df.filter("vec_id < 20")
    hits = sharded.search(q, 5).select("query_id", "base_id").join(S.knn(q, df, 5).select("query_id", "base_id"), ["query_id", "base_id"]).count()
    assert sharded.table.count() > 1 and hits >= 90


def test_selector_tables():
    assert SEL.default_k_values(10_000, 10_000, True) == [32, 64, 128, 256]
    assert SEL.default_k_values(1_000_000, 1_000_000, True)[-1] == 24576
    assert SEL.default_k_values(5_000_000, 3_000_000, True)[-1] == 65536
    assert SEL.default_k_values(10**9, 30_000_000, True)[-1] == 262144
    assert SEL.default_k_values(1_000_000, 1_000_000, False)[-1] == 8192
    assert SEL.time_budget("balanced", 1_000_000) == 600 and SEL.time_budget("balanced", 10_000_000) == 1200
    assert SEL.time_budget("balanced", 10_000_000, True) == 2400
    assert SEL.train_budget("balanced", 10_000_000, 4) == 224 and SEL.train_budget("balanced", 10_000_000, 4, True) == 448
    assert SEL.assignment_sample_limit(5_000_000, True) == 3_000_000 and SEL.assignment_sample_limit(100) == 0
    assert SEL.skeleton_targets(10_000) == [2000, 5000, 10000]
    with pytest.raises(ValueError):
        SEL.skeleton_targets(0)
    options = SEL.resolved(SEL.Options(for_recall=True), 10_000, 10_000)
    tried = SEL.phase_one(options, 10_000, 10_000)
    assert len(tried) == len(set(tried)) and all(c.knn < c.k for c in tried)
    assert SEL.capacity_values([2, 4, 8, 16, 32], 10, 0.3, 2, 8) == [2, 4, 8]


def test_selector_scores():
    def m(q, t, s, ok=True):
        return SEL.Metrics(SEL.Config(2, 1), ok, q, q, q, 0.1, t, s)

    a, b, c, bad = m(0.9, 5.0, 100), m(0.89, 1.0, 50), m(0.5, 9.0, 900), m(1.0, 0.1, 1, ok=False)
    everything = [a, b, c, bad]
    SEL.assign_objectives(everything, SEL.Weights())
    assert bad.objective == -1.0 and b.objective > c.objective
    assert SEL.front(everything) == [a, b] and SEL.dominates(b, c) and not SEL.dominates(a, b)
    got = SEL.roles(everything)
    assert got["peak_recall"] is a and got["fast"] is b and got["small"] is b and got["knee"] is b
    assert SEL.roles(everything, budget=10)["peak_recall"] is a
    assert SEL.ranked(everything, 2) == [a, b] and SEL.ranked(everything, 5, budget=60) == [b]
    assert SEL.validated([a, m(1.5, 1, 1)]) == [a]


def test_selection_policies():
    assert [SN.effective_profile("auto", n) for n in (10, 500_000, 3_000_000)] == ["exhaustive", "balanced", "fast"]
    with pytest.raises(ValueError):
        SN.effective_profile("quick", 10)
    assert SN.effective_weights(SEL.Options(), 600_000).recall == 0.75 and SN.effective_weights(SEL.Options(for_recall=True), 10).recall == 0.88
    own = SEL.Weights(recall=0.5)
    assert SN.effective_weights(SEL.Options(weights=own), 10**7) is own
    assert SN.evenly_spaced(9, 3) == [0, 4, 8] and SN.evenly_spaced(2, 5) == [0, 1]
    assert SN.effective_budget("deep", 10, 10**7) == 3600 and SN.effective_budget("smoke", 99, 10) == 99

    def context(target, score):
        made = SN.Context((target,), target, None, None)
        return made, score

    def chosen(scores, keep):
        held = [context((i + 1) * 10, s) for i, s in enumerate(scores)]
        table = {id(c): s for c, s in held}
        probe = lambda c: SEL.Metrics(SEL.Config(2, 1), table[id(c)] is not None, table[id(c)] or 0.0)
        return [c.target for c in SN.choose_contexts([c for c, _ in held], keep, probe)]

    assert chosen([0.1, 0.9, 0.3, 0.2], None) == [10, 20, 30, 40]
    assert chosen([0.1, 0.9, 0.3, 0.2], 1) in ([20], [30])  # of the probed ones
    assert set(chosen([0.1, 0.2, 0.9, 0.3, 0.2], 3)) >= {10, 50} and chosen([0.1, None, 0.9], 2) == [30, 10]


def test_selection_seeds():
    def m(q, recall, t=1.0, s=10, graph=False):
        return SEL.Metrics(SEL.Config(2, 1, graph_order=graph), True, q, recall, recall, 0.1, t, s)

    a, b = SN.Context((10,), 10, None, None), SN.Context((20,), 20, None, None)
    pool = [(a, m(0.9, 0.5)), (a, m(0.8, 0.9)), (b, m(0.3, 0.2)), (b, m(0.2, 0.1, 0.1, 1, True))]
    SEL.assign_objectives([x for _, x in pool], SEL.Weights())
    seeds = SN.calibration_seeds(pool, 3)
    assert [t[1] for t in seeds] == [pool[0][1], pool[2][1], pool[1][1]]
    roles = SN.role_seeds(pool, seeds, 10)
    assert roles[0] is pool[1] and len(roles) == 4 and SN.role_seeds(pool, seeds, 1) == [pool[1]]
    assert SN.recall_anchor([x for _, x in pool]) is pool[1][1] and SN.quality_anchor([x for _, x in pool]) is pool[0][1]
    told = SN.graph_order_evidence([x for _, x in pool])
    assert told["enabled"] == {"candidates": 1, "quality": 0.2, "recall": 0.1, "rank_distance": 0.1} and told["disabled"]["candidates"] == 3
    assert SN.quality_status([pool[0][1]], 0.4) == {"sound": True, "recall_reached": True, "ok": True}
    assert not SN.quality_status([m(float("nan"), 0.1)])["ok"] and not SN.quality_status([pool[2][1]], 0.4)["recall_reached"]


def test_whole_search_and_report(spark, cloud):
    x, df = cloud
    options = SEL.Options(bits=128, k_values=(4, 8), knn_values=(2,), branches=(4,), specs=("linear,linear",), two_opts=(2,), max_trains=3, rounds=1, iterations=2, node_counts=(8,), windows=(10, 50), for_recall=True, seconds=0)
    out = SN.search(df, df.filter("vec_id % 10 = 0"), options, targets=[20, 190], m=6, calibrate=2)
    assert set(out.roles) == set(SN.ROLES) and len(out.calibrated) == 2 and out.searched == out.contexts
    full, compact = out.as_dict(), out.as_dict(compact=True)
    assert full["version"] == 1 and "candidates" not in compact and set(RP.selection_tables(full)) == {"roles", "front", "calibrated", "candidates"}
    assert SN.quality_status([t[1] for t in out.calibrated])["sound"]


def test_option_checks_and_pools():
    assert SEL.checked_options(SEL.Options()).bits == 64
    for bad in ({"bits": 0}, {"bits": 300}, {"k_values": (0,)}, {"specs": ("linear",)}, {"recall_target": 1.5}, {"two_opts": (-1,)}, {"weights": SEL.Weights(0, 0, 0, 0, 0)}, {"kept": 0}):
        with pytest.raises(ValueError):
            SEL.checked_options(SEL.Options(**bad))
    held = [SEL.Metrics(SEL.Config(2, 1), True, q, r, r, d, t, s) for q, r, d, t, s in ((0.9, 0.1, 0.5, 9, 9), (0.1, 0.9, 0.5, 9, 9), (0.1, 0.1, 0.1, 9, 9), (0.1, 0.1, 0.5, 1, 9), (0.1, 0.1, 0.5, 9, 1), (0.2, 0.2, 0.4, 5, 5))]
    assert SEL.pooled(held, 1) == held[:5] and len(SEL.pooled(held, 6)) == 6


def test_scan_of_many_queries_holds_tiles_only():
    """All rows as queries: what a task holds does not grow with queries times the rows of a batch."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(12_000, 16)), rng.normal(size=(6000, 16))
    x[:3000] = q[:3000]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(list(x))], ["base_id", "embedding"])
    tracemalloc.start()
    found = [p.to_pydict() for p in S._scan(SimpleNamespace(value=(np.arange(12_000), q)), "l2", 5, None, True)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    got = {}
    for part in found:
        for i, j, d in zip(part["query_id"], part["base_id"], part["distance"], strict=True):
            got.setdefault(i, []).append((d, j))
    for i in range(0, 12_000, 1001):
        d = ((x - q[i]) ** 2).sum(1)
        assert sorted(got[i]) == sorted((float(d[j]), j) for j in range(6000) if j != i)[:5]


def test_bitmap_that_repeats(spark):
    e = spark.range(0, 40_000).withColumnRenamed("id", "vec_id")
    assert e.filter(S.ids_in_bitmap("vec_id", bytes([0b101]) * 2000, repeats=True)).count() == 10_000
    assert e.filter(S.ids_in_bitmap("vec_id", bytes([0b101]) * 2000)).count() == 4000


def test_id_selector_beyond_the_bitmap(spark, tmp_path):
    """Ids of more than 16 000 are chosen as well."""
    import __spark_entry__ as entry

    x = np.random.default_rng(9).normal(size=(400, 4))
    ids = np.arange(400) * 50
    rows = [(int(i), [float(t) for t in v], 0) for i, v in zip(ids, x, strict=True)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    chosen = [int(i) for i in ids if ((100 <= i < 300) != (i % 8 in (0, 2))) and i not in (100, 101)]
    x = x.astype(np.float32).astype(np.float64)
    for r in entry.queries()["id_selector_search"](spark, str(tmp_path)).filter("nn_rank = 10 and query_id >= 19000").collect():
        d = sorted((float(((x[i // 50] - x[r["query_id"] // 50]) ** 2).sum()), i) for i in chosen)
        assert r["base_id"] == d[9][1]


@pytest.fixture(scope="module")
def far_apart(spark, tmp_path_factory):
    """4000 vectors of 128 dimensions without neighbourhoods: settings that do on small tables do not here."""
    x = np.random.default_rng(11).normal(size=(4000, 128)).astype(np.float32)
    path = tmp_path_factory.mktemp("far")
    rows = [(i, [float(t) for t in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize(
    ("name", "narrow"),
    [
        ("index_hnsw", {"ef": 10}),
        ("index_hnsw_flat_progressive", {"ef": 10}),
        ("index_hnsw_sq", {"ef": 10}),
        ("index_ivf_lsq", {}),
        ("index_ivf_plsq", {}),
        ("index_ivf_plsq_fast", {}),
        ("index_ivf_pq_fast", {}),
        ("index_hnsw_pq", {"ef": 10}),
        ("index_hnsw_two_level", {"ef": 10}),
        ("index_ivf_lsq_fast", {}),
        ("index_ivf_pq", {}),
        ("index_ivf_pq_residual", {}),
        ("index_ivf_prq", {}),
    ],
)
def test_index_reaches_the_floor(spark, far_apart, name, narrow):
    """The settings given (a graph's walk: narrower ones) find less than the floor; the search widens them."""
    from ranklore.queries import indexes as QI

    text, settings = next((t, s) for n, t, s in QI.RECALL_SETTINGS if n == name)
    settings = settings | narrow
    e = spark.read.parquet(f"{far_apart}/embeddings.parquet")
    q = e.filter("vec_id % 100 = 0")
    index, truth = IX.index_factory(text).fit(e).add(e), S.knn(q, e, 10)
    assert IX.search_to_recall(index, q, truth, 10, 0.0, **settings)[2] < QI.FLOOR
    found, grown, recall = IX.search_to_recall(index, q, truth, 10, QI.FLOOR, **settings)
    assert recall >= QI.FLOOR and grown != settings and QI.recall_row(spark, e, found).first()["recall"] == pytest.approx(recall)
