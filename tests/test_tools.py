"""Caches, reports, materialisation, export, online statistics, storage of graphs and pivots."""

import io
import json
import math
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklore.functions import bits
from ranklore.functions import randoms as RN
from ranklore.operators import centroids as C
from ranklore.operators import codecs as Q
from ranklore.operators import export as EX
from ranklore.operators import graphs as G
from ranklore.operators import indexes as IX
from ranklore.operators import inverted_lists as IL
from ranklore.operators import learned as L
from ranklore.operators import search as S
from ranklore.operators import store as ST
from ranklore.operators import vector_hash as VH
from ranklore.sources import binary as B
from ranklore.sources import caches as CA
from ranklore.sources import materialise as MT
from ranklore.sources import models as MD
from ranklore.sources import reports as RP
from ranklore.sources import truth as T
from ranklore.streaming import online as ON


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).normal(size=(150, 8))
    return x, frame(spark, x).cache()


@pytest.mark.parametrize(
    "text",
    ["SQ8", "IVF4r,PQ4x4", "PCA4,Flat", "Refine3(IVF(RCQ2x2),SQ4)", "Dedup(Flat)", "HNSW6_SQ8", "IMI2x2,Flat", "IVF4,LSH32", "PRQ2x2x4fs", "RaBitQfs", "Panorama2", "2Layer4_PQ4x4", "SH16", "MinMaxFP16"],
)
def test_indexes_survive_storage(spark, cloud, tmp_path, text):
    _, df = cloud
    q = df.filter("vec_id < 6")
    index = IX.index_factory(text).fit(df).add(df)
    ST.save_index(index, f"file://{tmp_path}/ix", spark)
    kw = {"probes": 2} if "IVF" in text or "IMI" in text else {}
    again = ST.load_index(f"file://{tmp_path}/ix", spark)
    order = ["query_id", "nn_rank"]
    assert index.search(q, 4, **kw).orderBy(*order).collect() == again.search(q, 4, **kw).orderBy(*order).collect()


def test_storage_takes_listed_kinds_only(spark, tmp_path):
    with pytest.raises(TypeError):
        ST.to_state(object())
    with pytest.raises(ValueError):
        ST.from_state({"kind": "Popen", "state": {}})
    shards = IX.Shards([IX.index_factory("Flat").fit(frame(spark, np.eye(4))).add(frame(spark, np.eye(4)))])
    ST.save_index(shards, f"file://{tmp_path}/s", spark)
    assert len(ST.load_index(f"file://{tmp_path}/s", spark).indexes) == 1


def test_probes_read_their_folders_only(spark, cloud):
    _, df = cloud
    index = IX.index_factory("IVF6,Flat").fit(df).add(df)
    plan = index.probed([1, 4])._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_block" in plan or "PartitionFilters: [isnotnull(list_block" in plan
    sizes = {r["list_id"]: r["size"] for r in IL.list_sizes(index.table).collect()}
    assert index.probed([1, 4]).count() == sizes.get(1, 0) + sizes.get(4, 0)
    assert IL.lists_a_folder(5000) == 5 and IL.lists_a_folder(3) == 1


def test_progressive_search_is_exact(spark, cloud):
    x, df = cloud
    q = df.filter("vec_id < 12")
    order = ["query_id", "nn_rank"]
    for levels in (1, 3, 8, 50):
        told = IX.progressive_knn(q, df, 5, levels).orderBy(*order).select("query_id", "base_id").collect()
        assert told == S.knn(q, df, 5).orderBy(*order).select("query_id", "base_id").collect()
    assert IX.progressive_knn(q.limit(0), df, 3).count() == 0


def test_deduplicated_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(12)], "vec_id bigint, embedding array<double>")
    index = IX.index_factory("Dedup(Flat)").fit(df).add(df)
    assert index.index.table.count() == 3
    told = index.search(df.filter("vec_id = 4"), 6).orderBy("nn_rank").collect()
    assert [r["base_id"] for r in told] == [1, 4, 7, 10, 0, 2] and [r["distance"] for r in told] == [0, 0, 0, 0, 1, 1]


def test_binary_graph_and_edges(spark, cloud):
    _, df = cloud
    codes = df.select("vec_id", bits.sign_words(F.col("embedding"), 8).alias("code"))
    index = G.BinaryGraphIndex(8, 8).add(codes)
    told = index.search(codes.filter("vec_id < 5"), 3, ef=60).groupBy("query_id").agg(F.sum("distance").alias("d")).collect()
    x = (cloud[0] >= 0).astype(int)
    for r in told:
        assert r["d"] == np.sort(np.abs(x - x[r["query_id"]]).sum(1))[:3].sum()
    graph = G.GraphIndex(6).add(df)
    edges = graph.edges()
    assert edges.filter("src = dst").isEmpty() and edges.filter("depth = 0").select("src").distinct().count() == 150
    back = edges.filter("depth = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert edges.filter("depth = 0").select("src", "dst").join(back, ["src", "dst"]).count() > 100


def test_contexts_share_skeletons(spark, cloud):
    _, df = cloud
    told = G.contexts(df, 4, [1, 2, 140, 150, 150]).collect()
    assert sum(len(r["targets"]) for r in told) == 4 and len({r["fingerprint"] for r in told}) == len(told)
    assert any(set(r["targets"]) >= {140, 150} and r["nodes"] == 150 for r in told)


def test_csr_round_trip(spark, cloud, tmp_path):
    nodes = spark.range(6).withColumnRenamed("id", "vec_id")
    edges = spark.createDataFrame([(0, 1), (0, 4), (2, 0), (5, 5), (2, 0)], "src bigint, dst bigint")
    path = f"file://{tmp_path}/csr"
    G.write_csr(nodes, edges, path)
    back = G.read_csr(spark, path)
    assert back[0].count() == 6 and sorted(map(tuple, back[1].collect())) == [(0, 1), (0, 4), (2, 0), (5, 5)]
    told = {r["vec_id"]: (r["first"], r["degree"]) for r in spark.read.parquet(f"{path}/nodes").collect()}
    assert told[0] == (0, 2) and told[2] == (2, 1) and told[1] == (None, 0)
    G.write_csr(nodes.filter("vec_id <> 4"), edges, path + "-bad")
    with pytest.raises(ValueError):
        G.read_csr(spark, path + "-bad")


def test_code_sets_and_lists(spark):
    held = IL.CodeSet()
    first = held.insert(spark.createDataFrame([(3, b"a"), (1, b"a"), (2, b"b")], "vec_id bigint, code binary"))
    assert {(r["vec_id"], r["is_new"]) for r in first.collect()} == {(1, True), (3, False), (2, True)}
    second = held.insert(spark.createDataFrame([(0, b"a"), (9, b"c")], "vec_id bigint, code binary"))
    assert {(r["vec_id"], r["is_new"]) for r in second.collect()} == {(0, False), (9, True)} and held.codes.count() == 3
    rows = spark.createDataFrame([(i % 3, i, bytes([i])) for i in range(10)], "list_id bigint, vec_id bigint, code binary")
    assert sorted(map(tuple, IL.unblocked(IL.blocked(rows, 2)).select("list_id", "vec_id").collect())) == sorted((i % 3, i) for i in range(10))
    assert IL.list_sizes(IL.vstack([rows, rows], [3, 3])).count() == 6


def test_fnv_and_identity(spark, cloud):
    assert CA.fnv1a(b"") == 0xCBF29CE484222325 and CA.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    _, df = cloud
    assert CA.identity(df) == CA.identity(df.repartition(3)) != CA.identity(df.limit(149))
    assert CA.identity_key("a", [df], {"k": 1}) != CA.identity_key("a", [df], {"k": 2})
    assert MD.file_hash64(b"a") == "af63dc4c8601ec8c" and MD.file_digest(b"", "md5") == "d41d8cd98f00b204e9800998ecf8427e"


def test_caches(spark, cloud, tmp_path):
    _, df = cloud
    cache = CA.Cache(spark, f"file://{tmp_path}/cache")
    q = df.filter("vec_id < 4")
    a, b = cache.truth(q, df, 3).collect(), cache.truth(q.repartition(2), df, 3).collect()
    assert (cache.hits, cache.misses) == (1, 1) and sorted(a) == sorted(b)
    cache.truth(q, df, 4)
    assert cache.misses == 2
    hashed = df.select("vec_id", F.xxhash64("vec_id").alias("hash"))
    told = cache.sorted_hashes(hashed, "m")
    assert told.count() == 150 and cache.sorted_hashes(hashed, "m").count() == 150 and cache.hits == 2
    mixed = spark.createDataFrame([(i * 7 % 150, i) for i in range(150)], "hash bigint, vec_id bigint")
    mixed.repartition(3).write.parquet(f"file://{tmp_path}/mixed")
    assert not CA.files_in_order(spark.read.parquet(f"file://{tmp_path}/mixed"))


class Broken:
    """A source whose ranges fail now and then."""

    def __init__(self, data, failures):
        self.data, self.failures, self.asked = data, failures, []

    def size(self):
        return len(self.data)

    def read_at(self, offset, length):
        self.asked.append(offset)
        if self.failures:
            self.failures -= 1
            raise OSError("lost")
        return self.data[offset : offset + length]


def test_fetch_resumes_and_verifies(tmp_path):
    data = bytes(range(256)) * 40
    target = str(tmp_path / "got")
    with pytest.raises(OSError):
        MT.fetch(Broken(data, 99), target, step=1000, retries=2)
    (tmp_path / "got.part").write_bytes(data[:2500])
    source = Broken(data, 2)
    assert MT.fetch(source, target, step=1000) == len(data) - 2500 and source.asked[0] == 2500
    assert (tmp_path / "got").read_bytes() == data
    assert MT.verified(target, MT.digest_of(target)) == target
    with pytest.raises(ValueError):
        MT.verified(target, "00", "md5")
    assert MT.fetch(MT.FileSource(f"file://{target}"), str(tmp_path / "head"), stop=77) == 77
    (tmp_path / "x.part").write_bytes(data)
    with pytest.raises(ValueError):
        MT.fetch(Broken(data, 0), str(tmp_path / "x"), stop=10)


def test_extraction_is_safe(tmp_path):
    def archive(name, kind=tarfile.REGTYPE):
        path = tmp_path / "a.tar"
        with tarfile.open(path, "w") as tar:
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, 3 if kind == tarfile.REGTYPE else 0
            tar.addfile(info, io.BytesIO(b"abc"))
        return str(path)

    (got,) = MT.extract(archive("sub/file.bin"), str(tmp_path / "out"))
    assert open(got, "rb").read() == b"abc"
    for bad in ("../up", "/root/abs", "a/../../b"):
        with pytest.raises(ValueError):
            MT.extract(archive(bad), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        MT.extract(archive("link", tarfile.SYMTYPE), str(tmp_path / "out"))


def test_materialise_and_bundle(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 4)).astype("<f4")
    for name, rows in (("base.fbin", x), ("query.fbin", x[:5] + 0.01)):
        (tmp_path / name).write_bytes(np.array(rows.shape, "<u4").tobytes() + rows.tobytes())
    made = MT.materialise(spark, "small", f"file://{tmp_path}/base.fbin", f"file://{tmp_path}/query.fbin", f"file://{tmp_path}/out", k=3)
    assert [t["rows"] for t in made["tables"]] == [60, 5, 15]
    parts = MT.convert_xbin_to_vecs(spark, f"file://{tmp_path}/base.fbin", f"file://{tmp_path}/vecs")
    assert sum(p["rows"] for p in parts) == 60
    truth = spark.read.parquet(f"file://{tmp_path}/out/truth")
    parts = MT.truth_to_ivecs(truth, f"file://{tmp_path}/ivecs", 3)
    lists = B.read_vecs(spark, f"file://{tmp_path}/ivecs/{parts[0]['name']}", "ivecs").first()["embedding"]
    assert lists == [r["base_id"] for r in truth.filter("query_id = 0").orderBy("nn_rank").collect()]
    with pytest.raises(ValueError):
        MT.truth_to_ivecs(truth, f"file://{tmp_path}/no", 4)
    MT.build_bundle(spark, {"truth": truth, "base": spark.read.parquet(f"file://{tmp_path}/out/base")}, {"run": 1}, f"file://{tmp_path}/bundle")
    assert MT.verify_bundle(spark, f"file://{tmp_path}/bundle") == {}
    truth.limit(3).write.mode("overwrite").parquet(f"file://{tmp_path}/bundle/truth")
    assert "rows" in MT.verify_bundle(spark, f"file://{tmp_path}/bundle")["truth"]


def test_reports(spark):
    nested = {"a": {"b": [1, {"c": "x"}], "d": True}, "e": None}
    assert dict(RP.flatten(nested)) == {"a.b.0": 1, "a.b.1.c": "x", "a.d": True, "e": None}
    rows = {r["metric"]: (r["value"], r["text"]) for r in RP.metrics_frame(spark, {"run": nested}).collect()}
    assert rows == {"a.b.0": (1.0, None), "a.b.1.c": (None, "x"), "a.d": (1.0, None), "e": (None, None)}
    costs = spark.createDataFrame([("r", "train", 4.0), ("r", "eval", 4.0), ("r", "io", 2.0), ("s", "io", 1.0)], "run string, part string, ms double")
    assert {tuple(r) for r in RP.dominant_cost(costs, "run", "part", "ms").collect()} == {("r", "eval", 4.0, 0.4), ("s", "io", 1.0, 1.0)}
    assert {(r["part"], r["rows"], round(r["share"], 3)) for r in RP.attribution(costs, ["part"], "ms").collect()} == {("train", 1, 0.364), ("eval", 1, 0.364), ("io", 2, 0.273)}
    assert RP.to_csv(["a"], [["x,y"], [0.5]]) == 'a\n"x,y"\n0.5\n' and "| x\\|y |" in RP.to_markdown(["a"], [["x|y"]])
    page = RP.to_html("<t>", {"one": (["h"], [["<script>"]])})
    assert "<script>" not in page and "&lt;script&gt;" in page and "&lt;t&gt;" in page


def test_pivots_are_kept(spark, tmp_path):
    c = np.random.default_rng(2).normal(size=(20, 3))
    MD.save_pivots(spark, c, 4, f"file://{tmp_path}/pivots")
    ids, table = MD.load_pivots(spark, f"file://{tmp_path}/pivots")
    assert table.shape == (20, 4)
    for q in np.random.default_rng(3).normal(size=(10, 3)):
        assert C.pruned_nearest(q, c, ids, table)[0] == ((c - q) ** 2).sum(1).argmin()
    assert not C.wants_pivots(64, 512) and C.wants_pivots(64, 513) and not C.wants_pivots(32, 256) and C.wants_pivots(16, 8)


def test_chain_starts_spread(spark):
    x = np.concatenate([np.zeros((90, 2)), np.full((5, 2), 50.0), np.full((5, 2), -50.0)]) + np.random.default_rng(0).normal(0, 0.1, (100, 2))
    hits = [len({tuple(np.sign(np.round(r / 50))) for r in C.chain_init(x, 3, 80, seed)}) for seed in range(10)]
    assert np.mean(hits) > 2.5 and len(np.unique(C.chain_init(x, 5), axis=0)) >= 4
    with pytest.raises(ValueError):
        C.chain_init(x, 101)


def test_ties_by_id(spark):
    truth = spark.createDataFrame([(0, 9, 1, 0.5), (0, 2, 2, 0.5), (0, 5, 3, 0.7)], "query_id bigint, base_id bigint, nn_rank int, distance double")
    assert [r["base_id"] for r in T.ties_by_id(truth).orderBy("nn_rank").collect()] == [2, 9, 5]


@pytest.mark.parametrize("spec", ["linear,linear", "cubic,linear", "linear,cubic", "normal,linear_spline", "loglinear,linear", "lognormal,linear", "linear,linear,linear"])
def test_exported_sql_gives_the_model(spark, spec):
    values = sorted({int(v) for v in np.random.default_rng(4).exponential(400, 300)})
    df = spark.createDataFrame([(v,) for v in values], "key bigint")
    index = L.train(df, "key", spec, 4)
    told = EX.index_sql(index, "key")
    got = index.predict(df, "key").select("key", "raw", "pred", "err", F.expr(told["prediction"]).alias("p"), F.expr(told["position"]).alias("pos"), F.expr(told["error"]).alias("e")).collect()
    assert all(r["pred"] == r["pos"] and r["err"] == r["e"] and (r["raw"] == r["p"] or math.isclose(r["raw"], r["p"], rel_tol=1e-12)) for r in got)


def test_export_errors_and_centroids(spark, cloud):
    x, df = cloud
    with pytest.raises(ValueError):
        EX.index_sql(L.train(df.select(F.col("vec_id").alias("key")), "key", "radix,linear", 4), "key")
    model = VH.fit_vector_hash(df, 5, 32, leaves=4, iterations=3)
    told = model.apply(df).select("vec_id", "centroid_id").join(df.select("vec_id", F.expr(EX.centroid_sql(model, "embedding")).alias("c")), "vec_id")
    assert told.filter("centroid_id <> c").isEmpty() and told.count() == 150


def test_online_quantiles():
    rng = np.random.default_rng(6)
    for data in (rng.normal(size=20_000), rng.exponential(size=20_000)):
        stats = ON.OnlineStats((0.1, 0.5, 0.95)).add(data[:9000].tolist())
        stats = ON.OnlineStats.load(stats.dump()).add(data[9000:].tolist())
        count, low, high, avg, *told = stats.row()
        assert count == 20_000 and low == data.min() and high == data.max() and avg == pytest.approx(data.mean())
        spread = data.std()
        assert np.allclose(told, np.quantile(data, (0.1, 0.5, 0.95)), atol=0.05 * spread)
    assert ON.OnlineStats().row()[4] is None and ON.OnlineStats((0.5,)).add([3.0, 1.0, 2.0]).row()[4] == 2.0
    with pytest.raises(ValueError):
        ON.P2Quantile(1.0)


def test_online_quantiles_of_a_stream(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"), (F.col("id") % 4).alias("part"))
    rows.write.partitionBy("part").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("g bigint, v double").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    query = ON.online_quantiles(stream, "g", "v", (0.5,)).writeStream.outputMode("update").format("memory").queryName("online_q").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r["g"]: r for r in spark.table("online_q").orderBy("count").collect()}
    assert {g: r["count"] for g, r in last.items()} == {0: 200, 1: 200} and all(abs(r["q0"] - 199.5) < 30 for r in last.values())


def test_latency_and_interruption(spark):
    assert ON.summarize_latency([]) == {"avg": 0.0, "p95": 0.0, "p99": 0.0}
    assert ON.summarize_latency(list(range(1, 101))) == {"avg": 50.5, "p95": 95.0, "p99": 99.0}
    assert ON.measure_latency(lambda i: i, 20)["p99"] >= 0
    slow = spark.range(0, 8, 1, 8).mapInPandas(lambda frames: (time.sleep(30) or f for f in frames), "id bigint")
    begun = time.monotonic()
    with pytest.raises(ON.Cancelled), ON.interruptible(spark, 2.0):
        slow.count()
    assert time.monotonic() - begun < 25
    with ON.interruptible(spark, 60):
        assert spark.range(5).count() == 5


def test_selection_report(spark, tmp_path):
    metric = {"config": {"k": 2, "knn": 1, "spec": "linear,linear", "branch": 8, "two_opt": 0, "graph_order": False}, **dict.fromkeys(RP._FIGURES, 0.5)}
    told = {"roles": {"fast": metric}, "front": [metric], "calibrated": [{"skeleton": 9, **metric}]}
    assert RP.write_selection(spark, told, f"file://{tmp_path}/rep") == ["candidates.csv", "report.html", "result.json"]
    assert json.loads(spark.read.text(f"file://{tmp_path}/rep/result.json", wholetext=True).first()[0]) == told


def test_random_columns(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "vec_id")
    told = ids.select(RN.uniform(F.col("vec_id"), 3).alias("u"), RN.normal(F.col("vec_id"), 3).alias("g"), RN.integer(F.col("vec_id"), 7).alias("i")).toPandas()
    assert 0 < told.u.min() and told.u.max() < 1 and abs(told.u.mean() - 0.5) < 0.01
    assert abs(told.g.mean()) < 0.03 and abs(told.g.std() - 1) < 0.03 and sorted(told.i.unique()) == list(range(7))
    order = RN.permuted(ids.limit(100), "vec_id", 5).orderBy("position").select("vec_id").toPandas().vec_id.tolist()
    assert sorted(order) == list(range(100)) and order != sorted(order)
    x = np.array(RN.smooth_vectors(ids.limit(300), 16, 1).orderBy("vec_id").toPandas().embedding.tolist())
    assert x.shape == (300, 16) and np.abs(x).max() <= 1 and np.array_equal(x, np.array(RN.smooth_vectors(ids.limit(300).repartition(3), 16, 1).orderBy("vec_id").toPandas().embedding.tolist()))


def test_encoded_training_and_entries(spark, cloud):
    x, df = cloud
    index = IX.index_factory("SQ8").fit(df).add(df)
    assert IX.train_encoded(index, 4, 3).shape == (4, 8)
    told = IX.index_factory("CAGRA8").fit(df).add(df).search(df.filter("vec_id < 20"), 5)
    assert told.select("query_id", "base_id").join(S.knn(df.filter("vec_id < 20"), df, 5).select("query_id", "base_id"), ["query_id", "base_id"]).count() > 90
    with pytest.raises(ValueError):
        G.GraphIndex(8, entries=4)


def test_additive_codebooks_beyond_a_byte():
    """More words in all codebooks together than a byte counts."""
    x = np.random.default_rng(1).normal(size=(300, 6))
    for codec in (Q.LocalSearch(6, 6, rounds=1), Q.ProductAdditive(2, 5, 6, local_search=True)):
        codec.fit(x)
        assert ((codec.decode(codec.encode(x)) - x) ** 2).mean() < 0.05
