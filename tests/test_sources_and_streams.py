import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklore.operators import learned as L
from ranklore.operators import scalar_hash as H
from ranklore.operators import vector_hash as VH
from ranklore.sources import binary as B
from ranklore.sources import models as MD
from ranklore.sources import truth as T
from ranklore.streaming import apply as A


def test_scalar_files(spark, tmp_path):
    for name, values in (("a_uint64", [1, 5, 9]), ("a_uint32", [2, 2]), ("a_f64", [0.5, 1.25])):
        path = str(tmp_path / name)
        kind = "double" if name.endswith("f64") else "bigint"
        assert B.write_scalars(spark.createDataFrame([(v,) for v in values], f"k {kind}"), "k", path, name[2:]) == len(values)
        assert [(r["row"], r["key"]) for r in B.read_scalars(spark, path).orderBy("row").collect()] == list(enumerate(values))
    short = tmp_path / "b_uint64"
    short.write_bytes(np.array([4, 1], "<u8").tobytes())
    with pytest.raises(ValueError):
        B.read_scalars(spark, str(short))
    (tmp_path / "c_uint64").write_bytes(b"abc")
    with pytest.raises(ValueError):
        B.read_scalars(spark, str(tmp_path / "c_uint64"))
    with pytest.raises(ValueError):
        B.read_scalars(spark, str(tmp_path / "untyped"))


def test_vector_files(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [-1.0, 0.5, 4.0])], "vec_id bigint, embedding array<float>")
    parts = B.write_vecs(df, str(tmp_path / "out"), "fvecs", 2)
    whole = tmp_path / "all.fvecs"
    whole.write_bytes(b"".join((tmp_path / "out" / p["name"]).read_bytes() for p in parts))
    monkeypatch.setattr(B, "RANGE_BYTES", 16)
    assert [r["embedding"] for r in B.read_vecs(spark, str(whole)).orderBy("vec_id").collect()] == [[1.0, 2.0, 3.0], [-1.0, 0.5, 4.0]]
    whole.write_bytes(whole.read_bytes()[:-1])
    with pytest.raises(ValueError):
        B.read_vecs(spark, str(whole))
    with pytest.raises(ValueError):
        B.write_vecs(df.limit(0), str(tmp_path / "none"))


def test_xbin_and_truth(spark, tmp_path):
    x = np.arange(12, dtype=np.uint8).reshape(4, 3)
    path = tmp_path / "v.u8bin"
    path.write_bytes(np.array([4, 3], "<u4").tobytes() + x.tobytes())
    got = B.read_xbin(spark, str(path)).orderBy("vec_id").collect()
    assert [r["embedding"] for r in got] == x.astype(float).tolist()
    assert B.convert_xbin(spark, str(path), str(tmp_path / "pq"), first=2).count() == 2
    assert B.vector_faults(B.read_xbin(spark, str(path)), 3).first().asDict() == {"rows": 4, "wrong_dim": 0, "missing_ids": 0, "infinite": 0}
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(ValueError):
        B.read_xbin(spark, str(path))
    truth = tmp_path / "gt"
    truth.write_bytes(np.array([2, 2], "<u4").tobytes() + np.array([[1, 2], [3, 9]], "<u4").tobytes() + np.array([[0.1, 0.2], [0.5, 0.4]], "<f4").tobytes())
    rows = B.read_truth(spark, str(truth))
    assert T.truth_faults(rows, 5).first().asDict() == {"rows": 4, "out_of_bounds": 1, "unordered": 1}
    lists = T.truth_lists(rows, 2)
    assert {r["query_id"]: r["neighbours"] for r in lists.collect()} == {0: [1, 2], 1: [3, 9]}
    assert T.truth_rows(lists, 1).count() == 2


def test_model_folders(spark, tmp_path):
    keys = spark.range(500).select((F.col("id") * 3).alias("key"))
    model = H.fit_scalar_hash(keys, "key", "linear,cubic", 8, 48)
    MD.save_scalar_hash(model, str(tmp_path / "m"))
    again = MD.load_scalar_hash(spark, str(tmp_path / "m"))
    a, b = (m.apply(keys, "key").select("key", "hash_hex").orderBy("key").collect() for m in (model, again))
    assert a == b
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id bigint, embedding array<double>")
    vh = VH.fit_vector_hash(vectors, 3, 40, leaves=3, iterations=3)
    MD.save_vector_hash(vh, spark, str(tmp_path / "v"))
    loaded = MD.load_vector_hash(spark, str(tmp_path / "v"))
    a, b = (m.apply(vectors).select("vec_id", "hash_hex").orderBy("vec_id").collect() for m in (vh, loaded))
    assert a == b
    with pytest.raises(ValueError):
        MD.load_index(spark, str(tmp_path / "v"))
    grid = tmp_path / "grid.json"
    grid.write_text(MD.grid_json([("linear,linear", 64)]))
    assert MD.read_grid(spark, str(grid)) == [("linear,linear", 64)]
    MD.write_hashes(model.apply(keys, "key"), "key", str(tmp_path / "csv"), 48)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["key_dec", "hash_dec", "hash_hex"]
    MD.write_predictions(L.train(keys, "key").predict(keys, "key"), "key", str(tmp_path / "pred"), 10)
    assert spark.read.csv(str(tmp_path / "pred"), header=True).count() == 10
    assert MD.raw_hashes(model.apply(keys, "key")).select(F.length("hash_bytes")).first()[0] == 6


def test_manifests_and_names(spark):
    df = spark.range(10)
    m = MD.table_manifest(df, "t")
    assert MD.verify_manifest(df, m) == [] and MD.verify_manifest(df.limit(9), m) == ["rows", "checksum"]
    assert MD.safe_component("../a b") == "a_b" and MD.identifier("3 x") == "_3_x"
    assert MD.duration(1500) == "1.50 us" and MD.duration(12) == "12 ns" and MD.duration(2.5e6) == "2.50 ms"
    with pytest.raises(ValueError):
        MD.safe_component("..")


def test_streams(spark, tmp_path):
    keys = spark.range(300).select(F.col("id").cast("double").alias("key"))
    model = H.fit_scalar_hash(keys, "key", "linear,linear", 4, 32)
    source = tmp_path / "in"
    keys.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sink = A.sliding_batches(spark, str(tmp_path / "out"), 2, lambda b: A.hash_stream(b, model, "key").select("key", "hash_hex"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in kept.select("batch").distinct().collect()) == [1, 2]
    batch = {r["key"]: r["hash_hex"] for r in model.apply(keys, "key").collect()}
    assert all(batch[r["key"]] == r["hash_hex"] for r in kept.collect())
    vh = VH.fit_vector_hash(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id bigint, embedding array<double>"), 2, 32, leaves=2, iterations=2)
    assert A.register_functions(spark, "t", model, vh) == ["t_map", "t_nearest"]
    assert spark.sql("SELECT t_map(299.0D) h").first()[0] == "ffffffff"
    near = spark.sql("SELECT t_nearest(array(0.0D, 0.0D)) c").first()[0]
    assert near == int(((vh.centroids) ** 2).sum(1).argmin())
