import json

import pytest
from pyspark.sql import functions as F

from ranklore import cli


def test_malformed_flags():
    for bad in ([], ["nothing"], ["fit-index", "--input", "x"], ["fit-index", "--input", "a", "--output", "b", "--key", "k", "--branch", "-3"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_keys_end_to_end(spark, tmp_path):
    spark.range(400).select((F.col("id") * 5).alias("key")).write.parquet(f"{tmp_path}/keys")

    def go(*words):
        return cli.run(spark, cli.parser().parse_args(list(words)))

    go("fit-hash", "--input", f"{tmp_path}/keys", "--output", f"{tmp_path}/m", "--key", "key", "--spec", "linear,linear", "--branch", "8", "--bits", "32")
    go("hash", "--input", f"{tmp_path}/keys", "--output", f"{tmp_path}/h", "--key", "key", "--model", f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/h", header=True).count() == 400


def test_vectors_end_to_end(spark, tmp_path):
    rows = [(i, [float(i % 13), float(i % 7)]) for i in range(150)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/v")

    def go(*words):
        return cli.run(spark, cli.parser().parse_args(list(words)))

    go("fit-vectors", "--input", f"{tmp_path}/v", "--output", f"{tmp_path}/m", "--k", "4", "--leaves", "3", "--bits", "40")
    told = json.loads(go("evaluate", "--input", f"{tmp_path}/v", "--model", f"{tmp_path}/m", "--neighbours", "3", "--every", "10"))
    assert 0 <= told["recall"] <= 1 and 0 <= told["quality"] <= 1


def test_vector_indexes_and_export(spark, tmp_path):
    import json

    from ranklore.operators import learned as L
    from ranklore.sources import models as MD

    rows = [(i, [float(i % 7), float(i)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/v")
    where = {"--input": f"{tmp_path}/v", "--output": f"{tmp_path}/ix"}

    def call(command, **options):
        words = [command]
        for name, value in options.items():
            words += [f"--{name}", str(value)]
        return cli.run(spark, cli.parser().parse_args(words))

    call("build-vectors", input=where["--input"], output=where["--output"], index="IVF4,Flat")
    call("search-vectors", input=where["--input"], model=where["--output"], output=f"{tmp_path}/found", k=1, probes=4)
    found = spark.read.parquet(f"{tmp_path}/found").collect()
    assert len(found) == 60 and all(r["query_id"] == r["base_id"] for r in found)
    keys = spark.range(100).withColumnRenamed("id", "key")
    MD.save_index(L.train(keys, "key", "linear,linear", 4), f"{tmp_path}/learned")
    told = json.loads(call("export-sql", model=f"{tmp_path}/learned", key="key"))
    assert keys.selectExpr(f"abs({told['position']} - key) AS d").filter("d > 1").isEmpty()
