"""Model folders: Parquet tables with a JSON sidecar, configuration grids, CSV sinks, manifests."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.functions.models import parse_spec
from ranklore.functions.wide import check_bits
from ranklore.operators.centroids import Range, pivots
from ranklore.operators.learned import LearnedIndex
from ranklore.operators.scalar_hash import Mapping, ScalarHash
from ranklore.operators.vector_hash import VectorHash


def write_json(spark: SparkSession, value, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    """Strict JSON; integers stay exact."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def save_index(index: LearnedIndex, path: str) -> None:
    spark = index.errors.sparkSession
    for i, layer in enumerate(index.layers):
        layer.write.mode("overwrite").parquet(f"{path}/layer-{i}")
    index.errors.write.mode("overwrite").parquet(f"{path}/errors")
    index.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    write_json(spark, {"kind": "learned-index", "version": 1, "spec": index.spec, "leaves": index.leaves, "rows": index.rows, "widths": index.widths}, f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> LearnedIndex:
    m = read_json(spark, f"{path}/manifest")
    if m.get("kind") != "learned-index" or m.get("version") != 1:
        raise ValueError(f"{path} holds no learned index")
    parse_spec(",".join(m["spec"]))
    layers = [spark.read.parquet(f"{path}/layer-{i}") for i in range(len(m["spec"]))]
    return LearnedIndex(m["spec"], m["leaves"], m["rows"], layers, spark.read.parquet(f"{path}/errors"), spark.read.parquet(f"{path}/metrics"), m["widths"])


def save_scalar_hash(model: ScalarHash, path: str) -> None:
    save_index(model.index, f"{path}/index")
    write_json(model.index.errors.sparkSession, model.manifest(), f"{path}/hash")


def load_scalar_hash(spark: SparkSession, path: str) -> ScalarHash:
    m = read_json(spark, f"{path}/hash")
    if "mapping" not in m:
        raise ValueError(f"{path} has no mapping")
    mapping = Mapping(m["mapping"]["max_index"], check_bits(m["mapping"]["bits"]), m["mapping"]["scale"])
    span = m["calibration"] or {"min": None, "max": None}
    return ScalarHash(load_index(spark, f"{path}/index"), mapping, span["min"], span["max"])


def save_vector_hash(model: VectorHash, spark: SparkSession, path: str) -> None:
    model.frame(spark).write.mode("overwrite").parquet(f"{path}/centroids")
    write_json(spark, {"kind": "vector-hash", "version": 1, "bits": model.bits, "spec": model.spec, "centroids": len(model.centroids)}, f"{path}/manifest")


def load_vector_hash(spark: SparkSession, path: str) -> VectorHash:
    m = read_json(spark, f"{path}/manifest")
    if m.get("kind") != "vector-hash" or m.get("version") != 1:
        raise ValueError(f"{path} holds no vector hash")
    rows = spark.read.parquet(f"{path}/centroids").orderBy("centroid_id").collect()  # one row a centroid
    if len(rows) != m["centroids"]:
        raise ValueError(f"{path} lacks centroids")
    return VectorHash(
        check_bits(m["bits"]),
        m["spec"],
        np.array([r["vec"] for r in rows]),
        [r["centroid_id"] for r in sorted(rows, key=lambda r: r["ord"])],
        [r["mass"] for r in rows],
        [Range(int(r["range_start"]), int(r["range_size"]), r["full"]) for r in rows],
        [r["min_d2"] for r in rows],
        [r["max_d2"] for r in rows],
        [r["rows"] for r in rows],
        [list(r["top"]) for r in rows],
        [[list(p) for p in r["leaf"]] for r in rows],
    )


def read_grid(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(spec, branching factor) of a JSON file {"configs": [{"layers": ..., "branching factor": ...}]}."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("configs").alias("c"))
    return [(r["c"]["layers"], int(r["c"]["branching factor"])) for r in rows.collect()]


def grid_json(configs: list[tuple[str, int]]) -> str:
    return json.dumps({"configs": [{"layers": s, "branching factor": b} for s, b in configs]})


def write_predictions(predicted: DataFrame, key: str, path: str, limit: int | None = None) -> None:
    """CSV of key, pred, err in key order."""
    rows = predicted.select(key, "pred", "err")
    rows = rows if limit is None else rows.orderBy(key).limit(limit)
    rows.write.mode("overwrite").csv(path, header=True)


def write_hashes(hashed: DataFrame, key: str, path: str, bits: int) -> None:
    """CSV: key, decimal and hex hash up to 64 bits; else key, top 64 bits and full hash in hex."""
    if bits <= 64:
        rows = hashed.select(F.col(key).alias("key_dec"), F.col("hash").cast("decimal(20,0)").cast("string").alias("hash_dec"), F.col("hash_hex"))
    else:
        rows = hashed.select(F.col(key).alias("key_dec"), F.substring("hash_hex", 1, 16).alias("hash_msb64_hex"), F.col("hash_hex"))
    rows.write.mode("overwrite").csv(path, header=True)


def raw_hashes(hashed: DataFrame) -> DataFrame:
    """Big-endian bytes of each hash."""
    padded = F.when(F.length("hash_hex") % 2 == 1, F.concat(F.lit("0"), F.col("hash_hex"))).otherwise(F.col("hash_hex"))
    return hashed.withColumn("hash_bytes", F.unhex(padded))


def table_manifest(df: DataFrame, name: str) -> dict:
    """Schema, rows and an order-free checksum of a table."""
    hashed = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x")).first()
    return {"name": name, "schema": json.loads(df.schema.json()), "rows": hashed["n"], "checksum": hashed["x"]}


def verify_manifest(df: DataFrame, manifest: dict) -> list[str]:
    """What differs from the manifest; empty if nothing does."""
    now = table_manifest(df, manifest["name"])
    return [k for k in ("schema", "rows", "checksum") if now[k] != manifest[k]]


def file_digest(data: bytes, kind: str = "sha256") -> str:
    return hashlib.new(kind, data).hexdigest()


def file_hash64(data: bytes) -> str:
    """64-bit FNV-1a of a file's bytes, as 16 hex digits."""
    from ranklore.sources.caches import fnv1a

    return f"{fnv1a(data):016x}"


def save_pivots(spark: SparkSession, centroids: np.ndarray, count: int, path: str) -> None:
    """The pivots of a centroid set and every centroid's distance to them: (pivot_id, centroid_id, distance)."""
    ids, distances = pivots(centroids, count)
    rows = [(int(p), int(c), float(distances[c, i])) for i, p in enumerate(ids) for c in range(len(centroids))]
    spark.createDataFrame(rows, "pivot_id bigint, centroid_id bigint, distance double").write.mode("overwrite").parquet(path)


def load_pivots(spark: SparkSession, path: str) -> tuple[list[int], np.ndarray]:
    """(pivots in order of number, (centroids, pivots) distances); a missing pair is an error."""
    rows = spark.read.parquet(path).collect()  # pivots x centroids
    ids, n = sorted({r["pivot_id"] for r in rows}), 1 + max((r["centroid_id"] for r in rows), default=-1)
    out = np.full((n, len(ids)), np.nan)
    for r in rows:
        out[r["centroid_id"], ids.index(r["pivot_id"])] = r["distance"]
    if np.isnan(out).any():
        raise ValueError(f"{path} lacks distances")
    return ids, out


def safe_component(name: str) -> str:
    """A name that is safe as one part of a path."""
    out = re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("._")
    if not out:
        raise ValueError(f"nothing safe is left of {name!r}")
    return out


def identifier(name: str) -> str:
    out = re.sub(r"\W+", "_", name)
    return f"_{out}" if not out or out[0].isdigit() else out


def duration(ns: float) -> str:
    """Nanoseconds in ns, us or ms."""
    for unit, size in (("ms", 1e6), ("us", 1e3)):
        if ns >= size:
            return f"{ns / size:.2f} {unit}"
    return f"{ns:.0f} ns"
