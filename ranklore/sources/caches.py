"""Results kept in the shared folder under the identity of what they were made from.

A key is a hash of the inputs (rows and an order-free checksum of each table) and the
parameters, so a changed input never meets an old result. A cache is written whole
before it is renamed into place; a crash leaves nothing that a reader would take.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.operators import search as S
from ranklore.plans.workspace import fresh_path, move_path, path_exists, shared_dir

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, start: int = FNV_OFFSET) -> int:
    """64-bit FNV-1a."""
    value = start
    for byte in data:
        value = (value ^ byte) * FNV_PRIME % 2**64
    return value


def identity(df: DataFrame) -> list[int]:
    """Rows and an order-free checksum of all columns: the same for the same rows in any layout."""
    told = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return [told["n"], told["x"] or 0, int(told["s"] or 0)]


def identity_key(kind: str, tables: list[DataFrame], parameters: dict) -> str:
    """16 hex digits that stand for a result of ``kind`` over these tables and parameters."""
    text = json.dumps([kind, [identity(t) for t in tables], parameters], sort_keys=True)
    return f"{fnv1a(text.encode()):016x}"


class Cache:
    """Tables by key below ``folder`` (unset: ``cache`` in the shared folder)."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_dir(spark)}/ranklore/cache").rstrip("/")
        self.hits = self.misses = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{key}"
        if path_exists(self.spark, f"{path}/_SUCCESS"):
            self.hits += 1
            return self.spark.read.parquet(path)
        self.misses += 1
        draft = fresh_path(self.spark, "cache-draft")
        make().write.parquet(draft)
        move_path(self.spark, draft, path)
        return self.spark.read.parquet(path)

    def truth(self, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
        """Exact neighbours, computed once for these queries, base and parameters."""
        key = identity_key("truth", [queries, base], {"k": k, "metric": metric, "exclude_self": exclude_self})
        return self.get(key, lambda: S.knn(queries, base, k, metric, exclude_self))

    def sorted_hashes(self, hashed: DataFrame, name: str) -> DataFrame:
        """(hash, vec_id) in hash order, written by ranges; ``name`` identifies the model that made the hashes."""
        key = identity_key("hashes", [hashed.select("vec_id", "hash")], {"model": name})
        found = self.get(key, lambda: hashed.select("hash", "vec_id").repartitionByRange("hash", "vec_id").sortWithinPartitions("hash", "vec_id"))
        if not files_in_order(found):
            raise ValueError(f"the cached hashes under {key} are not in order")
        return found


def files_in_order(hashes: DataFrame) -> bool:
    """Whether no file of a (hash, vec_id) table holds a hash that belongs into another: one row a file is compared."""
    files = hashes.groupBy(F.input_file_name().alias("f")).agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).orderBy("lo", "hi").collect()
    return all(a["hi"] <= b["lo"] for a, b in zip(files, files[1:], strict=False))
