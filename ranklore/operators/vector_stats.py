"""Profiles of vector columns and searches on their bit codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklore.functions import vectors as V
from ranklore.operators.search import top_k


def _exploded(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.posexplode(V.as_double(F.col(vector))).alias("dim", "x"))


def matrix_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per dimension: rows, NaN, infinite and zero entries, least, greatest, mean, standard deviation."""
    x = F.col("x")

    def count(condition):
        return F.sum(F.when(condition, 1).otherwise(0).cast("bigint"))

    return _exploded(df, vector).groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"),
        count(F.isnan(x)).alias("nan"),
        count(F.abs(x) == float("inf")).alias("inf"),
        count(x == 0).alias("zero"),
        F.round(F.min("x"), 6).alias("least"),
        F.round(F.max("x"), 6).alias("greatest"),
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_pop("x"), 6).alias("sd"),
    )


def means(df: DataFrame, vector: str = "embedding") -> list[float]:
    """Mean of each dimension: as many numbers as there are dimensions."""
    rows = _exploded(df, vector).groupBy("dim").agg(F.avg("x").alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["dim"])]


def centred(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with the mean vector subtracted."""
    mean = F.array(*[F.lit(m) for m in means(df, vector)])
    return df.withColumn(vector, V.subtract(F.col(vector), mean))


def duplicate_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """first_id, copies of every vector that occurs more than once."""
    return (
        df.groupBy(vector)
        .agg(F.min(vec_id).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("first_id", "copies")
    )


def _hamming_scan(shared, bound, k):
    def scan(batches):
        q_ids, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            base = np.asarray(batch.column(1).flatten()).view(np.uint64).reshape(len(ids), -1)
            d = sum(np.bitwise_count(q[:, None, w] ^ base[None, :, w]).astype(np.int32) for w in range(base.shape[1]))
            if bound is None:
                kept = min(k, len(ids))
                hit = d <= np.partition(d, kept - 1, axis=1)[:, kept - 1 : kept]
            else:
                hit = d < bound
            at, pos = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[at], pa.int64()), pa.array(ids[pos], pa.int64()), pa.array(d[at, pos], pa.int32())],
                ["query_id", "base_id", "distance"],
            )

    return scan


def _hamming_pairs(queries: DataFrame, base: DataFrame, bound: int | None, k: int | None, limit: int = 100_000) -> DataFrame:
    from functools import reduce

    spark, parts, ids, codes = base.sparkSession, [], [], []
    schema = "query_id bigint, base_id bigint, distance int"

    def flush():
        shared = spark.sparkContext.broadcast((np.array(ids), np.array(codes, np.int64).view(np.uint64)))
        parts.append(base.select("vec_id", "code").mapInArrow(_hamming_scan(shared, bound, k), schema))
        ids.clear()
        codes.clear()

    for row in queries.select("vec_id", "code").orderBy("vec_id").toLocalIterator():  # blocks of a bounded size
        ids.append(row[0])
        codes.append(row[1])
        if len(ids) >= limit:
            flush()
    if ids:
        flush()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def hamming_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """k nearest codes of each query by Hamming distance; both sides are (vec_id, code array<bigint>)."""
    return top_k(_hamming_pairs(queries, base, None, k), k)


def hamming_range(queries: DataFrame, base: DataFrame, bound: int) -> DataFrame:
    """All pairs with Hamming distance under ``bound``."""
    return _hamming_pairs(queries, base, bound, None)


def bit_histogram(codes: DataFrame, bits: int) -> DataFrame:
    """bit, ones: rows in which each bit is set."""
    from ranklore.functions.bits import bit

    flags = F.array(*[bit(F.col("code"), i) for i in range(bits)])
    return codes.select(F.posexplode(flags).alias("bit", "x")).groupBy("bit").agg(F.sum("x").alias("ones"))
