"""Sorted-key operators: first-occurrence positions, unique keys, runs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklore.plans.ranking import hashed_first, one_task_limit, with_running_sum
from ranklore.plans.workspace import staged

#: Up to so many different keys one task adds up the counts; beyond, range partitions and blocks do.
ONE_TASK_KEYS = 100_000
KEY_TYPES = {"uint64": T.LongType(), "uint32": T.LongType(), "f64": T.DoubleType()}


def key_type(name: str) -> T.DataType:
    """Key type by the marker in a file name."""
    for marker in ("uint32", "f64", "uint64"):
        if marker in name:
            return KEY_TYPES[marker]
    raise ValueError(f"no key type in {name!r}: expected one of {sorted(KEY_TYPES)}")


def unique_keys(df: DataFrame, key: str, copies: str | None = None) -> DataFrame:
    """key, pos, copies: every different key with the sorted position of its first occurrence.

    Rows are counted per key first (partial sums before the shuffle), so a key that a
    third of all rows hold is one row here; positions are running sums of the counts
    over a range-partitioned order. ``copies``: a column of counts, where ``df`` has one.
    """
    number = F.count(F.lit(1)) if copies is None else F.sum(copies)
    held = df.filter(F.col(key).isNotNull())
    counts = staged(held.groupBy(F.col(key).alias("key")).agg(number.cast("bigint").alias("copies")), "key-counts")
    few = counts.count() <= one_task_limit(df.sparkSession, ONE_TASK_KEYS)
    return with_running_sum(counts, ["key"], "copies", "pos", few).select("key", "pos", "copies")


def key_view(df: DataFrame, key: str, copies: str | None = None) -> DataFrame:
    """x, k, y, copies of each different key: as double, as integer, first position."""
    u = unique_keys(df, key, copies)
    return u.select(F.col("key").cast("double").alias("x"), F.col("key").cast("bigint").alias("k"), F.col("pos").alias("y"), "copies")


def training_view(df: DataFrame, key: str) -> DataFrame:
    """x, k, y of every row: duplicates share the first position. Fits take ``key_view`` instead."""
    one = F.lit(1).cast("bigint")
    return key_view(df, key).select("x", "k", "y", F.explode(F.sequence(one, F.col("copies"))).alias("copy")).drop("copy")


def scaled(y: Column, factor: float) -> Column:
    """trunc(y * factor); a factor of one leaves y alone."""
    return y if abs(factor - 1.0) <= 2.220446049250313e-16 else F.floor(y * F.lit(factor)).cast("bigint")


def prefix(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """The first n ids."""
    return df.filter(F.col(id_column) < n)


def hashed_sample(df: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same on every run, in id order."""
    return hashed_first(df, n, id_column, seed).orderBy(id_column)


def even_sample(df: DataFrame, position: str, m: int) -> DataFrame:
    """m rows at trunc(i (n - 1) / (m - 1)); m = 1 takes row n div 2. Needs 0-based positions."""
    n = df.count()
    m = min(m, n)
    spark = df.sparkSession
    at = spark.range(m).select((F.lit(n // 2) if m == 1 else F.floor(F.col("id") * (n - 1) / F.lit(max(m - 1, 1)))).cast("bigint").alias(position))
    return df.join(F.broadcast(at.distinct()), position, "left_semi") if m else df.limit(0)


def gather(df: DataFrame, ids: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """Rows whose id is listed, with the list's other columns (its order)."""
    return ids.join(df, id_column)
