"""Trained models on streams: stateless hashing, incremental indexes, sliding windows.

A hash is a function of the row and a small static model, so a stream needs no state
and no watermark: rows are hashed as they come and appended. An index over a stream is
maintained by ``foreachBatch``, whose batch number makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.operators.centroids import squared_distances
from ranklore.operators.scalar_hash import wide_hash
from ranklore.plans.workspace import drop_path, path_exists


def hash_stream(stream: DataFrame, model, key: str) -> DataFrame:
    """Apply a scalar hash to a stream of rows: joins with the model's static tables only."""
    return model.apply(stream, key)


def route_stream(stream: DataFrame, model, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Apply a vector hash to a stream of vectors."""
    return model.apply(stream, keep)


def append_batches(out: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch becomes one folder, replaced if the batch comes again."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def sliding_batches(spark: SparkSession, out: str, slices: int, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """As ``append_batches``, but only the newest ``slices`` batches stay."""
    append = append_batches(out, transform)

    def write(batch: DataFrame, number: int) -> None:
        append(batch, number)
        old = f"{out}/batch={number - slices}"
        if number >= slices and path_exists(spark, old):
            drop_path(spark, old)

    return write


def stream_quantiles(df: DataFrame, column: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """min, max, avg and mergeable approximate quantiles in one pass."""
    quantiles = [F.percentile_approx(column, q, accuracy).alias(name) for name, q in shares.items()]
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("avg"), *quantiles)


def register_functions(spark: SparkSession, prefix: str, scalar=None, vector=None) -> list[str]:
    """SQL functions of trained models: ``<prefix>_map(prediction)`` for a scalar hash's mapping (hex),
    ``<prefix>_nearest(vector)`` for a vector hash's centroid."""
    made = []
    if scalar is not None:
        spark.udf.register(f"{prefix}_map", wide_hash(scalar.mapping))
        made.append(f"{prefix}_map")
    if vector is not None:
        centroids, active = vector.centroids, vector.active

        def nearest(v):
            x = np.array(v.tolist(), np.float64)
            return pd.Series(active[squared_distances(x, centroids[active]).argmin(1)])

        nearest.__annotations__ = {"v": pd.Series, "return": pd.Series}
        spark.udf.register(f"{prefix}_nearest", F.pandas_udf(nearest, "bigint"))
        made.append(f"{prefix}_nearest")
    return made
