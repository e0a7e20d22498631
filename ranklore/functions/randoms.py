"""Random numbers as functions of an id and a seed: the same on every attempt, in any layout."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = 1 << 52
_HIDDEN = 10


def uniform(key: Column, seed: int = 0, stream: int = 0) -> Column:
    """A number in (0, 1) for each key; ``stream`` numbers independent draws."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(stream)), F.lit(_UNIT)) + 0.5) / float(_UNIT)


def integer(key: Column, n: int, seed: int = 0) -> Column:
    """0 to n - 1."""
    return F.floor(uniform(key, seed) * n).cast("bigint")


def normal(key: Column, seed: int = 0, stream: int = 0) -> Column:
    """Standard normal numbers (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.ln(uniform(key, seed, 2 * stream)))
    return radius * F.cos(2.0 * math.pi * uniform(key, seed, 2 * stream + 1))


def permuted(df: DataFrame, id_column: str, seed: int = 0, position: str = "position") -> DataFrame:
    """``df`` with each row's place in a random order."""
    from ranklore.plans.ranking import with_position

    shuffled = df.withColumn("__h", F.xxhash64(F.col(id_column), F.lit(seed)))
    return with_position(shuffled, ["__h", id_column], position).drop("__h")


def smooth_vectors(ids: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """vec_id, embedding: vectors on a smooth surface of ten dimensions, bent by sines into ``dim``."""
    rng = np.random.default_rng(seed)
    mix, bend = rng.random((_HIDDEN, dim)), rng.random(dim) * 4 + 0.1
    hidden = F.array(*[normal(F.col("vec_id"), seed, i) for i in range(_HIDDEN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.asarray(batch.column(1).flatten()).reshape(-1, _HIDDEN)
            x = np.sin(z @ mix * bend)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["vec_id", "embedding"])

    return ids.select(F.col("vec_id").cast("bigint").alias("vec_id"), hidden.alias("z")).mapInArrow(run, "vec_id bigint, embedding array<double>")
