"""Vector transforms: fitted by aggregates or on a bounded sample, applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklore.operators.codecs import Product, rotation
from ranklore.plans.ranking import hashed_first

#: Rows of a training sample, the first in hash order.
SAMPLE_ROWS = 20_000


def sample_matrix(df: DataFrame, rows: int = SAMPLE_ROWS, vec_id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """At most ``rows`` vectors on the driver."""
    return np.array([r[0] for r in hashed_first(df, rows, vec_id).select(vector).collect()], np.float64)


class Transform:
    def fit(self, df: DataFrame, vector: str = "embedding") -> Transform:
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def reverse(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def transform(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """``df`` with ``vector`` replaced by its image."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        at = df.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = np.asarray(batch.column(at).flatten(), np.float64)
                out = shared.value.apply(flat.reshape(batch.num_rows, -1)) if batch.num_rows else np.empty((0, 0))
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (out.shape[1] if batch.num_rows else 0))
                columns = list(batch.columns)
                columns[at] = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, fields)


class Linear(Transform):
    """x A^T + b."""

    def __init__(self, matrix=None, bias=None):
        self.matrix = None if matrix is None else np.asarray(matrix, np.float64)
        self.bias = 0.0 if bias is None else np.asarray(bias, np.float64)

    def apply(self, x):
        return x @ self.matrix.T + self.bias

    def reverse(self, x):
        return (x - self.bias) @ np.linalg.pinv(self.matrix).T


class RandomRotation(Linear):
    def __init__(self, dim: int, out: int | None = None, seed: int = 0):
        super().__init__(rotation(dim, seed, out))


def moments(df: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance over all rows; a task sends one dim x dim partial sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1)
            n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            sums = np.concatenate((s, q.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), n)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["n", "place", "x"]
            )

    parts = df.select(vector).mapInArrow(partial, "n bigint, place int, x double")
    rows = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # dim + dim^2 numbers
    if not rows:
        raise ValueError("no rows to take moments of")
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["place"]] = r["x"]
    n = rows[0]["n"]
    dim = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:dim] / n
    return n, mean, flat[dim:].reshape(dim, dim) / n - np.outer(mean, mean)


class Pca(Linear):
    """Principal components over all rows; ``power`` scales by eigenvalue^power, ``rotate`` spreads the variance."""

    def __init__(self, out: int, power: float = 0.0, rotate: bool = False, seed: int = 0):
        super().__init__()
        self.out, self.power, self.rotate, self.seed = out, power, rotate, seed

    def fit(self, df, vector="embedding"):
        _, mean, cov = moments(df, vector)
        values, vectors = np.linalg.eigh(cov)
        top = np.argsort(values)[::-1][: self.out]
        axes = vectors[:, top].T * np.where(self.power, np.maximum(values[top], 1e-12) ** self.power, 1.0)[:, None]
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        if self.rotate:
            axes = rotation(self.out, self.seed) @ axes
        self.matrix, self.bias = axes, -axes @ mean
        self.explained = values[top] / values.sum()
        return self


class Itq(Linear):
    """Rotation (after centring and normalising) that brings vectors near the corners of the cube."""

    def __init__(self, iterations: int = 30, seed: int = 0):
        super().__init__()
        self.iterations, self.seed = iterations, seed

    def fit(self, df, vector="embedding"):
        x = sample_matrix(df, vector=vector)
        self.mean = x.mean(0)
        x = self._prepared(x)
        r = rotation(x.shape[1], self.seed)
        for _ in range(self.iterations):
            u, _, vt = np.linalg.svd(np.where(x @ r.T >= 0, 1.0, -1.0).T @ x)
            r = u @ vt
        self.matrix = r
        return self

    def _prepared(self, x):
        x = x - self.mean
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length > 0, length, 1)

    def apply(self, x):
        return self._prepared(x) @ self.matrix.T


class Opq(Linear):
    """Rotation fitted together with a product quantizer."""

    def __init__(self, m: int, bits: int = 6, rounds: int = 5, seed: int = 0):
        super().__init__()
        self.m, self.bits, self.rounds, self.seed = m, bits, rounds, seed

    def fit(self, df, vector="embedding"):
        x = sample_matrix(df, vector=vector)
        r = rotation(x.shape[1], self.seed)
        for _ in range(self.rounds):
            y = x @ r.T
            coder = Product(self.m, self.bits).fit(y)
            u, _, vt = np.linalg.svd(coder.decode(coder.encode(y)).T @ x)
            r = u @ vt
        self.matrix = r
        return self


class Center(Transform):
    def fit(self, df, vector="embedding"):
        self.mean = moments(df, vector)[1]
        return self

    def apply(self, x):
        return x - self.mean

    def reverse(self, x):
        return x + self.mean


class Normalize(Transform):
    def apply(self, x):
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length > 0, length, 1)

    def reverse(self, x):
        return x


class Remap(Transform):
    """Entries at ``places``; -1 pads with 0."""

    def __init__(self, places: list[int]):
        self.places = np.array(places)

    def apply(self, x):
        out = x[:, np.maximum(self.places, 0)]
        out[:, self.places < 0] = 0.0
        return out

    def reverse(self, x):
        held = self.places >= 0
        out = np.zeros((len(x), self.places.max() + 1))
        out[:, self.places[held]] = x[:, held]
        return out


class Chain(Transform):
    """Transforms one after another, each fitted on the images of those before."""

    def __init__(self, parts: list[Transform]):
        self.parts = parts

    def fit(self, df, vector="embedding"):
        for part in self.parts:
            part.fit(df, vector)
            df = part.transform(df, vector)
        return self

    def apply(self, x):
        for part in self.parts:
            x = part.apply(x)
        return x

    def reverse(self, x):
        for part in reversed(self.parts):
            x = part.reverse(x)
        return x
