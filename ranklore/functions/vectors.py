"""Distances and arithmetic on ``array<float|double>`` columns, as JVM expressions.

Sums run left to right over doubles. Each metric also has a NumPy form over
(queries, base, dim) differences for the Arrow search path; parity is tested.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(as_double(a), as_double(b), f)


def inner_product(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(pairwise(a, b, lambda x, y: F.abs(x - y)))


def lp(a: Column, b: Column, p: float) -> Column:
    """Sum of |x - y|^p, without the root."""
    return total(pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def canberra(a: Column, b: Column) -> Column:
    """Sum of |x - y| / (|x| + |y|); a place where both are 0 makes it NaN."""
    return total(
        pairwise(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(float("nan"))).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))
    )


def bray_curtis(a: Column, b: Column) -> Column:
    down = total(pairwise(a, b, lambda x, y: F.abs(x + y)))
    return F.when(down == 0, F.lit(float("nan"))).otherwise(total(pairwise(a, b, lambda x, y: F.abs(x - y))) / down)


def jensen_shannon(a: Column, b: Column) -> Column:
    """Half the sum of both divergences to the midpoint, for positive entries."""

    def one(x, y):
        mid = (x + y) * 0.5
        return x * F.ln(x / mid) + y * F.ln(y / mid)

    return total(pairwise(a, b, one)) * 0.5


def jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima: a similarity."""
    up = total(pairwise(a, b, lambda x, y: F.least(x, y)))
    down = total(pairwise(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(down == 0, F.lit(float("nan"))).otherwise(up / down)


def nan_euclidean(a: Column, b: Column) -> Column:
    """dim / present * squared L2 over the places where neither side is NaN; NaN if there are none."""
    pairs = pairwise(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.lit(None).cast("double")).otherwise((x - y) * (x - y)))
    held = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(held) == 0, F.lit(float("nan"))).otherwise(F.size(a) / F.size(held) * total(held))


def gower(a: Column, b: Column) -> Column:
    """Mean over the places without NaN: |x - y| for numbers in [0, 1]; 0 or 1 for categories (both
    negative: equal or not). A number over 1, a category against a number, or no place at all: NaN."""
    nan = F.lit(float("nan"))

    def one(x, y):
        numbers = F.when((x > 1) | (y > 1), nan).otherwise(F.abs(x - y))
        return (
            F.when(F.isnan(x) | F.isnan(y), F.lit(None).cast("double"))
            .when((x >= 0) & (y >= 0), numbers)
            .when((x < 0) & (y < 0), F.when(x == y, 0.0).otherwise(1.0))
            .otherwise(nan)
        )

    held = F.filter(pairwise(a, b, one), lambda x: x.isNotNull())
    return F.when(F.size(held) == 0, nan).otherwise(total(held) / F.size(held))


def norm_squared(a: Column) -> Column:
    return total(F.transform(as_double(a), lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(norm_squared(a))


def l2_from_products(a: Column, b: Column) -> Column:
    return norm_squared(a) + norm_squared(b) - 2 * inner_product(a, b)


def normalised(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, as_double(a)).otherwise(F.transform(as_double(a), lambda x: x / length))


def add(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x - y)


def multiply_add(a: Column, factor: float, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x + factor * y)


def argmin(a: Column) -> Column:
    """Index of the first least entry."""
    return F.array_position(as_double(a), F.array_min(as_double(a))).cast("int") - 1


def remap(a: Column, places: list[int]) -> Column:
    """Entries at ``places`` in that order; -1 gives 0 (padding)."""
    return F.transform(
        F.array(*[F.lit(p) for p in places]), lambda p: F.when(p < 0, 0.0).otherwise(F.get(as_double(a), p))
    )


def linear_map(a: Column, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    """matrix @ a + bias, row by row."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    out = F.transform(rows, lambda row: total(F.zip_with(row, as_double(a), lambda x, y: x * y)))
    return out if bias is None else F.zip_with(out, F.array(*[F.lit(float(x)) for x in bias]), lambda x, y: x + y)


@dataclass(frozen=True)
class Metric:
    """A column form, a NumPy form over broadcast blocks, and the order of nearness."""

    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ascending: bool = True


def _blockwise(f):
    return lambda q, b: f(q[:, None, :], b[None, :, :])


def _block_gower(x, y):
    absent = np.isnan(x) | np.isnan(y)
    numbers = np.where((x > 1) | (y > 1), np.inf, np.abs(x - y))
    d = np.where((x >= 0) & (y >= 0), numbers, np.where((x < 0) & (y < 0), (x != y) * 1.0, np.inf))
    held = (~absent).sum(-1)
    mean = np.where(absent, 0.0, d).sum(-1) / held
    return np.where(np.isfinite(mean), mean, np.nan)


def _block_nan(x, y):
    d = (x - y) ** 2
    n = (~np.isnan(d)).sum(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, d.shape[-1] / n * np.nansum(d, -1), np.nan)


def _block_js(x, y):
    mid = (x + y) * 0.5
    return 0.5 * (x * np.log(x / mid) + y * np.log(y / mid)).sum(-1)


METRICS: dict[str, Metric] = {
    "l2": Metric(l2_squared, _blockwise(lambda x, y: ((x - y) ** 2).sum(-1))),
    "ip": Metric(inner_product, lambda q, b: q @ b.T, ascending=False),
    "l1": Metric(l1, _blockwise(lambda x, y: np.abs(x - y).sum(-1))),
    "linf": Metric(linf, _blockwise(lambda x, y: np.abs(x - y).max(-1))),
    "lp3": Metric(lambda a, b: lp(a, b, 3), _blockwise(lambda x, y: (np.abs(x - y) ** 3).sum(-1))),
    "canberra": Metric(canberra, _blockwise(lambda x, y: (np.abs(x - y) / (np.abs(x) + np.abs(y))).sum(-1))),
    "bray_curtis": Metric(bray_curtis, _blockwise(lambda x, y: np.abs(x - y).sum(-1) / np.abs(x + y).sum(-1))),
    "jensen_shannon": Metric(jensen_shannon, _blockwise(_block_js)),
    "jaccard": Metric(jaccard, _blockwise(lambda x, y: np.minimum(x, y).sum(-1) / np.maximum(x, y).sum(-1)), ascending=False),
    "nan_euclidean": Metric(nan_euclidean, _blockwise(_block_nan)),
    "gower": Metric(gower, _blockwise(_block_gower)),
}
