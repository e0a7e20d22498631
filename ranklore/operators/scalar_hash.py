"""Learned hashes of scalar keys: prediction, calibration, mapping to 1..256 bits.

The mapping is monotone in the prediction. Up to 64 bits everything is a column
expression; wider hashes are made in Arrow batches and carried as fixed-width hex.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklore.functions import wide as W
from ranklore.operators import learned as L


@dataclass(frozen=True)
class Mapping:
    """How predictions 0..max_index are spread over the hash space."""

    max_index: int
    bits: int
    scale: float = 1.0

    def __post_init__(self):
        W.check_bits(self.bits)
        W.scale_fixed(self.scale)
        if self.max_index < 0:
            raise ValueError("the largest index must not be negative")

    @property
    def range(self) -> int:
        return W.scaled_range(self.bits, self.scale)

    @property
    def unit(self) -> int:
        """Hash units per index; 0 where there are more indexes than hashes."""
        return self.range // self.max_index if self.max_index else 0

    def map_index(self, index: int) -> int:
        i = min(index, self.max_index)
        if self.bits > 64:
            return (i * self.unit) & W.max_for_bits(self.bits)
        if self.unit or not self.max_index:
            return i * self.unit
        return i * self.range // self.max_index

    def map_prediction(self, prediction: float) -> int:
        if not self.max_index or not prediction > 0.0 or prediction == float("inf"):
            return 0
        if prediction >= self.max_index:
            return self.range
        return (self.range * W.fraction_to_q64(prediction / self.max_index)) >> 64

    def as_dict(self) -> dict:
        return asdict(self) | {"scale_words": W.words(self.unit)}


def map_index(index: Column, mapping: Mapping) -> Column:
    """DECIMAL hash of an integer index (up to 64 bits)."""
    i = F.least(index, F.lit(mapping.max_index)).cast(W.WIDE)
    if mapping.unit or not mapping.max_index:
        return (i * F.lit(str(mapping.unit)).cast(W.WIDE)).cast(W.WIDE)
    return W.divided((i * F.lit(str(mapping.range)).cast(W.WIDE)).cast(W.WIDE), F.lit(mapping.max_index))


def _inside(prediction: Column, mapping: Mapping) -> Column:
    """The prediction as a share of the largest index; 0 where it has none, 1 from the largest index on."""
    finite = prediction.isNotNull() & ~F.isnan(prediction) & (prediction < float("inf")) & (prediction > 0)
    share = F.least(prediction / F.lit(float(max(mapping.max_index, 1))), F.lit(1.0))
    return F.when(~finite | F.lit(not mapping.max_index), 0.0).when(prediction >= mapping.max_index, 1.0).otherwise(share)


def map_halves(prediction: Column, mapping: Mapping) -> Column:
    """High and low 32 bits of a prediction's hash of up to 64 bits, as a struct of bigints."""
    top = [F.lit(mapping.range >> 32).cast("bigint"), F.lit(mapping.range & (2**32 - 1)).cast("bigint")]
    whole = F.struct(top[0].alias("high"), top[1].alias("low"))

    def placed(share: Column) -> Column:
        return F.when(share >= 1.0, whole).otherwise(W.halves_times(*top, share))

    return W.let(W.let(prediction, lambda p: _inside(p, mapping)), placed)


def with_halves(df: DataFrame, prediction: Column, mapping: Mapping) -> DataFrame:
    """Add __high and __low, as ``map_halves`` has them, by generated code alone: each step is a column of
    its own, so that it is evaluated once."""
    shared = df.withColumn("__share", _inside(prediction, mapping))
    a, b = W.q64_halves(F.col("__share"))
    top = [F.lit(mapping.range >> 32).cast("bigint"), F.lit(mapping.range & (2**32 - 1)).cast("bigint")]
    told = W.product_halves(*top, F.col("__a"), F.col("__b"))
    high, low = (F.when(F.col("__share") >= 1.0, t).otherwise(own) for t, own in zip(top, told, strict=True))
    stepped = shared.withColumn("__a", a).withColumn("__b", b)
    return stepped.withColumn("__high", high).withColumn("__low", low).drop("__share", "__a", "__b")


def map_prediction(prediction: Column, mapping: Mapping) -> Column:
    """DECIMAL hash of a prediction (up to 64 bits)."""
    return W.let(map_halves(prediction, mapping), lambda p: W.halves_decimal(p["high"], p["low"]))


def wide_hash(mapping: Mapping):
    """Hex hash of a prediction as a vectorised Python function, for any width."""

    def hashed(prediction):
        return prediction.map(lambda p: W.to_hex(mapping.map_prediction(float(p)), mapping.bits))

    hashed.__annotations__ = {"prediction": pd.Series, "return": pd.Series}
    return F.pandas_udf(hashed, "string")


@dataclass
class ScalarHash:
    """A trained hash: learned index, calibration range of its predictions, mapping."""

    index: L.LearnedIndex
    mapping: Mapping
    low: float | None
    high: float | None

    def calibrated(self, raw: Column) -> Column:
        """Predictions stretched so that the least becomes 0 and the greatest max_index."""
        if self.low is None or self.high is None or not self.high > self.low:
            return raw
        return (raw - F.lit(self.low)) * F.lit(float(self.mapping.max_index)) / F.lit(self.high - self.low)

    def apply(self, keys: DataFrame, key: str) -> DataFrame:
        """``keys`` with raw, prediction and hash_hex, and ``hash`` (DECIMAL) up to 64 bits."""
        told = self.index.predict(keys, key).drop("leaf", "pred", "err").withColumn("prediction", self.calibrated(F.col("raw")))
        if self.mapping.bits > 64:
            return told.withColumn("hash_hex", wide_hash(self.mapping)(F.coalesce("prediction", F.lit(0.0))))
        halves = with_halves(told, F.col("prediction"), self.mapping)
        hashed = halves.withColumn("hash", W.halves_decimal(F.col("__high"), F.col("__low")))
        return hashed.withColumn("hash_hex", W.halves_hex(F.col("__high"), F.col("__low"), self.mapping.bits)).drop("__high", "__low")

    def manifest(self) -> dict:
        return {
            "spec": self.index.spec,
            "leaves": self.index.leaves,
            "rows": self.index.rows,
            "mapping": self.mapping.as_dict(),
            "calibration": None if self.low is None else {"min": self.low, "max": self.high},
        }


def fit_scalar_hash(
    df: DataFrame,
    key: str,
    spec: str | None = None,
    branch: int | None = None,
    bits: int = 64,
    scale: float = 1.0,
    calibrate: bool = True,
    max_bytes: int | None = None,
    grid: list[tuple[str, int]] | None = None,
) -> ScalarHash:
    """Train: an explicit configuration, else the best of ``grid`` under ``max_bytes``, else the balanced one."""
    grid = grid or [("linear,linear", 64), ("linear,linear", 256), ("cubic,linear", 64), ("linear,cubic", 64)]
    held = L.Keys.of(df, key)
    if spec:
        index = L.train(df, key, spec, branch or 64, held)
    elif max_bytes:
        index = L.train_for_size(df, key, grid, max_bytes)
    else:
        best = L.select_balanced(L.measure(df, key, grid, held)).first()
        index = L.train(df, key, best["spec"], best["branch"], held)
    mapping = Mapping(max(index.rows - 1, 0), bits, scale)
    low = high = None
    if calibrate:
        raw = held.predicted(index).select("raw")
        finite = raw.filter(~F.isnan("raw") & (F.abs("raw") < float("inf")))
        low, high = finite.agg(F.min("raw"), F.max("raw")).first()
    return ScalarHash(index, mapping, low, high)


def top_views(hash_hex: Column, bits: int) -> dict[str, Column]:
    """Hex of the most significant 64 and 128 bits (whole digits; widths that are multiples of 4)."""
    return {f"top{w}_hex": F.substring(hash_hex, 1, min(W.hex_width(bits), w // 4)) for w in (64, 128)}


def order_violations(hashed: DataFrame, key: str, hash_column: str) -> DataFrame:
    """Number of neighbouring keys whose hashes do not ascend: least squares leaves may drop at their ends."""
    from ranklore.plans.ranking import with_neighbours

    both = with_neighbours(hashed.select(key, hash_column), [key], F.lit(True), [key, hash_column])
    return both.agg(
        F.sum(F.when(F.col(f"l.{hash_column}") > F.col(hash_column), 1).otherwise(0)).cast("bigint").alias("violations")
    )
