import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ranklore.functions import wide as W
from ranklore.operators import scalar_hash as H


def test_wide_goldens():
    top = W.max_for_bits(65)
    assert W.words(top) == [2**64 - 1, 1, 0, 0]
    assert W.to_hex(top, 65) == "1ffffffffffffffff"
    assert divmod(2**64 - 1, 3) == (6148914691236517205, 0)
    value = sum(w << (64 * i) for i, w in enumerate((0, 1, 2, 3)))
    assert W.top_bits(value, 256, 128) == (3 << 64) + 2
    assert W.to_bytes(0x1FF, 9) == b"\x01\xff"
    for bits in (0, 257):
        with pytest.raises(ValueError):
            W.max_for_bits(bits)


def test_mapping_goldens():
    mapping = H.Mapping(127, 128, 1.0)
    assert mapping.map_index(127) >> 64 != 0
    assert H.Mapping(0, 32).map_prediction(5.0) == 0
    assert H.Mapping(10, 32).map_prediction(float("nan")) == 0
    assert H.Mapping(10, 32).map_prediction(11.0) == 2**32 - 1
    assert W.scale_fixed(3.0) == 2**32 and W.scale_fixed(1e-30) == 1
    with pytest.raises(ValueError):
        W.scale_fixed(0.0)


@given(st.floats(0, 1, allow_nan=False), st.integers(0, 2**64 - 1))
def test_fraction_truncates(f, size):
    q = W.fraction_to_q64(f)
    assert 0 <= q < 2**64
    if 0 < f < 1:
        assert q == max(int(np.ldexp(np.longdouble(f), 64)), 1)
    assert (size * q) >> 64 <= size


def test_column_forms_equal_python(spark):
    sizes = [0, 1, 255, 2**32, 2**63 + 12345, 2**64 - 1]
    fractions = [0.0, 1e-300, 0.1, 0.25, 0.5, 0.9999999999999999, 1 / 3]
    rows = [(str(s), f) for s in sizes for f in fractions]
    df = spark.createDataFrame(rows, "s string, f double").withColumn("size", F.col("s").cast(W.WIDE))
    got = df.select("s", "f", W.times_fraction(F.col("size"), F.col("f")).alias("h"), W.decimal_hex(F.col("size"), 64).alias("x")).collect()
    for r in got:
        assert int(r["h"]) == (int(r["s"]) * W.fraction_to_q64(r["f"])) >> 64
        assert r["x"] == W.to_hex(int(r["s"]), 64)
    mapping = H.Mapping(1000, 64, 0.7)
    points = [-1.0, 0.0, 0.5, 999.99, 1000.0, 5000.0, float("nan"), float("inf")]
    got = spark.createDataFrame([(p,) for p in points], "p double").select("p", H.map_prediction(F.col("p"), mapping).alias("h")).collect()
    for p, r in zip(points, got, strict=True):
        assert int(r["h"]) == mapping.map_prediction(p), p


def test_scalar_hash_follows_keys(spark):
    keys = spark.range(128).select(F.col("id").alias("key"))
    trained = H.fit_scalar_hash(keys, "key", "linear,linear", 8, 64)
    rows = trained.apply(keys, "key").orderBy("key").collect()
    hashes = [int(r["hash"]) for r in rows]
    assert hashes == sorted(hashes) and hashes[0] == 0 and hashes[-1] == 2**64 - 1
    assert all(np.isfinite(r["prediction"]) for r in rows)
    wide = H.ScalarHash(trained.index, H.Mapping(127, 256), trained.low, trained.high).apply(keys, "key").orderBy("key").collect()
    assert [r["hash_hex"] for r in wide] == sorted(r["hash_hex"] for r in wide)
    assert len(wide[5]["hash_hex"]) == 64
    assert H.order_violations(trained.apply(keys, "key"), "key", "hash").first()[0] == 0
    assert trained.manifest()["mapping"]["bits"] == 64


def test_filters_on_hashes_and_both_forms(spark):
    """A filter on a hash is pushed below the arithmetic: it must still plan and give the same rows."""
    keys = spark.range(400).select((F.col("id") * 3).alias("key"))
    trained = H.fit_scalar_hash(keys, "key", "linear,linear", 8, 64)
    told = trained.apply(keys, "key")
    rows = told.collect()
    cut = sorted(r["hash"] for r in rows)[200]
    assert told.filter(F.col("hash") >= F.lit(cut)).count() == sum(r["hash"] >= cut for r in rows)
    assert told.filter(F.col("hash") != H.map_prediction(F.col("prediction"), trained.mapping)).isEmpty()
