"""Queries on learned hashes of scalar keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklore.catalogue import register
from ranklore.functions import wide as W
from ranklore.operators import scalar_hash as H
from ranklore.queries.learned import two_layer
from ranklore.queries.tables import table


def _hash_sql(source: str, key: str, leaves: int, integer: bool, bits: int, scale: float = 1.0) -> str:
    top = W.scaled_range(bits, scale)
    return (
        two_layer(source, key, leaves, integer)
        + f""", c AS (SELECT min(raw) AS lo, max(raw) AS hi FROM q),
h0 AS (SELECT DISTINCT x, (raw - lo) * (n.n - 1)::DOUBLE / (hi - lo) AS prediction, n.n - 1 AS m FROM q, c, n),
h1 AS (SELECT x, prediction, m, floor(prediction / m * 4294967296.0::DOUBLE) AS a FROM h0),
h2 AS (SELECT *, floor((prediction / m * 4294967296.0::DOUBLE - a) * 4294967296.0::DOUBLE) AS b0 FROM h1),
h3 AS (SELECT *, CASE WHEN prediction > 0 AND a = 0 AND b0 = 0 THEN 1 ELSE b0 END AS b FROM h2),
h AS (SELECT x, prediction, CASE WHEN prediction <= 0 THEN 0::HUGEINT WHEN prediction >= m THEN {top}::HUGEINT
      ELSE ({top}::HUGEINT * a::HUGEINT + ({top}::HUGEINT * b::HUGEINT) // 4294967296) // 4294967296 END AS hash FROM h3)
"""
    )


def _trained(spark, sf_dir, source, key, leaves, bits, scale=1.0):
    df = table(spark, sf_dir, source)
    return H.fit_scalar_hash(df, key, "linear,linear", leaves, bits, scale), df.select(key).distinct()


@register(
    "scalar_hash32",
    _hash_sql("events", "value", 64, False, 32) + "SELECT x AS value, round(prediction, 6) AS prediction, hash::BIGINT AS hash, "
    "lpad(lower(hex(hash::BIGINT)), 8, '0') AS hash_hex FROM h",
)
def scalar_hash32(spark, sf_dir):
    trained, keys = _trained(spark, sf_dir, "events", "value", 64, 32)
    return trained.apply(keys, "value").select(
        "value", F.round("prediction", 6).alias("prediction"), F.col("hash").cast("bigint").alias("hash"), "hash_hex"
    )


@register(
    "scalar_hash64_hex",
    _hash_sql("lineitem", "l_orderkey", 32, True, 64)
    + "SELECT x::BIGINT AS l_orderkey, lower(lpad(hex((hash // 4294967296)::BIGINT), 8, '0') || lpad(hex((hash % 4294967296)::BIGINT), 8, '0')) AS hash_hex FROM h",
)
def scalar_hash64_hex(spark, sf_dir):
    trained, keys = _trained(spark, sf_dir, "lineitem", "l_orderkey", 32, 64)
    return trained.apply(keys, "l_orderkey").select("l_orderkey", "hash_hex")


@register(
    "scalar_hash_scaled",
    _hash_sql("events", "value", 64, False, 40, 0.3) + "SELECT count(*) AS keys, max(hash)::BIGINT AS greatest, count(DISTINCT hash) AS hashes FROM h",
)
def scalar_hash_scaled(spark, sf_dir):
    trained, keys = _trained(spark, sf_dir, "events", "value", 64, 40, 0.3)
    return trained.apply(keys, "value").agg(
        F.count(F.lit(1)).alias("keys"), F.max("hash").cast("bigint").alias("greatest"), F.countDistinct("hash").alias("hashes")
    )


@register(
    "scalar_hash_order_violations",
    _hash_sql("events", "value", 64, False, 32)
    + "SELECT sum(CASE WHEN p > hash THEN 1 ELSE 0 END)::BIGINT AS violations FROM (SELECT hash, lag(hash) OVER (ORDER BY x) AS p FROM h)",
)
def scalar_hash_order_violations(spark, sf_dir):
    trained, keys = _trained(spark, sf_dir, "events", "value", 64, 32)
    return H.order_violations(trained.apply(keys, "value"), "value", "hash")


@register(
    "scalar_index_map",
    "WITH n AS (SELECT max(o_orderkey) AS m FROM orders) SELECT o_orderkey, (o_orderkey::HUGEINT * (1152921504606846975::HUGEINT // m))::BIGINT AS hash FROM orders, n",
)
def scalar_index_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    mapping = H.Mapping(orders.agg(F.max("o_orderkey")).first()[0], 60)
    return orders.select("o_orderkey", H.map_index(F.col("o_orderkey"), mapping).cast("bigint").alias("hash"))


def _wide_sql(bits: int) -> str:
    """Beyond 64 bits: (2^bits - 1) q / 2^64 is q - 1 followed by ones, for a fraction q of 64 bits that is not 0."""
    digits = bits // 4
    part = "lpad(hex((({q}) {op} 4294967296)::BIGINT), 8, '0')"
    q = "a::HUGEINT * 4294967296 + b::HUGEINT - 1"
    head = f"lower({part.format(q=q, op='//')} || {part.format(q=q, op='%')})"
    return (
        _hash_sql("orders", "o_custkey", 16, True, 32)
        + f"SELECT x::BIGINT AS o_custkey, CASE WHEN prediction <= 0 THEN repeat('0', {digits}) WHEN prediction >= m THEN repeat('f', {digits}) ELSE {head} || repeat('f', {digits - 16}) END AS hash_hex FROM h3"
    )


@register("scalar_hash128", f"SELECT *, substr(hash_hex, 1, 16) AS top64_hex, hash_hex AS top128_hex FROM ({_wide_sql(128)})")
def scalar_hash128(spark, sf_dir):
    trained, keys = _trained(spark, sf_dir, "orders", "o_custkey", 16, 128)
    hashed = trained.apply(keys, "o_custkey")
    return hashed.select("o_custkey", "hash_hex", *[c.alias(n) for n, c in H.top_views(F.col("hash_hex"), 128).items()])


@register("scalar_hash256", f"SELECT o_custkey, hash_hex, substr(hash_hex, 1, 32) AS top128_hex, 32 AS bytes FROM ({_wide_sql(256)})")
def scalar_hash256(spark, sf_dir):
    trained, keys = _trained(spark, sf_dir, "orders", "o_custkey", 16, 256)
    hashed = trained.apply(keys, "o_custkey")
    views = H.top_views(F.col("hash_hex"), 256)
    return hashed.select("o_custkey", "hash_hex", views["top128_hex"].alias("top128_hex"), F.length(F.unhex("hash_hex")).alias("bytes"))
