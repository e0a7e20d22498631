"""Queries on sorted keys, model kinds and learned indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklore.catalogue import register
from ranklore.functions import models as M
from ranklore.operators import keys as K
from ranklore.operators import learned as L
from ranklore.queries.tables import by_ranges, table


def sig(x: str, digits: int = 12) -> str:
    scale = f"pow(10.0::DOUBLE, {digits - 1} - floor(log10(abs({x}))))"
    return f"(CASE WHEN ({x}) = 0 OR ({x}) IS NULL THEN ({x}) ELSE round(({x}) * {scale}) / {scale} END)"


def keyed(name: str, key: str) -> str:
    return f"k AS (SELECT {key}::DOUBLE AS x, {key} AS key, (rank() OVER (ORDER BY {key}) - 1)::BIGINT AS y FROM {name})"


def line(y: str, x: str = "x") -> tuple[str, str]:
    flat = f"count({x}) <= 1 OR var_samp({x}) = 0 OR var_samp({x}) IS NULL"
    beta = sig(f"CASE WHEN {flat} THEN 0 ELSE covar_samp({y}, {x}) / var_samp({x}) END")
    return f"{sig(f'coalesce(avg({y}), 0)')} - {beta} * {sig(f'coalesce(avg({x}), 0)')}", beta


# keys


@register(
    "key_positions_first_occurrence",
    "SELECT DISTINCT l_partkey AS key, (rank() OVER (ORDER BY l_partkey) - 1)::BIGINT AS pos FROM lineitem",
)
def key_positions(spark, sf_dir):
    return K.unique_keys(table(spark, sf_dir, "lineitem"), "l_partkey").select("key", "pos")


@register(
    "key_positions_by_ranges",
    "SELECT DISTINCT l_orderkey AS key, (rank() OVER (ORDER BY l_orderkey) - 1)::BIGINT AS pos FROM lineitem",
)
def key_positions_by_ranges(spark, sf_dir):
    with by_ranges(spark):
        return K.unique_keys(table(spark, sf_dir, "lineitem"), "l_orderkey").select("key", "pos")


@register("unique_keys", "SELECT o_custkey AS key, count(*) AS copies FROM orders GROUP BY 1")
def unique_keys(spark, sf_dir):
    return K.unique_keys(table(spark, sf_dir, "orders"), "o_custkey").select("key", "copies")


@register(
    "training_view_scaled",
    f"WITH {keyed('events', 'value')}, n AS (SELECT count(*) AS n FROM k) "
    "SELECT y, floor(y * (64::DOUBLE / n))::BIGINT AS target, count(*) AS rows FROM k, n GROUP BY 1, 2",
)
def training_view_scaled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.count()
    return (
        K.training_view(e, "value")
        .withColumn("target", K.scaled(F.col("y"), 64 / n))
        .groupBy("y", "target")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@register(
    "even_sample",
    "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT DISTINCT floor(i * (n - 1)::DOUBLE / 36)::BIGINT AS vec_id FROM n, range(37) t(i)",
)
def even_sample(spark, sf_dir):
    return K.even_sample(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 37)


@register("prefix_rows", "SELECT vec_id, label FROM embeddings WHERE vec_id < 100")
def prefix_rows(spark, sf_dir):
    return K.prefix(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 100)


@register("hashed_sample", "SELECT 50::BIGINT AS rows, 50::BIGINT AS ids, 50::BIGINT AS of_the_table, TRUE AS same_again")
def hashed_sample(spark, sf_dir):
    """So many different rows of the table, the same ones from another layout."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    drawn = K.hashed_sample(e, "vec_id", 50, 3)
    same = drawn.exceptAll(K.hashed_sample(e.repartition(5), "vec_id", 50, 3)).isEmpty()
    told = drawn.join(e.withColumn("held", F.lit(1)), ["vec_id", "label"], "left")
    return told.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"), F.count("held").alias("of_the_table"), F.lit(same).alias("same_again"))


# single models

_TRIMMED = (
    ", r AS (SELECT *, row_number() OVER (ORDER BY x, y) - 1 AS i, count(*) OVER () AS n FROM k), "
    "k2 AS (SELECT * FROM r WHERE i >= greatest(1, floor(n * 0.0001)) AND i < n - greatest(1, floor(n * 0.0001)))"
)
_LOGGED = ", k2 AS (SELECT x, ln(y::DOUBLE) AS y FROM k WHERE y > 0)"


def _one(kind: str, sql: str, source: str = "events", key: str = "value", ranges: bool = False) -> None:
    @register(f"{kind}_fit" + "_by_ranges" * ranges, sql)
    def fit(spark, sf_dir):
        if not ranges:
            return made(spark, sf_dir)
        with by_ranges(spark):
            return made(spark, sf_dir)

    def made(spark, sf_dir):
        view = K.key_view(table(spark, sf_dir, source), key)
        fitted = M.KINDS[kind].fit(view, [])
        width = len(M.KINDS[kind].empty)
        return fitted.select(*[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(width)])


def _line_sql(extra: str, source: str) -> str:
    alpha, beta = line("y")
    return f"WITH {keyed('events', 'value')}{extra} SELECT round({sig(alpha)}, 6) AS p0, round({beta}, 6) AS p1 FROM {source}"


_one("linear", _line_sql("", "k"))
_one("robust_linear", _line_sql(_TRIMMED, "k2"))
_one("robust_linear", _line_sql(_TRIMMED, "k2"), ranges=True)
_one("loglinear", _line_sql(_LOGGED, "k2"))
_one(
    "linear_spline",
    f"WITH {keyed('events', 'value')}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k) "
    "SELECT round(y0 - (y1 - y0) / (x1 - x0) * x0, 6) AS p0, round((y1 - y0) / (x1 - x0), 6) AS p1 FROM e",
)
_one(
    "normal",
    f"WITH {keyed('events', 'value')} SELECT round({sig('avg(x)')}, 6) AS p0, round({sig('stddev_pop(x)')}, 6) AS p1, max(y)::DOUBLE AS p2 FROM k",
)
_one(
    "lognormal",
    f"WITH {keyed('customer', 'c_acctbal')}, l AS (SELECT CASE WHEN x > 0 THEN ln(x) ELSE 0 END AS x, y FROM k) "
    f"SELECT round({sig('avg(x)')}, 6) AS p0, round({sig('stddev_pop(x)')}, 6) AS p1, max(y)::DOUBLE AS p2 FROM l",
    "customer",
    "c_acctbal",
)

_CUBIC = f"""
WITH {keyed('events', 'value')},
e AS (SELECT min(x) AS lo, max(x) AS hi, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM k),
s AS (SELECT *, (SELECT struct_pack(x := min(k.x), y := arg_min(k.y, k.x)) FROM k, e WHERE k.x > e.lo) AS a,
             (SELECT struct_pack(x := max(k.x), y := arg_max(k.y, k.x)) FROM k, e WHERE k.x < e.hi) AS b FROM e),
m AS (SELECT *, ((a.y - y0) / (y1 - y0)) / ((a.x - lo) / (hi - lo)) AS r1, ((y1 - b.y) / (y1 - y0)) / ((hi - b.x) / (hi - lo)) AS r2 FROM s),
t AS (SELECT *, CASE WHEN r1 * r1 + r2 * r2 > 9 THEN 3 / sqrt(r1 * r1 + r2 * r2) ELSE 1 END AS tau, (y1 - y0) / pow(hi - lo, 3) AS u FROM m),
c AS (SELECT lo, hi, y0, y1, u, r1 * tau AS m1, r2 * tau AS m2 FROM t),
p AS (SELECT *, (m1 + m2 - 2) * u AS pa, -(hi * (2 * m1 + m2 - 3) + lo * (m1 + 2 * m2 - 3)) * u AS pb,
      (m1 * hi * hi + m2 * lo * lo + hi * lo * (2 * m1 + 2 * m2 - 6)) * u AS pc,
      -lo * (m1 * hi * hi + hi * lo * (m2 - 3) + lo * lo) * u + y0 AS pd, (y1 - y0) / (hi - lo) AS g FROM c),
d AS (SELECT sum(abs(((pa * x + pb) * x + pc) * x + pd - y)) AS ce, sum(abs(y0 - g * lo + g * x - y)) AS le FROM k, p)
SELECT round(CASE WHEN le < ce THEN 0 ELSE pa END, 6) AS p0, round(CASE WHEN le < ce THEN 0 ELSE pb END, 6) AS p1,
       round(CASE WHEN le < ce THEN g ELSE pc END, 6) AS p2, round(CASE WHEN le < ce THEN y0 - g * lo ELSE pd END, 6) AS p3 FROM p, d
"""
_one("cubic", _CUBIC)


@register(
    "radix_params",
    "WITH k AS (SELECT l_orderkey AS key, (rank() OVER (ORDER BY l_orderkey) - 1)::BIGINT AS y FROM lineitem), "
    "b AS (SELECT bit_or(key) AS o, bit_and(key) AS a, max(y) AS m FROM k) "
    "SELECT (64 - length(ltrim((xor(o, a))::BIT::VARCHAR, '0')))::DOUBLE AS p0, floor(log2((m + 1)::DOUBLE)) AS p1 FROM b",
)
def radix_params(spark, sf_dir):
    view = K.key_view(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return M.fit_radix(view, []).select(F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"))


_RADIX = """
WITH k AS (SELECT l_orderkey AS key, (rank() OVER (ORDER BY l_orderkey) - 1)::BIGINT AS y FROM lineitem),
f AS (SELECT 64 - length(ltrim((xor(bit_or(key), bit_and(key)))::BIT::VARCHAR, '0')) AS prefix FROM k),
b AS (SELECT CASE WHEN prefix + 8 > 64 THEN key % (1::BIGINT << (64 - prefix)) ELSE (key % (1::BIGINT << (64 - prefix))) >> (64 - prefix - 8) END AS bucket, min(y) AS y FROM k, f GROUP BY 1),
e AS (SELECT i AS bucket, y FROM range(256) t(i) LEFT JOIN b ON bucket = i)
SELECT bucket::BIGINT AS bucket, CASE WHEN bucket = 0 THEN 0 ELSE coalesce((SELECT z.y FROM b z WHERE z.bucket >= e.bucket ORDER BY z.bucket LIMIT 1), 256) END::BIGINT AS hint FROM e
"""


@register("radix_table", _RADIX)
def radix_table(spark, sf_dir):
    return M.radix_table(K.key_view(table(spark, sf_dir, "lineitem"), "l_orderkey"), 8)


_BRADIX = """
WITH k AS (SELECT o_orderkey AS key FROM orders),
f AS (SELECT 64 - length(ltrim((xor(bit_or(key), bit_and(key)))::BIT::VARCHAR, '0')) AS prefix, count(*)::DOUBLE AS n FROM k),
s(bits, high, clamp) AS (VALUES (5, true, 39), (5, false, -23), (6, true, 39), (6, false, -87)),
b AS (SELECT bits, high, clamp, n, (key % (1::BIGINT << (64 - prefix))) >> (64 - prefix - bits) AS raw FROM k, f, s),
c AS (SELECT bits, high, clamp, any_value(n) AS n, CASE WHEN high THEN least(raw, clamp) WHEN raw < clamp THEN 0 ELSE raw - clamp END AS bucket, count(*) AS c FROM b GROUP BY bits, high, clamp, 5)
SELECT bits::INTEGER AS bits, high, clamp::BIGINT AS clamp, round(sum((c - n / 40) * (c - n / 40) / (n / 40)) + (40 - count(*)) * any_value(n) / 40, 6) AS score FROM c GROUP BY bits, high, clamp
"""


@register("bradix_chi2", _BRADIX)
def bradix_chi2(spark, sf_dir):
    view = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("bigint").alias("y"))
    return M.balanced_radix(view, 40)


@register(
    "equidepth_histogram",
    "WITH k AS (SELECT o_custkey AS key, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS n FROM orders) "
    "SELECT (r // (n // 50))::BIGINT AS bin, key AS split FROM k WHERE r % (n // 50) = 0 AND r // (n // 50) < 50",
)
def equidepth_histogram(spark, sf_dir):
    view = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(50).cast("bigint").alias("y"))
    return M.histogram_splits(view)


_KNOTS = (
    "WITH v AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events), "
    "q AS (SELECT DISTINCT i, floor(i * (n - 1)::DOUBLE / 31 + 0.5)::BIGINT AS r FROM v, range(32) t(i)) "
    "SELECT i::INTEGER AS knot, x FROM q JOIN v USING (r)"
)


@register("cdf_piecewise_knots", _KNOTS)
def cdf_piecewise_knots(spark, sf_dir):
    view = table(spark, sf_dir, "events").select(F.col("value").alias("x"))
    return M.quantile_knots(view, []).select(F.posexplode("p").alias("knot", "x"))


@register(
    "cdf_piecewise_predict",
    f"WITH kn AS ({_KNOTS}), p AS (SELECT e.event_id, e.value AS x, max(kn.knot) AS l FROM events e JOIN kn ON kn.x <= e.value GROUP BY 1, 2) "
    "SELECT event_id, round(CASE WHEN b.x IS NULL THEN 1.0 WHEN p.x <= (SELECT min(x) FROM kn) THEN 0 ELSE (l + CASE WHEN b.x > a.x THEN (p.x - a.x) / (b.x - a.x) ELSE 0 END) / 31 END, 6) AS cdf "
    "FROM p JOIN kn a ON a.knot = l LEFT JOIN kn b ON b.knot = l + 1",
)
def cdf_piecewise_predict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    knots = M.quantile_knots(e.select(F.col("value").alias("x")), [])
    asked = e.crossJoin(F.broadcast(knots))  # 32 numbers
    return asked.select("event_id", F.round(M.predict_knots(F.col("p"), F.col("value")), 6).alias("cdf"))


# learned indexes


def two_layer(source: str, key: str, leaves: int, integer: bool) -> str:
    """CTEs of a linear,linear index: k, n, t (root), r (rows with leaf), s (leaf table with p0, p1), q (predictions)."""
    a, b = line("yy")
    la, lb = line("y")
    step = "1" if integer else "2.220446049250313e-16::DOUBLE"
    return f"""
WITH {keyed(source, key)}, n AS (SELECT count(*) AS n FROM k),
t AS (SELECT {sig(a)} AS a, {b} AS b FROM (SELECT x, floor(y * ({leaves}::DOUBLE / n)) AS yy FROM k, n)),
r AS (SELECT x, y, least({leaves - 1}, floor(greatest(a + b * x, 0))::BIGINT) AS leaf FROM k, t),
z AS (SELECT leaf, min(x) AS fx, max(x) AS lx, min(y) AS fy, max(y) AS ly, count(*) AS n FROM r GROUP BY leaf),
sp AS (SELECT min(leaf) AS split FROM z WHERE leaf >= {leaves // 2}),
zz AS (SELECT z.*, CASE WHEN leaf >= split AND EXISTS (SELECT 1 FROM z w WHERE w.leaf < {leaves // 2}) THEN 1 ELSE 0 END AS part FROM z, sp),
nb AS (SELECT leaf, lag(lx) OVER w AS px, lag(ly) OVER w AS py, lead(fx) OVER w AS nx, lead(fy) OVER w AS ny FROM zz WINDOW w AS (PARTITION BY part ORDER BY leaf)),
d AS (SELECT leaf, x, y FROM r UNION ALL SELECT leaf, px, py FROM nb WHERE px IS NOT NULL UNION ALL SELECT leaf, nx, ny FROM nb WHERE nx IS NOT NULL),
f AS (SELECT leaf, {la} AS a0, {lb} AS p1 FROM d GROUP BY leaf),
g AS (SELECT leaf, {sig('a0')} AS p0, p1 FROM f),
al AS (SELECT i AS leaf, z.n, z.fx, z.lx, z.fy, z.ly FROM range({leaves}) q(i) LEFT JOIN z ON z.leaf = i),
ne AS (SELECT al.leaf, al.n AS rows, (SELECT min(z.fy) FROM z WHERE z.leaf > al.leaf) AS ny0, (SELECT min(z.fx) FROM z WHERE z.leaf > al.leaf) AS nx0,
       (SELECT max(z.lx) FROM z WHERE z.leaf < al.leaf) AS px0 FROM al),
nn AS (SELECT leaf, rows, coalesce(ny0, n.n) AS next_pos, coalesce(nx0, 1.7976931348623157e308::DOUBLE) AS next_key, coalesce(px0, 0) AS prev_key FROM ne, n),
s AS (SELECT nn.*, CASE WHEN rows IS NOT NULL THEN p0 WHEN nn.leaf < {leaves - 1} THEN next_pos ELSE 0 END AS p0,
      CASE WHEN rows IS NOT NULL THEN p1 ELSE 0 END AS p1 FROM nn LEFT JOIN g USING (leaf)),
q AS (SELECT r.*, p0 + p1 * x AS raw, floor(least(greatest(p0 + p1 * x, 0), 9e18))::BIGINT AS pred FROM r JOIN s USING (leaf)),
oe AS (SELECT leaf, max(abs(least(pred, n.n) - least(y, n.n))) AS own FROM q, n GROUP BY leaf),
lr AS (SELECT leaf, max(c) AS run FROM (SELECT leaf, x, count(*) AS c FROM r GROUP BY leaf, x) WHERE x < (SELECT max(x) FROM k) GROUP BY leaf),
fe AS (SELECT s.*, lag(next_pos) OVER (ORDER BY leaf) AS before FROM s),
er AS (SELECT fe.leaf, coalesce(rows, 0) AS n, coalesce(own, 0) AS own_err,
       greatest(coalesce(own, 0), abs(least(floor(least(greatest(p0 + p1 * (next_key - {step}), 0), 9e18))::BIGINT, n.n) - least(next_pos + 1, n.n)),
                abs(least(floor(least(greatest(p0 + p1 * (prev_key + {step}), 0), 9e18))::BIGINT, n.n) - least(coalesce(before, next_pos), n.n))) + coalesce(run, 0) AS max_err
       FROM fe LEFT JOIN oe USING (leaf) LEFT JOIN lr USING (leaf), n)
"""


def _index(spark, sf_dir, source="events", key="value", leaves=64):
    return L.fit_two_layer(table(spark, sf_dir, source), key, "linear,linear", leaves)


@register(
    "rm_two_layer_predict",
    two_layer("events", "value", 64, False)
    + "SELECT DISTINCT x AS value, leaf, pred, max_err AS err FROM q JOIN er USING (leaf)",
)
def rm_two_layer_predict(spark, sf_dir):
    index = _index(spark, sf_dir)
    keys = table(spark, sf_dir, "events").select("value").distinct()
    return index.predict(keys, "value").select("value", "leaf", "pred", "err")


@register("rm_leaf_errors_by_ranges", two_layer("lineitem", "l_partkey", 32, True) + "SELECT leaf, n, own_err, max_err FROM er")
def rm_leaf_errors_by_ranges(spark, sf_dir):
    with by_ranges(spark):
        return _index(spark, sf_dir, "lineitem", "l_partkey", 32).errors


@register("rm_leaf_errors", two_layer("lineitem", "l_orderkey", 32, True) + "SELECT leaf, n, own_err, max_err FROM er")
def rm_leaf_errors(spark, sf_dir):
    return _index(spark, sf_dir, "lineitem", "l_orderkey", 32).errors


@register(
    "rm_error_metrics",
    two_layer("events", "value", 64, False)
    + ", m AS (SELECT sum(er.n * max_err)::DOUBLE / any_value(n.n) AS avg_err, sum(er.n * max_err::DOUBLE * max_err) / any_value(n.n) AS avg_l2_err, "
    "sum(er.n * log2(2::DOUBLE * max_err + 2)) / any_value(n.n) AS avg_log2_err, max(max_err) AS max_err FROM er, n), "
    "w AS (SELECT avg(abs(least(pred, n.n) - least(y, n.n))::DOUBLE) AS mae, sqrt(avg(pow(abs(least(pred, n.n) - least(y, n.n))::DOUBLE, 2))) AS rmse FROM q, n) "
    "SELECT round(avg_err, 6) AS avg_err, round(avg_l2_err, 4) AS avg_l2_err, round(avg_log2_err, 6) AS avg_log2_err, max_err, "
    "round(log2(2::DOUBLE * max_err + 2), 6) AS max_log2_err, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM m, w",
)
def rm_error_metrics(spark, sf_dir):
    m = _index(spark, sf_dir).metrics
    digits = {"avg_l2_err": 4}
    return m.select(*[c if c == "max_err" else F.round(c, digits.get(c, 6)).alias(c) for c in m.columns])


@register(
    "rm_empty_leaf_next",
    two_layer("events", "value", 256, False)
    + "SELECT leaf, next_pos::BIGINT AS next_pos, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM s WHERE rows IS NULL",
)
def rm_empty_leaf_next(spark, sf_dir):
    index = _index(spark, sf_dir, leaves=256)
    stats = index.errors.filter("n = 0").select("leaf")
    told = index.layers[-1].join(stats, "leaf")
    return told.select(
        "leaf",
        F.round(F.get("p", F.lit(0)), 6).alias("p0"),
        F.round(F.get("p", F.lit(1)), 6).alias("p1"),
    ).join(_neighbours(spark, sf_dir, index), "leaf").select("leaf", "next_pos", "p0", "p1")


def _neighbours(spark, sf_dir, index):
    keys = K.key_view(table(spark, sf_dir, "events"), "value").withColumnRenamed("x", "value")
    placed = index.predict(keys, "value").select("leaf", F.col("value").alias("x"), "y", "copies")
    return L.leaf_neighbours(L.leaf_stats(placed), index.leaves, index.rows)


@register(
    "rm_prev_next_leaf",
    two_layer("events", "value", 64, False)
    + "SELECT leaf, next_pos::BIGINT AS next_pos, CASE WHEN next_key > 1e300 THEN -1 ELSE next_key END AS next_key, prev_key::DOUBLE AS prev_key FROM nn",
)
def rm_prev_next_leaf(spark, sf_dir):
    around = _neighbours(spark, sf_dir, _index(spark, sf_dir))
    return around.select(
        "leaf", "next_pos", F.when(F.col("next_key") > 1e300, -1.0).otherwise(F.col("next_key")).alias("next_key"), "prev_key"
    )


@register(
    "longest_dup_run_per_leaf",
    two_layer("lineitem", "l_orderkey", 32, True) + "SELECT leaf, coalesce(run, 0)::BIGINT AS longest_run FROM z LEFT JOIN lr USING (leaf)",
)
def longest_dup_run_per_leaf(spark, sf_dir):
    index = _index(spark, sf_dir, "lineitem", "l_orderkey", 32)
    keys = K.key_view(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumnRenamed("k", "l_orderkey")
    placed = index.predict(keys.drop("x"), "l_orderkey").select("leaf", F.col("l_orderkey").cast("double").alias("x"), "y", "copies")
    return L.leaf_stats(placed).select("leaf", F.col("longest_run").cast("bigint").alias("longest_run"))


@register("rm_position_probe", "SELECT 0::BIGINT AS outside")
def rm_position_probe(spark, sf_dir):
    """Keys whose true position lies outside [pred - err, pred + err]: none."""
    events = table(spark, sf_dir, "events")
    index = _index(spark, sf_dir)
    told = index.predict(K.key_view(events, "value").withColumnRenamed("x", "value").select("value", "y"), "value")
    off = F.abs(F.least("pred", F.lit(index.rows)) - F.col("y")) > F.col("err")
    return told.filter(off).agg(F.count(F.lit(1)).alias("outside"))


def _within_bounds(spark, sf_dir, source, key, spec, branch):
    """rows, keys, leaves and the keys whose true position lies outside [pred - err, pred + err]."""
    rows = table(spark, sf_dir, source)
    held = L.Keys.of(rows, key)
    index = L.train(rows, key, spec, branch, held)
    told = held.predicted(index).join(index.errors.select("leaf", "max_err"), "leaf")
    off = F.abs(F.least("pred", F.lit(index.rows)) - F.col("y")) > F.col("max_err")
    return told.agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("keys"), F.lit(index.leaves).cast("bigint").alias("leaves"), F.sum(off.cast("bigint")).alias("outside")
    )


@register("rm_multi_layer", "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS keys, 64::BIGINT AS leaves, 0::BIGINT AS outside FROM lineitem")
def rm_multi_layer(spark, sf_dir):
    return _within_bounds(spark, sf_dir, "lineitem", "l_orderkey", "linear,linear,cubic", 8)


@register("rm_cubic_leaf", "SELECT count(*) AS rows, count(DISTINCT value) AS keys, 32::BIGINT AS leaves, 0::BIGINT AS outside FROM events")
def rm_cubic_leaf(spark, sf_dir):
    return _within_bounds(spark, sf_dir, "events", "value", "linear,cubic", 32)


@register("rm_model_as_sql", "SELECT count(DISTINCT value) AS keys, 0::BIGINT AS differing FROM events")
def rm_model_as_sql(spark, sf_dir):
    """The exported expression against the model, key by key."""
    from ranklore.operators.export import index_sql

    events = table(spark, sf_dir, "events")
    index = _index(spark, sf_dir)
    told = index_sql(index, "value")
    both = index.predict(events.select("value").distinct(), "value").withColumn("p", F.expr(told["position"])).withColumn("e", F.expr(told["error"]))
    off = (F.col("p") != F.col("pred")) | (F.col("e") != F.col("err"))
    return both.agg(F.count(F.lit(1)).alias("keys"), F.sum(off.cast("bigint")).alias("differing"))


@register("bounded_spline_lookup", "SELECT l_orderkey, count(*) AS copies, true AS held FROM lineitem GROUP BY l_orderkey")
def bounded_spline_lookup(spark, sf_dir):
    """Every key's first position lies in the line that the spline names."""
    rows = table(spark, sf_dir, "lineitem")
    points = L.bounded_spline(rows, "l_orderkey", 32)
    keys = K.unique_keys(rows, "l_orderkey").withColumnRenamed("key", "l_orderkey")
    found = L.spline_lookup(points, keys, "l_orderkey", 32, rows.count())
    held = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + 32)
    return keys.join(found, "l_orderkey").select("l_orderkey", "copies", held.alias("held"))


# configurations

_CONFIGS = [
    ("linear,linear", 64, 1552, 5.2, 40, 11.0),
    ("linear,linear", 256, 6160, 4.1, 22, 6.5),
    ("linear,cubic", 64, 2592, 4.4, 31, 8.0),
    ("cubic,linear", 64, 1584, 5.4, 44, 12.5),
    ("cubic,cubic", 256, 10272, 3.2, 15, 4.0),
    ("robust_linear,linear", 128, 3088, 4.4, 30, 7.5),
    ("loglinear,linear", 1024, 24592, 3.2, 14, 4.1),
]
_VALUES = ", ".join(f"('{s}', {b}, {z}, {e}::DOUBLE, {m}, {a}::DOUBLE)" for s, b, z, e, m, a in _CONFIGS)
_CONFIG_SQL = f"c(spec, branch, size, avg_log2_err, max_err, mae) AS (SELECT col0, col1::BIGINT, col2::BIGINT, col3, col4::BIGINT, col5 FROM (VALUES {_VALUES}))"
_CONFIG_SCHEMA = "spec string, branch bigint, size bigint, avg_log2_err double, max_err bigint, mae double"


@register(
    "pareto_front_size_error",
    f"WITH {_CONFIG_SQL} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.size <= c.size AND d.avg_log2_err <= c.avg_log2_err "
    "AND (d.size < c.size OR d.avg_log2_err < c.avg_log2_err))",
)
def pareto_front_size_error(spark, sf_dir):
    return L.pareto_front(spark.createDataFrame(_CONFIGS, _CONFIG_SCHEMA))


@register(
    "select_balanced",
    f"WITH {_CONFIG_SQL}, b AS (SELECT *, 0.5 * (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) + "
    "0.5 * (avg_log2_err - min(avg_log2_err) OVER ()) / (max(avg_log2_err) OVER () - min(avg_log2_err) OVER ()) AS score FROM c) "
    "SELECT spec, branch, size, avg_log2_err, max_err, mae, round(score, 6) AS score FROM b ORDER BY b.score LIMIT 1",
)
def select_balanced(spark, sf_dir):
    return L.select_balanced(spark.createDataFrame(_CONFIGS, _CONFIG_SCHEMA)).withColumn("score", F.round("score", 6))


@register("narrow_front")
def narrow_front(spark, sf_dir):
    front = [r.asDict() for r in L.pareto_front(spark.createDataFrame(_CONFIGS, _CONFIG_SCHEMA)).collect()]
    return spark.createDataFrame([tuple(c[k] for k in ("spec", "branch", "size")) for c in L.narrow_front(front, 3)], "spec string, branch bigint, size bigint")


@register("rm_config_search", "SELECT * FROM (VALUES ('linear,linear', 16::BIGINT, 400::BIGINT), ('linear,linear', 64::BIGINT, 1552::BIGINT), ('cubic,linear', 16::BIGINT, 416::BIGINT), ('robust_linear,linear', 64::BIGINT, 1552::BIGINT)) t(spec, branch, size), (SELECT TRUE AS front_is_sound)")
def rm_config_search(spark, sf_dir):
    """Measured configurations of a small grid: their sizes, and whether the front holds exactly those that none beats."""
    events = table(spark, sf_dir, "events")
    measured = L.measure(events, "value", [("linear,linear", 16), ("linear,linear", 64), ("cubic,linear", 16), ("robust_linear,linear", 64)])
    rows = measured.collect()  # the configurations tried
    front = {(r["spec"], r["branch"]) for r in L.pareto_front(measured).collect()}

    def beats(a, b):
        return a["size"] <= b["size"] and a["avg_log2_err"] <= b["avg_log2_err"] and (a["size"], a["avg_log2_err"]) != (b["size"], b["avg_log2_err"])

    sound = front == {(r["spec"], r["branch"]) for r in rows if not any(beats(o, r) for o in rows)}
    return measured.select("spec", "branch", "size", F.lit(sound).alias("front_is_sound"))
