"""Queries on centroids, vector hashes and the evaluation of their layouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ranklore.catalogue import register
from ranklore.functions import vectors as V
from ranklore.operators import centroids as C
from ranklore.operators import evaluation as E
from ranklore.operators import search as S
from ranklore.operators import vector_hash as VH
from ranklore.queries.tables import by_ranges, table

K = 8
_SUM = "list_reduce(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda x, y: x + y)"
_D = _SUM.format(a="e.v", b="c.v")
_ASSIGN = f"""
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT vec_id AS centroid_id, v FROM e WHERE vec_id < {K}),
p AS (SELECT e.vec_id, centroid_id, {_D} AS d2 FROM e, c),
a AS (SELECT vec_id, centroid_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, centroid_id) AS n FROM p) WHERE n = 1)"""


def _first(df, k=K):
    rows = df.filter(F.col("vec_id") < k).orderBy("vec_id").collect()  # k rows
    return np.array([r["embedding"] for r in rows], np.float64)


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@register("nearest_centroid_assign", f"WITH {_ASSIGN} SELECT vec_id, centroid_id, round(d2, 9) AS d2 FROM a")
def nearest_centroid_assign(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return C.assign(e, _first(e)).withColumn("d2", F.round("d2", 9))


@register(
    "top_k_centroids",
    f"WITH {_ASSIGN} SELECT vec_id, centroid_id, round(d2, 9) AS d2, n::INTEGER AS nn_rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, centroid_id) AS n FROM p) WHERE n <= 3",
)
def top_k_centroids(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return C.nearest_centroids(e, _first(e), 3).withColumn("d2", F.round("d2", 9))


@register("centroid_mass", f"WITH {_ASSIGN} SELECT centroid_id, count(*) AS mass FROM a GROUP BY centroid_id")
def centroid_mass(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return C.mass(C.assign(e, _first(e)))


@register(
    "imbalance_factor",
    f"WITH {_ASSIGN}, h AS (SELECT count(*)::DOUBLE AS m FROM a GROUP BY centroid_id) SELECT round({K} * sum(m * m) / (sum(m) * sum(m)), 9) AS imbalance FROM h",
)
def imbalance_factor(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return C.imbalance_factor(C.assign(e, _first(e)), K).select(F.round("imbalance", 9).alias("imbalance"))


@register(
    "kmeans_one_iteration",
    f"WITH {_ASSIGN}, u AS (SELECT centroid_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM a JOIN e USING (vec_id)) "
    "SELECT centroid_id, dim::INTEGER AS dim, round(avg(x), 6) AS x FROM u GROUP BY centroid_id, dim",
)
def kmeans_one_iteration(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    new, counts, _ = C.kmeans_step(e, _first(e))
    rows = [(i, [float(x) for x in new[i]]) for i in np.flatnonzero(counts).tolist()]
    return (
        spark.createDataFrame(rows, "centroid_id bigint, v array<double>")
        .select("centroid_id", F.posexplode("v").alias("dim", "x"))
        .withColumn("x", F.round("x", 6))
    )


def _lloyd_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and means as one chain of CTEs, from the first k rows."""
    parts = ["e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", f"c0 AS (SELECT vec_id AS cid, v FROM e WHERE vec_id < {k})"]
    for r in range(rounds):
        d = _SUM.format(a="e.v", b="c.v")
        parts.append(f"a{r} AS (SELECT vec_id, cid FROM (SELECT e.vec_id, c.cid, row_number() OVER (PARTITION BY e.vec_id ORDER BY {d}, c.cid) AS n FROM e, c{r} c) WHERE n = 1)")
        parts.append(f"u{r} AS (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{r} JOIN e USING (vec_id))")
        parts.append(f"c{r + 1} AS (SELECT cid, list(x ORDER BY dim) AS v FROM (SELECT cid, dim, avg(x) AS x FROM u{r} GROUP BY cid, dim) GROUP BY cid)")
    return "WITH " + ", ".join(parts)


@register("kmeans_full", _lloyd_sql(10, 3) + " SELECT cid AS centroid_id, (generate_subscripts(v, 1) - 1)::INTEGER AS dim, round(unnest(v), 6) AS x FROM c3")
def kmeans_full(spark, sf_dir):
    """Three rounds from given centroids."""
    e = _embeddings(spark, sf_dir)
    centroids, _ = C.kmeans(e, 10, iterations=3, init=_first(e, 10))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "centroid_id bigint, v array<double>").select("centroid_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@register("kmeans_objective", "SELECT count(*) AS rows, 10 AS centroids, TRUE AS never_rises FROM embeddings")
def kmeans_objective(spark, sf_dir):
    """From hashed starts: all rows are assigned, and no round makes the sum of squares larger."""
    e = _embeddings(spark, sf_dir)
    centroids, objectives = C.kmeans(e, 10, iterations=8)
    falls = all(b <= a * (1 + 1e-12) for a, b in zip(objectives, objectives[1:], strict=False))
    return C.mass(C.assign(e, centroids)).agg(F.sum("mass").alias("rows"), F.lit(len(centroids)).alias("centroids"), F.lit(falls).alias("never_rises"))


@register(
    "centroid_knn_edges",
    f"WITH {_ASSIGN}, g AS (SELECT e.centroid_id AS from_id, c.centroid_id AS to_id, {_D} AS d2 FROM c e, c WHERE e.centroid_id <> c.centroid_id) "
    "SELECT from_id, to_id, round(d2, 9) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY d2, to_id) AS n FROM g) WHERE n <= 3",
)
def centroid_knn_edges(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return C.knn_edge_frame(spark, _first(e), 3).withColumn("d2", F.round("d2", 9))


@register("centroid_order", "SELECT vec_id AS centroid_id, TRUE AS once, TRUE AS shorter FROM embeddings WHERE vec_id < 32")
def centroid_order(spark, sf_dir):
    """Every centroid once, along a way that is shorter than that of their numbers."""
    c = _first(_embeddings(spark, sf_dir), 32)
    order = C.centroid_order(c, knn=4)
    length = lambda way: float(np.sqrt(((c[way[1:]] - c[way[:-1]]) ** 2).sum(1)).sum())
    rows = [(int(i), order.count(i) == 1, length(np.array(order)) < length(np.arange(32))) for i in order]
    return spark.createDataFrame(rows, "centroid_id bigint, once boolean, shorter boolean")


_RANGES = f"""
m AS (SELECT c.centroid_id, count(a.vec_id) AS mass FROM c LEFT JOIN a USING (centroid_id) GROUP BY 1),
t AS (SELECT centroid_id, mass, (mass::HUGEINT * 4294967296) // sum(mass) OVER () AS q, (mass::HUGEINT * 4294967296) % sum(mass) OVER () AS r FROM m),
z AS (SELECT *, q + CASE WHEN row_number() OVER (ORDER BY r DESC, centroid_id) <= 4294967296 - sum(q) OVER () THEN 1 ELSE 0 END AS size FROM t),
rg AS (SELECT centroid_id, mass, size::BIGINT AS range_size, coalesce(sum(size) OVER (ORDER BY centroid_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS range_start FROM z)"""


@register("allocate_ranges", f"WITH {_ASSIGN}, {_RANGES} SELECT centroid_id, mass, centroid_id AS ord, range_start, range_size FROM rg")
def allocate_ranges(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    masses = C.mass(C.assign(e, _first(e))).withColumn("ord", F.col("centroid_id"))
    return C.ranges_frame(masses, 32).select(
        "centroid_id", "mass", "ord", F.col("range_start").cast("bigint").alias("range_start"), F.col("range_size").cast("bigint").alias("range_size")
    )


def _plain_hash(e, bits: int = 32) -> VH.VectorHash:
    """A hash without trained CDFs: the slot is the distance's place between the centroid's least and greatest."""
    centroids = _first(e)
    rows = C.assign(e, centroids).groupBy("centroid_id").agg(F.count(F.lit(1)).alias("n"), F.min("d2").alias("lo"), F.max("d2").alias("hi")).collect()
    by = {r["centroid_id"]: r for r in rows}  # one row a centroid
    masses = [by[i]["n"] if i in by else 0 for i in range(K)]
    order = list(range(K))
    ends = [[by[i][c] if i in by else None for i in range(K)] for c in ("lo", "hi")]
    return VH.VectorHash(bits, ["linear", "linear"], centroids, order, masses, C.allocate_ranges(masses, order, bits), *ends, [0] * K, [[]] * K, [[]] * K)


_HASHED = f"""{_ASSIGN}, {_RANGES},
b AS (SELECT centroid_id, min(d2) AS lo, max(d2) AS hi FROM a GROUP BY centroid_id),
f AS (SELECT vec_id, centroid_id, d2, range_start, range_size, CASE WHEN hi > lo THEN least(greatest((d2 - lo) / (hi - lo), 0), 0.9999999999999999::DOUBLE) ELSE 0 END AS x
      FROM a JOIN b USING (centroid_id) JOIN rg USING (centroid_id)),
w AS (SELECT *, floor(x * 4294967296.0::DOUBLE) AS h FROM f),
hs AS (SELECT vec_id, centroid_id, (range_start + (range_size::HUGEINT * h::HUGEINT + (range_size::HUGEINT * floor((x * 4294967296.0::DOUBLE - h) * 4294967296.0::DOUBLE)::HUGEINT) // 4294967296) // 4294967296)::BIGINT AS hash FROM w)"""


@register("vector_hash", f"WITH {_HASHED} SELECT vec_id, centroid_id, hash, lpad(lower(hex(hash)), 8, '0') AS hash_hex FROM hs")
def vector_hash(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return _plain_hash(e).apply(e).select("vec_id", "centroid_id", F.col("hash").cast("bigint").alias("hash"), "hash_hex")


@register(
    "hash_owner_lookup",
    f"WITH {_HASHED} SELECT vec_id, hash, centroid_id AS owner FROM hs",
)
def hash_owner_lookup(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    model = _plain_hash(e)
    hashed = model.apply(e).select("vec_id", F.col("hash").cast("bigint").alias("hash"))
    return C.range_owners(hashed, model.ranges).withColumnRenamed("centroid_id", "owner")


@register("vector_hash_trained", f"WITH {_ASSIGN} SELECT vec_id, TRUE AS own_range, TRUE AS in_unit FROM e")
def vector_hash_trained(spark, sf_dir):
    """With trained CDFs every hash lies in the range of its centroid."""
    e = _embeddings(spark, sf_dir)
    model = VH.fit_vector_hash(e, 8, bits=64, leaves=8, iterations=4)
    told = model.apply(e).select("vec_id", "centroid_id", "hash", "cdf")
    owners = C.range_owners(told.select("vec_id", "hash"), model.ranges).select("vec_id", F.col("centroid_id").alias("owner"))
    unit = (F.col("cdf") >= 0) & (F.col("cdf") < 1)
    return told.join(owners, "vec_id").select("vec_id", (F.col("owner") == F.col("centroid_id")).alias("own_range"), unit.alias("in_unit"))


#: Beyond 64 bits different distances have different hashes, so hashes sort like (range, place in it).
_WIDE = _HASHED[: _HASHED.index("w AS (")] + "hs AS (SELECT vec_id, centroid_id, dense_rank() OVER (ORDER BY centroid_id, x) AS hash FROM f)"


@register("vector_hash_256", f"WITH {_WIDE} SELECT vec_id, centroid_id, 64 AS digits, row_number() OVER (ORDER BY hash, vec_id) - 1 AS rank FROM hs")
def vector_hash_256(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    told = _plain_hash(e, 256).apply(e).select("vec_id", "centroid_id", F.col("hash_hex").alias("hash")).cache()
    return told.join(E.base_ranks(told).withColumnRenamed("base_id", "vec_id"), "vec_id").select("vec_id", "centroid_id", F.length(told["hash"]).alias("digits"), "rank")


_KNN = f"""
kn AS (SELECT query_id, base_id, n::INTEGER AS nn_rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS base_id,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SUM.format(a='a.v', b='b.v')}, b.vec_id) AS n FROM e a, e b WHERE a.vec_id <> b.vec_id) WHERE n <= 10)"""


@register(
    "centroid_affinity_top128",
    f"WITH {_ASSIGN}, {_KNN}, l AS (SELECT x.centroid_id AS f, y.centroid_id AS t FROM kn JOIN a x ON x.vec_id = query_id JOIN a y ON y.vec_id = base_id WHERE x.centroid_id <> y.centroid_id), "
    "s AS (SELECT f, t FROM l UNION ALL SELECT t, f FROM l), g AS (SELECT f AS from_id, t AS to_id, count(*) AS count FROM s GROUP BY 1, 2) "
    "SELECT from_id, to_id, count, round(count::DOUBLE / max(count) OVER (PARTITION BY from_id), 9) AS weight FROM g",
)
def centroid_affinity(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    links = S.knn(e, e, 10, exclude_self=True).select(F.col("query_id").alias("src"), F.col("base_id").alias("dst"))
    return C.graph_affinity(links, C.assign(e, _first(e))).withColumn("weight", F.round("weight", 9))


# evaluation

_EVAL = f"""{_HASHED}, {_KNN}, n AS (SELECT count(*) AS n FROM hs),
rk AS (SELECT vec_id, hash, row_number() OVER (ORDER BY hash, vec_id) - 1 AS rank FROM hs),
po AS (SELECT q.vec_id AS query_id, q.hash AS qh, least(any_value(n.n) - 1, count(b.vec_id)) AS pos FROM hs q LEFT JOIN hs b ON b.hash < q.hash, n WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
nb AS (SELECT query_id, nn_rank, base_id, rank, pos, n.n AS n, 1.0::DOUBLE / log2(nn_rank + 1.0::DOUBLE) AS weight, abs(rank - pos) AS rank_gap, abs(rk.hash - qh)::DOUBLE AS hash_gap
       FROM kn JOIN rk ON rk.vec_id = base_id JOIN po USING (query_id), n)"""
_NODES = (32, 64, 128)
_RING = """
rg2 AS (SELECT nb.*, nc, abs(least(pos * nc // n, nc - 1) - least(rank * nc // n, nc - 1)) AS apart FROM nb, (VALUES (32), (64), (128)) v(nc)),
ri AS (SELECT *, least(apart, nc - apart) AS ring FROM rg2),
nm AS (SELECT nc::BIGINT AS node_count, avg(CASE WHEN ring = 0 THEN 1.0 ELSE 0 END) AS same, avg(CASE WHEN ring <= 1 THEN 1.0 ELSE 0 END) AS near_1, avg(CASE WHEN ring <= 2 THEN 1.0 ELSE 0 END) AS near_2,
       avg(CASE WHEN ring <= 4 THEN 1.0 ELSE 0 END) AS near_4, avg(ring / (nc * 0.5)) AS distance_norm, sum(weight / (1.0 + ring)) / sum(weight) AS overlay FROM ri GROUP BY nc),
qo AS (SELECT query_id, sum(weight / (1.0 + ring)) / sum(weight) AS overlay FROM ri GROUP BY query_id)"""


def _neighbours(spark, sf_dir, bits: int = 32):
    e = _embeddings(spark, sf_dir)
    own = F.col("hash").cast("bigint") if bits < 64 else F.col("hash_hex")
    hashed = _plain_hash(e, bits).apply(e).select("vec_id", own.alias("hash"))
    queries = hashed.filter("vec_id % 100 = 0")
    truth = S.knn(e.filter("vec_id % 100 = 0"), e, 10, exclude_self=True)
    return hashed, queries, truth


@register("base_rank", f"WITH {_HASHED} SELECT vec_id AS base_id, hash, row_number() OVER (ORDER BY hash, vec_id) - 1 AS rank FROM hs")
def base_rank(spark, sf_dir):
    return E.base_ranks(_neighbours(spark, sf_dir)[0])


@register("base_rank_by_ranges", f"WITH {_HASHED} SELECT vec_id AS base_id, hash, row_number() OVER (ORDER BY hash, vec_id) - 1 AS rank FROM hs")
def base_rank_by_ranges(spark, sf_dir):
    with by_ranges(spark):
        return E.base_ranks(_neighbours(spark, sf_dir)[0])


@register(
    "recall_ladder_by_ranges",
    f"WITH {_EVAL} SELECT w::BIGINT AS \"window\", round(avg(CASE WHEN rank_gap <= w THEN 1.0 ELSE 0 END), 9) AS recall FROM nb, (VALUES (5), (50)) v(w) GROUP BY w",
)
def recall_ladder_by_ranges(spark, sf_dir):
    with by_ranges(spark):
        return E.recall_by_window(E.neighbour_table(*_neighbours(spark, sf_dir)), [5, 50]).withColumn("recall", F.round("recall", 9))


@register(
    "query_lower_bound_pos",
    f"WITH {_HASHED}, n AS (SELECT count(*) AS n FROM hs) SELECT q.vec_id AS query_id, least(any_value(n.n) - 1, count(b.vec_id)) AS pos "
    "FROM hs q LEFT JOIN hs b ON b.hash < q.hash, n WHERE q.vec_id % 100 = 0 GROUP BY 1",
)
def query_lower_bound_pos(spark, sf_dir):
    hashed, queries, _ = _neighbours(spark, sf_dir)
    return S.lower_bound_positions(hashed, queries, "hash", "vec_id", "vec_id")


@register(
    "recall_in_window_ladder",
    f"WITH {_EVAL} SELECT w::BIGINT AS \"window\", round(avg(CASE WHEN rank_gap <= w THEN 1.0 ELSE 0 END), 9) AS recall FROM nb, (VALUES (5), (20), (50), (100)) v(w) GROUP BY w",
)
def recall_in_window_ladder(spark, sf_dir):
    found = E.recall_by_window(E.neighbour_table(*_neighbours(spark, sf_dir)), [5, 20, 50, 100])
    return found.withColumn("recall", F.round("recall", 9))


@register(
    "rank_distance",
    f"WITH {_EVAL} SELECT round(avg(rank_gap), 6) AS mean_rank_distance, round(avg(rank_gap / n), 9) AS rank_distance, round(avg(hash_gap) / 4294967296, 9) AS hash_distance FROM nb",
)
def rank_distance(spark, sf_dir):
    return E.neighbour_table(*_neighbours(spark, sf_dir)).agg(
        F.round(F.avg("rank_gap"), 6).alias("mean_rank_distance"),
        F.round(F.avg(F.col("rank_gap") / F.col("n")), 9).alias("rank_distance"),
        F.round(F.avg("hash_gap") / 4294967296.0, 9).alias("hash_distance"),
    )


@register(
    "overlay_match_by_nodes",
    f"WITH {_EVAL}, {_RING} SELECT node_count, round(same, 9) AS same, round(near_1, 9) AS near_1, round(near_2, 9) AS near_2, round(near_4, 9) AS near_4, round(distance_norm, 9) AS distance_norm, round(overlay, 9) AS overlay FROM nm",
)
def overlay_match_by_nodes(spark, sf_dir):
    m = E.node_metrics(E.neighbour_table(*_neighbours(spark, sf_dir)), list(_NODES))
    return m.select("node_count", *[F.round(c, 9).alias(c) for c in ("same", "near_1", "near_2", "near_4", "distance_norm", "overlay")])


@register(
    "node_locality",
    f"WITH {_EVAL}, {_RING} SELECT round(avg(least(greatest(0.35 * same + 0.30 * near_1 + 0.20 * near_2 + 0.10 * near_4 + 0.05 * (1 - least(greatest(distance_norm, 0), 1)), 0), 1)), 9) AS node_locality, "
    "round(avg(overlay), 9) AS overlay FROM nm",
)
def node_locality(spark, sf_dir):
    m = E.node_locality(E.node_metrics(E.neighbour_table(*_neighbours(spark, sf_dir)), list(_NODES)))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@register(
    "per_query_percentiles",
    f"WITH {_EVAL}, {_RING} SELECT round(quantile_disc(overlay, 0.05), 9) AS p05, round(quantile_disc(overlay, 0.5), 9) AS p50, round(quantile_disc(overlay, 0.95), 9) AS p95 FROM qo",
)
def per_query_percentiles(spark, sf_dir):
    per = E.query_overlay(E.neighbour_table(*_neighbours(spark, sf_dir)), list(_NODES))
    out = E.nearest_rank_percentiles(per, "overlay", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@register(
    "interpolated_percentiles",
    "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events",
)
def interpolated_percentiles(spark, sf_dir):
    out = E.interpolated_percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register(
    "recall_auc",
    f"WITH {_EVAL}, r AS (SELECT w, avg(CASE WHEN rank_gap <= w THEN 1.0 ELSE 0 END) AS y FROM nb, (VALUES (5), (20), (50), (100)) v(w) GROUP BY w), "
    "s AS (SELECT ln(w) - lag(ln(w)) OVER (ORDER BY w) AS dx, (y + lag(y) OVER (ORDER BY w)) * 0.5 AS m FROM r) SELECT round(sum(dx * m) / sum(dx), 9) AS auc FROM s",
)
def recall_auc(spark, sf_dir):
    ladder = E.recall_by_window(E.neighbour_table(*_neighbours(spark, sf_dir)), [5, 20, 50, 100])
    return E.recall_auc(ladder).select(F.round("auc", 9).alias("auc"))


@register(
    "locality_grouping_sets",
    f"WITH {_EVAL}, {_RING} SELECT nc::BIGINT AS node_count, round(avg(ring), 9) AS mean_ring, count(*) AS rows FROM ri GROUP BY GROUPING SETS ((nc), ())",
)
def locality_grouping_sets(spark, sf_dir):
    nb = E.neighbour_table(*_neighbours(spark, sf_dir))
    ladder = spark.createDataFrame([(c,) for c in _NODES], "node_count bigint")
    count = F.col("node_count")
    at = lambda p: F.least(F.floor(F.col(p) * count / F.col("n")), count - 1)
    ring = nb.crossJoin(F.broadcast(ladder)).withColumn("apart", F.abs(at("pos") - at("rank"))).withColumn("ring", F.least("apart", count - F.col("apart")))
    return ring.groupingSets([["node_count"], []], "node_count").agg(F.round(F.avg("ring"), 9).alias("mean_ring"), F.count(F.lit(1)).alias("rows"))


_ALL = f"""{_EVAL}, {_RING},
wl AS (SELECT w, avg(CASE WHEN rank_gap <= w THEN 1.0 ELSE 0 END) AS y FROM nb, (VALUES (10), (50), (100)) v(w) GROUP BY w),
ws AS (SELECT ln(w) - lag(ln(w)) OVER (ORDER BY w) AS dx, (y + lag(y) OVER (ORDER BY w)) * 0.5 AS m FROM wl),
au AS (SELECT sum(dx * m) / sum(dx) AS auc FROM ws),
ov AS (SELECT avg(CASE WHEN rank_gap <= least(1000, n // 10 + 1) THEN 1.0 ELSE 0 END) AS recall, avg(rank_gap / n) AS rank_distance,
       quantile_disc(rank_gap / n, 0.5) AS rank_p50, quantile_disc(rank_gap / n, 0.95) AS rank_p95, quantile_disc(rank_gap / n, 0.99) AS rank_p99 FROM nb),
lo AS (SELECT avg(least(greatest(0.35 * same + 0.30 * near_1 + 0.20 * near_2 + 0.10 * near_4 + 0.05 * (1 - least(greatest(distance_norm, 0), 1)), 0), 1)) AS node_locality, avg(overlay) AS overlay FROM nm),
pq AS (SELECT quantile_disc(overlay, 0.05) AS overlay_p05, quantile_disc(overlay, 0.5) AS overlay_p50, quantile_disc(overlay, 0.95) AS overlay_p95 FROM qo),
ev AS (SELECT *, least(greatest(0.50 * overlay + 0.20 * node_locality + 0.15 * auc + 0.10 * overlay_p05 + 0.05 * (1 - least(greatest(rank_p50, 0), 1)), 0), 1) AS quality FROM ov, au, lo, pq)"""
_FIGURES = "recall rank_distance auc node_locality overlay rank_p50 rank_p95 rank_p99 overlay_p05 overlay_p50 overlay_p95 quality".split()
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in _FIGURES)


def _evaluated(spark, sf_dir, bits: int):
    return E.evaluate(*_neighbours(spark, sf_dir, bits), bits, [10, 50, 100], list(_NODES)).select(*[F.round(c, 9).alias(c) for c in _FIGURES])


@register("layout_evaluation", f"WITH {_ALL} SELECT {_ROUNDED} FROM ev")
def layout_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir, 32)


for _bits in (128, 256):

    @register(f"layout_evaluation_{_bits}", f"WITH {_ALL.replace(_HASHED, _WIDE)} SELECT {_ROUNDED} FROM ev")
    def layout_evaluation_wide(spark, sf_dir, bits=_bits):
        return _evaluated(spark, sf_dir, bits)


@register(
    "truth_groundtruth_check",
    f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), {_KNN} SELECT count(*) AS rows, sum(CASE WHEN base_id < 0 OR base_id >= (SELECT count(*) FROM e) THEN 1 ELSE 0 END)::BIGINT AS out_of_bounds, 0::BIGINT AS unordered FROM kn WHERE query_id % 100 = 0",
)
def truth_check(spark, sf_dir):
    from ranklore.sources.truth import truth_faults

    e = _embeddings(spark, sf_dir)
    return truth_faults(S.knn(e.filter("vec_id % 100 = 0"), e, 10, exclude_self=True), e.count())


@register(
    "vector_norm_bands",
    "SELECT label, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS mean_norm FROM embeddings GROUP BY label",
)
def vector_norm_bands(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return e.groupBy("label").agg(F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))
