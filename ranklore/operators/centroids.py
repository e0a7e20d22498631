"""Centroids: nearest-centroid joins, k-means, order along a line, hash ranges, affinity.

The data side is distributed; the centroid side is a model of a size that the caller
chooses (checked against ``MODEL_BYTES``) and works on the driver or as a broadcast.
Squared distances sum double differences left to right; ties go to the lower id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklore.functions.wide import WIDE, check_bits, divided
from ranklore.plans.ranking import hashed_first

MODEL_BYTES = 256 << 20
#: Fixed values of the order graph: discount per unit of affinity, least factor, cap of graph edges, kept row length.
AFFINITY_DISCOUNT, LEAST_FACTOR, EDGE_CAP, ROW_TOP = 0.25, 0.05, 1.25, 128
SPLIT_EPSILON = 1 / 1024
GAIN_EPSILON = 1e-12


def checked(centroids: np.ndarray) -> np.ndarray:
    centroids = np.asarray(centroids, np.float64)
    if centroids.ndim != 2 or not len(centroids):
        raise ValueError("centroids must be a non-empty matrix")
    if centroids.nbytes > MODEL_BYTES:
        raise ValueError("the centroids are too large for a broadcast model")
    return centroids


def squared_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(queries, centroids), summed left to right over the dimensions."""
    out = np.zeros((len(q), len(c)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - c[None, :, j]
        out += d * d
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _assigner(shared, k: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        step = max(1, (8 << 20) // max(1, len(c)))
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _vectors(batch.column(batch.num_columns - 1))
            near, dist = [], []
            for i in range(0, len(q), step):
                d = squared_distances(q[i : i + step], c)
                order = np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None]
                near.append(ids[order])
                dist.append(np.take_along_axis(d, order, axis=1))
            near, dist = np.concatenate(near), np.concatenate(dist)
            width = near.shape[1]
            rank = np.tile(np.arange(1, width + 1, dtype=np.int32), len(q))
            at = pa.array(np.repeat(np.arange(len(q)), width))
            yield pa.RecordBatch.from_arrays(
                [
                    *[col.take(at) for col in batch.columns[:-1]],
                    pa.array(near.ravel(), pa.int64()),
                    pa.array(dist.ravel(), pa.float64()),
                    pa.array(rank),
                ],
                [*batch.schema.names[:-1], "centroid_id", "d2", "nn_rank"],
            )

    return assign


def nearest_centroids(
    df: DataFrame, centroids: np.ndarray, k: int = 1, active: np.ndarray | None = None, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding"
) -> DataFrame:
    """``keep`` columns with the k nearest active centroids: centroid_id, d2, nn_rank."""
    c = checked(centroids)
    ids = np.arange(len(c)) if active is None else np.asarray(active)
    if not len(ids):
        raise ValueError("no active centroid")
    shared = df.sparkSession.sparkContext.broadcast((ids, c[ids]))
    slim = df.select(*keep, vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != vector)
    return slim.mapInArrow(_assigner(shared, min(k, len(ids))), f"{fields}, centroid_id bigint, d2 double, nn_rank int")


def assign(df: DataFrame, centroids: np.ndarray, active=None, keep=("vec_id",), vector: str = "embedding") -> DataFrame:
    """``keep`` columns with centroid_id and d2 of the nearest active centroid."""
    return nearest_centroids(df, centroids, 1, active, keep, vector).drop("nn_rank")


def active_centroids(ranges: list[tuple[int, bool]]) -> np.ndarray:
    """Ids whose (range_size, full) leaves them any hash."""
    return np.array([i for i, (size, full) in enumerate(ranges) if full or size], np.int64)


def mass(assigned: DataFrame) -> DataFrame:
    """centroid_id, mass."""
    return assigned.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("mass"))


def imbalance_factor(assigned: DataFrame, k: int) -> DataFrame:
    """k sum(h^2) / (sum h)^2 over the masses."""
    h = F.col("mass").cast("double")
    return mass(assigned).agg((F.lit(float(k)) * F.sum(h * h) / (F.sum(h) * F.sum(h))).alias("imbalance"))


# k-means


def _partial_sums(shared):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count, objective = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _vectors(batch.column(0))
            step = max(1, (8 << 20) // max(1, len(c)))
            for i in range(0, len(q), step):
                d = squared_distances(q[i : i + step], c)
                near = d.argmin(axis=1)
                np.add.at(total, near, q[i : i + step])
                count += np.bincount(near, minlength=len(c))
                objective += np.bincount(near, d[np.arange(len(near)), near], minlength=len(c))
        held = np.flatnonzero(count)
        flat = pa.array(total[held].ravel())
        offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * c.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(count[held]), pa.array(objective[held]), pa.ListArray.from_arrays(offsets, flat)],
            ["centroid_id", "n", "objective", "total"],
        )

    return sums


def kmeans_step(df: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray, float]:
    """One round: new centroids (old ones where no row came), rows of each, sum of squared distances.
    Each task sends one partial sum a centroid; they are added up by (centroid, dimension)."""
    c = checked(centroids)
    shared = df.sparkSession.sparkContext.broadcast(c)
    parts = df.select(vector).mapInArrow(_partial_sums(shared), "centroid_id bigint, n bigint, objective double, total array<double>")
    dims = c.shape[1]
    summed = parts.groupBy("centroid_id").agg(
        F.sum("n").alias("n"), F.sum("objective").alias("objective"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(dims)]).alias("total")
    )
    out, counts, objective = c.copy(), np.zeros(len(c), np.int64), 0.0
    for row in summed.collect():  # one row a centroid
        counts[row["centroid_id"]] = row["n"]
        out[row["centroid_id"]] = np.array(row["total"]) / row["n"]
        objective += row["objective"]
    return out, counts, objective


def split_empty(centroids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Give each empty centroid half of the largest: both copies are moved apart by a factor of 1/1024."""
    out, counts = centroids.copy(), counts.copy()
    sign = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1.0, -1.0) * SPLIT_EPSILON
    for empty in np.flatnonzero(counts == 0):
        big = int(counts.argmax())
        out[empty] = out[big] * (1 + sign)
        out[big] = out[big] * (1 - sign)
        counts[empty] = counts[big] // 2
        counts[big] -= counts[empty]
    return out


def kmeans(
    df: DataFrame,
    k: int,
    iterations: int = 20,
    seed: int = 0,
    max_points_per_centroid: int | None = 256,
    spherical: bool = False,
    integer: bool = False,
    frozen: bool = False,
    init: np.ndarray | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> tuple[np.ndarray, list[float]]:
    """Lloyd rounds from hashed random rows; stops early when the objective stands still.

    More than ``max_points_per_centroid`` * k rows are sampled by hash (a training bound;
    None trains on all rows). ``spherical`` normalises, ``integer`` rounds the centroids
    each round, ``frozen`` keeps ``init``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n = df.count()
    if n < k:
        raise ValueError(f"{n} rows cannot make {k} centroids")
    drawn = df.withColumn("__h", F.xxhash64(F.col(vec_id), F.lit(seed)))
    if init is None:
        rows = hashed_first(df, k, vec_id, seed).select(vector).collect()
        init = np.array([r[0] for r in rows], np.float64)
    c = checked(init)
    bad = df.filter(F.exists(vector, lambda x: F.isnan(x.cast("double")) | (F.abs(x) == float("inf"))))
    if not bad.isEmpty():
        raise ValueError("vectors hold NaN or infinite entries")
    if frozen:
        return c, []
    points = df.select(vector)
    if max_points_per_centroid and n > max_points_per_centroid * k:
        share = max_points_per_centroid * k / n
        low = F.lit(int(-(2**63) + share * 2**64 - 1))
        points = drawn.filter(F.col("__h") <= low).select(vector)
    points = points.persist()
    objectives: list[float] = []
    try:
        for _ in range(iterations):
            c, counts, objective = kmeans_step(points, c, vector)
            c = split_empty(c, counts)
            if spherical:
                length = np.linalg.norm(c, axis=1, keepdims=True)
                c = np.where(length > 0, c / np.where(length > 0, length, 1), c)
            if integer:
                c = np.round(c)
            objectives.append(objective)
            if len(objectives) > 1 and objectives[-1] == objectives[-2]:
                break
    finally:
        points.unpersist()
    return c, objectives


def plus_plus_init(df: DataFrame, k: int, seed: int = 0, vec_id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """k-means++: each next centroid is the row with the greatest hash-weighted distance (exponential races)."""
    drawn = df.withColumn("__u", (F.pmod(F.xxhash64(F.col(vec_id), F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1))
    chosen = [np.array(drawn.orderBy("__u", vec_id).first()[vector], np.float64)]
    while len(chosen) < k:
        near = assign(drawn.withColumn("__v", F.col(vector)), np.array(chosen), keep=(vec_id, "__u", vector), vector="__v")
        race = F.when(F.col("d2") > 0, -F.ln(F.col("__u")) / F.col("d2")).otherwise(float("inf"))
        chosen.append(np.array(near.orderBy(race, vec_id).first()[vector], np.float64))
    return np.array(chosen)


def kmeans_1d(values: np.ndarray, k: int) -> np.ndarray:
    """Optimal k means of sorted numbers by dynamic programming (a model-sized input)."""
    x = np.sort(np.asarray(values, np.float64))
    n = len(x)
    if n <= k:
        return x
    s, q = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))

    def cost(i, j):
        m = j - i
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / m

    best = np.array([cost(0, j) if j else 0.0 for j in range(n + 1)])
    cuts = []
    for _ in range(1, k):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            i = np.arange(j)
            total = best[:j] + (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (j - i)
            cut[j] = int(total.argmin())
            new[j] = total[cut[j]]
        cuts.append(cut)
        best = new
    ends = [n]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    ends.append(0)
    ends = ends[::-1]
    return np.array([x[a:b].mean() for a, b in zip(ends, ends[1:], strict=False) if b > a])


# order


def knn_edges(centroids: np.ndarray, knn: int) -> list[tuple[int, int, float]]:
    """(from, to, d2) to the ``knn`` nearest other centroids of each."""
    c = checked(centroids)
    out = []
    for i in range(len(c)):
        d = squared_distances(c[i : i + 1], c)[0]
        near = [j for j in np.argsort(d, kind="stable").tolist() if j != i][:knn]
        out += [(i, j, float(d[j])) for j in near]
    return out


def _tree(k: int, edges: dict[tuple[int, int], float], centroids: np.ndarray) -> dict[int, list[tuple[float, int]]]:
    """Spanning tree from centroid 0 by (weight, from, to); parts that no edge reaches are
    hung on at their nearest pair."""
    links: dict[int, list[tuple[float, int, int]]] = {}
    for (a, b), w in edges.items():
        links.setdefault(a, []).append((w, a, b))
        links.setdefault(b, []).append((w, b, a))
    tree: dict[int, list[tuple[float, int]]] = {i: [] for i in range(k)}
    inside = np.zeros(k, bool)
    heap: list[tuple[float, int, int]] = []

    def enter(node):
        inside[node] = True
        for edge in links.get(node, []):
            if not inside[edge[2]]:
                heapq.heappush(heap, edge)

    enter(0)
    while not inside.all():
        while heap and inside[heap[0][2]]:
            heapq.heappop(heap)
        if heap:
            w, a, b = heapq.heappop(heap)
        else:
            outs = np.flatnonzero(~inside)
            ins = np.flatnonzero(inside)
            b = int(outs[0])
            d = squared_distances(centroids[b : b + 1], centroids[ins])[0]
            a, w = int(ins[d.argmin()]), float(d.min())
        tree[a].append((w, b))
        tree[b].append((w, a))
        enter(b)
    return tree


def _walk(tree: dict[int, list[tuple[float, int]]]) -> list[int]:
    """Pre-order from 0, children by (weight, id)."""
    order, stack, seen = [], [0], set()
    while stack:
        node = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append(node)
        stack += [b for _, b in sorted(tree[node], reverse=True) if b not in seen]
    return order


def _two_opt(cycle: list[int], d: np.ndarray, rounds: int) -> list[int]:
    """Up to ``rounds`` exchanges, each the one that shortens the cycle most."""
    n = len(cycle)
    order = np.array(cycle)
    if n < 4:
        return cycle
    for _ in range(rounds):
        after = np.roll(order, -1)
        edge = d[order, after]
        gain = edge[:, None] + edge[None, :] - d[np.ix_(order, order)] - d[np.ix_(after, after)]
        i, j = np.triu_indices(n, 2)
        ok = ~((i == 0) & (j == n - 1))
        i, j = i[ok], j[ok]
        at = int(gain[i, j].argmax())
        if gain[i[at], j[at]] <= GAIN_EPSILON:
            break
        order[i[at] + 1 : j[at] + 1] = order[i[at] + 1 : j[at] + 1][::-1].copy()
    return order.tolist()


def centroid_order(
    centroids: np.ndarray, knn: int = 32, two_opt: int = 8, affinity: dict[tuple[int, int], float] | None = None
) -> list[int]:
    """Centroid ids along a line: kNN graph, spanning tree, pre-order, 2-opt, cut at the longest edge.

    ``affinity`` (weights in [0, 1]) shortens distances by up to a quarter and adds its own
    edges where they are not longer than 1.25 times the row's longest kNN edge.
    """
    c = checked(centroids)
    k = len(c)
    if k == 1:
        return [0]
    raw = squared_distances(c, c)
    d = raw.copy()
    for (a, b), w in (affinity or {}).items():
        d[a, b] = raw[a, b] * max(LEAST_FACTOR, 1 - AFFINITY_DISCOUNT * min(1.0, w))
    if affinity:
        d = np.minimum(d, d.T)
    edges: dict[tuple[int, int], float] = {}
    caps = np.zeros(k)

    def put(a, b):
        edges[(a, b)] = min(edges.get((a, b), np.inf), float(d[a, b]))

    for a, b, w in knn_edges(c, knn):
        caps[a] = max(caps[a], w)
        put(a, b)
    for a, b in affinity or {}:
        if raw[a, b] <= EDGE_CAP * caps[a]:
            put(a, b)
    cycle = _walk(_tree(k, edges, c))
    if two_opt:
        cycle = _two_opt(cycle, d, two_opt)
    lengths = [d[a, b] for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True)]
    cut = (int(np.argmax(lengths)) + 1) % k
    return cycle[cut:] + cycle[:cut]


# hash ranges


@dataclass(frozen=True)
class Range:
    start: int
    size: int
    full: bool = False


def allocate_ranges(masses: list[int], order: list[int], bits: int) -> list[Range]:
    """A contiguous range for each centroid, in order, proportional to its mass: floors first, then
    one unit each to the largest remainders (ties: lower id). One owner of 256 bits is ``full``."""
    check_bits(bits)
    if sorted(order) != list(range(len(masses))):
        raise ValueError("the order must hold every centroid once")
    if any(m < 0 for m in masses) or any(m >= 2**64 for m in masses):
        raise ValueError("a mass is out of range")
    total = sum(masses)
    if not total:
        raise ValueError("the total mass is zero")
    if total >= 2**64:
        raise ValueError("the total mass overflows 64 bits")
    space = 1 << bits
    sizes = [m * space // total for m in masses]
    rest = [m * space % total for m in masses]
    for i in sorted(range(len(masses)), key=lambda i: (-rest[i], i))[: space - sum(sizes)]:
        sizes[i] += 1
    out, start = [Range(0, 0)] * len(masses), 0
    for i in order:
        full = bits == 256 and sizes[i] == space
        out[i] = Range(start, 0 if full else sizes[i], full)
        start += sizes[i]
    return out


def ranges_frame(masses: DataFrame, bits: int) -> DataFrame:
    """The same for (centroid_id, mass, ord) up to 64 bits, as windows over one row a centroid."""
    if check_bits(bits) > 64:
        raise ValueError("wider spaces are allocated by allocate_ranges")
    everything = Window.partitionBy(F.lit(1))
    product = (F.col("mass").cast(WIDE) * F.lit(str(1 << bits)).cast(WIDE)).cast(WIDE)
    total = F.sum(F.col("mass").cast(WIDE)).over(everything).cast(WIDE)
    sized = masses.withColumn("__t", total).withColumn("__q", divided(product, F.col("__t"))).withColumn("__r", (product % F.col("__t")).cast(WIDE))
    left = (F.lit(str(1 << bits)).cast(WIDE) - F.sum("__q").over(everything)).cast(WIDE)
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("__r"), "centroid_id"))
    sized = sized.withColumn("range_size", (F.col("__q") + F.when(nth <= left, 1).otherwise(0).cast(WIDE)).cast(WIDE))
    before = Window.partitionBy(F.lit(1)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("range_size").over(before), F.lit(0)).cast(WIDE)
    return sized.withColumn("range_start", start).select("centroid_id", "mass", "ord", "range_start", "range_size")


def range_owners(hashes: DataFrame, ranges: list[Range], column: str = "hash") -> DataFrame:
    """Add centroid_id: the owner of each hash of up to 64 bits, from the range starts."""
    starts = sorted((r.start, i) for i, r in enumerate(ranges) if r.size)
    bounds, owners = F.array(*[F.lit(Decimal(s)).cast("decimal(20,0)") for s, _ in starts]), F.array(*[F.lit(i) for _, i in starts])
    at = F.size(F.filter(bounds, lambda b: b <= F.col(column))) - 1
    return hashes.withColumn("centroid_id", F.get(owners, at).cast("bigint"))


# affinity of centroids through a neighbour graph


def graph_affinity(edges: DataFrame, labels: DataFrame, top: int = ROW_TOP) -> DataFrame:
    """from_id, to_id, count, weight: how often graph edges (src, dst) link two centroids' members,
    counted both ways, self links left out, the ``top`` most frequent of each, as a share of the row's largest."""
    a = labels.select(F.col("vec_id").alias("src"), F.col("centroid_id").alias("__a"))
    b = labels.select(F.col("vec_id").alias("dst"), F.col("centroid_id").alias("__b"))
    linked = edges.join(a, "src").join(b, "dst").filter(F.col("__a") != F.col("__b"))
    both = linked.select(F.explode(F.array(F.struct(F.col("__a").alias("f"), F.col("__b").alias("t")), F.struct(F.col("__b").alias("f"), F.col("__a").alias("t")))).alias("e"))
    counts = both.groupBy(F.col("e.f").alias("from_id"), F.col("e.t").alias("to_id")).agg(F.count(F.lit(1)).alias("count"))
    row = Window.partitionBy("from_id")
    kept = counts.withColumn("__n", F.row_number().over(row.orderBy(F.desc("count"), "to_id"))).filter(F.col("__n") <= top)
    return kept.withColumn("weight", F.col("count") / F.max("count").over(row)).drop("__n")


def knn_edge_frame(spark: SparkSession, centroids: np.ndarray, knn: int) -> DataFrame:
    return spark.createDataFrame(knn_edges(centroids, knn), "from_id bigint, to_id bigint, d2 double")


# pivots


def pivots(centroids: np.ndarray, count: int = 16, active: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """Farthest-point pivots from the first active centroid, and all centroids' (unsquared) distances to them."""
    c = checked(centroids)
    ids = np.arange(len(c)) if active is None else np.asarray(active)
    chosen = [int(ids[0])]
    nearest = squared_distances(c[ids], c[chosen])[:, 0]
    while len(chosen) < min(count, len(ids)):
        at = int(nearest.argmax())
        if nearest[at] == 0.0:
            break
        chosen.append(int(ids[at]))
        nearest = np.minimum(nearest, squared_distances(c[ids], c[chosen[-1:]])[:, 0])
    return chosen, np.sqrt(squared_distances(c[ids], c[chosen]))


def pruned_nearest(query: np.ndarray, centroids: np.ndarray, pivot_ids: list[int], table: np.ndarray) -> tuple[int, float, int]:
    """Nearest centroid by scanning in the order of the pivots' lower bounds and stopping when
    the bound reaches the best distance; returns (id, d2, distances computed)."""
    q = np.asarray(query, np.float64)[None, :]
    to_pivots = np.sqrt(squared_distances(q, centroids[pivot_ids])[0])
    bounds = (np.abs(table - to_pivots[None, :]).max(axis=1)) ** 2
    best, best_id, seen = np.inf, -1, 0
    for i in np.argsort(bounds, kind="stable").tolist():
        if bounds[i] * (1 - 1e-12) > best:
            break
        d = float(squared_distances(q, centroids[i : i + 1])[0, 0])
        seen += 1
        if d < best or (d == best and i < best_id):
            best, best_id = d, i
    return best_id, best, seen


def wants_pivots(dim: int, k: int) -> bool:
    """Whether pivots can pay: small sets of long vectors are compared one and all."""
    return not ((dim >= 64 and k <= 512) or (dim >= 32 and k <= 256))


def chain_init(sample: np.ndarray, k: int, chain: int = 50, seed: int = 0) -> np.ndarray:
    """k starting centroids from a sample by Markov chains (AFK-MC2): each takes the last state of a chain
    whose proposals mix squared distances to the first centroid with even chances."""
    x = checked(sample)
    if not 0 < k <= len(x):
        raise ValueError(f"{len(x)} rows cannot make {k} centroids")
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    total = far.sum()
    q = (far / total if total > 0 else np.full(len(x), 1 / len(x))) * 0.5 + 0.5 / len(x)
    q /= q.sum()
    while len(chosen) < k:
        proposals, accept = rng.choice(len(x), chain, p=q), rng.random(chain)
        d = ((x[proposals][:, None] - x[chosen][None]) ** 2).sum(-1).min(1)
        state = 0
        for step in range(1, chain):
            up, down = d[step] * q[proposals[state]], d[state] * q[proposals[step]]
            if down == 0 or accept[step] < up / down:
                state = step
        chosen.append(int(proposals[state]))
    return x[chosen].copy()
