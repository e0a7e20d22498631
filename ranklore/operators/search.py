"""Exact vector search as DataFrame operators.

The stated query set is small against the base: it is cut into blocks of a checked
size, each block is broadcast, and one pass over the base's Arrow batches keeps the
best ``k`` of every batch (a partial top-k); a window merges the partial lists. What
is shuffled is k rows per query and batch, never the pairs. Ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklore.functions.vectors import METRICS

#: Most query bytes in one broadcast block.
BLOCK_BYTES = 32 << 20
_TILE = 1 << 22
_ROWS = 1 << 16  # pairs whose vectors are held at once
_SMALL = 1 << 16  # entries of a batch, up to which all distances are made one by one


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


#: Up to so many queries come to the driver in one Arrow table; more, partition by partition.
FEW_QUERIES = 10_000
#: Blocks of a search, each of them a scan of the base; more are an error: ask in parts.
MAX_BLOCKS = 1024


def _blocks(queries: DataFrame, query_id: str, vector: str):
    """Query blocks of at most BLOCK_BYTES, as (ids, matrix) on the driver, one at a time, in order of ids."""
    slim = queries.select(query_id, vector)
    if slim.count() <= FEW_QUERIES:
        table = slim.toArrow().sort_by(query_id).combine_chunks()
        ids, q = np.asarray(table[0]), _matrix(table[1].combine_chunks()) if table.num_rows else np.empty((0, 0))
        step = max(1, BLOCK_BYTES // max(8 * q.shape[1], 1))
        for i in range(0, len(ids), step):
            yield ids[i : i + step], q[i : i + step]
        return
    ids, rows, size, blocks = [], [], 0, 0
    for row in slim.orderBy(query_id).toLocalIterator(prefetchPartitions=True):
        ids.append(row[0])
        rows.append(row[1])
        size += 8 * len(row[1])
        if size >= BLOCK_BYTES:
            blocks += 1
            if blocks > MAX_BLOCKS:
                raise ValueError(f"more than {MAX_BLOCKS} blocks of {BLOCK_BYTES >> 20} MB: ask in parts")
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def _distances(block, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = max(1, _TILE // max(1, b.size))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.concatenate([block(q[i : i + step], b) for i in range(0, len(q), step)])


def _near_l2(q: np.ndarray, b: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(query, row, distance) of all rows that may be among the k nearest: products bound the distances, which
    are then made as ``METRICS`` makes them, for these rows alone. None where products tell nothing."""
    qq, bb = (q * q).sum(1), (b * b).sum(1)
    scale = qq[:, None].max(initial=0.0) + bb.max(initial=0.0)
    if not np.isfinite(scale):
        return None
    d = qq[:, None] + bb[None, :] - 2.0 * (q @ b.T)
    if own is not None:
        d[own] = np.inf
    bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    at, pos = np.nonzero((d <= bound + 8.0 * (q.shape[1] + 4) * np.finfo(np.float64).eps * scale) & (d < np.inf))
    return at, pos, np.concatenate([((q[at[i : i + _ROWS]] - b[pos[i : i + _ROWS]]) ** 2).sum(-1) for i in range(0, len(at), _ROWS)] or [np.empty(0)])


def _scan(shared, metric: str, k: int | None, radius: float | None, exclude_self: bool):
    kind = METRICS[metric]

    def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = q_ids[:, None] == ids[None, :] if exclude_self else None
        if metric == "l2" and radius is None and base.size > _SMALL and (told := _near_l2(q, base, own, min(k, len(base)))) is not None:
            at, pos, found = told
            d = order_by = None
        else:
            d = _distances(kind.block, q, base)
            order_by = d if kind.ascending else -d
            if exclude_self:
                order_by = np.where(own, np.nan, order_by)
        if radius is not None:
            at, pos = np.nonzero(order_by < (radius if kind.ascending else -radius))
        elif order_by is not None:
            # candidates: all that are not farther than the k-th nearest, so ties stay
            kept = min(k, base.shape[0])
            ranked = np.where(np.isnan(order_by), np.inf, order_by)
            bound = np.partition(ranked, kept - 1, axis=1)[:, kept - 1 : kept]
            at, pos = np.nonzero((ranked <= bound) & ~np.isnan(order_by))
        if d is not None:
            found = d[at, pos]
        if radius is None:
            at, pos, found = _best_of_batch(at, ids[pos], found if kind.ascending else -found, k)
            return q_ids[at], pos, found if kind.ascending else -found
        return q_ids[at], ids[pos], found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, base = np.asarray(batch.column(0)), _matrix(batch.column(1))
            step = max(1, _TILE // len(base))  # queries whose distances to a batch are held at once
            for i in range(0, len(q), step):
                at, pos, d = nearest(q_ids[i : i + step], q[i : i + step], ids, base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array(pos, pa.int64()), pa.array(d, pa.float64())], ["query_id", "base_id", "distance"]
                )

    return scan


def _best_of_batch(at: np.ndarray, ids: np.ndarray, order_by: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's candidates the k first by distance and id."""
    order = np.lexsort((ids, order_by, at))
    at, ids, order_by = at[order], ids[order], order_by[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], ids[first], order_by[first]


def _pairs(queries, base, metric, k, radius, exclude_self, ids, vector) -> DataFrame:
    spark = base.sparkSession
    schema = "query_id bigint, base_id bigint, distance double"
    slim = base.select(F.col(ids[1]).cast("bigint").alias("base_id"), F.col(vector))
    parts = []
    for q_ids, q in _blocks(queries, ids[0], vector):
        shared = spark.sparkContext.broadcast((q_ids, q))
        parts.append(slim.mapInArrow(_scan(shared, metric, k, radius, exclude_self), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def top_k(pairs: DataFrame, k: int, ascending: bool = True, group: str = "query_id") -> DataFrame:
    """Best ``k`` rows per group with their rank from 1; ties go to the lower base id.
    Spark limits each partition to k rows a group before the shuffle."""
    order = F.col("distance") if ascending else F.desc("distance")
    ranked = pairs.withColumn("nn_rank", F.row_number().over(Window.partitionBy(group).orderBy(order, "base_id")))
    return ranked.filter(F.col("nn_rank") <= k)


def merge_top_k(shards: list[DataFrame], k: int, ascending: bool = True) -> DataFrame:
    """Merge result lists of shards or replicas into one top-k."""
    return top_k(reduce(DataFrame.unionByName, [s.select("query_id", "base_id", "distance") for s in shards]), k, ascending)


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2",
    exclude_self: bool = False,
    ids: tuple[str, str] = ("vec_id", "vec_id"),
    vector: str = "embedding",
) -> DataFrame:
    """query_id, base_id, distance, nn_rank: the k nearest base rows of each query."""
    if k < 1:
        raise ValueError("k must be positive")
    pairs = _pairs(queries, base, metric, k, None, exclude_self, ids, vector)
    return top_k(pairs, k, METRICS[metric].ascending)


def range_search(
    queries: DataFrame,
    base: DataFrame,
    radius: float,
    metric: str = "l2",
    exclude_self: bool = False,
    ids: tuple[str, str] = ("vec_id", "vec_id"),
    vector: str = "embedding",
) -> DataFrame:
    """All pairs nearer than ``radius`` (for similarities: greater than it)."""
    return _pairs(queries, base, metric, None, radius, exclude_self, ids, vector)


def distances_by_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: str = "l2") -> DataFrame:
    """Distance of explicit (left_id, right_id) pairs: two equi joins and a projection."""
    a = left.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("__a"))
    b = right.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("__b"))
    joined = pairs.join(a, "left_id").join(b, "right_id")
    return joined.withColumn("distance", METRICS[metric].column(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def rank_candidates(queries: DataFrame, base: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's own candidates (query_id, base_id), by exact squared distance.

    The queries and their candidates, a stated set and a few each, are broadcast in blocks of at
    most BLOCK_BYTES; a scan of the base picks out the candidates. Base vectors are not shuffled.
    """
    own = candidates.groupBy("query_id").agg(F.sort_array(F.collect_set("base_id")).alias("wanted"))  # a few a query
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(own, "query_id").select("query_id", "embedding", "wanted")
    spark, parts = base.sparkSession, []
    slim = base.select(F.col("vec_id").cast("bigint").alias("base_id"), "embedding")

    def block(rows: list) -> DataFrame:
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        wanted = np.concatenate([np.array(r[2], np.int64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        order = np.argsort(wanted, kind="stable")
        shared = spark.sparkContext.broadcast((ids, q, wanted[order], owner[order]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, wanted, owner = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = np.asarray(batch.column(0))
                first, last = np.searchsorted(wanted, held, "left"), np.searchsorted(wanted, held, "right")
                counts = last - first
                if not counts.any():
                    continue
                row = np.repeat(np.arange(len(held)), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                x = _matrix(batch.column(1))
                d = ((q[owner[place]] - x[row]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[place]], pa.int64()), pa.array(held[row], pa.int64()), pa.array(d)], ["query_id", "base_id", "distance"]
                )

        return slim.mapInArrow(scan, "query_id bigint, base_id bigint, distance double")

    rows, size = [], 0
    for row in asked.toLocalIterator():
        rows.append(row)
        size += 8 * (len(row[1]) + 2 * len(row[2]))
        if size >= BLOCK_BYTES:
            parts.append(block(rows))
            rows, size = [], 0
    if rows:
        parts.append(block(rows))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id bigint, base_id bigint, distance double")
    return top_k(found, k)


def knn_by_lists(queries: DataFrame, base: DataFrame, lists: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """kNN of each query among its own candidate ids (``lists``: query_id, candidates array)."""
    pairs = lists.select(F.col("query_id").alias("left_id"), F.explode("candidates").alias("right_id")).distinct()
    found = distances_by_pairs(pairs, queries, base, metric)
    return top_k(found.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("base_id"), "distance"), k, METRICS[metric].ascending)


# id selectors: predicates on an id column that combine like columns do


def ids_between(id_column: str, low: int, high: int) -> Column:
    return (F.col(id_column) >= low) & (F.col(id_column) < high)


def ids_in(id_column: str, ids: list[int]) -> Column:
    return F.col(id_column).isin(ids)


def ids_in_bitmap(id_column: str, bitmap: bytes, repeats: bool = False) -> Column:
    """Bit i of byte i // 8 selects id i; beyond its end the bitmap begins again (``repeats``) or selects nothing."""
    word, bits, own = F.lit(bytearray(bitmap)), 8 * len(bitmap), F.col(id_column)
    place = own % bits if repeats else own
    byte = F.conv(F.hex(F.substring(word, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = (own >= 0) if repeats else (own >= 0) & (own < bits)
    return F.when(inside, byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).otherwise(F.lit(False))


def ids_xor(a: Column, b: Column) -> Column:
    return a != b


def lower_bound_positions(base: DataFrame, queries: DataFrame, key: str, base_id: str, query_id: str) -> DataFrame:
    """query_id, pos: number of base rows whose key is less than the query's, at most n - 1.

    The as-of join by running count: base and query keys are ordered together, queries
    before equal base keys; positions come from a range-partitioned order.
    """
    from ranklore.plans.ranking import with_position

    n, asking = base.count(), queries.count()
    union = base.select(F.col(key).alias("__k"), F.lit(1).alias("__is_base"), F.lit(None).cast("bigint").alias("query_id")).unionByName(
        queries.select(F.col(key).alias("__k"), F.lit(0).alias("__is_base"), F.col(query_id).cast("bigint").alias("query_id"))
    )
    placed = with_position(union, ["__k", "__is_base", "query_id"], "__p", rows=n + asking)
    asked = placed.filter("__is_base = 0").select("query_id", "__k", "__p")
    # a query's own order number, subtracted, leaves the base rows before it
    return with_position(asked, ["__p"], "__before", rows=asking).select(
        "query_id", F.least(F.col("__p") - F.col("__before"), F.lit(max(n - 1, 0))).cast("bigint").alias("pos")
    )


def spot_check(queries: DataFrame, base: DataFrame, truth: DataFrame, k: int, tolerance: float = 1e-6) -> DataFrame:
    """Rows of ``truth`` (query_id, base_id) farther than the exact k-th distance allows; empty if it is sound."""
    exact = knn(queries, base, k).groupBy("query_id").agg(F.max("distance").alias("kth"))
    told = distances_by_pairs(
        truth.select(F.col("query_id").alias("left_id"), F.col("base_id").alias("right_id")), queries, base
    ).withColumnRenamed("left_id", "query_id")
    return told.join(exact, "query_id").filter(
        F.col("distance") > F.col("kth") + F.greatest(F.lit(tolerance), 1e-5 * F.col("kth"))
    )
