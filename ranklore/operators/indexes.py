"""Vector indexes as tables: flat, coded, inverted-file, refined, sharded and binary.

An index is a Parquet-backed table of (vec_id, code[, list_id]) and a small trained
model. Adding appends rows, removing is an anti-join, merging a union, a shard a
filter. A search broadcasts blocks of the stated query set, scans the code table once
per block and merges partial top-k lists. An inverted file is laid out by list, so a
block reads only the folders of the lists that its queries probe. ``store.save_index``
and ``store.load_index`` keep any of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklore.operators import centroids as C
from ranklore.operators import codecs as Q
from ranklore.operators import coarse as K
from ranklore.operators import inverted_lists as L
from ranklore.operators import search as S
from ranklore.operators import transforms as TR
from ranklore.plans.workspace import staged

_RESULT = "query_id bigint, base_id bigint, distance double"


def _codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _keep_best(ids, order_by, d, q_ids, k, radius) -> pa.RecordBatch:
    ranked = np.where(np.isnan(order_by), np.inf, order_by)
    if radius is not None:
        at, pos = np.nonzero(ranked < radius)
    else:
        kept = min(k, ranked.shape[1])
        bound = np.partition(ranked, kept - 1, axis=1)[:, kept - 1 : kept]
        at, pos = np.nonzero((ranked <= bound) & (ranked < np.inf))
    return pa.RecordBatch.from_arrays(
        [pa.array(q_ids[at], pa.int64()), pa.array(ids[pos], pa.int64()), pa.array(d[at, pos], pa.float64())], ["query_id", "base_id", "distance"]
    )


class VectorIndex:
    """Codec index with optional inverted lists and transform; the codec's own distances, or L2 to decoded vectors.

    ``coarse`` decides on lists (unset: ``lists`` trained centroids); with ``coarse_transform`` it
    works on images of the vectors while codes stay in the index's own space.
    """

    def __init__(
        self,
        codec=None,
        lists: int = 0,
        residual: bool = False,
        transform: TR.Transform | None = None,
        iterations: int = 8,
        coarse: K.FlatCoarse | None = None,
        coarse_transform: TR.Transform | None = None,
    ):
        self.codec, self.residual, self.transform = codec or Q.Flat(), residual, transform
        self.coarse = coarse or (K.FlatCoarse(lists, iterations) if lists else None)
        self.coarse_transform = coarse_transform
        self.table: DataFrame | None = None
        if residual and coarse_transform is not None:
            raise ValueError("codes of residuals need lists in the index's own space")

    @property
    def lists(self) -> int:
        return self.coarse.lists if self.coarse else 0

    @property
    def centroids(self) -> np.ndarray | None:
        return self.coarse.centroids if self.coarse else None

    @property
    def partitions(self) -> list[str]:
        return ["list_block"] if self.coarse else []

    # training and maintenance

    def _view(self, df: DataFrame) -> DataFrame:
        slim = df.select("vec_id", "embedding")
        return slim if self.transform is None else self.transform.transform(slim)

    def fit(self, df: DataFrame, centroids: np.ndarray | None = None) -> VectorIndex:
        """Train transform, coarse centroids and codec on a bounded sample (transforms: as they document)."""
        if self.transform is not None:
            self.transform.fit(df)
        view = self._view(df)
        sample = TR.sample_matrix(view)
        if not len(sample):
            raise ValueError("cannot train on an empty table")
        if centroids is not None:
            self.coarse = K.FlatCoarse(centroids=C.checked(centroids))
        if self.coarse_transform is not None:
            self.coarse_transform.fit(view)
        if self.coarse is not None:
            self.coarse.fit(self._coarse_view(sample))
        if self.residual:
            sample = sample - self.centroids[self.coarse.top(sample, 1)[:, 0]]
        self.codec.fit(sample)
        return self

    def _coarse_view(self, x: np.ndarray) -> np.ndarray:
        return x if self.coarse_transform is None else self.coarse_transform.apply(x)

    def _model(self):
        return self.codec, self.coarse, self.residual, self.coarse_transform

    def encode(self, df: DataFrame) -> DataFrame:
        """vec_id, code binary, list_id (0 without lists)."""
        shared = df.sparkSession.sparkContext.broadcast(self._model())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, coarse, residual, image = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _vectors(batch.column(1))
                near = np.zeros(len(x), np.int64) if coarse is None else coarse.top(x if image is None else image.apply(x), 1)[:, 0]
                codes = codec.encode(x - coarse.centroids[near] if residual else x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near)], ["vec_id", "code", "list_id"]
                )

        return self._view(df).mapInArrow(run, "vec_id bigint, code binary, list_id bigint")

    def add(self, df: DataFrame) -> VectorIndex:
        made = self.encode(df)
        rows = L.laid_out(made, self.lists, "index-lists") if self.coarse else staged(made, "index-codes")
        self.table = rows if self.table is None else self.table.unionByName(rows)
        return self

    def remove(self, ids: DataFrame) -> VectorIndex:
        self.table = self.table.join(ids.select("vec_id"), "vec_id", "left_anti")
        return self

    def update(self, df: DataFrame) -> VectorIndex:
        return self.remove(df).add(df)

    def merge(self, other: VectorIndex) -> VectorIndex:
        """Take over another index's rows; both must have been trained alike."""
        if type(self.codec) is not type(other.codec) or (self.centroids is None) != (other.centroids is None):
            raise ValueError("the indexes do not fit together")
        if self.centroids is not None and not np.array_equal(self.centroids, other.centroids):
            raise ValueError("the indexes have different lists")
        self.table = self.table.unionByName(other.table)
        return self

    def reset(self) -> VectorIndex:
        self.table = None
        return self

    def shard(self, shards: int) -> list[VectorIndex]:
        """Indexes over hash parts of the rows that share this one's model and coarse quantizer."""
        out = []
        for i in range(shards):
            part = VectorIndex.__new__(VectorIndex)
            vars(part).update(vars(self))
            part.table = self.table.filter(F.pmod(F.xxhash64("vec_id"), F.lit(shards)) == i)
            out.append(part)
        return out

    # reading

    def decode(self) -> DataFrame:
        """vec_id, embedding as the index sees it (in the transformed space)."""
        shared = self.table.sparkSession.sparkContext.broadcast(self._model())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, coarse, residual, _ = shared.value
            for batch in batches:
                if batch.num_rows:
                    x = codec.decode(_codes_of(batch.column(1)))
                    x = x + coarse.centroids[np.asarray(batch.column(2))] if residual else x
                    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["vec_id", "embedding"])

        return self.table.select("vec_id", "code", "list_id").mapInArrow(run, "vec_id bigint, embedding array<double>")

    def probed(self, lists: list[int]) -> DataFrame:
        """The rows of some lists; only their folders are read."""
        return L.probed(self.table, self.lists, lists)

    def _search(self, queries: DataFrame, k: int | None, radius: float | None, probes: int) -> DataFrame:
        spark, parts = self.table.sparkSession, []
        for q_ids, q in S._blocks(self._view(queries), "vec_id", "embedding"):
            asked_lists = None if self.coarse is None else self.coarse.top(self._coarse_view(q), probes)
            shared = spark.sparkContext.broadcast((*self._model()[:3], q_ids, q, asked_lists))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                codec, coarse, residual, ids, vectors, probed = shared.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    base_ids, where = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                    codes = _codes_of(batch.column(1))
                    if probed is None:
                        groups = [(None, slice(None), slice(None))]
                    else:
                        groups = [(g, np.flatnonzero(where == g), np.flatnonzero((probed == g).any(1))) for g in np.unique(where)]
                    for g, rows, asked in groups:
                        if g is None or len(asked):
                            q = vectors[asked] - coarse.centroids[g] if residual else vectors[asked]
                            d = Q.code_distances(codec, q, codes[rows])
                            yield _keep_best(base_ids[rows], d, d, ids[asked], k, radius)

            table = self.table if asked_lists is None else self.probed([int(g) for g in np.unique(asked_lists)])
            parts.append(table.select("vec_id", "code", "list_id").mapInArrow(scan, _RESULT))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _RESULT)

    def search(self, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
        """query_id, base_id, distance, nn_rank."""
        return S.top_k(self._search(queries, k, None, probes), k)

    def range_search(self, queries: DataFrame, radius: float, probes: int = 1) -> DataFrame:
        return self._search(queries, None, radius, probes)

    def size_bytes(self) -> int:
        return self.table.agg(F.sum(F.length("code") + 8)).first()[0] or 0


class Refined:
    """Take k * factor candidates from an index and order them by the exact distance."""

    partitions: tuple[str, ...] = ()

    def __init__(self, index, factor: int = 4):
        self.index, self.factor, self.base = index, factor, None

    def fit(self, df):
        self.index.fit(df)
        return self

    def add(self, df):
        self.index.add(df)
        slim = df.select("vec_id", "embedding")
        self.base = slim if self.base is None else self.base.unionByName(slim)
        return self

    def search(self, queries: DataFrame, k: int, factor: int | None = None, **kw) -> DataFrame:
        """The candidates, at most k * factor a query of the stated set, are broadcast in checked blocks
        and one scan of the base ranks them, so vectors are not shuffled. ``factor``: in place of the index's own."""
        found = self.index.search(queries, k * (factor or self.factor), **kw).select("query_id", "base_id")
        return S.rank_candidates(queries, self.base, found, k)


class Deduplicated:
    """One entry for each different vector, and the ids that share it; results name them all."""

    partitions: tuple[str, ...] = ()

    def __init__(self, index):
        self.index, self.copies = index, None

    def fit(self, df):
        self.index.fit(df)
        return self

    def add(self, df):
        """Vectors that ``df`` repeats are stored once; those of an earlier call are not looked for."""
        from ranklore.plans.lookup import lookup_by_key

        rows = staged(df.select("vec_id", "embedding"), "dedup-rows")
        firsts = staged(rows.groupBy("embedding").agg(F.min("vec_id").alias("entry"), F.count(F.lit(1)).alias("n")), "dedup-firsts")
        told = lookup_by_key(rows, firsts, "embedding", "n", rows.count()).select("vec_id", "entry")
        self.index.add(firsts.select(F.col("entry").alias("vec_id"), "embedding"))
        copies = staged(told, "dedup-copies")
        self.copies = copies if self.copies is None else self.copies.unionByName(copies)
        return self

    def search(self, queries: DataFrame, k: int, **kw) -> DataFrame:
        """Every entry stands for one id at least, so k entries are enough; the first k ids of each are."""
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))
        first = self.copies.withColumn("__n", nth).filter(F.col("__n") <= k).select(F.col("entry").alias("base_id"), "vec_id")
        found = self.index.search(queries, k, **kw).select("query_id", "base_id", "distance")
        return S.top_k(found.join(first, "base_id").select("query_id", F.col("vec_id").alias("base_id"), "distance"), k)


def train_encoded(index: VectorIndex, k: int, iterations: int = 10) -> np.ndarray:
    """k-means over what an index has kept of its vectors, decoded as they are read."""
    return C.kmeans(index.decode(), k, iterations)[0]


class IdMap:
    """External ids: (vec_id, external_id) joined to the results."""

    partitions: tuple[str, ...] = ()

    def __init__(self, index, ids: DataFrame):
        self.index, self.ids = index, ids

    def search(self, queries: DataFrame, k: int, **kw) -> DataFrame:
        names = self.ids.select(F.col("vec_id").alias("base_id"), "external_id")
        return self.index.search(queries, k, **kw).join(names, "base_id")


class Shards:
    """Indexes over parts of a base; results are merged. Replicas are shards that hold the same rows."""

    partitions: tuple[str, ...] = ()

    def __init__(self, indexes: list, replicas: bool = False):
        self.indexes, self.replicas = indexes, replicas

    def search(self, queries: DataFrame, k: int, **kw) -> DataFrame:
        if self.replicas:  # each replica answers its part of the queries
            n = len(self.indexes)
            return reduce(
                DataFrame.unionByName,
                [ix.search(queries.filter(F.pmod(F.col("vec_id"), F.lit(n)) == i), k, **kw) for i, ix in enumerate(self.indexes)],
            )
        return S.merge_top_k([ix.search(queries, k, **kw) for ix in self.indexes], k)


class SplitVectors:
    """Sub-vectors searched apart, distances added up per base row."""

    def __init__(self, parts: list[tuple[int, int]]):
        self.parts = parts

    def search(self, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
        """One scan of the base: the parts' distances are added inside a batch, which keeps its best k."""
        spark, found, parts = base.sparkSession, [], list(self.parts)
        for q_ids, q in S._blocks(queries, "vec_id", "embedding"):
            shared = spark.sparkContext.broadcast((q_ids, q))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, vectors = shared.value
                for batch in batches:
                    if batch.num_rows:
                        x = _vectors(batch.column(1))
                        d = sum(C.squared_distances(vectors[:, a:b], x[:, a:b]) for a, b in parts)
                        yield _keep_best(np.asarray(batch.column(0)), d, d, ids, k, None)

            found.append(base.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(scan, _RESULT))
        return S.top_k(reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _RESULT), k)


def progressive_knn(queries: DataFrame, base: DataFrame, k: int, levels: int = 4) -> DataFrame:
    """Exact kNN that compares the dimensions in ``levels`` runs and drops, after each, the rows that
    cannot be among the k nearest any more.

    What is left of a distance lies between the squared difference and the squared sum of the
    lengths of the two remainders (Cauchy-Schwarz). Same rows as ``search.knn``.
    """
    spark, found = base.sparkSession, []
    for q_ids, q in S._blocks(queries, "vec_id", "embedding"):
        shared = spark.sparkContext.broadcast((q_ids, q))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                base_ids, x = np.asarray(batch.column(0)), _vectors(batch.column(1))
                cuts = np.linspace(0, x.shape[1], min(levels, x.shape[1]) + 1).astype(int)
                alive, kept = np.arange(len(x)), min(k, len(x))
                told = np.zeros((len(vectors), len(x)))
                possible = np.ones((len(vectors), len(x)), bool)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = vectors[:, a:b]
                    told += ((part[:, None, :] - x[None, alive, a:b]) ** 2).sum(-1) if len(alive) * part.size < 1 << 24 else C.squared_distances(part, x[alive, a:b])
                    rest_q = np.sqrt((vectors[:, b:] ** 2).sum(1))[:, None]
                    rest_x = np.sqrt((x[alive, b:] ** 2).sum(1))[None, :]
                    most = np.where(possible, told + (rest_q + rest_x) ** 2, np.inf)
                    bound = np.partition(most, kept - 1, axis=1)[:, kept - 1 : kept]
                    possible &= told + (rest_q - rest_x) ** 2 <= bound * (1 + 1e-9) + 1e-12
                    useful = possible.any(0)
                    if useful.sum() >= kept:
                        alive, told, possible = alive[useful], told[:, useful], possible[:, useful]
                d = np.where(possible, told, np.inf)
                yield _keep_best(base_ids[alive], d, d, ids, k, None)

        found.append(base.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(scan, _RESULT))
    return S.top_k(reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _RESULT), k)


class Progressive:
    """A flat index searched by ``progressive_knn``."""

    partitions: tuple[str, ...] = ()

    def __init__(self, levels: int = 4):
        self.levels, self.base = levels, None

    def fit(self, df):
        return self

    def add(self, df):
        rows = staged(df.select("vec_id", "embedding"), "flat-rows")
        self.base = rows if self.base is None else self.base.unionByName(rows)
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return progressive_knn(queries, self.base, k, self.levels)


def flat_1d(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """kNN of numbers (vec_id, x): the k rows before and after each query in the sorted order, by windows
    over blocks of the order, so nothing is compared with all."""
    from pyspark.sql import Window

    from ranklore.plans.ranking import with_position

    placed = staged(with_position(base.select("vec_id", "x"), ["x", "vec_id"], "pos"), "sorted-base")
    at = S.lower_bound_positions(base.select("vec_id", F.col("x").alias("h")), queries.select("vec_id", F.col("x").alias("h")), "h", "vec_id", "vec_id")
    wanted = at.select("query_id", F.explode(F.sequence(F.col("pos") - k, F.col("pos") + k)).alias("pos"))
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("__q"))
    near = wanted.join(placed, "pos").join(own, "query_id").select("query_id", F.col("vec_id").alias("base_id"), ((F.col("x") - F.col("__q")) * (F.col("x") - F.col("__q"))).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "base_id")
    return near.withColumn("nn_rank", F.row_number().over(order)).filter(F.col("nn_rank") <= k)


def random_results(queries: DataFrame, n: int, k: int, seed: int = 0) -> DataFrame:
    """k random base ids a query: a floor for recall figures."""
    draw = F.pmod(F.xxhash64("query_id", "nn_rank", F.lit(seed)), F.lit(n))
    return (
        queries.select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("nn_rank"))
        .withColumn("base_id", draw)
        .withColumn("distance", F.col("nn_rank").cast("double"))
    )


# binary indexes on (vec_id, code array<bigint>)


def _substring(code, start: int, bits: int):
    word, shift = start // 64, start % 64
    if shift + bits > 64:
        raise ValueError("a substring must not cross a word")
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("bigint")
    return F.shiftrightunsigned(F.get(code, F.lit(word)), shift).bitwiseAND(mask)


def binary_hash_search(queries: DataFrame, base: DataFrame, bits: int, flips: int, radius: int, tables: int = 1) -> DataFrame:
    """Pairs under ``radius`` that share a bucket: ``tables`` substrings of ``bits`` bits, up to ``flips``
    bits of the query's flipped. An equi-join on (table, bucket); each pair once."""
    from itertools import combinations

    masks = [sum(1 << b for b in c) for f in range(flips + 1) for c in combinations(range(bits), f)]

    def keyed(df, id_name, code_name, probe):
        keys = F.array(*[F.struct(F.lit(t).alias("t"), _substring(F.col("code"), t * bits, bits).alias("b")) for t in range(tables)])
        out = df.select(F.col("vec_id").alias(id_name), F.col("code").alias(code_name), F.explode(keys).alias("s"))
        out = out.select(id_name, code_name, F.col("s.t").alias("t"), F.col("s.b").alias("bucket"))
        if probe:
            flip = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
            out = out.withColumn("m", flip).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("m"))).drop("m")
        return out

    from ranklore.functions.bits import hamming

    pairs = keyed(queries, "query_id", "__q", True).join(keyed(base, "base_id", "__b", False), ["t", "bucket"])
    told = pairs.select("query_id", "base_id", hamming(F.col("__q"), F.col("__b")).alias("distance")).filter(F.col("distance") < radius)
    return told.distinct()


#: Lists of a binary inverted file: each row is compared with every head.
MAX_HEADS = 4096


def binary_ivf_search(queries: DataFrame, base: DataFrame, heads: DataFrame, probes: int, k: int) -> DataFrame:
    """Lists are the nearest head codes (``heads``: vec_id, code, at most ``MAX_HEADS``); the ``probes`` nearest lists are searched.

    Rows find their lists by an expression over the broadcast heads, without a shuffle; the queries with
    their lists are broadcast in a checked size, so a list that many rows share is scanned by all tasks
    that hold some of it."""
    from ranklore.functions.bits import hamming

    if heads.count() > MAX_HEADS:
        raise ValueError(f"more than {MAX_HEADS} heads")
    if queries.count() * (probes * 16 + 64) > S.BLOCK_BYTES:
        raise ValueError("too many queries for one block: search them in parts")
    held = heads.agg(F.collect_list(F.struct("vec_id", "code")).alias("__heads"))  # one row

    def lists(df: DataFrame, id_name: str, code_name: str, width: int) -> DataFrame:
        far = F.transform("__heads", lambda h: F.struct(hamming(F.col("code"), h["code"]).alias("d"), h["vec_id"].alias("list_id")))
        near = F.slice(F.array_sort(far), 1, width)
        told = df.crossJoin(F.broadcast(held)).select(F.col("vec_id").alias(id_name), F.col("code").alias(code_name), F.explode(near).alias("l"))
        return told.select(id_name, code_name, "l.list_id")

    asked = F.broadcast(lists(queries, "query_id", "__q", probes))
    pairs = lists(base, "base_id", "__b", 1).join(asked, "list_id")
    return S.top_k(pairs.select("query_id", "base_id", hamming(F.col("__q"), F.col("__b")).alias("distance")), k)


# sliding window of slices


class SlidingIndex:
    """The rows of the newest ``slices`` slices; a step appends one and drops the oldest."""

    def __init__(self, slices: int):
        self.slices, self.now, self.table = slices, -1, None

    def step(self, df: DataFrame) -> SlidingIndex:
        self.now += 1
        rows = df.withColumn("slice", F.lit(self.now))
        joined = rows if self.table is None else self.table.unionByName(rows)
        self.table = staged(joined.filter(F.col("slice") > self.now - self.slices), "slices")
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.knn(queries, self.table, k)


# construction from a string


def _codec(part: str):
    """The codec that a part of a description names, or None."""
    rules: list[tuple[str, Callable]] = [
        (r"Flat(?:Panorama)?", lambda m: Q.Flat()),
        (r"SQ(4|6|8)", lambda m: Q.Scalar(int(m[1]))),
        (r"SQ(fp16|bf16)", lambda m: Q.HalfFloat(m[1] == "bf16")),
        (r"PQ(\d+)x4fs", lambda m: Q.FastProduct(int(m[1]))),
        (r"PQ(\d+)(?:x(\d+))?", lambda m: Q.Product(int(m[1]), int(m[2] or 8))),
        (r"(?:RQ|LSQ|PRQ|PLSQ)[\dx]+x4fs", lambda m: Q.FastAdditive(_codec(m[0][:-2]))),
        (r"(RQ|LSQ)(\d+)x(\d+)", lambda m: (Q.Residual if m[1] == "RQ" else Q.LocalSearch)(int(m[2]), int(m[3]))),
        (r"(PRQ|PLSQ)(\d+)x(\d+)x(\d+)", lambda m: Q.ProductAdditive(int(m[2]), int(m[3]), int(m[4]), m[1] == "PLSQ")),
        (r"RaBitQfs", lambda m: Q.FastRotatedSigns()),
        (r"RaBitQ", lambda m: Q.RotatedSigns()),
        (r"LSH(\d+)", lambda m: Q.SignHash(int(m[1]), medians=True)),
        (r"SH(\d+)", lambda m: Q.SpectralHash(int(m[1]), 2.0)),
        (r"MinMaxFP16", lambda m: Q.MinMaxHalf()),
        (r"MinMax", lambda m: Q.RowwiseMinMax()),
        (r"ZnLattice(\d+)", lambda m: Q.Lattice(int(m[1]))),
        (r"2Layer(\d+)_(.+)", lambda m: Q.TwoLayer(int(m[1]), _codec(m[2]))),
        (r"(.+)\+(.+)", lambda m: Q.Refining(_codec(m[1]), _codec(m[2]))),
    ]
    for pattern, make in rules:
        if m := re.fullmatch(pattern, part):
            return make(m)
    return None


def _coarse(part: str) -> tuple[K.FlatCoarse, bool] | None:
    """The coarse quantizer that a part names and whether codes are of residuals, or None."""
    if m := re.fullmatch(r"IVF(\d+)(r)?", part):
        return K.FlatCoarse(int(m[1])), bool(m[2])
    if m := re.fullmatch(r"IVF\((RCQ|LSCQ)(\d+)x(\d+)(?:,beam(\d+))?\)(r)?", part):
        codec = (Q.Residual if m[1] == "RCQ" else Q.LocalSearch)(int(m[2]), int(m[3]))
        return K.AdditiveCoarse(codec, int(m[4] or 0)), bool(m[5])
    if m := re.fullmatch(r"IMI(\d+)x(\d+)(r)?", part):
        return K.MultiIndexCoarse(int(m[1]), int(m[2])), bool(m[3])
    return None


def _transform(part: str) -> TR.Transform | None:
    if m := re.fullmatch(r"PCA(R|W)?(\d+)", part):
        return TR.Pca(int(m[2]), power=-0.5 if m[1] == "W" else 0.0, rotate=m[1] == "R")
    if m := re.fullmatch(r"RR(\d+)", part):
        return TR.RandomRotation(int(m[1]))
    if m := re.fullmatch(r"OPQ(\d+)", part):
        return TR.Opq(int(m[1]))
    return {"ITQ": TR.Itq, "L2norm": TR.Normalize, "Center": TR.Center}.get(part, lambda: None)()


def index_factory(description: str):
    """``[transform,...]code`` or ``[transform,...]lists,code``, around them ``Refine<factor>(...)`` or ``Dedup(...)``.

    Transforms: PCA<n>, PCAR<n>, PCAW<n>, RR<n>, ITQ, OPQ<m>, L2norm, Center. Lists: IVF<n>, IVF(RCQ<m>x<bits>[,beam<b>]),
    IVF(LSCQ<m>x<bits>), IMI<parts>x<bits>, each with r behind it for codes of residuals; Coarse(<transform>) before them
    for lists in another space. Codes: Flat, SQ4, SQ6, SQ8, SQfp16, SQbf16, PQ<m>x<bits>, RQ<m>x<bits>, LSQ<m>x<bits>,
    PRQ<s>x<m>x<bits>, PLSQ<s>x<m>x<bits>, RaBitQ, MinMax, MinMaxFP16, ZnLattice<r2>, LSH<bits>, SH<bits>,
    2Layer<n>_<code>, <code>+<code> for a second code of what the first leaves over; PQ, the additive codes with 4 bits and
    RaBitQ also with fs behind them, for scans of small tables. Graphs: HNSW<m>, NSG<m>, NND<m>, CAGRA<m> (the ground
    level alone, entered at many places), alone or with _<code>. Panorama<levels> is a flat index that drops rows level by
    level; FlatPanorama as a code of lists, RefinePanorama<factor>(...) and HNSW<m>_FlatPanorama give the rows of the plain ones.
    """
    if m := re.fullmatch(r"Refine(?:Panorama)?(\d*)\((.+)\)", description):
        return Refined(index_factory(m[2]), int(m[1] or 4))
    if m := re.fullmatch(r"Dedup\((.+)\)", description):
        return Deduplicated(index_factory(m[1]))
    if m := re.fullmatch(r"Panorama(\d+)", description):
        return Progressive(int(m[1]))
    if m := re.fullmatch(r"(HNSW|NSG|NND|CAGRA)(\d+)(?:_(.+))?", description):
        from ranklore.operators.graphs import GraphIndex

        codec = _codec(m[3]) if m[3] else None
        if m[3] and codec is None:
            raise ValueError(f"unknown index part {m[3]!r}")
        return GraphIndex(int(m[2]), levels=m[1] == "HNSW", descent=m[1] == "NND", codec=codec, entries=32 if m[1] == "CAGRA" else 1)
    transforms: list[TR.Transform] = []
    coarse, codec, residual, image = None, None, False, None
    for part in (p.strip() for p in re.split(r",(?![^(]*\))", description)):
        if (made := _transform(part)) is not None:
            transforms.append(made)
        elif m := re.fullmatch(r"Coarse\((.+)\)", part):
            image = _transform(m[1])
        elif lists := _coarse(part):
            coarse, residual = lists
        elif (made := _codec(part)) is not None:
            codec = made
        else:
            raise ValueError(f"unknown index part {part!r}")
    if codec is None:
        raise ValueError("an index needs a code")
    transform = None if not transforms else transforms[0] if len(transforms) == 1 else TR.Chain(transforms)
    return VectorIndex(codec, residual=residual, transform=transform, coarse=coarse, coarse_transform=image)


# exploration of parameters


def operating_points(results: list[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """(name, accuracy, time) that no other beats on both; fastest first."""
    out, best = [], -1.0
    for name, accuracy, seconds in sorted(results, key=lambda r: (r[2], -r[1])):
        if accuracy > best:
            out.append((name, accuracy, seconds))
            best = accuracy
    return out


#: Rounds of ``search_to_recall``, each twice as wide as the one before.
MAX_WIDENINGS = 24


def _wider(index, k: int, settings: dict, rows: int) -> dict | None:
    """The settings twice as wide (probed lists, candidates of a walk, candidates to refine); None if nothing can grow."""
    held = index
    while not hasattr(held, "table") and hasattr(held, "index"):
        held = held.index
    grown = dict(settings)
    if "probes" in settings:
        grown["probes"] = max(settings["probes"], min(2 * settings["probes"], held.lists))
    if "ef" in settings:
        grown["ef"] = max(settings["ef"], min(2 * settings["ef"], rows))
    if "factor" in settings:
        grown["factor"] = max(settings["factor"], min(2 * settings["factor"], -(-rows // k)))
    return None if grown == settings else grown


def search_to_recall(index, queries: DataFrame, truth: DataFrame, k: int, floor: float, **settings) -> tuple[DataFrame, dict, float]:
    """(found, settings, recall): a search that is widened until it finds the share ``floor`` of ``truth`` (query_id,
    base_id: the exact neighbours of these queries, by brute force).

    It starts with the settings given and doubles what is searched, up to all rows and lists; the index itself stays.
    A codec that nothing refines has no wider search, so what is returned may stay below the floor: see ``recall``.
    """
    refined, rows = isinstance(index, Refined), None
    if refined:
        settings = {"factor": index.factor, **settings}
    exact = truth.select("query_id", "base_id")
    asked = exact.count()
    for _ in range(MAX_WIDENINGS):
        found = staged(index.search(queries, k, **settings), "found")
        recall = found.select("query_id", "base_id").distinct().join(exact, ["query_id", "base_id"]).count() / max(asked, 1)
        if recall >= floor or not asked:
            break
        rows = index_rows(index) if rows is None else rows
        if (grown := _wider(index, k, settings, rows)) is None:
            break
        settings = grown
    return found, settings, recall


def index_rows(index) -> int:
    """Vectors that an index holds."""
    from ranklore.operators.graphs import GraphIndex

    if isinstance(index, GraphIndex):
        return index.table.agg(F.sum(F.size("ids"))).first()[0] or 0
    if getattr(index, "copies", None) is not None:
        return index.copies.count()
    held = index.base if getattr(index, "base", None) is not None else index.table
    return held.count()


def explore(index, queries: DataFrame, truth: DataFrame, k: int, grid: dict[str, list]) -> list[tuple[str, float, float]]:
    """Operating points over a grid of search parameters; a setting that can't beat a faster one is skipped."""
    import itertools
    import time

    results: list[tuple[str, float, float]] = []
    names = sorted(grid)
    for values in itertools.product(*(sorted(grid[n]) for n in names)):
        settings = dict(zip(names, values, strict=True))
        begun = time.perf_counter()
        found = index.search(queries, k, **settings).select("query_id", "base_id")
        hits = found.join(truth.filter(F.col("nn_rank") <= k).select("query_id", "base_id"), ["query_id", "base_id"]).count()
        results.append((",".join(f"{n}={v}" for n, v in settings.items()), hits / max(truth.filter(F.col("nn_rank") <= k).count(), 1), time.perf_counter() - begun))
    return operating_points(results)
