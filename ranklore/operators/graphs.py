"""Neighbour graphs: kNN graphs with diversified links, geometric levels, best-first search.

The base is cut into shards of at most ``SHARD_ROWS`` rows by hash; each shard's graph is
built and searched by one task, results are merged. A shard's size, not the table's,
bounds what a task holds. A graph is one row of plain arrays: ids, codes, and of each
level its members, their links (as offsets and targets) and its entry. The queries of a
block walk a graph together, one step of all of them at a time. Graphs are approximate:
measure recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklore.operators import codecs as Q
from ranklore.operators import search as S
from ranklore.operators import transforms as TR
from ranklore.plans.workspace import staged

SHARD_ROWS = 20_000
_TOGETHER = 256  # queries that walk together: a task holds a mark for each of them and each node


def hashed_level(ids: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """Geometric levels with factor 1 / ln(m), from a hash of the id."""
    mixed = (ids.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    uniform = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)
    return np.floor(-np.log(uniform) / np.log(max(m, 2))).astype(int)


def knn_lists(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) nearest other rows, nearest first."""
    n = len(x)
    k = min(k, n - 1)
    out = np.zeros((n, max(k, 0)), np.int64)
    squares = (x * x).sum(1)
    for i in range(0, n, 512):
        d = squares[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if k:
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[i : i + 512] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


def diversified(x: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Of each node's candidates (rows of ``near``, nearest first) those that no kept one is closer to
    than the node is, at most m; True where kept. All nodes of a block are decided together."""
    keep = np.zeros(near.shape, bool)
    if not near.shape[1]:
        return keep
    step = max(1, (1 << 22) // max(1, near.shape[1] * x.shape[1]))
    for i in range(0, len(near), step):
        own = x[near[i : i + step]]
        d = ((own - x[i : i + step, None, :]) ** 2).sum(-1)
        kept = keep[i : i + step]
        blocked = np.zeros(d.shape, bool)
        for j in range(near.shape[1]):
            kept[:, j] = ~blocked[:, j] & (kept[:, :j].sum(1) < m)
            closer = ((own - own[:, j : j + 1]) ** 2).sum(-1) < d
            blocked |= closer & kept[:, j : j + 1]
    return keep


@dataclass
class Level:
    """Nodes of a level (ascending) and their links, as a matrix filled up with -1 (numbers within the level)."""

    members: np.ndarray
    links: np.ndarray


def _link_level(x: np.ndarray, members: np.ndarray, near: np.ndarray, m: int) -> Level:
    """Links both ways; at most 2 m a node, those to nearer nodes first."""
    keep = diversified(x[members], near, m)
    src, at = np.nonzero(keep)
    dst = near[src, at]
    a, b = np.concatenate((src, dst)), np.concatenate((dst, src))
    both = np.unique(a * np.int64(len(members)) + b)
    a, b = both // len(members), both % len(members)
    d = ((x[members[a]] - x[members[b]]) ** 2).sum(1)
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, nth = a[nth < 2 * m], b[nth < 2 * m], nth[nth < 2 * m]
    links = np.full((len(members), int(nth.max()) + 1 if len(nth) else 1), -1, np.int32)
    links[a, nth] = b
    return Level(members, links)


def _reach_all(x: np.ndarray, ground: Level, entry: int) -> Level:
    """Hang parts that the entry cannot reach onto their nearest reached node."""
    links, seen = ground.links, np.zeros(len(x), bool)
    seen[entry] = True
    frontier, extra = np.array([entry]), []
    while True:
        while len(frontier):
            found = np.unique(links[frontier])
            frontier = found[(found >= 0) & ~seen[np.maximum(found, 0)]]
            seen[frontier] = True
        left = np.flatnonzero(~seen)
        if not len(left):
            break
        reached, node = np.flatnonzero(seen), left[0]
        near = int(reached[((x[reached] - x[node]) ** 2).sum(1).argmin()])
        extra += [(near, int(node)), (int(node), near)]
        seen[node] = True
        frontier = np.array([node])
    if extra:
        rows = [[t for t in row if t >= 0] for row in links.tolist()]
        for a, b in extra:
            rows[a].append(b)
        links = np.full((len(rows), max(map(len, rows))), -1, np.int32)
        for i, row in enumerate(rows):
            links[i, : len(row)] = row
    return Level(ground.members, links)


def build_graph(ids: np.ndarray, x: np.ndarray, m: int, levels: bool = True, descent: bool = False) -> tuple[list[Level], int]:
    """Levels from the ground up, and the entry. ``descent``: lists by neighbours of neighbours, not exactly."""
    level = hashed_level(ids, m) if levels else np.zeros(len(ids), int)
    made = []
    for depth in range(int(level.max()) + 1 if len(level) else 0):
        members = np.flatnonzero(level >= depth)
        width = max(2 * m, 8)
        near = nn_descent(x[members], width) if descent and len(members) > width + 1 else knn_lists(x[members], width)
        made.append(_link_level(x, members, near, m))
    entry = int(level.argmax()) if levels else int(((x - x.mean(0)) ** 2).sum(1).argmin())
    made[0] = _reach_all(x, made[0], entry)
    return made, entry


def _descend(x: np.ndarray, level: Level, q: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Greedy steps of every query on one upper level, until none of them gets nearer."""
    at = np.searchsorted(level.members, node)
    best = ((x[level.members[at]] - q) ** 2).sum(1)
    going = np.arange(len(q))
    while len(going):
        links = level.links[at[going]]
        d = ((x[level.members[np.maximum(links, 0)]] - q[going, None, :]) ** 2).sum(-1)
        d[links < 0] = np.inf
        first = d.argmin(1)
        nearer = d[np.arange(len(going)), first] < best[going]
        going, links, first, d = going[nearer], links[nearer], first[nearer], d[nearer]
        at[going], best[going] = links[np.arange(len(going)), first], d[np.arange(len(going)), first]
    return level.members[at]


def search_graph(
    x: np.ndarray, levels: list[Level], entry: int, q: np.ndarray, k: int, ef: int, entries: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the k nearest that a best-first walk with ``ef`` candidates finds; -1 where there are fewer.
    With more ``entries`` a query starts at the nearest of so many nodes, evenly spread over the graph."""
    starts = np.unique(np.append(np.linspace(0, len(x) - 1, entries).astype(int), entry)) if entries > 1 else np.array([entry])
    node = starts[((x[starts][None] - q[:, None]) ** 2).sum(-1).argmin(1)]
    for level in levels[:0:-1]:
        node = _descend(x, level, q, node)
    links, n, rows = levels[0].links, len(x), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    seen[rows, node] = True
    width = max(ef, k)
    nodes = np.full((len(q), width), -1, np.int64)
    dist = np.full((len(q), width), np.inf)
    nodes[:, 0], dist[:, 0] = node, ((x[node] - q) ** 2).sum(1)
    fresh = np.zeros((len(q), width), bool)  # candidates whose links have not been followed
    fresh[:, 0] = True
    going = rows
    while len(going):
        first = np.where(fresh[going], dist[going], np.inf).argmin(1)
        some = fresh[going, first]
        going, first = going[some], first[some]
        if not len(going):
            break
        fresh[going, first] = False
        near = links[nodes[going, first]]
        new = (near >= 0) & ~seen[going[:, None], np.maximum(near, 0)]
        owner, at = np.nonzero(new)
        reached = near[owner, at]
        seen[going[owner], reached] = True
        d = np.full(near.shape, np.inf)
        d[owner, at] = ((x[reached] - q[going[owner]]) ** 2).sum(1)
        all_nodes = np.concatenate((nodes[going], np.where(new, near, -1)), 1)
        all_dist = np.concatenate((dist[going], d), 1)
        all_fresh = np.concatenate((fresh[going], new), 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        nodes[going] = np.take_along_axis(all_nodes, best, 1)
        dist[going] = np.take_along_axis(all_dist, best, 1)
        fresh[going] = np.take_along_axis(all_fresh, best, 1) & np.isfinite(dist[going])
    return np.where(np.isfinite(dist[:, :k]), nodes[:, :k], -1), dist[:, :k]


def nn_descent(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """kNN lists by neighbours of neighbours, from random lists; (rows, k), nearest first.

    A round joins every node with the neighbours, and a few of the nodes that have it as a
    neighbour, of its own neighbours, in blocks of nodes."""
    n, k = len(x), min(k, len(x) - 1)
    rng = np.random.default_rng(seed)
    near = rng.integers(0, n - 1, (n, k))
    near += near >= np.arange(n)[:, None]
    for _ in range(rounds):
        back = np.full((n, k), -1)
        owners, targets = np.repeat(np.arange(n), k), near.ravel()
        order = np.argsort(targets, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(targets[order], targets[order])
        held = nth < k
        back[targets[order][held], nth[held]] = owners[order][held]
        changed, step = 0, max(1, (1 << 22) // (max(1, k * k) * x.shape[1]))
        around = np.concatenate((near, back), 1)
        for i in range(0, n, step):
            own = np.arange(i, min(i + step, n))
            wide = np.concatenate((around[own], around[np.maximum(near[own], 0)].reshape(len(own), -1)), 1)
            wide = np.sort(wide, axis=1)
            bad = (wide < 0) | (wide == own[:, None])
            bad[:, 1:] |= wide[:, 1:] == wide[:, :-1]
            d = ((x[np.maximum(wide, 0)] - x[own, None, :]) ** 2).sum(-1)
            d[bad] = np.inf
            best = np.take_along_axis(wide, np.argsort(d, axis=1, kind="stable")[:, :k], 1)
            changed += int((best != near[own]).sum())
            near[own] = best
        if not changed:
            break
    return near


_GRAPH = (
    "shard int, ids array<bigint>, codes binary, width int, entry int, "
    "levels array<struct<members:array<int>,offsets:array<int>,targets:array<int>>>"
)


def _flat(level: Level) -> dict:
    held = level.links >= 0
    return {
        "members": level.members.astype(np.int32).tolist(),
        "offsets": np.concatenate(([0], np.cumsum(held.sum(1)))).astype(np.int32).tolist(),
        "targets": level.links[held].astype(np.int32).tolist(),
    }


def _level(flat: dict) -> Level:
    offsets, targets = np.asarray(flat["offsets"]), np.asarray(flat["targets"])
    counts = np.diff(offsets)
    links = np.full((len(counts), max(int(counts.max(initial=0)), 1)), -1, np.int32)
    row = np.repeat(np.arange(len(counts)), counts)
    links[row, np.arange(len(targets)) - offsets[row]] = targets
    return Level(np.asarray(flat["members"]), links)


class GraphIndex:
    """Graphs of hash shards, one row each, over vectors as ``codec`` keeps them; searches broadcast blocks of the query set."""

    partitions: tuple[str, ...] = ()

    def __init__(
        self, m: int = 16, ef: int = 64, levels: bool = True, shard_rows: int = SHARD_ROWS, descent: bool = False, codec=None, entries: int = 1
    ):
        self.m, self.ef, self.levels, self.shard_rows, self.descent, self.entries = m, ef, levels, shard_rows, descent, entries
        if levels and entries > 1:
            raise ValueError("a graph with levels has one entry")
        self.codec, self.table = codec or Q.Flat(), None

    def fit(self, df: DataFrame) -> GraphIndex:
        self.codec.fit(TR.sample_matrix(df))
        return self

    def add(self, df: DataFrame) -> GraphIndex:
        shards = max(1, -(-df.count() // (self.shard_rows * 3 // 4)))
        m, levels, descent, codec = self.m, self.levels, self.descent, self.codec

        def build(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("vec_id")
            codes = codec.encode(np.array(part["embedding"].tolist(), np.float64))
            made, entry = build_graph(part["vec_id"].to_numpy(), codec.decode(codes), m, levels, descent)
            row = [int(part["shard"].iloc[0]), part["vec_id"].to_numpy(), codes.tobytes(), codes.shape[1], entry, [_flat(v) for v in made]]
            return pd.DataFrame([row], columns=["shard", "ids", "codes", "width", "entry", "levels"])

        if not hasattr(codec, "dim") and isinstance(codec, Q.Flat):
            codec.fit(TR.sample_matrix(df, 1))
        keyed = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn(
            "shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
        )
        rows = staged(keyed.groupBy("shard").applyInPandas(build, _GRAPH), "graphs")
        self.table = rows if self.table is None else self.table.unionByName(rows)
        return self

    def edges(self) -> DataFrame:
        """src, dst, depth: the links of all graphs, by ids."""
        one = self.table.select("ids", F.posexplode("levels").alias("depth", "level"))
        node = one.select("ids", "depth", "level", F.posexplode("level.members").alias("i", "member"))
        first, last = F.get("level.offsets", F.col("i")), F.get("level.offsets", F.col("i") + 1)
        targets = F.slice("level.targets", first + 1, last - first)
        linked = node.select(
            "ids", "depth", F.get("ids", F.col("member")).alias("src"), F.col("level.members").alias("members"), F.explode(targets).alias("t")
        )
        return linked.select("src", F.get("ids", F.get("members", F.col("t"))).alias("dst"), "depth")

    def search(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        width, parts, codec = max(ef or self.ef, k), [], self.codec
        for q_ids, q in S._blocks(queries, "vec_id", "embedding"):
            shared = self.table.sparkSession.sparkContext.broadcast((q_ids, q, codec, self.entries))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, vectors, codec, entries = shared.value
                for batch in batches:
                    for row in batch.to_pylist():
                        held = np.asarray(row["ids"])
                        x = codec.decode(np.frombuffer(row["codes"], np.uint8).reshape(len(held), row["width"]))
                        levels = [_level(v) for v in row["levels"]]
                        for i in range(0, len(ids), _TOGETHER):
                            nodes, d = search_graph(x, levels, row["entry"], vectors[i : i + _TOGETHER], k, width, entries)
                            at, pos = np.nonzero(nodes >= 0)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[i + at], pa.int64()), pa.array(held[nodes[at, pos]], pa.int64()), pa.array(d[at, pos])],
                                ["query_id", "base_id", "distance"],
                            )

            graphs = self.table.select("ids", "codes", "width", "entry", "levels")
            parts.append(graphs.mapInArrow(run, "query_id bigint, base_id bigint, distance double"))
        empty = self.table.sparkSession.createDataFrame([], "query_id bigint, base_id bigint, distance double")
        return S.top_k(reduce(DataFrame.unionByName, parts, empty), k)


def signs_as_vectors(codes: DataFrame, bits: int) -> DataFrame:
    """vec_id, embedding of -1 and 1 from (vec_id, code): squared distances are four times Hamming distances."""
    from ranklore.functions.bits import to_signs

    return codes.select("vec_id", to_signs(F.col("code"), bits).alias("embedding"))


class BinaryGraphIndex:
    """A graph over bit codes (vec_id, code); distances are Hamming distances."""

    partitions: tuple[str, ...] = ()

    def __init__(self, bits: int, m: int = 16, ef: int = 64, levels: bool = True, entries: int = 1):
        self.bits, self.index = bits, GraphIndex(m, ef, levels, codec=Q.SignBits(bits), entries=entries)

    def fit(self, codes: DataFrame) -> BinaryGraphIndex:
        return self

    def add(self, codes: DataFrame) -> BinaryGraphIndex:
        self.index.add(signs_as_vectors(codes, self.bits))
        return self

    def search(self, codes: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        found = self.index.search(signs_as_vectors(codes, self.bits), k, ef)
        return found.withColumn("distance", (F.col("distance") / 4).cast("int"))


# skeletons of a large set


def levels(df: DataFrame, m: int, seed: int = 0, vec_id: str = "vec_id") -> DataFrame:
    """vec_id, level: geometric levels from a hashed uniform number, on the JVM."""
    uniform = (F.pmod(F.xxhash64(F.col(vec_id), F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return df.select(vec_id, F.floor(-F.ln(uniform) / F.ln(F.lit(float(max(m, 2))))).cast("int").alias("level"))


def choose_layer(leveled: DataFrame, target: int) -> int:
    """The highest layer that still has ``target`` nodes; 0 if none has."""
    counts = {r["level"]: r["count"] for r in leveled.groupBy("level").count().collect()}  # a few levels
    layer, total = 0, 0
    for level in sorted(counts, reverse=True):
        total += counts[level]
        if total >= target:
            layer = level
            break
    return max(layer, 0)


def skeleton(df: DataFrame, m: int, target: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a layer: members by level, and the ground links (src, dst) of a graph over them.

    The graph is built shard by shard, so its cost grows with the members and not with their pairs."""
    leveled = staged(levels(df, m, seed), "levels")
    layer = choose_layer(leveled, target)
    nodes = staged(df.join(leveled.filter(F.col("level") >= layer).select("vec_id"), "vec_id", "left_semi"), "skeleton-nodes")
    graph = GraphIndex(m, levels=False).add(nodes)
    return nodes, staged(graph.edges().select("src", "dst"), "skeleton-edges")


def contexts(df: DataFrame, m: int, targets: list[int], seed: int = 0) -> DataFrame:
    """fingerprint, layer, nodes, targets: the different skeletons that the targets lead to. Targets whose
    layer holds the same nodes share a row; the fingerprint is of the node ids, whatever their order."""
    leveled = staged(levels(df, m, seed), "levels")
    layers = {t: choose_layer(leveled, t) for t in sorted(set(targets))}
    asked = df.sparkSession.createDataFrame(list(layers.items()), "target bigint, layer int")
    told = leveled.crossJoin(F.broadcast(asked.select("layer").distinct())).filter(F.col("level") >= F.col("layer"))
    prints = told.groupBy("layer").agg(F.expr("bit_xor(xxhash64(vec_id))").alias("fingerprint"), F.count(F.lit(1)).alias("nodes"))
    return asked.join(prints, "layer").groupBy("fingerprint", "nodes").agg(F.min("layer").alias("layer"), F.sort_array(F.collect_list("target")).alias("targets"))


def restricted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    ids = members.select("vec_id")
    a = edges.join(ids.withColumnRenamed("vec_id", "src"), "src", "left_semi")
    return a.join(ids.withColumnRenamed("vec_id", "dst"), "dst", "left_semi")


def write_csr(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables: nodes (vec_id, position, first, degree) and links (place, src, dst), ``first`` being the
    place of a node's first link in the order of (src, dst)."""
    from ranklore.plans.ranking import with_position

    links = staged(with_position(edges.select("src", "dst").distinct(), ["src", "dst"], "place"), "csr-links")
    own = links.groupBy("src").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("degree"))
    placed = with_position(nodes.select("vec_id").distinct(), ["vec_id"], "position")
    told = placed.join(own.withColumnRenamed("src", "vec_id").hint("merge"), "vec_id", "left")
    told.select("vec_id", "position", "first", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")).write.mode("overwrite").parquet(f"{path}/nodes")
    links.select("place", "src", "dst").write.mode("overwrite").parquet(f"{path}/links")


def read_csr(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``write_csr``; offsets, degrees or ends that do not fit together are an error."""
    nodes, links = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links")
    own = links.groupBy(F.col("src").alias("vec_id")).agg(F.min("place").alias("f"), F.max("place").alias("l"), F.count(F.lit(1)).alias("n"))
    told = nodes.join(own, "vec_id", "full_outer")
    runs = F.col("f").eqNullSafe(F.col("first")) & (F.coalesce("n", F.lit(0)) == F.col("degree")) & (F.col("n").isNull() | (F.col("l") - F.col("f") + 1 == F.col("n")))
    strangers = links.join(nodes.select(F.col("vec_id").alias("dst")), "dst", "left_anti")
    if not told.filter(~F.coalesce(runs, F.lit(False))).isEmpty() or not strangers.isEmpty():
        raise ValueError(f"the graph at {path} is not consistent")
    return nodes.select("vec_id"), links.select("src", "dst")
