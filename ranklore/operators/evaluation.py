"""Evaluation of hash layouts: ranks, query positions, recall in windows, node locality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklore.operators.search import lower_bound_positions
from ranklore.plans.ranking import with_position
from ranklore.plans.workspace import staged

#: Fixed values of the scores.
NODE_WEIGHTS = (0.35, 0.30, 0.20, 0.10, 0.05)
QUALITY_WEIGHTS = (0.50, 0.20, 0.15, 0.10, 0.05)
NODE_COUNTS = (32, 64, 128, 256, 512, 1024)


def base_ranks(hashed: DataFrame, hash_column: str = "hash") -> DataFrame:
    """base_id, hash, rank of each base row in (hash, id) order."""
    slim = hashed.select(F.col("vec_id").alias("base_id"), F.col(hash_column).alias("hash"))
    return with_position(slim, ["hash", "base_id"], "rank", rows=hashed.count())


def window_ladder(windows: list[int], n: int) -> list[int]:
    """Windows from 1 to n - 1, sorted, each once; never empty."""
    held = sorted({min(w, max(n - 1, 1)) for w in windows if w > 0})
    return held or [min(max(n - 1, 1), default_window(n))]


def default_window(n: int) -> int:
    return min(1000, n // 10 + 1)


def node_ladder(counts: list[int]) -> list[int]:
    return sorted({c for c in counts if c > 0}) or list(NODE_COUNTS)


def hash_gap(a: Column, b: Column, text: bool) -> Column:
    """Distance of two hashes as a double. Hashes of more than 64 bits are fixed-width hex text, which
    sorts like the numbers; their distance is taken from the first 16 digits, exact to 2^-53 or so."""
    if not text:
        return F.abs(a - b).cast("double")
    top = [F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") for h in (a, b)]
    below = F.greatest(F.length(a) - 16, F.lit(0)) * 4
    return F.abs(top[0] - top[1]).cast("double") * F.pow(F.lit(2.0), below.cast("double"))


def neighbour_table(base_hashed: DataFrame, query_hashed: DataFrame, truth: DataFrame, hash_column: str = "hash") -> DataFrame:
    """query_id, nn_rank, base_id, rank, pos, n, weight, hash_gap: one row per true neighbour.

    ``truth`` is (query_id, base_id, nn_rank from 1); weights are 1 / log2(nn_rank + 1).
    Hashes are numbers or, beyond 64 bits, hex text of one width.
    """
    text = base_hashed.schema[hash_column].dataType.typeName() == "string"
    base_hashed = staged(base_hashed.select("vec_id", hash_column), "base-hashes")
    query_hashed = staged(query_hashed.select("vec_id", hash_column), "query-hashes")
    ranks = staged(base_ranks(base_hashed, hash_column), "base-ranks")
    n = ranks.count()
    pos = lower_bound_positions(
        base_hashed.select("vec_id", F.col(hash_column).alias("h")), query_hashed.select("vec_id", F.col(hash_column).alias("h")), "h", "vec_id", "vec_id"
    )
    own = query_hashed.select(F.col("vec_id").alias("query_id"), F.col(hash_column).alias("__qh"))
    return (
        truth.select("query_id", "base_id", "nn_rank")
        .join(ranks, "base_id")
        .join(pos, "query_id")
        .join(own, "query_id")
        .select(
            "query_id",
            "nn_rank",
            "base_id",
            "rank",
            "pos",
            F.lit(n).cast("bigint").alias("n"),
            (F.lit(1.0) / F.log2(F.col("nn_rank") + 1.0)).alias("weight"),
            F.abs(F.col("rank") - F.col("pos")).alias("rank_gap"),
            hash_gap(F.col("hash"), F.col("__qh"), text).alias("hash_gap"),
        )
    )


def recall_by_window(neighbours: DataFrame, windows: list[int]) -> DataFrame:
    """window, recall: share of true neighbours whose rank lies within the window of the query's position."""
    ladder = neighbours.sparkSession.createDataFrame([(w,) for w in windows], "window bigint")
    hit = (F.col("rank_gap") <= F.col("window")).cast("double")
    return neighbours.crossJoin(F.broadcast(ladder)).groupBy("window").agg(F.avg(hit).alias("recall"))


def recall_auc(recalls: DataFrame) -> DataFrame:
    """auc: area under recall over ln(window), as a share; one window gives its recall."""
    order = Window.partitionBy(F.lit(1)).orderBy("window")  # one row a window of the ladder
    x = F.ln(F.greatest(F.col("window"), F.lit(1)).cast("double"))
    steps = recalls.select(
        (x - F.lag(x).over(order)).alias("dx"), ((F.col("recall") + F.lag("recall").over(order)) * 0.5).alias("mid"), "recall"
    )
    area = F.sum(F.col("dx") * F.col("mid")) / F.sum("dx")
    return steps.agg(F.when(F.sum("dx") > 0, area).otherwise(F.max("recall")).alias("auc"))


def _node(position: Column, count: Column) -> Column:
    return F.least(F.floor(position * count / F.col("n")), count - 1)


def node_metrics(neighbours: DataFrame, node_counts: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Per node count (and ``by``): same, near_1, near_2, near_4, distance_norm, overlay and its parts.

    The n positions are dealt to ``node_count`` nodes on a ring; a neighbour matches by
    1 / (1 + ring distance), weighted by its rank.
    """
    ladder = neighbours.sparkSession.createDataFrame([(c,) for c in node_counts], "node_count bigint")
    count = F.col("node_count")
    apart = F.abs(_node(F.col("pos"), count) - _node(F.col("rank"), count))
    ring = F.least(apart, count - apart)
    with_ring = neighbours.crossJoin(F.broadcast(ladder)).withColumn("ring", ring)

    def share(limit: int) -> Column:
        return F.avg((F.col("ring") <= limit).cast("double"))

    match = F.col("weight") / (1.0 + F.col("ring"))
    return with_ring.groupBy(*by, "node_count").agg(
        share(0).alias("same"),
        share(1).alias("near_1"),
        share(2).alias("near_2"),
        share(4).alias("near_4"),
        F.avg(F.col("ring") / F.greatest(F.lit(1.0), count * 0.5)).alias("distance_norm"),
        (F.sum(match) / F.sum("weight")).alias("overlay"),
        F.sum(match).alias("matched"),
        F.sum("weight").alias("weight"),
    )


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def node_locality(metrics: DataFrame) -> DataFrame:
    """node_locality, overlay: means over the node counts."""
    a, b, c, d, e = NODE_WEIGHTS
    score = _clamp(
        a * F.col("same") + b * F.col("near_1") + c * F.col("near_2") + d * F.col("near_4") + e * (1.0 - _clamp(F.col("distance_norm")))
    )
    return metrics.agg(F.avg(score).alias("node_locality"), F.avg("overlay").alias("overlay"))


def query_overlay(neighbours: DataFrame, node_counts: list[int]) -> DataFrame:
    """query_id, overlay over all node counts."""
    per = node_metrics(neighbours, node_counts, ("query_id",))
    return per.groupBy("query_id").agg((F.sum("matched") / F.sum("weight")).alias("overlay"))


def nearest_rank_percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """sorted[ceil(q n) - 1] for each share."""
    return df.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").alias(name) for name, q in shares.items()])


def interpolated_percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Linear interpolation at (n - 1) q."""
    return df.agg(*[F.percentile(column, F.lit(q)).alias(name) for name, q in shares.items()])


def evaluate(
    base_hashed: DataFrame, query_hashed: DataFrame, truth: DataFrame, bits: int, windows: list[int], node_counts: list[int]
) -> DataFrame:
    """One row with all locality metrics of a layout."""
    neighbours = staged(neighbour_table(base_hashed, query_hashed, truth), "neighbours")
    n = base_hashed.count()
    windows = window_ladder(windows or [default_window(n)], n)
    chosen = default_window(n)
    overall = neighbours.agg(
        F.avg((F.col("rank_gap") <= chosen).cast("double")).alias("recall"),
        F.avg(F.col("rank_gap") / F.col("n")).alias("rank_distance"),
        (F.avg("hash_gap") / F.lit(math.ldexp(1.0, bits))).alias("hash_distance"),
    )
    spread = nearest_rank_percentiles(
        neighbours.withColumn("r", F.col("rank_gap") / F.col("n")), "r", {"rank_p50": 0.5, "rank_p95": 0.95, "rank_p99": 0.99}
    )
    per_query = nearest_rank_percentiles(query_overlay(neighbours, node_counts), "overlay", {"overlay_p05": 0.05, "overlay_p50": 0.5, "overlay_p95": 0.95})
    parts = [overall, recall_auc(recall_by_window(neighbours, windows)), node_locality(node_metrics(neighbours, node_counts)), spread, per_query]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    a, b, c, d, e = QUALITY_WEIGHTS
    quality = _clamp(
        a * F.col("overlay") + b * F.col("node_locality") + c * F.col("auc") + d * F.col("overlay_p05") + e * (1.0 - _clamp(F.col("rank_p50")))
    )
    return out.withColumn("quality", quality)
