"""Connected components by alternating large-star and small-star rounds.

Each round is two DataFrame joins on work tables, which the next round deletes; the
number of rounds grows with the logarithm of the longest chain. No link, node or
component reaches the driver: only a row count and a checksum do, to see that nothing
changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklore.plans.lookup import lookup_by_key
from ranklore.plans.workspace import discard, staged


def _hook(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """For directed (u, v), ``total`` of them: (u, v, least neighbour of u or u itself); and the work table behind it."""
    least = staged(
        edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree")), "star-least"
    )
    return lookup_by_key(edges, least, "u", "degree", total), least


def _signature(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node with a link; ``root`` is the least node of its component.

    ``edges`` has two columns of the same orderable type. Nodes without links are absent.
    """
    a, b = edges.columns
    now = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges"
    )
    seen = _signature(now)
    for _ in range(max_rounds if seen[0] else 0):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked, least = _hook(both, 2 * seen[0])
        large = staged(
            hooked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "star-large"
        )
        again, nearest = _hook(large, large.count())
        pairs = again.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select("p.*")
        made = staged(pairs.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-small")
        discard(now, least, large, nearest)
        now, before, seen = made, seen, _signature(made)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if seen[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
