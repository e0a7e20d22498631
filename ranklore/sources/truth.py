"""Ground-truth tables (query_id, base_id, nn_rank, distance): checks and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def truth_faults(truth: DataFrame, base_rows: int) -> DataFrame:
    """rows, out_of_bounds (ids outside the base), unordered (a distance below the one before it)."""
    order = Window.partitionBy("query_id").orderBy("nn_rank")  # k rows a query
    before = F.lag("distance").over(order)
    flagged = truth.withColumn("__drop", F.coalesce(before > F.col("distance"), F.lit(False)))

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")

    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        count((F.col("base_id") < 0) | (F.col("base_id") >= base_rows)).alias("out_of_bounds"),
        count(F.col("__drop")).alias("unordered"),
    )


def truth_lists(truth: DataFrame, k: int) -> DataFrame:
    """query_id, neighbours: the first k ids of each query in rank order."""
    first = truth.filter(F.col("nn_rank") <= k)
    return first.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nn_rank", "base_id"))), lambda s: s["base_id"]).alias("neighbours")
    )


def truth_rows(lists: DataFrame, k: int) -> DataFrame:
    """The other way round: query_id, nn_rank from 1, base_id of the first k entries; -1 marks a missing one."""
    opened = lists.select("query_id", F.posexplode("neighbours").alias("pos", "base_id"))
    return opened.filter((F.col("pos") < k) & (F.col("base_id") >= 0)).select("query_id", (F.col("pos") + 1).alias("nn_rank"), "base_id")


def ties_by_id(truth: DataFrame) -> DataFrame:
    """``truth`` with nn_rank given anew by (distance, base_id): of equal distances the lower id comes first."""
    order = Window.partitionBy("query_id").orderBy("distance", "base_id")  # k rows a query
    return truth.withColumn("nn_rank", F.row_number().over(order))
