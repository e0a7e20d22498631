"""Inverted lists as tables (list_id, vec_id, code) and their combinations.

A list is the set of rows that share ``list_id``. Stacking, slicing and masking are
unions, projections and semi joins: nothing is copied until it is written. ``laid_out``
writes lists so that a probe reads only the folders of the lists it asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklore.plans.lookup import lookup_by_key
from ranklore.plans.ranking import with_group_rank
from ranklore.plans.workspace import fresh_path, staged

#: Folders of a laid-out table; with more lists, each folder holds a run of consecutive lists.
MAX_FOLDERS = 1024
COLUMNS = ("list_id", "vec_id", "code")


def lists_a_folder(lists: int) -> int:
    return max(1, -(-lists // MAX_FOLDERS))


def laid_out(rows: DataFrame, lists: int, name: str = "lists", path: str | None = None) -> DataFrame:
    """Write ``rows`` by list: folders ``list_block=...``, sorted by list inside. The order's last key
    splits a list that very many rows share between tasks and files."""
    spark = rows.sparkSession
    path = path or fresh_path(spark, name)
    blocked = rows.withColumn("list_block", F.floor(F.col("list_id") / lists_a_folder(lists)).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["list_block", "list_id", F.xxhash64("vec_id")]
    blocked.repartitionByRange(parts, *order).sortWithinPartitions("list_block", "list_id", "vec_id").write.partitionBy("list_block").parquet(path)
    return spark.read.schema(blocked.schema).parquet(path)


def probed(table: DataFrame, lists: int, wanted: list[int]) -> DataFrame:
    """The rows of the ``wanted`` lists; of a laid-out table only their folders are read."""
    held = table.filter(F.col("list_id").isin(wanted))
    if "list_block" in table.columns:
        held = held.filter(F.col("list_block").isin(sorted({w // lists_a_folder(lists) for w in wanted})))
    return held


def list_sizes(table: DataFrame) -> DataFrame:
    """list_id, size of every list that holds something."""
    return table.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))


def direct_map(table: DataFrame) -> DataFrame:
    """vec_id, list_id, offset: where each id stands in its list, in order of ids."""
    return with_group_rank(table.select("list_id", "vec_id"), ["list_id"], ["vec_id"], "offset").select("vec_id", "list_id", "offset")


def hstack(tables: list[DataFrame]) -> DataFrame:
    """List i is list i of every table, one after another."""
    return reduce(DataFrame.unionByName, [t.select(*COLUMNS) for t in tables])


def vstack(tables: list[DataFrame], lists: list[int]) -> DataFrame:
    """The lists of all tables, numbered on: table t's list i becomes i plus the lists of those before."""
    starts = [sum(lists[:i]) for i in range(len(lists))]
    return hstack([t.withColumn("list_id", F.col("list_id") + F.lit(s).cast("bigint")) for t, s in zip(tables, starts, strict=True)])


def sliced(table: DataFrame, first: int, stop: int) -> DataFrame:
    """Lists ``first`` to ``stop`` - 1, numbered from 0."""
    held = table.filter((F.col("list_id") >= first) & (F.col("list_id") < stop))
    return held.select((F.col("list_id") - F.lit(first)).cast("bigint").alias("list_id"), "vec_id", "code")


def masked(table: DataFrame, behind: DataFrame) -> DataFrame:
    """A list of ``table`` where that holds something, the list of ``behind`` elsewhere."""
    taken = table.select("list_id").distinct()  # one row a list
    return hstack([table, behind.join(F.broadcast(taken), "list_id", "left_anti")])


def without_stop_words(table: DataFrame, most: int) -> DataFrame:
    """Lists of more than ``most`` rows read as empty."""
    long = list_sizes(table).filter(F.col("size") > most).select("list_id")
    return table.select(*COLUMNS).join(F.broadcast(long), "list_id", "left_anti")


def blocked(table: DataFrame, rows: int) -> DataFrame:
    """list_id, block, ids, codes: lists as runs of ``rows`` entries, in order of ids; the last may be shorter."""
    placed = with_group_rank(table.select(*COLUMNS), ["list_id"], ["vec_id"], "offset")
    entry = F.struct("offset", "vec_id", "code")
    made = placed.groupBy("list_id", F.floor(F.col("offset") / rows).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return made.select("list_id", "block", F.col("e.vec_id").alias("ids"), F.col("e.code").alias("codes"))


def unblocked(blocks: DataFrame) -> DataFrame:
    """The rows of ``blocked`` lists."""
    return blocks.select("list_id", F.explode(F.arrays_zip("ids", "codes")).alias("e")).select("list_id", F.col("e.ids").alias("vec_id"), F.col("e.codes").alias("code"))


class CodeSet:
    """Distinct codes: ``insert`` tells which of its rows bring a code that was not there before."""

    def __init__(self):
        self.codes: DataFrame | None = None

    def insert(self, rows: DataFrame) -> DataFrame:
        """vec_id, code, is_new: of equal new codes the row with the smallest id is the new one."""
        rows = staged(rows.select("vec_id", "code"), "code-rows")
        firsts = staged(rows.groupBy("code").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "code-firsts")
        new = firsts if self.codes is None else firsts.join(self.codes.hint("merge"), "code", "left_anti")
        new = staged(new.select("code"), "new-codes")
        told = lookup_by_key(rows, staged(firsts.join(new.withColumn("fresh", F.lit(True)).hint("merge"), "code", "left"), "code-told"), "code", "n", rows.count())
        self.codes = new if self.codes is None else self.codes.unionByName(new)
        return told.select("vec_id", "code", (F.coalesce("fresh", F.lit(False)) & (F.col("vec_id") == F.col("first_id"))).alias("is_new"))


def bucket_sorted(df: DataFrame, bucket: str, tie: str) -> DataFrame:
    """``df`` with ``offset``, the place of each row in the order of (bucket, tie), from counts: a
    counting sort. ``bucket`` is a small integer; its counts and starts are one row a bucket."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn(
        "__start", F.coalesce(F.sum("__n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = with_group_rank(df, [bucket], [tie], "__rank")
    return ranked.join(F.broadcast(starts.select(bucket, "__start")), bucket).withColumn("offset", F.col("__start") + F.col("__rank")).select(*df.columns, "offset")
