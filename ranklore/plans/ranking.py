"""Gapless global positions without a single-partition window.

``row_number()`` over an unpartitioned window moves every row to one task.
Here rows are range-partitioned by the sort key, sorted locally and numbered
inside their partition; the partitions' row counts (one row each, so a bounded
broadcast) turn local numbers into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklore.plans.lookup import lookup_by_key
from ranklore.plans.workspace import staged

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many rows (known to the caller) one task numbers them; beyond, range partitions do.
ONE_TASK_ROWS = 50_000
#: A session's own limit, in rows, in place of these; 0 has range partitions do it always.
ONE_TASK_CONF = "ranklore.oneTaskRows"


def one_task_limit(spark, default: int) -> int:
    return int(spark.conf.get(ONE_TASK_CONF, str(default)))


def with_position(
    df: DataFrame, order_by: list[str], position: str = "position", partitions: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by`` (ascending).

    ``order_by`` should end in a unique column: rows that tie on all columns get
    distinct positions in no defined order, and a key that many rows share can
    only be split between tasks by the columns after it.
    An empty input gives an empty output. ``rows``: the number of rows, where it is known.
    """
    if rows is not None and rows <= one_task_limit(df.sparkSession, ONE_TASK_ROWS):
        order = Window.partitionBy(F.lit(1)).orderBy(*order_by)
        return df.withColumn(position, F.row_number().over(order).cast("bigint") - 1)
    ranged = df.repartitionByRange(_partitions(df, partitions), *[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    return numbered(ranged, position)


def numbered(ranged: DataFrame, position: str = "position", name: str = "ranged") -> DataFrame:
    """Add the 0-based position of each row in the order of partitions, and of rows in them, that ``ranged``
    has (range-partitioned and sorted). The rows are written once, whole, to the work table ``name``."""
    spark = ranged.sparkSession
    mid = "__mid"
    ranged = staged(ranged.withColumn(mid, F.monotonically_increasing_id()), name)
    pid = F.shiftright(F.col(mid), _LOCAL_BITS)
    sizes = ranged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["__pid"]):
        starts.append((row["__pid"], total))
        total += row["n"]
    schema = T.StructType([T.StructField("__pid", T.LongType()), T.StructField("__start", T.LongType())])
    offsets = spark.createDataFrame(starts, schema)
    local = F.col(mid).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranged.withColumn("__pid", pid)
        .join(F.broadcast(offsets), "__pid")
        .withColumn(position, F.col("__start") + local)
        .drop("__pid", "__start", mid)
    )


def with_running_sum(df: DataFrame, order_by: list[str], weight: str, name: str, few: bool = False, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before each row in the order of ``order_by``.

    Sums are made inside range partitions and, one row a partition, between them. ``order_by``
    should end in a unique column. ``few``: so few rows that one task may add them up."""
    zero = F.lit(0).cast("bigint")
    if few:
        before = Window.partitionBy(F.lit(1)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(weight).over(before), zero))
    ranged = df.repartitionByRange(_partitions(df, partitions), *[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    placed = staged(ranged.withColumn("__mid", F.monotonically_increasing_id()), "running")
    placed = placed.withColumn("__pid", F.shiftright("__mid", _LOCAL_BITS))
    sums = placed.groupBy("__pid").agg(F.sum(weight).cast("decimal(38,0)").alias("s")).collect()  # one row a partition
    starts, total = [], 0
    for row in sorted(sums, key=lambda r: r["__pid"]):
        starts.append((row["__pid"], total))
        total += int(row["s"] or 0)
    offsets = df.sparkSession.createDataFrame(starts, "__pid bigint, __start bigint")
    inner = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__own", F.coalesce(F.sum(weight).over(inner), zero))
        .join(F.broadcast(offsets), "__pid")
        .withColumn(name, F.col("__start") + F.col("__own"))
        .drop("__mid", "__pid", "__own", "__start")
    )


def with_group_rank(
    df: DataFrame, group: list[str], order_by: list[str], rank: str = "rank", partitions: int | None = None
) -> DataFrame:
    """0-based rank inside each group, for groups of any size.

    The rows are ordered once by (group, order); a group's first position, which hot
    groups get by a broadcast, is subtracted. A group that holds a third of all rows is
    split between tasks. Null is a group value like others.
    Also adds ``<rank>_of``, the number of rows in the group.
    """
    placed = staged(with_position(df, [*group, *order_by], "__pos", partitions).withColumn("__group", F.struct(*group)), "placed")
    firsts = staged(
        placed.groupBy("__group").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias(f"{rank}_of")), "group-firsts"
    )
    total = firsts.agg(F.sum(f"{rank}_of")).first()[0] or 0
    return (
        lookup_by_key(placed, firsts, "__group", f"{rank}_of", total)
        .withColumn(rank, F.col("__pos") - F.col("__first"))
        .drop("__pos", "__first", "__group")
    )


def with_neighbours(
    df: DataFrame, order_by: list[str], marked: Column, fields: list[str], block: int = 100_000, partitions: int | None = None
) -> DataFrame:
    """Add ``l`` and ``r``: structs of ``fields`` of the nearest marked rows before and after each row (the
    as-of join of two key lists in one order). Blocks of consecutive rows are searched apart; what
    lies in other blocks comes from one row a block."""
    placed = staged(with_position(df, order_by, "__pos", partitions), "ordered").withColumn("__block", F.floor(F.col("__pos") / block))
    pt = F.when(marked, F.struct("__pos", *fields))
    ends = placed.groupBy("__block").agg(F.max(pt).alias("__last"), F.min(pt).alias("__first"))
    # what follows is what precedes in the other order: Spark goes through a frame that ends unbounded anew for every row
    up, down = (Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc("__block"), F.desc("__block")))  # one row a block
    carried = ends.select("__block", F.last("__last", True).over(up).alias("__before"), F.last("__first", True).over(down).alias("__after"))
    inner = Window.partitionBy("__block")
    before, after = (inner.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc("__pos"), F.desc("__pos")))
    return (
        placed.join(F.broadcast(carried), "__block")
        .withColumn("l", F.coalesce(F.last(pt, True).over(before), "__before"))
        .withColumn("r", F.coalesce(F.last(pt, True).over(after), "__after"))
        .drop("__pos", "__block", "__before", "__after")
    )


def hashed_first(df: DataFrame, rows: int, vec_id: str = "vec_id", seed: int | None = None) -> DataFrame:
    """The first ``rows`` rows in hash order of their id. Rows are thinned by the same hash to about
    twice as many before they are ordered, so the last merge is as small on any input."""
    drawn = F.xxhash64(F.col(vec_id)) if seed is None else F.xxhash64(F.col(vec_id), F.lit(seed))
    total = df.count()
    if total > 2 * rows + 100:
        df = df.filter(drawn.cast("double") / 2.0**64 + 0.5 < (2 * rows + 100) / total)
    return df.orderBy(drawn, vec_id).limit(rows)
