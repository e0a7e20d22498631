"""Sharding by proportional stratified interleaving.

Rows are shuffled inside each source by a seeded hash and ranked there; the rank as a
fraction of the source's rows is a common scale on which all sources are spread evenly.
Sorted by that fraction and cut into equal runs, every shard gets of every source its
share, to within one or two rows. Law: ``rows``, shard sizes differ by one at most.

Ranks and cuts come from range-partitioned positions, so a source that holds a third
of all rows is split between tasks like any other key range. Positions are found on
keys alone; each task then looks up those of its rows, and whole rows are shuffled
once, into the folders ``shard=0``, ``shard=1``, ... of Parquet files in the shared
folder. A file holds a run of slots in order; its column ``row`` is the document with
all its columns, whatever their names.

Defined results: a null source counts as the empty one; a null text has 0 bytes, so
size 8; rows that repeat everything still get slots of their own; fewer rows than
shards leave later shards empty (without a folder); empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklore.plans.ranking import with_group_rank, with_position
from ranklore.plans.workspace import drop_path, fresh_path, staged

SHARDS, SEED = 24, 7
_PART_BITS = 33  # monotonically_increasing_id keeps the task's number above them


def _size(text):
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("bigint") + 8


def _crc32(text):
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _positions(held: DataFrame, seed: int) -> DataFrame:
    """__id and __pos, its place in the order of all shards, for every row of ``held``."""
    source, doc_id, text = (F.col(f"row.{c}") for c in ("source", "doc_id", "text"))
    rows = staged(
        held.select(
            "__id",
            F.coalesce(source, F.lit("")).alias("source"),
            doc_id.alias("doc_id"),
            _size(text).alias("size"),
            _crc32(text).alias("text_crc32"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")).alias("__h"),
        ),
        "shard-keys",
    )
    tie = ["__h", "doc_id", "text_crc32", "size", "__id"]
    ranked = with_group_rank(rows, ["source"], tie, "__rank")
    spread = ranked.withColumn("__f", (F.col("__rank") + 0.5) / F.col("__rank_of"))
    return with_position(spread, ["__f", "source", *tie], "__pos").select("__id", "__pos")


def _place_batches(folder: str):
    """A batch function that appends ``__pos`` to rows, from the files of their part."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = fs.FileSystem.from_uri(folder)
        part, known, found = None, None, None
        for batch in batches:
            ids = np.asarray(batch.column(0))
            pos = np.empty(len(ids), np.int64)
            parts = ids >> _PART_BITS
            for p in np.unique(parts):
                if p != part:
                    table = pq.read_table(f"{root}/part={p}", filesystem=store, columns=["__id", "__pos"], partitioning=None)
                    part, known, found = p, np.asarray(table["__id"]), np.asarray(table["__pos"])
                    order = np.argsort(known)
                    known, found = known[order], found[order]
                own = parts == p
                at = np.minimum(np.searchsorted(known, ids[own]), len(known) - 1)
                if (known[at] != ids[own]).any():
                    raise ValueError(f"rows without a position in part {p}")
                pos[own] = found[at]
            yield pa.RecordBatch.from_arrays([pa.array(pos), batch.column(1)], ["__pos", "row"])

    return place


def written_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Write every row of ``docs`` into its shard below ``path`` (unset: a fresh folder in the
    shared one) and return a scan of the shards: row (all columns of ``docs``), slot, shard."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    held_path, map_path = fresh_path(spark, "shard-rows"), fresh_path(spark, "shard-positions")
    numbered = docs.select(F.monotonically_increasing_id().alias("__id"), F.struct("*").alias("row"))
    numbered.write.option("compression", "zstd").parquet(held_path)
    held = spark.read.schema(numbered.schema).parquet(held_path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright("__id", _PART_BITS).alias("part")
    _positions(held, seed).select("__id", "__pos", part).repartition(tasks, "part").write.partitionBy("part").parquet(map_path)
    n = max(held.count(), 1)
    kind = T.StructType([T.StructField("__pos", T.LongType()), numbered.schema["row"]])
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    rows = (
        held.mapInArrow(_place_batches(map_path), kind)
        .repartitionById(tasks, F.expr(f"cast(__pos * {tasks} div {n} as int)"))
        .withColumn("shard", F.expr(f"cast(__pos * {shards} div {n} as int)"))
        .select("row", (F.col("__pos") - first).alias("slot"), "shard")
        .sortWithinPartitions("shard", "slot")
    )
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    for done in (held_path, map_path):  # the shards hold the same rows
        drop_path(spark, done)
    return spark.read.schema(rows.schema).parquet(path)


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, text, size, text_crc32, shard, slot and row of every row of ``docs``, as read from the written shards."""
    return written_shards(docs, shards, seed).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce("row.source", F.lit("")).alias("source"),
        F.col("row.text").alias("text"),
        _size(F.col("row.text")).alias("size"),
        _crc32(F.col("row.text")).alias("text_crc32"),
        "shard",
        "slot",
        "row",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

