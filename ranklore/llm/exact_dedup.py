"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a Parquet table ``(digest, keep_id, keep_mark, batch)`` bucketed and
sorted by ``digest``; it outlives the session that made it. A batch of new
documents is hashed once, copies inside the batch are folded with a map-side
combine, the remaining digests are anti-joined (sort-merge; the index side is
read in bucket order without a shuffle) and only unseen ones are appended.

Nothing in the index depends on how a batch was split into tasks: the survivor of a
group is found by (doc_id, ``keep_mark``), a hash of all its columns. Rows that agree
in every column are interchangeable, so the one of them that stays is picked anew,
by its place, in each call. A batch can therefore be run again, over any layout and
after a crash at any point, and gives the same rows.

The number of buckets is part of the index: it is written beside the data when the
index is made, taken from there when it is opened again, and opening it with another
number is an error. It defaults to one bucket for ``ROWS_PER_BUCKET`` expected rows,
and to the session's shuffle partitions at least. Each append adds a file a bucket;
``rewritten`` makes a compacted copy, with another number of buckets if asked.

Defined results
* Equality: texts identical after lower-casing A-Z only; a null text counts as
  empty, so nulls and empty texts are copies of each other.
* Inside a batch the largest ``doc_id`` stays (null ids are smaller than all
  others); of rows with that id the one with the largest mark; of rows that repeat
  everything exactly one.
* A text that an earlier batch has already put into the index is dropped whole:
  ``keep_id`` then names the document that stayed back then.
* A batch name stands for one set of rows; the same rows under it again change nothing.
* Empty input: empty result, index unchanged. Input columns may have any names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.plans.lookup import lookup_by_key
from ranklore.plans.workspace import drop_path, fresh_path, read_marker, staged, write_marker

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000  # what Spark allows by default


def text_digest(text: str = "text") -> Column:
    """SHA-256 (32 bytes) of the normalised text in UTF-8."""
    folded = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.unhex(F.sha2(folded.cast("binary"), 256))


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns of a row (of what cannot be hashed, of its JSON)."""
    plain = [f.dataType.simpleString().find("map<") < 0 and f.dataType.typeName() != "variant" for f in docs.schema]
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema]
    return F.xxhash64(*[c if ok else F.to_json(F.struct(c)) for c, ok in zip(columns, plain, strict=True)])


class DigestIndex:
    """The persistent index at ``path``; ``buckets`` (unset: from ``expected_rows``) is fixed when it is first made."""

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_mark BIGINT, batch STRING"
    _MARKER = "buckets"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, expected_rows: int = 0):
        self.spark, self.path = spark, path or fresh_path(spark, "digest-index")
        made = read_marker(spark, self.path, self._MARKER)
        if made is not None and buckets not in (None, int(made)):
            raise ValueError(f"the index at {self.path} has {made} buckets, not {buckets}")
        if made is None:
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            made = buckets or min(MAX_BUCKETS, max(least, -(-expected_rows // ROWS_PER_BUCKET)))
            write_marker(spark, self.path, self._MARKER, str(made))
        self.buckets = int(made)
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{self.buckets}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        # dealt as the buckets are: one file a bucket and append
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)

    def drop(self) -> None:
        """Delete the index and its entry in the catalog."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.path)

    def rewritten(self, path: str, buckets: int | None = None) -> DigestIndex:
        """A copy at the new ``path`` with one file a bucket, and ``buckets`` of them (unset: as many as now)."""
        copy = DigestIndex(self.spark, path, buckets or self.buckets)
        if not copy.read().isEmpty():
            raise ValueError(f"there is an index at {path} already")
        copy._append(self.read())
        return copy

    def dedup(self, docs: DataFrame, batch: str) -> DataFrame:
        """Deduplicate ``docs`` against the index and append what is new.

        Returns one row per row of ``docs``: doc_id, digest, mark, keep_id, group_size
        (rows of this batch with the same text), kept.
        """
        rows = staged(
            docs.select(
                F.col("doc_id").cast("bigint").alias("doc_id"),
                text_digest().alias("digest"),
                row_mark(docs).alias("mark"),
                F.monotonically_increasing_id().alias("row_id"),
            ),
            "digests",
        )
        groups = staged(
            rows.groupBy("digest")
            .agg(
                F.max(F.struct("doc_id", "mark", "row_id")).alias("top"),
                F.count(F.lit(1)).alias("group_size"),
            )
            .select("digest", "top", "group_size"),
            "digest-groups",
        )
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.mark").alias("keep_mark"), F.lit(batch).alias("batch")))
        known = self.read().withColumnRenamed("batch", "first_batch").hint("merge")
        own = (F.col("first_batch") == batch) & F.col("keep_id").eqNullSafe(F.col("top.doc_id")) & (F.col("keep_mark") == F.col("top.mark"))
        decided = groups.join(known, "digest").select("digest", "keep_id", F.when(own, F.col("top.row_id")).alias("keep_row"), "group_size")
        return lookup_by_key(rows, decided, "digest", "group_size", rows.count()).select(
            "doc_id", "digest", "mark", "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_row")).alias("kept")
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """Deduplicate ``docs``; without an index a new, empty one, sized by them, is made in the shared folder."""
    return (index or DigestIndex(docs.sparkSession, expected_rows=docs.count())).dedup(docs, batch)


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Rows leave by (doc_id, text, mark), so documents that share an id are decided one by
    one; of rows that agree in every column one stays.
    """
    used = index or DigestIndex(docs.sparkSession, expected_rows=docs.count())
    verdict = staged(exact_dedup(docs, used, batch), "dedup-verdict")
    if index is None:
        used.drop()
    stay = verdict.filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest"), F.col("mark").alias("stay_mark"))
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), text_digest().alias("digest"), row_mark(docs).alias("mark")
    )
    same = (F.col("digest") == F.col("stay_digest")) & (F.col("mark") == F.col("stay_mark")) & F.col("id").eqNullSafe(F.col("stay_id"))
    out = keyed.join(stay.hint("merge"), same, "left_semi")
    twins = verdict.filter("NOT kept AND doc_id <=> keep_id")
    if not twins.isEmpty():  # rows that repeat everything pass the join together
        out = out.dropDuplicates(["id", "digest", "mark"])
    return out.select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return verdict.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
