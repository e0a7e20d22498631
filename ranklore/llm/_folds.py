"""Held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Training samples: documents at most, in all or for each class.
SAMPLE_SEED = "sample-1"


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def draw(column: str = "doc_id") -> Column:
    """A seeded number for ordering ids: any prefix of that order is a uniform sample."""
    return F.xxhash64(F.col(column), F.lit(SAMPLE_SEED))


def drawn_share(share: Column | float, column: str = "doc_id") -> Column:
    """True for about ``share`` of the ids, always the first in seeded order."""
    return draw(column).cast("double") / 2.0**64 + 0.5 < share


def sampled_labels(labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """At most ``limit`` rows (doc_id, label): ids outside the held-out fold with a non-null
    label (of repeated ids the largest label), the first in seeded order."""
    eligible = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(fold("doc_id", folds) != held_out)
    # thinned to about twice the limit before the sort, so that its last merge stays small on any input
    share = (2 * limit + 100) / max(eligible.count(), 1)
    return (
        eligible.filter(drawn_share(share))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(draw(), "doc_id")
        .limit(limit)
    )


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, text of the documents that ``chosen`` (doc_id, label) names: one row an id,
    with the least text where the id repeats, so never more rows than ``chosen`` has."""
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text")
