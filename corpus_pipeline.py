"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents, with any further columns that documents may have, whatever their names.
A stage's own work tables are deleted once its result is written.

Defined results
* Null, empty and blank texts, and texts without a letter, leave in the first stage.
* A null lang is not learned from; if no language can be learned, all texts with a
  letter stay. A null source counts as the empty one, with a share of its own.
* Null doc_ids: the exact stage ranks them below all others, the near stage behind all
  others, so a row with an id stays in their place; they draw one number in the mixture.
* Rows that share a doc_id but not a text are decided one by one by both dedup stages,
  and draw the same number in the mixture; of rows that agree in all columns one stays.
* Ties are decided by doc_id, then by a hash of the row or text, never by its place.
* Very long texts are handled whole, in runs of bounded size.
* Empty table: empty result with the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranklore.llm.exact_dedup import drop_exact_copies
from ranklore.llm.language_id import drop_unidentified
from ranklore.llm.mixing import mixed
from ranklore.llm.piece_bpe import encode_pieces
from ranklore.llm.simhash_dedup import drop_near_copies
from ranklore.plans.workspace import discard, scratch, staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language (null or no letter) go."""
    return drop_unidentified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target rate draws them, globally shuffled."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and digests."""
    from public_tokenizers import path

    keep = ("doc_id", "lang", "source")
    return encode_pieces(docs, path("piece_bpe_32k.model"), with_ids=True, keep=keep)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near),
    ("mixing", mix),
    ("piece_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, table = docs, f"pipeline-{name}"
        with scratch(spark, keep=lambda path, table=table: f"/{table}-" in path):
            docs = staged(stage(spark, docs, sf_dir), table)
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express SimHash, language profiles or merge rounds; tests/llm holds run() against a plain version.
ORACLE_SQL = None
