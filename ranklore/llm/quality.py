"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

Tokens are runs of letters and digits, or runs of other signs, case kept. Unigrams and
bigrams are hashed into 2^18 slots; a bigram of a token with itself, and a token that
comes back after one other, are signs of their own. A document's features are
1 + ln(tf), scaled to length one; its score is the logistic of one sparse dot product
plus bias.

Training follows the regularised leader, document by document in seeded order, over at
most ``SAMPLE`` labelled documents outside the held-out fold (a bounded sample; the
bound is this parameter). Features of the sample are made on the executors; the driver
sees sparse vectors of at most that many documents and sends back 2^18 weights (2 MB).
Scores use the text alone.

Defined results: null and empty texts have no features and score the bias; without any
label the model is empty and all scores are 0.5; repeated ids are scored row by row;
empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.llm._batches import Memo, text_runs
from ranklore.llm._folds import fold, sampled_labels, texts_of

BITS, SAMPLE, STEPS = 18, 6000, 24_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SAME = np.uint64(0x5851F42D4C957F2D)
_AGAIN = np.uint64(0x14057B7EF767814F)
_HASHES = Memo(lambda token: xxhash.xxh64_intdigest(token), 200_000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of ``texts``: slots, values, and the number of entries of each row."""
    tokens = [TOKEN.findall(t) for t in texts]
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = [t for own in tokens for t in own]
    h = np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))
    owner = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair[h[:-1] == h[1:]] = _SAME
    inner = owner[:-1] == owner[1:]
    again = np.flatnonzero((h[:-2] == h[2:]) & (owner[:-2] == owner[2:]))
    slots = np.concatenate((h, pair[inner], np.full(len(again), _AGAIN))) >> np.uint64(64 - BITS)
    whose = np.concatenate((owner, owner[:-1][inner], owner[again]))
    keys, tf = np.unique(whose.astype(np.uint64) << np.uint64(BITS) | slots, return_counts=True)
    rows = (keys >> np.uint64(BITS)).astype(np.int64)
    values = 1.0 + np.log(tf)
    norms = np.sqrt(np.bincount(rows, values * values, minlength=len(texts)))
    return (
        (keys & np.uint64((1 << BITS) - 1)).astype(np.int32),
        (values / norms[rows]).astype(np.float32),
        np.bincount(rows, minlength=len(texts)),
    )


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS) -> np.ndarray:
    """FTRL-proximal over (slots, values, label) rows, about ``steps`` updates in 4 to 40 passes; weights with the bias in the last place."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(at):
        raw = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, raw)

    for _ in range(max(4, min(40, steps // max(len(rows), 1)))):
        for slots, values, label in rows:
            at, x = np.concatenate((slots, bias)), np.append(values, 1.0)
            w = weights(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label
            g = error * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange((1 << BITS) + 1))


def score(texts: list[str], weights: np.ndarray) -> np.ndarray:
    slots, values, counts = features(texts)
    rows = np.repeat(np.arange(len(texts)), counts)
    dots = np.bincount(rows, weights[slots] * values, minlength=len(texts)) + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(dots, -35, 35)))


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, texts in text_runs(batch):
            slots, values, counts = features(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.ListArray.from_arrays(offsets, pa.array(slots)),
                    pa.ListArray.from_arrays(offsets, pa.array(values)),
                ],
                ["doc_id", "label", "slots", "vals"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents outside the held-out fold."""
    chosen = sampled_labels(labels, "quality", FOLDS, HELD_OUT, sample)
    texts = texts_of(docs, chosen)
    found = texts.mapInArrow(_vector_batches, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, slots array<int>, vals array<float>")
    table = found.toArrow().sort_by("doc_id")  # at most ``sample`` rows
    order = np.random.default_rng(1).permutation(table.num_rows)
    slots, values = table["slots"].combine_chunks(), table["vals"].combine_chunks()
    label = table["label"].to_pylist()
    rows = [(np.asarray(slots[i].values), np.asarray(values[i].values), label[i]) for i in order.tolist()]
    return train(rows)


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            scores = [score(texts, weights) for _, _, texts in text_runs(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate([np.empty(0), *scores]))], [*batch.schema.names[:-1], "score"]
            )

    return run


def score_quality(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text"]
    return slim.mapInArrow(_score_batches(shared), ", ".join([*fields, "score double"]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, weights).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
