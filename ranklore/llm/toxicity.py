"""Toxicity by multiple-instance learning: noisy-or over sentences.

A document's label says that some sentence is toxic, not which. Sentences (cut at
``.!?`` and line ends, and every ``WINDOW`` words) get a logistic score from the hashed
different words, their first four letters and bias; the document's score is the noisy-or
1 - prod(1 - p). Both are trained together from document labels by adaptive
gradient steps on the noisy-or likelihood, over at most ``SAMPLE`` labelled documents
outside the held-out fold (a bounded sample; the bound is this parameter). The trained
sentence scores then locate the offending sentences.

Features of the sample are made on the executors; the driver sees at most that many
documents as slot numbers and sends back 2^18 weights (2 MB). Scores use text alone.
An offending sentence is given by its place in the text (characters from 0, end
exclusive; of a sentence cut by ``WINDOW``, from its first word to its last), and the
query carries the number and the places of the offending sentences of each document.

Defined results: a text without words (null, empty, blank) scores 0; without any label
the model is empty, sentences score as little as the bias lets them; repeated ids are
scored row by row; empty table: empty result.
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

BITS, SAMPLE, UPDATES, BATCH, WINDOW = 18, 12_000, 300_000, 128, 40
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
RATE, START, DECAY, PRIOR = 1.0, 1e-2, 1e-4, -7.0
PARTS = 2
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?\n]")


def _slots(word: str) -> tuple[int, int]:
    """Slots of the word and of its first four letters (the last slot: the word is too short to have them)."""
    shift, none = 64 - BITS, (1 << BITS) - 1
    low = word.lower()
    return (
        xxhash.xxh64_intdigest(low, 1) >> shift,
        xxhash.xxh64_intdigest(low[:4], 2) >> shift if len(low) > 3 else none,
    )


_SLOTS = Memo(_slots, 100_000)


def sentences(text: str) -> list[list[str]]:
    """The different words of each sentence; sentences without a word are left out."""
    out = []
    for part in _END.split(text):
        words = _WORD.findall(part)
        out += [list(dict.fromkeys(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)]
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``sentences(text)`` stands: (start, stop), from its first word to its last."""
    out, at = [], 0
    for part in _END.split(text):
        words = [m.span() for m in _WORD.finditer(part)]
        out += [(at + words[i][0], at + words[min(i + WINDOW, len(words)) - 1][1]) for i in range(0, len(words), WINDOW)]
        at += len(part) + 1
    return out


def _noisy_or(logits: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """ln of the chance that no sentence of a document is toxic."""
    return -np.bincount(doc, np.logaddexp(0.0, logits), minlength=docs)


def train(
    slots: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, passes: int | None = None, batch: int = BATCH
) -> np.ndarray:
    """Weights (bias last) by adaptive gradient steps on the noisy-or likelihood.

    ``slots`` is (words, PARTS); ``sentence`` the sentence of each word and ``doc`` the
    document of each sentence, both ascending; ``label`` the label of each document.
    Steps take ``batch`` documents in order; ``passes`` defaults to about ``UPDATES`` documents seen.
    """
    w = np.zeros((1 << BITS) + 1)
    w[-1] = PRIOR
    if not len(label) or not len(slots):
        return w
    none = (1 << BITS) - 1
    power = np.full(len(w), float(START))
    docs = np.arange(0, len(label) + batch, batch).clip(max=len(label))
    sents = np.searchsorted(doc, docs)
    words = np.searchsorted(sentence, sents)
    for _ in range(passes or max(8, min(60, UPDATES // len(label)))):
        for k in range(len(docs) - 1):
            flat = slots[words[k] : words[k + 1]].ravel()
            owner = np.repeat(sentence[words[k] : words[k + 1]] - sents[k], PARTS)
            own, y = doc[sents[k] : sents[k + 1]] - docs[k], label[docs[k] : docs[k + 1]]
            logits = np.bincount(owner, w[flat], minlength=len(own)) + w[-1]
            clean = _noisy_or(logits, own, len(y))
            p = 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))
            toxic = -np.expm1(np.minimum(clean, -1e-12))
            pull = np.where(y[own] == 1, -p * (np.exp(clean) / toxic)[own], p)
            g = np.bincount(flat, pull[owner], minlength=len(w))
            g[-1] = pull.sum()
            g[none] = 0.0
            g[:-1] += DECAY * len(y) * w[:-1]
            power += g * g
            w -= RATE * g / np.sqrt(power)
    return w


class SentenceScorer:
    """Scores words through a bounded memo of their summed weights."""

    def __init__(self, weights: np.ndarray):
        self.bias = float(weights[-1])
        w = weights.tolist()
        self.words = Memo(lambda word: sum(w[s] for s in _slots(word)), 200_000)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every sentence of ``texts``, text by text, and the number of sentences of each text."""
        value, sums, counts = self.words.__getitem__, [], []
        for text in texts:  # one text's words at a time: what is kept of them is a number a sentence
            own = [sum(map(value, s)) for s in sentences(text)]
            sums += own
            counts.append(len(own))
        return np.array(sums, np.float64) + self.bias, np.array(counts, np.int64)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score of each text, the scores of all sentences, text by text, and each text's number of sentences."""
        logits, counts = self.logits(texts)
        clean = _noisy_or(logits, np.repeat(np.arange(len(texts)), counts), len(texts))
        return -np.expm1(clean), 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35))), counts

    def sentence_scores(self, text: str) -> list[float]:
        return self.scores([text])[1].tolist()

    def score(self, text: str) -> float:
        return float(self.scores([text])[0][0])


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, texts in text_runs(batch):
            slots, sizes = [], []
            for text in texts:
                own = sentences(text)
                slots.append([x for s in own for word in s for x in _SLOTS[word]])
                sizes.append([len(s) for s in own])
            part = batch.slice(start, stop - start)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(slots, kind), pa.array(sizes, kind)], ["doc_id", "label", "slots", "sizes"]
            )


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents outside the held-out fold."""
    chosen = sampled_labels(labels, "toxic", FOLDS, HELD_OUT, sample)
    texts = texts_of(docs, chosen)
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(_sample_batches, f"doc_id {kind}, label int, slots array<int>, sizes array<int>")
    table = found.toArrow().sort_by("doc_id")  # at most ``sample`` rows
    table = table.take(np.random.default_rng(1).permutation(table.num_rows))
    slots = np.asarray(table["slots"].combine_chunks().flatten()).reshape(-1, PARTS)
    sizes = table["sizes"].combine_chunks()
    per_sentence = np.asarray(sizes.flatten()).astype(np.int64)
    per_doc = np.asarray(sizes.value_lengths()).astype(np.int64)
    return train(
        slots,
        np.repeat(np.arange(len(per_sentence)), per_sentence),
        np.repeat(np.arange(len(per_doc)), per_doc),
        np.asarray(table["label"].to_pylist(), np.int64),
    )


_SPANS = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
_SPAN_COLUMN = "offending array<struct<sentence:int,start:bigint,stop:bigint,score:double>>"


def _score_batches(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = SentenceScorer(shared.value)
        for batch in batches:
            scores, found = [np.empty(0)], []
            for _, _, texts in text_runs(batch):
                own, sentence_scores, counts = scorer.scores(texts)
                scores.append(own)
                hits = np.flatnonzero(sentence_scores >= threshold)
                firsts = np.cumsum(counts) - counts
                told: list[list[dict]] = [[] for _ in texts]
                last, spans = -1, []
                for hit, i in zip(hits.tolist(), (np.searchsorted(firsts, hits, "right") - 1).tolist(), strict=True):
                    if i != last:
                        last, spans = i, sentence_spans(texts[i])
                    k = hit - int(firsts[i])
                    told[i].append({"sentence": k, "start": spans[k][0], "stop": spans[k][1], "score": float(sentence_scores[hit])})
                found += told
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(scores)), pa.array(found, _SPANS)], [*batch.schema.names[:-1], "score", "offending"]
            )

    return run


def score_toxicity(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, the noisy-or score of every row, and ``offending``: sentence (from 0),
    start, stop and score of its sentences that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text"]
    return slim.mapInArrow(_score_batches(shared, threshold), ", ".join([*fields, "score double", _SPAN_COLUMN]))


def offending_sentences(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (from 0), score, start, stop, words (the text there) of every sentence that scores at least ``threshold``."""
    found = score_toxicity(docs, weights, ("doc_id", F.col("text").cast("string").alias("__text")), threshold)
    one = found.select("doc_id", "__text", F.explode("offending").alias("one"))
    words = F.expr("substring(__text, CAST(one.start AS INT) + 1, CAST(one.stop - one.start AS INT))")
    return one.select("doc_id", "one.sentence", "one.score", "one.start", "one.stop", words.alias("words"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, weights).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )
