"""Language identification by rank-order n-gram profiles.

A text is lower-cased, cut at everything that is not a letter, and its words padded
with a boundary mark (combining marks belong to the letter before them and are nothing
without one). Its 1- to 4-grams are hashed into 2^16 places; the ``PROFILE``
most frequent ones, in order, are its profile. A language's profile is made the same
way from the counts of a sample of its texts (``SAMPLE`` documents a language, the
first in seeded order). Out-of-place distance: for each n-gram of the text the
difference of its ranks, ``PROFILE`` if the language's profile lacks it. The nearest
language wins, ties go to the name that sorts first. Score: one minus the distance as
a share of the largest possible one.

Only text and non-null ``lang`` of documents outside the held-out fold are learned
from. Texts are scored whole, in vectorised passes over runs of bounded size.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and
for all texts if nothing could be learned; repeated ids are predicted row by row;
empty table: empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklore.llm._batches import text_runs
from ranklore.llm._folds import draw, drawn_share, fold
from ranklore.plans.workspace import staged

PROFILE, SAMPLE, FOLDS, HELD_OUT = 400, 400, 3, 1
UNKNOWN = "und"
MAX_LANGUAGES = 500  # each worker holds a rank table per language; more are an error
_ORDERS, _BITS = 4, 16
_MARK = 1 << 24  # above all code points
_RUN = 256 << 10


@lru_cache(1)
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, a combining mark plus ``_MARK``, or 0 for what is neither."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
        elif unicodedata.combining(char) and point < 0x3100:
            table[point] = point | _MARK
    return table


def _letters(points: np.ndarray) -> np.ndarray:
    """Folded code points, 0 for what is not part of a word: a mark is one only behind a letter or its marks."""
    folded = _folding()[points]
    mark = folded >= _MARK
    if not mark.any():
        return folded
    bearer = np.maximum.accumulate(np.where(mark, 0, np.arange(len(folded))))  # the last place before that is no mark
    return np.where(mark & ((folded[bearer] == 0) | mark[bearer]), 0, folded & (_MARK - 1))


def ngram_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash places of all n-grams of ``texts``, text by text, and the number of each text."""
    joined = "".join([f"\0{t}\0" for t in texts])  # each text brings its own marks, whatever stands beside it
    points = _letters(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = points > 0
    # of a run of other characters the first stays, as the boundary mark; so does the one that opens a text
    keep = letter | np.concatenate(([False], letter[:-1]))
    keep[np.cumsum(sizes) - sizes] = True
    points, owner, letter = points[keep], owner[keep], letter[keep]
    if not len(points):
        return np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
    places, owners = [], []
    value = np.full(len(points), 2166136261, np.uint32)
    inside = np.ones(len(points), bool)  # the n-gram has no mark but at its ends
    for n in range(1, _ORDERS + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        value = (value[:size] ^ points[n - 1 :]) * np.uint32(16777619)
        value ^= value >> np.uint32(15)
        inside = inside[:size]
        if n > 2:
            inside = inside & letter[n - 2 : n - 2 + size]
        good = inside & (owner[:size] == owner[n - 1 :])
        if n == 1:
            good = good & letter[:size]
        places.append(((value ^ (value >> np.uint32(16))) & np.uint32((1 << _BITS) - 1))[good].astype(np.uint16))
        owners.append(owner[:size][good])
    every, whose = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return every[order], np.bincount(whose, minlength=len(texts))


def top_places(counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent places in order; ties go to the lower place."""
    held = np.flatnonzero(counts)
    key = (counts[held].astype(np.int64) << _BITS) | ((1 << _BITS) - 1 - held)
    if len(key) > size:
        key = np.partition(key, len(key) - size)[-size:]
    return (1 << _BITS) - 1 - (np.sort(key)[::-1] & ((1 << _BITS) - 1))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of each language's n-grams in this task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for start, _, texts in text_runs(batch, _RUN):
            places, sizes = ngram_places(texts)
            for i, part in enumerate(np.split(places, np.cumsum(sizes)[:-1])):
                own = totals.setdefault(langs[start + i], np.zeros(1 << _BITS, np.int64))
                own += np.bincount(part, minlength=1 << _BITS)
    for lang, counts in totals.items():
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())],
            ["lang", "place", "n"],
        )


def learn_profiles(docs: DataFrame, per_language: int = SAMPLE) -> dict[str, list[int]]:
    """Profile of each language: places in order. On the driver: languages x ``PROFILE`` numbers."""
    eligible = docs.filter(
        (fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    counts = eligible.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], (2.0 * per_language + 100) / r["n"]) for r in counts], "lang string, share double")
    # each language is thinned to about twice the sample first, so the ranking moves few rows however common it is
    thin = eligible.select("doc_id", "lang").join(F.broadcast(shares), "lang").filter(drawn_share(F.col("share"))).select("doc_id", "lang").distinct()
    ranked = Window.partitionBy("lang").orderBy(draw(), "doc_id")
    chosen = thin.withColumn("__n", F.row_number().over(ranked)).filter(F.col("__n") <= per_language)
    found = eligible.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    texts = found.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")  # one text of an id that repeats
    places = texts.mapInArrow(_count_batches, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "place")
    top = places.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "place", "rank").collect():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["place"]))
    return {lang: [p for _, p in sorted(found)] for lang, found in sorted(profiles.items())}


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.ranks = np.full((len(self.names), 1 << _BITS), -1, np.int32)
        for i, name in enumerate(self.names):
            self.ranks[i, profiles[name]] = np.arange(len(profiles[name]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        places, sizes = ngram_places(texts)
        stops = np.cumsum(sizes).tolist()
        start = 0
        for stop in stops:
            if stop == start or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            top = top_places(np.bincount(places[start:stop], minlength=1 << _BITS))
            ranks = self.ranks[:, top]
            apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
            best = int(np.argmin(apart))
            names.append(self.names[best])
            scores.append(1.0 - float(apart[best]) / (PROFILE * len(top)))
            start = stop
        return names, scores


def _predict_batches(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            names, scores = [], []
            for _, _, texts in text_runs(batch, _RUN):
                found = profiles.predict(texts)
                names += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return predict


def predict_languages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), profiles: dict[str, list[int]] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred and score for every row; profiles are learned from ``docs`` if not given."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_profiles(docs) if profiles is None else profiles)
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text"]
    return slim.mapInArrow(_predict_batches(shared), ", ".join([*fields, "lang_pred string", "score double"]))


def drop_unidentified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows whose language is identified with a score of at least ``least_score``; others go.

    No score is below 0, so by default only ``und`` goes: null texts and texts without a letter.
    If no language could be learned, the rows whose text has a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_profiles(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            flags = []
            for _, _, texts in text_runs(batch, _RUN):
                if not profiles.names:
                    flags += (ngram_places(texts)[1] > 0).tolist()
                    continue
                names, scores = profiles.predict(texts)
                flags += [n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
