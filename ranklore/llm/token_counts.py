"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A document of up to ``CHUNK`` characters is encoded at once. A longer one is encoded
in chunks that overlap; each chunk's encoding comes with offsets and with the number
of the pre-token that each token belongs to. Two neighbouring chunks are spliced at a
boundary that is proven stable:

* both encodings start a pre-token there (pre-tokens are cut from left to right, so
  from a common start on, both see the same text and cut it alike), and
* in the left chunk at least two more pre-tokens follow and the boundary is further
  from its end than any special string is long, so neither the chunk's end nor a
  special string that it cuts can have moved it.

Tokens never cross pre-tokens, so the counts left and right of the boundary add up.
Where the overlap has no such boundary (one pre-token of thousands of characters) the
overlap is doubled, at the utmost to the whole rest of the document.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside texts count as the library's default has it. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.llm._batches import text_runs

CHUNK, OVERLAP, LIMIT = 32_768, 512, 512


def load_tokenizer(definition: bytes):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ChunkedCounter:
    """Counts the tokens of single texts; ``widened`` tells how often an overlap was doubled."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        self.tokenizer, self.chunk, self.overlap, self.widened = tokenizer, chunk, overlap, 0
        specials = tokenizer.get_added_tokens_decoder().values()
        self.margin = max((len(t.content) for t in specials), default=0)

    def _encode(self, text: str, start: int, stop: int) -> tuple[list[int], dict[int, int]]:
        """Tokens of text[start:stop]: starts of the pre-tokens (in the whole text), and
        for each start the number of tokens before it."""
        encoding = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        starts, before = [], {}
        last = object()
        for n, (word, (left, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
            if word is None or word != last:  # an added token has no pre-token number: it is one of its own
                starts.append(start + left)
                before[start + left] = n
            last = word
        before[stop] = len(encoding.ids)
        return starts, before

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, spliced, stop = 0, 0, self.chunk
        starts, before = self._encode(text, 0, stop)
        while stop < len(text):
            overlap = self.overlap
            while True:
                right_start = max(spliced, stop - overlap)
                right_stop = min(len(text), max(right_start + self.chunk, stop + overlap))
                right_starts, right_before = self._encode(text, right_start, right_stop)
                right_set = set(right_starts[1:])  # its first start may be inside a pre-token
                common = next(
                    (s for s in reversed(starts[:-2]) if s <= stop - self.margin and s > spliced and s in right_set), None
                )
                if common is not None:
                    break
                self.widened += 1
                overlap *= 2
                if right_start == spliced:  # nothing left to widen on the left: a longer left chunk
                    stop = min(len(text), max(2 * stop - spliced, stop + overlap))
                    starts, before = self._encode(text, spliced, stop)
                    if stop == len(text):
                        return total + before[stop]
            total += before[common] - before.get(spliced, 0)
            spliced, starts, before, stop = common, right_starts, right_before, right_stop
        return total + before[len(text)] - before.get(spliced, 0)


_COUNTERS: dict[str, ChunkedCounter] = {}


def _counter(definition: bytes, chunk: int, overlap: int) -> ChunkedCounter:
    key = f"{hashlib.sha256(definition).hexdigest()}-{chunk}-{overlap}"
    if key not in _COUNTERS:
        _COUNTERS[key] = ChunkedCounter(load_tokenizer(definition), chunk, overlap)
    return _COUNTERS[key]


def _count_batches(definition, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition.value, chunk, overlap)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, _, texts in text_runs(batch):
                short = [t for t in texts if len(t) <= chunk]
                encoded = iter(counter.tokenizer.encode_batch_fast(short, add_special_tokens=False))
                for t in texts:
                    n_bytes.append(len(t.encode("utf-8")))
                    n_tokens.append(len(next(encoded).ids) if len(t) <= chunk else counter.count(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. The tokenizer file is read on
    the driver and broadcast (its size is fixed, a few MB)."""
    with open(tokenizer_path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    counted = slim.mapInArrow(
        _count_batches(definition, chunk, overlap), f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"))
