"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles with
repeats, XXH64 (seed 42) of each; a bit is set when more than half the hashes set it.

Candidates: each of the 64 bit places gets a non-zero vector of GF(2)^5. Table ``v``
keeps the places whose vector has odd inner product with ``v``. Four vectors never
span five dimensions, so for any four differing places some table drops all of them:
every pair within the radius shares a key in at least one of the 31 tables. No
candidate is capped. A bucket of more than ``BUCKET_LIMIT`` different fingerprints is
dealt again by a second (then third) covering under the joint mask; after three
levels so few places are left free that buckets are small whatever the data.

Only different fingerprints are compared, each once per table; a bucket gives
spanning-forest edges, not its pairs. Components come from alternating large-star
and small-star rounds on work tables in the shared folder.

Defined results
* Null, empty and blank texts have no words: fingerprint 0, linked like any other.
* 1 to 3 words: the whole sequence is the only shingle.
* Rows that share a doc_id get their own fingerprints; ``component_id`` is the
  smallest non-null doc_id of the component (null if all are null).
* Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.llm._batches import text_runs
from ranklore.llm._components import components
from ranklore.plans.lookup import lookup_by_key
from ranklore.plans.workspace import staged

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
BUCKET_LIMIT = 8192
_SHORT_RUN = 32


def covering_masks(seed: int, radius: int = RADIUS) -> list[int]:
    """2^(radius+1)-1 masks; any two 64-bit values within ``radius`` agree on one of them."""
    vectors = (1 << (radius + 1)) - 1
    places = np.random.default_rng(seed).permutation(64)
    vector_of = {int(p): 1 + i % vectors for i, p in enumerate(places)}
    return [
        sum(1 << p for p, vec in vector_of.items() if (vec & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-SHINGLE_WORDS] + 1)).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ends = stops[SHINGLE_WORDS - 1 :].tolist()
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))


_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each group of ``counts[i]`` consecutive hashes (0 for an empty group).

    Bit counts run in eight byte lanes of a 64-bit word, in blocks of at most 255
    hashes, so a lane never overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    blocks = -(-sizes // 255)
    firsts = np.cumsum(sizes) - sizes
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_starts = np.repeat(firsts, blocks) + within * 255
    group_starts = np.cumsum(blocks) - blocks
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, block_starts)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), group_starts)
        for lane in range(8):
            bit = (2 * totals[:, lane] > sizes).astype(np.uint64)
            out[full] |= bit << np.uint64(8 * lane + k)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.empty(0, np.uint64)]
        for _, _, texts in text_runs(batch):
            hashes = [shingle_hashes(t) for t in texts]
            parts.append(majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes])))
        fp = np.concatenate(parts).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fp), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]]
        )


def fingerprints(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, fp) and the columns ``keep`` for every row; ``fp`` is the fingerprint as a signed 64-bit number."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[2:]]
    return slim.mapInArrow(_fingerprint_batches, ", ".join(["doc_id bigint, fp bigint", *kept]))


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _reach(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) edges of the link graph on different ``values``: every member is
    compared with all that are not yet reached, in blocks, and pairs are not kept."""
    left, members, roots = values.copy(), [], []
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            block, frontier = frontier[:128], frontier[128:]
            hit = np.zeros(len(left), bool)
            for value in block:
                hit |= _within(left, value)
            found, left = left[hit], left[~hit]
            members.append(found)
            roots.append(np.full(len(found), root))
            frontier = np.concatenate((frontier, found))
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *members]), np.concatenate([empty, *roots])


def _bucket_edges(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside runs of equal ``key``; short runs pair by pair at once, longer ones by search."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    room = np.repeat(np.where(sizes <= _SHORT_RUN, sizes, 0), sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))
    for step in range(1, _SHORT_RUN):
        i = np.flatnonzero(room > step)
        if not len(i):
            break
        a, b = fp[i], fp[i + step]
        near = _within(a, b)
        left.append(a[near])
        right.append(b[near])
    for k in np.flatnonzero(sizes > _SHORT_RUN):
        a, b = _reach(np.unique(fp[starts[k] : starts[k] + sizes[k]]))
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _link_batches(limit: int | None):
    """Rows (mask, key, fp) sorted by (mask, key) to edges (mask null) and, of buckets
    over ``limit``, the rows themselves (b null) for the next level."""

    def out(a, b, mask):
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), b if isinstance(b, pa.Array) else pa.array(b.view(np.int64)), mask], ["a", "b", "mask"]
        )

    def over(mask, fp):
        return out(fp, pa.nulls(len(fp), pa.int64()), pa.array(mask))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.empty(0, np.int64)
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        spilling = None  # (mask, key) of a bucket that has passed the limit

        def edges(run_key, run_fp):
            a, b = _bucket_edges(run_key, run_fp)
            return out(a, b, pa.nulls(len(a), pa.int64()))

        for batch in batches:
            m, k, f = (np.asarray(batch.column(i)) for i in range(3))
            mask, key, fp = np.concatenate((mask, m)), np.concatenate((key, k)), np.concatenate((fp, f.view(np.uint64)))
            if spilling is not None:
                n = int(np.argmin(np.append((mask == spilling[0]) & (key == spilling[1]), False)))
                yield over(mask[:n], fp[:n])
                mask, key, fp = mask[n:], key[n:], fp[n:]
                spilling = spilling if not len(key) else None
            if not len(key):
                continue
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            run = np.cumsum(new)
            if limit is not None:
                big = np.repeat(sizes > limit, sizes)
                if big.any():
                    yield over(mask[big], fp[big])
                    if big[-1]:
                        spilling = (mask[-1], key[-1])
            else:
                big = np.zeros(len(key), bool)
            open_run = run == run[-1]  # may go on in the next batch
            done = ~big & ~open_run
            if done.any():
                yield edges(run[done], fp[done])
            rest = open_run & ~big
            mask, key, fp = mask[rest], key[rest], fp[rest]
        if len(key):
            yield edges(np.zeros(len(key), np.int64), fp)

    return link


def near_edges(distinct_fps: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of "differ in at most 4 bits" on different ``fp``."""
    spark = distinct_fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, found = distinct_fps.select(F.lit(0).cast("bigint").alias("mask"), "fp"), None
    for depth in range(3):
        masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in covering_masks(depth + 1)])
        keyed = (
            level.select("fp", F.col("mask").alias("outer"), F.explode(masks).alias("inner"))
            .withColumn("mask", F.col("outer").bitwiseOR(F.col("inner")))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        )
        last = depth == 2
        linked = staged(
            keyed.repartition(parts, "mask", "key")
            .sortWithinPartitions("mask", "key")
            .mapInArrow(_link_batches(None if last else limit), "a bigint, b bigint, mask bigint"),
            "near-links",
        )
        edges = linked.filter("b IS NOT NULL").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        level = linked.filter("b IS NULL").select("mask", F.col("a").alias("fp")).distinct()
        if last or level.isEmpty():
            return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    return found


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` (one row a different ``fp``) with the root of their component."""
    roots = components(near_edges(nodes.select("fp")))
    return staged(
        nodes.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        ),
        "fp-roots",
    )


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id."""
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = staged(
        rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "fp-nodes"
    )
    rooted = _rooted(nodes)
    heads = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = lookup_by_key(rooted, heads, "root", "nodes", nodes.count()).select("fp", "copies", "component_id")
    return lookup_by_key(rows, staged(named, "fp-components"), "fp", "copies", rows.count()).select(
        "doc_id", "fp", "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id.

    Null ids come last; of rows that share the id the smallest digest of the text
    decides, and of rows that share both any one stays.
    """
    held = staged(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "near-rows")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")
    slim = held.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "place")
    rows = staged(fingerprints(slim, digest, F.col("place")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "place")
    rooted = _rooted(staged(rows.groupBy("fp").agg(F.min(order).alias("first")), "fp-nodes"))
    stay = staged(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.place"), "near-stay")
    return held.join(stay.hint("merge"), "place", "left_semi").select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
