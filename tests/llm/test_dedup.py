import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ranklore.llm import exact_dedup as X
from ranklore.llm import simhash_dedup as N
from ranklore.llm._components import components
from ranklore.plans.lookup import lookup_by_key

FOLD = str.maketrans(X.UPPER, X.UPPER.lower())


def norm(t):
    return (t or "").translate(FOLD)


def plain_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r["doc_id"])
    return groups


def test_exact_against_plain(hard, clashing):
    rows = hard.collect()
    groups = plain_groups(rows)
    for docs in (hard, clashing):
        got = X.exact_dedup(docs).collect()
        assert len(got) == len(rows)
        by_digest = {}
        for r in got:
            by_digest.setdefault(bytes(r["digest"]), []).append(r)
        assert len(by_digest) == len(groups)
        for text, ids in groups.items():
            own = by_digest[hashlib.sha256(text.encode()).digest()]
            top = max((i for i in ids if i is not None), default=None)
            assert {r["keep_id"] for r in own} == {top} and {r["group_size"] for r in own} == {len(ids)}
            assert sum(r["kept"] for r in own) == 1 and next(r for r in own if r["kept"])["doc_id"] == top


def test_exact_drop_keeps_columns_and_one_of_each(hard, clashing, empty):
    out = X.drop_exact_copies(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sorted(norm(r["text"]) for r in rows) == sorted(plain_groups(hard.collect()))
    assert {r["doc_id"] for r in rows if norm(r["text"]) == ""} == {6}
    assert X.drop_exact_copies(empty).collect() == [] and X.exact_dedup(empty).count() == 0


def test_index_persists_and_is_idempotent(spark, hard, tmp_path):
    path = f"file://{tmp_path}/index"
    index = X.DigestIndex(spark, path, buckets=4)
    first = X.exact_dedup(hard.filter("doc_id < 4"), index, "one").collect()
    assert sum(r["kept"] for r in first) == 2
    again = X.DigestIndex(spark, path, buckets=4)
    second = X.exact_dedup(hard.filter("doc_id >= 4"), again, "two")
    told = {r["doc_id"]: r for r in second.filter("doc_id IN (4, 13)").collect()}
    assert not told[4]["kept"] and told[4]["keep_id"] == 3 and told[13]["kept"]
    n = again.read().count()
    X.exact_dedup(hard.filter("doc_id >= 4"), again, "three").count()
    assert again.read().count() == n == again.read().select("digest").distinct().count()


def test_replay_keeps_one_row_of_each_text(spark, tmp_path):
    """The same batch over other splits, and after a crash between append and answer."""
    rows = [(i // 2 if i % 10 else None, f"Text {i % 50}" if i % 3 else f"text {i % 50}", i % 4) for i in range(200)] + [(7, "twice", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    index = X.DigestIndex(spark, f"file://{tmp_path}/replayed", buckets=4)
    answers = []
    for layout in (docs, docs.repartition(1), docs.repartition(7), docs.orderBy(F.desc("text")), docs.repartition(3, "other")):
        kept = X.exact_dedup(layout, index, "one").filter("kept")
        answers.append(sorted((r["doc_id"] or -1, bytes(r["digest"]), r["mark"]) for r in kept.collect()))
        dropped = X.drop_exact_copies(layout, index, "one").collect()
        assert sorted(norm(r["text"]) for r in dropped) == sorted({norm(r[1]) for r in rows})
    assert all(a == answers[0] for a in answers) and len(answers[0]) == 51
    assert index.read().count() == 51
    fresh = spark.createDataFrame([(500, "TEXT 3", 0), (501, "unseen", 0)], docs.schema)
    told = {r["doc_id"]: r for r in X.exact_dedup(fresh, index, "two").collect()}
    assert not told[500]["kept"] and told[500]["keep_id"] < 200 and told[501]["kept"]


def test_index_knows_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/counted"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    X.exact_dedup(docs, X.DigestIndex(spark, path, buckets=4), "one").collect()
    with pytest.raises(ValueError, match="4 buckets"):
        X.DigestIndex(spark, path, buckets=8)
    again = X.DigestIndex(spark, path)
    assert again.buckets == 4 and X.exact_dedup(docs, again, "two").filter("kept").count() == 0
    wide = again.rewritten(f"file://{tmp_path}/wide", 9)
    assert X.DigestIndex(spark, wide.path).buckets == 9 and wide.read().count() == 50
    assert X.exact_dedup(docs, wide, "two").filter("kept").count() == 0 and wide.read().count() == 50
    assert X.DigestIndex(spark, f"file://{tmp_path}/large", expected_rows=40_000_000).buckets == 40


def test_exact_drop_with_any_column_names(spark):
    names = [*"row id digest mark stay_id stay_digest stay_mark kept top keep_id keep_mark keep_row batch first_batch row_id group_size own __own __id __digest".split(), "a b", "dot.ted"]
    docs = spark.createDataFrame([(1, "One", *names), (2, "one", *names), (2, "one", *names)], ["doc_id", "text", *names])
    out = X.drop_exact_copies(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "one", *names)]


def test_hot_keys_are_looked_up_whole(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 1500, 0).otherwise(F.col("id"))).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = lookup_by_key(rows, keyed, "k", "n", 3000)
    assert out.count() == 3000 and out.filter("k = 0 AND n = 1500").count() == 1500


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_plain(hard, clashing):
    want = sorted(plain_fingerprint(r["text"]) for r in hard.collect())
    for docs in (hard, clashing):
        assert sorted(r["fp"] % 2**64 for r in N.fingerprints(docs).collect()) == want


def test_hashes_are_those_of_spark(spark):
    text = "one two three four"
    assert spark.sql(f"SELECT xxhash64('{text}') h").first()["h"] % 2**64 == int(N.shingle_hashes(text)[0])


def test_covering_never_misses():
    rng = np.random.default_rng(0)
    for seed in (1, 2, 3):
        masks = N.covering_masks(seed)
        assert len(masks) == 31
        for _ in range(2000):
            flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            assert any(not flips & m for m in masks)


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("limit", [N.BUCKET_LIMIT, 40, 3])
def test_near_links_against_plain(spark, limit):
    """Chains, dense balls and strangers; small limits send buckets through the further levels."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(150)}
    for _ in range(20):
        x = int(rng.integers(0, 2**63))
        for _ in range(4):
            fps.add(x)
            x ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
    fps = sorted(fps)
    df = spark.createDataFrame([(N._signed(f),) for f in fps], "fp bigint")
    got = {r["node"] % 2**64: r["root"] for r in components(N.near_edges(df, limit)).collect()}
    want = plain_components(fps)
    mine = [got.get(f, N._signed(f)) for f in fps]
    pairs = {(a, b) for a, b in zip(want, mine, strict=True)}
    assert len(pairs) == len(set(want)) == len(set(mine))


def test_near_components_whole(hard, clashing, empty):
    rows = hard.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    roots = plain_components(fps)
    want = sorted(
        (str(r["doc_id"]), str(min((q["doc_id"] for q, o in zip(rows, roots, strict=True) if o == root and q["doc_id"] is not None), default=None)))
        for r, root in zip(rows, roots, strict=True)
    )
    for docs in (hard, clashing):
        assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in N.near_components(docs).collect()) == want
    assert N.near_components(empty).count() == 0
    out = N.drop_near_copies(clashing)
    assert out.columns == clashing.columns
    assert {5} == {r["doc_id"] for r in out.collect() if norm(r["text"]).split() == []}
    assert N.drop_near_copies(empty).count() == 0


def test_near_drop_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "stone", "bread"))
    rows = [(None, a, 1), (None, a.upper(), 2), (3, b, 3), (None, b, 4), (None, b, 5), (6, c, 6), (6, c, 7), (6, c.title(), 8), (9, c, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    for order in (docs, docs.repartition(3)):
        out = N.drop_near_copies(order).collect()
        assert sorted(str(r["doc_id"]) for r in out) == ["3", "6", "None"]
        assert {norm(r["text"]) for r in out} == {a, b, c}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (200, 250)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(1, 60))
    assert got[300] == 200 and got[250] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
