import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ranklore.llm import mixing as M
from ranklore.llm import sharding as SH
from ranklore.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_shards_against_plain(spark):
    rows = [(i, "t" * (i % 11), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(997)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    got = SH.interleaved_shards(docs, 24, 7).collect()
    assert len(got) == 997
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    order = {}
    for i, _, source, _ in rows:
        order.setdefault(source, []).append((hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    fractions = sorted(((k + 0.5) / len(own), source, i) for source, own in order.items() for k, (_, i) in enumerate(sorted(own)))
    want = {i: p * 24 // 997 for p, (_, _, i) in enumerate(fractions)}
    assert {r["doc_id"]: r["shard"] for r in got} == want
    mixture = Counter((r["shard"], r["source"]) for r in got)
    for source, own in order.items():
        assert all(abs(mixture[(s, source)] - len(own) / 24) <= 2 for s in range(24))


def test_shards_hard_cases(hard, clashing, empty):
    for docs in (hard, clashing):
        got = SH.interleaved_shards(docs).collect()
        assert len(got) == 16 and {r["slot"] for r in got} == {0} and len({r["shard"] for r in got}) == 16
        assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
            (len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in hard.collect()
        )
    assert SH.interleaved_shards(empty).count() == 0


def test_shards_keep_whole_rows(spark, hard, clashing, tmp_path):
    for name, docs in (("hard", hard), ("clashing", clashing)):
        for path in (None, f"file://{tmp_path}/{name}"):
            out = SH.written_shards(docs.repartition(5), 3, 7, path)
            assert sorted(map(repr, (r["row"] for r in out.collect()))) == sorted(map(repr, docs.collect()))
        files = spark.read.parquet(f"{path}/shard=1").orderBy("slot").collect()
        assert [r["slot"] for r in files] == list(range(len(files))) and 5 <= len(files) <= 6
    same = spark.createDataFrame([(None, "one text", "a")] * 50 + [(7, None, None)] * 22, "doc_id bigint, text string, source string")
    got = SH.interleaved_shards(same, 24).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == {(None, "one text"): 50, (7, None): 22}
    assert len({(r["shard"], r["slot"]) for r in got}) == 72


def test_poisson():
    for rate in (0.0, 0.3, 1.0, 7.5, 400.0):
        cdf = M.poisson_cdf(rate)
        assert cdf[-1] == pytest.approx(1.0, abs=1e-12) and all(a <= b for a, b in zip(cdf, cdf[1:], strict=False))
        assert cdf[0] == pytest.approx(math.exp(-rate), rel=1e-12)


def test_mixture_meets_its_weights(spark):
    rows = [(i, "x", "big" if i % 10 else "small") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = M.mixed(docs, {"big": 0.5, "small": 0.5, "absent": 3.0}, 10_000)
    assert out.columns == docs.columns
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(counts.values())
    assert abs(counts["small"] / total - 0.5) < 0.02
    again = M.replicated(docs.repartition(7), {"big": 0.5, "small": 0.5}, 10_000).groupBy("doc_id").count()
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in M.replicated(docs, {"big": 0.5, "small": 0.5}, 10_000).groupBy("doc_id").count().collect()}
    copies = {r["doc_id"]: r["count"] for r in again.collect()}
    rate = 10_000 * 0.5 / 2000
    cdf = M.poisson_cdf(rate)
    for i in range(0, 400, 10):
        u = (int(hashlib.md5(f"{M.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert copies.get(i, 0) == sum(c < u for c in cdf)


def test_mixing_hard_cases(hard, clashing, empty):
    sizes = [M.mixed(d).count() for d in (hard, clashing)]
    assert sizes[0] == sizes[1]
    assert M.mixed(clashing).columns == clashing.columns
    assert M.mixed(empty).count() == 0
    assert M.mixed(hard, {"a": 1.0}).select("source").distinct().count() <= 1


def test_mixing_with_any_column_names(hard):
    names = "row __source __copies __copy __rate __order __position ___copy rate copies copy order position least cdf u __u __cdf __mid __pid __start".split() + ["a b", "dot.ted"]
    docs = hard.select("*", *[F.lit(n).alias(n) for n in names])
    plain = Counter(str(r["doc_id"]) for r in M.mixed(hard).collect())
    for out, columns in ((M.mixed(docs), docs.columns), (M.replicated(docs), docs.columns), (M.written_mixture(docs), docs.columns)):
        assert out.columns[: len(columns)] == columns and len({c.lower() for c in out.columns}) == len(out.columns)
        rows = out.collect()
        assert Counter(str(r["doc_id"]) for r in rows) == plain
        assert all(tuple(r)[len(hard.columns) : len(columns)] == tuple(names) for r in rows)
    assert {"____copy", "___order"} <= set(M.replicated(docs).columns)


def test_poisson_tables_are_cut_and_bounded(spark):
    for rate in (3.0, 150.0, 5000.0, 250_000.0):
        start = M.least_copies(rate)
        cut = M.poisson_cdf(rate, start)
        assert len(cut) < 20 * math.sqrt(rate) + 90 and (not start or cut[0] < 1e-15) and cut[-1] == pytest.approx(1.0, abs=1e-9)
        if rate < 1e4:
            whole = M.poisson_cdf(rate)
            for u in (0.5 / 2**52, 1e-9, 0.1, 0.5, 0.9, 1 - 1e-9):
                assert start + sum(c < u for c in cut) == sum(c < u for c in whole)
    one = spark.createDataFrame([(1, "x", "a")], "doc_id bigint, text string, source string")
    assert 4000 < M.mixed(one, {"a": 1.0}, 5000).count() < 6000
    with pytest.raises(ValueError, match="repeated over"):
        M.mixed(one, {"a": 1.0}, 10**9)


def test_query_shuffles_whole_documents(spark, clashing, monkeypatch):
    out = M.written_mixture(clashing)
    rows = out.orderBy("__position").collect()
    assert [r["__position"] for r in rows] == list(range(len(rows)))
    assert [r["__order"] for r in rows] == sorted(r["__order"] for r in rows)
    assert sorted(map(repr, out.select(*clashing.columns).collect())) == sorted(map(repr, M.mixed(clashing).collect()))
    seen, shuffled = [], M.shuffled
    monkeypatch.setattr(M, "shuffled", lambda docs, *a: seen.append(docs.columns) or shuffled(docs, *a))
    QUERIES["op9_mixing"](spark, DATA)
    assert seen == [spark.read.parquet(f"{DATA}/documents.parquet").columns]


def test_pipeline_against_plain(spark, hard, tmp_path):
    from test_dedup import norm, plain_components, plain_fingerprint

    folder = tmp_path / "sf"
    spark.createDataFrame([(1000 + i, f"{t} {i % 40} words of some length follow here {i % 40 * 7}", "en", f"s{i % 3}", 1) for i, t in enumerate(["alpha beta", "Alpha beta", "12 34"] * 30)] + [tuple(r) for r in hard.collect()], hard.schema).write.parquet(
        f"{folder}/documents.parquet"
    )
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    best = {}
    for r in rows:
        key = norm(r["text"])
        if key not in best or (r["doc_id"] is not None and (best[key]["doc_id"] is None or r["doc_id"] > best[key]["doc_id"])):
            best[key] = r
    rows = list(best.values())
    roots = plain_components([plain_fingerprint(r["text"]) for r in rows])
    firsts = {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            firsts[root] = min(firsts.get(root, r["doc_id"]), r["doc_id"])
    rows = [r for r, root in zip(rows, roots, strict=True) if r["doc_id"] == firsts.get(root)]
    counts = Counter(r["source"] or "" for r in rows)
    weight = {s: math.sqrt(n) for s, n in counts.items()}
    want = Counter()
    for r in rows:
        s = r["source"] or ""
        rate = weight[s] / sum(weight.values()) * len(rows) / counts[s]
        u = (int(hashlib.md5(f"{M.SEED}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[str(r["doc_id"])] += sum(c < u for c in M.poisson_cdf(rate))
    got = corpus_pipeline.run(spark, str(folder))
    assert Counter(str(r["doc_id"]) for r in got.select("doc_id").collect()) == Counter({k: v for k, v in want.items() if v})
    assert {"n_tokens", "ids"} <= set(got.columns)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "piece_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder)).columns == docs.columns


def test_pipeline_of_no_documents_and_its_work_tables(spark, hard, empty, tmp_path):
    import os

    folder = tmp_path / "none"
    empty.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, str(folder))
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    work = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/ranklore"
    hard.write.parquet(f"{tmp_path}/some/documents.parquet")
    before = set(os.listdir(work))
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    left = [f.split("-")[:2] for f in set(os.listdir(work)) - before]
    assert left == [["pipeline", "mixing"]] and out.count() > 0


def test_pipeline_with_any_column_names(spark, hard, tmp_path):
    names = "row fp __row __digest __own digest mark kept source_ u u_ copies least cdf __u order __order lang_pred score a_b".split() + ["a b"]
    docs = hard.select("*", *[F.lit(n).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(tuple(r)[len(hard.columns) :] == tuple(names) for r in out.collect())
    plain = [sorted(map(repr, (tuple(r)[: len(hard.columns)] for r in stage(spark, d, str(tmp_path)).collect()))) for _, stage in corpus_pipeline.STAGES[:-1] for d in (docs, hard)]
    assert plain[0::2] == plain[1::2]


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(x[i] for i in at)) for x in rel.fetchall()), name


def test_query_columns(spark):
    want = {
        "op2_quality": {"doc_id", "held_out", "score", "predicted"},
        "op4_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op5_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    }
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, cols in want.items():
        df = QUERIES[name](spark, DATA)
        assert cols <= set(df.columns) and df.count() == n, name


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert told.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    told = QUERIES["op2_quality"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in told]) > 0.95
    told = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in told]) > 0.95
