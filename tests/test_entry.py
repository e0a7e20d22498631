"""The driver's contract, and a sample of queries against their SQL."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return int(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    ["rm_two_layer_predict", "rm_leaf_errors", "scalar_hash32", "scalar_hash64_hex", "knn_l2_top10", "range_search_l2", "dist_gower", "vector_hash", "recall_in_window_ladder",
     "overlay_match_by_nodes", "ivf_search_nprobe", "pq_assign", "allocate_ranges", "cubic_fit", "radix_table", "pareto_front_size_error", "binary_multi_hash"],
)
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([_plain(r[i]) for i in at]) for r in rel.fetchall())
