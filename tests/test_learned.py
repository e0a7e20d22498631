import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklore.functions import models as M
from ranklore.operators import keys as K
from ranklore.operators import learned as L
from ranklore.plans import ranking as R


def keys_of(spark, values, kind="bigint"):
    return spark.createDataFrame([(v,) for v in values], f"key {kind}")


def test_specs():
    assert M.parse_spec(" linear , linear ") == ["linear", "linear"]
    for bad in ("", "linear,,linear", "linear,not_a_model", "linear,radix"):
        with pytest.raises(ValueError):
            M.parse_spec(bad)
    assert M.bit_length(255) == 8 and M.bit_length(254) == 7 and M.bit_length(0) == 0


def test_positions_and_duplicates(spark):
    got = {r["key"]: (r["pos"], r["copies"]) for r in K.unique_keys(keys_of(spark, [10, 20, 20, 20, 30]), "key").collect()}
    assert got == {10: (0, 1), 20: (1, 3), 30: (4, 1)}
    assert K.unique_keys(keys_of(spark, []), "key").count() == 0


def test_positions_without_one_task(spark, monkeypatch):
    values = [i // 3 for i in range(1000)]
    monkeypatch.setattr(K, "ONE_TASK_KEYS", 0)
    got = {r["key"]: r["pos"] for r in K.unique_keys(keys_of(spark, values), "key").collect()}
    assert got == {k: 3 * k for k in range(334)}


def test_ranking(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 1000) for i in range(1000)], "g int, v int")
    placed = sorted((r["position"], r["v"], r["g"]) for r in R.with_position(df, ["v", "g"]).collect())
    assert [p for p, _, _ in placed] == list(range(1000)) and [v for _, v, _ in placed] == sorted(v for _, v, _ in placed)
    ranks = R.with_group_rank(df, ["g"], ["v"]).collect()
    for g in range(3):
        own = sorted((r["rank"], r["v"]) for r in ranks if r["g"] == g)
        assert [r for r, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert R.with_position(df.limit(0), ["v"]).count() == 0
    one_task = sorted((r["position"], r["v"], r["g"]) for r in R.with_position(df, ["v", "g"], rows=1000).collect())
    assert one_task == placed


def test_neighbours(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(95)], "v int, m boolean")
    for r in R.with_neighbours(df, ["v"], F.col("m"), ["v"], block=7).collect():
        before = (r["v"] - 1) // 10 * 10 if r["v"] > 0 else None
        after = r["v"] // 10 * 10 + 10 if r["v"] < 90 else None
        assert (r["l"]["v"] if r["l"] else None) == before and (r["r"]["v"] if r["r"] else None) == after


@pytest.mark.parametrize("spec", ["linear,linear", "cubic,linear", "linear,cubic", "linear_spline,linear", "robust_linear,linear_spline", "radix,linear", "linear,cdf_piecewise", "normal,linear"])
def test_every_key_is_within_its_bound(spark, spec):
    values = sorted({int(x) for x in np.random.default_rng(1).exponential(500, 300)})
    df = keys_of(spark, values)
    index = L.train(df, "key", spec, 8)
    for r in index.predict(df, "key").collect():
        if spec.endswith("cdf_piecewise"):
            continue  # a CDF in [0, 1) is no position; it only has to train
        assert abs(min(r["pred"], len(values)) - values.index(r["key"])) <= r["err"]
    assert index.errors.count() == 8 and index.size_bytes() > 0


def test_dense_keys_and_layers(spark):
    df = spark.range(1024).withColumnRenamed("id", "key")
    index = L.train(df, "key", "linear,linear", 8)
    assert [layer.count() for layer in index.layers] == [1, 8] and index.rows == 1024
    told = index.predict(df, "key")
    assert told.filter(F.abs(F.col("pred") - F.col("key")) > 1).isEmpty()
    three = L.train(df, "key", "linear,linear,linear", 4)
    assert three.widths == [1, 4, 16]
    assert three.predict(df, "key").filter(F.abs(F.col("pred") - F.col("key")) > F.col("err")).isEmpty()


def test_duplicates_train(spark):
    df = keys_of(spark, [float(i // 8) for i in range(2048)], "double")
    index = L.train(df, "key", "linear,linear", 32)
    assert index.predict(df.distinct(), "key").filter(F.abs(F.col("pred") - F.col("key") * 8) > F.col("err")).isEmpty()


def test_errors(spark):
    df = keys_of(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        L.train(df, "key", "linear,linear", 1)
    with pytest.raises(ValueError):
        L.train(df.limit(0), "key", "linear,linear", 4)
    with pytest.raises(ValueError):
        L.train(df, "key", "linear,linear,linear", 64)


def test_bounded_spline(spark):
    values = sorted(set(np.random.default_rng(2).integers(0, 10**6, 800).tolist()))
    df = keys_of(spark, values)
    points = L.bounded_spline(df, "key", 16, block=200)
    found = L.spline_lookup(points, df, "key", 16, len(values)).collect()
    place = {v: i for i, v in enumerate(values)}
    assert len(found) == len(values) and all(r["start"] <= place[r["key"]] < r["start"] + 16 for r in found)
    assert points.count() < len(values)


def test_bounded_spline_between_blocks(spark):
    """Blocks that meet at neighbouring keys: no key has two points, and each key finds its line whichever way ties fall."""
    copies = [1 + (k * k) % 6 for k in range(400)]
    values = [k + 3 * (k // 130) - 200 for k, c in enumerate(copies) for _ in range(c)]  # below zero too, and gaps
    df = keys_of(spark, values)
    for block in (1, 50):
        points = [tuple(r) for r in L.bounded_spline(df, "key", 4, block).collect()]
        assert len({k for k, _ in points}) == len(points), block
        place = {v: values.index(v) for v in values}
        for order in (sorted(points), sorted(points, reverse=True)):
            table = spark.createDataFrame(order, "key bigint, value bigint").coalesce(1)
            found = L.spline_lookup(table, df.distinct(), "key", 4, len(values)).collect()
            assert len(found) == 400 and all(r["start"] <= place[r["key"]] < r["start"] + 4 for r in found), block


def plain_spline(keys, offsets, line):
    """The greedy fit point by point."""
    points, last = [], 0
    for key, offset in zip(keys, offsets, strict=True):
        if max(key - 1, 0) != last:
            points.append((key - 1, offset))
        points.append((key, offset))
        last = key
    kept, start = [points[0]], 0
    for i in range(1, len(points)):
        (x0, y0), (x1, y1) = points[start], points[i]
        told = [((1 - (x - x0) / (x1 - x0)) * y0 + (x - x0) / (x1 - x0) * y1, y) for x, y in points[start + 1 : i]]
        if any(int(p) // line != y // line for p, y in told):
            kept.append(points[i - 1])
            start = i - 1
    return [*kept, points[-1]]


@pytest.mark.parametrize(("low", "high"), [(1, 3000), (0, 900), (5, 10**12)])
def test_spline_against_plain(low, high):
    rng = np.random.default_rng(low + 1)
    for line in (4, 32):
        keys = np.unique(np.concatenate(([low], rng.integers(low, high, 400), low + np.arange(40))))
        offsets = np.sort(rng.integers(0, 4000, len(keys)))
        got, plain = L._greedy_spline(keys, offsets, line), plain_spline(keys.tolist(), offsets.tolist(), line)
        assert len(got) <= len(plain) and got[0] == plain[0] and got[-1] == plain[-1]  # rounding ends some of the plain one's segments early
        x, y = np.array(got).T
        at = np.maximum(np.searchsorted(x, keys), 1)
        t = (keys - x[at - 1]) / (x[at] - x[at - 1])
        told = ((1 - t) * y[at - 1] + t * y[at]).astype(int)
        assert (told // line == offsets // line).all()
    assert L._greedy_spline(np.array([1, 9]), np.array([0, 4]), 2)[0] == (1, 0)


def test_hot_keys_weigh_and_are_not_repeated(spark):
    """A key that stands for 2^33 rows trains; weights give what repeated rows give."""
    counts = [(k, 1 + (k * 7) % 5 + (40 if k == 11 else 0)) for k in range(1, 60)]
    weighted = spark.createDataFrame(counts, "key bigint, copies bigint")
    repeated = keys_of(spark, [k for k, c in counts for _ in range(c)])
    for spec in ("robust_linear,linear", "cubic,linear_spline", "linear,linear,cubic"):
        a = L.train(weighted, "key", spec, 4, L.Keys.of(weighted, "key", "copies"))
        b = L.train(repeated, "key", spec, 4)
        assert a.rows == b.rows and a.errors.orderBy("leaf").collect() == b.errors.orderBy("leaf").collect(), spec
    for kind in ("linear", "robust_linear", "loglinear", "cubic", "normal", "lognormal", "cdf_piecewise"):
        rows = K.training_view(repeated, "key").withColumn("g", F.col("k") % 2)
        view = K.key_view(repeated, "key").withColumn("g", F.col("k") % 2)
        for group in ([], ["g"]):
            one, other = (sorted(M.KINDS[kind].fit(v, group).collect(), key=lambda r: r["g"] if group else 0) for v in (rows, view))
            assert [r["p"] for r in other] == [pytest.approx(r["p"], rel=1e-9) for r in one], (kind, group)
    huge = spark.createDataFrame([(1, 5), (2, 2**33), (3, 7), (9, 1)], "key bigint, copies bigint")
    index = L.train(huge, "key", "linear,linear", 4, L.Keys.of(huge, "key", "copies"))
    assert index.rows == 2**33 + 13
    told = {r["key"]: r for r in index.predict(huge, "key").collect()}
    places = {1: 0, 2: 5, 3: 2**33 + 5, 9: 2**33 + 12}
    assert all(abs(min(told[k]["pred"], index.rows) - p) <= told[k]["err"] for k, p in places.items())


def test_running_sums_of_ranges_and_of_one_task(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("w"))
    own = {r["id"]: r["s"] for r in R.with_running_sum(df, ["id"], "w", "s").collect()}
    assert own == {r["id"]: r["s"] for r in R.with_running_sum(df, ["id"], "w", "s", few=True).collect()}
    assert own[0] == 0 and own[4999] == sum(i % 7 for i in range(4999))


def test_fronts(spark):
    assert len(L.first_phase("fast")) == 3 * 2 * 2
    assert L.within_leaf_limit(2, 1 << 19) and not L.within_leaf_limit(3, 1 << 11)
    front = [{"size": s, "avg_log2_err": e} for s, e in ((10, 9.0), (11, 8.0), (40, 5.0), (41, 4.0), (400, 1.0))]
    assert [c["size"] for c in L.narrow_front(front, 3)] == [10, 41, 400]
    with pytest.raises(ValueError):
        L.narrow_front(front, 1)


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "vec_id")
    assert sorted(r[0] for r in K.even_sample(df, "vec_id", 5).collect()) == [0, 24, 49, 74, 99]
    assert [r[0] for r in K.even_sample(df, "vec_id", 1).collect()] == [50]
    assert K.hashed_sample(df, "vec_id", 10, 1).collect() == K.hashed_sample(df, "vec_id", 10, 1).collect()
    assert K.key_type("osm_uint64").typeName() == "long"
    with pytest.raises(ValueError):
        K.key_type("osm")


def test_neighbours_in_linear_time(spark, capsys):
    """No frame runs from a row to the end of its block: Spark would go through it anew for every row."""
    from ranklore.plans.ranking import with_neighbours

    df = spark.createDataFrame([(i, int(i % 7 == 3)) for i in range(200)], "k bigint, m int")
    found = with_neighbours(df, ["k"], F.col("m") == 1, ["k"], block=32)
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    marked = [i for i in range(200) if i % 7 == 3]
    for r in found.collect():
        assert (r["l"] and r["l"]["k"]) == max((i for i in marked if i < r["k"]), default=None)
        assert (r["r"] and r["r"]["k"]) == min((i for i in marked if i > r["k"]), default=None)
