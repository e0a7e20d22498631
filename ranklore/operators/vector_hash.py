"""Learned hashes of vectors: nearest centroid, distance CDF inside it, slot in its hash range.

A model is one row a centroid. The fits are grouped aggregates over (centroid, leaf),
so a centroid that holds a third of all vectors is spread like any other rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklore.functions import wide as W
from ranklore.functions.models import BELOW_ONE, KINDS, clamp_unit, parse_spec, to_position
from ranklore.operators import centroids as C
from ranklore.operators.keys import scaled
from ranklore.plans.ranking import with_group_rank
from ranklore.plans.workspace import staged

_PARAMS = T.ArrayType(T.DoubleType())
MODEL_SCHEMA = T.StructType(
    [
        T.StructField("centroid_id", T.LongType()),
        T.StructField("vec", _PARAMS),
        T.StructField("ord", T.LongType()),
        T.StructField("mass", T.LongType()),
        T.StructField("range_start", T.StringType()),
        T.StructField("range_size", T.StringType()),
        T.StructField("full", T.BooleanType()),
        T.StructField("min_d2", T.DoubleType()),
        T.StructField("max_d2", T.DoubleType()),
        T.StructField("rows", T.LongType()),
        T.StructField("top", _PARAMS),
        T.StructField("leaf", T.ArrayType(_PARAMS)),
    ]
)


@dataclass
class VectorHash:
    """Parallel lists of one entry a centroid; ``top`` and ``leaf`` are the CDF's parameters."""

    bits: int
    spec: list[str]
    centroids: np.ndarray
    order: list[int]
    masses: list[int]
    ranges: list[C.Range]
    min_d2: list[float | None]
    max_d2: list[float | None]
    rows: list[int]
    top: list[list[float]]
    leaf: list[list[list[float]]]
    objectives: list[float] = field(default_factory=list)

    @property
    def active(self) -> np.ndarray:
        return C.active_centroids([(r.size, r.full) for r in self.ranges])

    def frame(self, spark) -> DataFrame:
        place = {c: i for i, c in enumerate(self.order)}
        return spark.createDataFrame(
            [
                (
                    i,
                    [float(x) for x in self.centroids[i]],
                    place[i],
                    self.masses[i],
                    str(self.ranges[i].start),
                    str(self.ranges[i].size),
                    self.ranges[i].full,
                    self.min_d2[i],
                    self.max_d2[i],
                    self.rows[i],
                    self.top[i],
                    self.leaf[i],
                )
                for i in range(len(self.centroids))
            ],
            MODEL_SCHEMA,
        )

    def route(self, df: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
        return C.assign(df, self.centroids, self.active, keep, vector)

    def hash_routed(self, routed: DataFrame) -> DataFrame:
        """Add cdf, fraction, hash_hex and, up to 64 bits, ``hash`` (DECIMAL) to rows with centroid_id and d2."""
        spark = routed.sparkSession
        model = self.frame(spark).drop("vec", "ord", "mass")
        joined = routed.join(F.broadcast(model), "centroid_id")  # one row a centroid, checked with the centroids
        told = joined.withColumn("cdf", self._cdf(F.col("d2"))).withColumn("fraction", _fraction(F.col("cdf"), F.col("d2")))
        drop = [c for c in model.columns if c != "centroid_id"]
        if self.bits > 64:
            return told.withColumn("hash_hex", _wide_slot(self.bits)("range_start", "range_size", "full", "fraction")).drop(*drop)
        start = F.col("range_start").cast(W.WIDE)
        hashed = told.withColumn("hash", (start + W.times_fraction(F.col("range_size"), F.col("fraction"))).cast(W.WIDE))
        return hashed.withColumn("hash_hex", W.let(F.col("hash"), lambda h: W.decimal_hex(h, self.bits))).drop(*drop)

    def apply(self, df: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
        return self.hash_routed(self.route(df, keep, vector))

    def _cdf(self, d2: Column) -> Column:
        rows, leaves = F.col("rows"), F.size("leaf")
        top = KINDS[self.spec[0]].predict(F.col("top"), d2)
        at = F.least(to_position(top), (leaves - 1).cast("bigint")).cast("int")
        raw = KINDS[self.spec[1]].predict(F.get(F.col("leaf"), F.greatest(at, F.lit(0))), d2)
        bound = (rows - 1).cast("double")
        held = F.least(F.greatest(F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(raw), F.lit(0.0)), bound)
        return F.when((rows < 2) | (leaves <= 0), 0.0).otherwise(clamp_unit(held / F.when(bound > 0, bound)))

    def size_bytes(self) -> int:
        params = sum(len(t) + sum(map(len, lf)) for t, lf in zip(self.top, self.leaf, strict=True))
        return 8 * (params + self.centroids.size // 2 + len(self.centroids) * (2 * 4 + 4))


def _fraction(cdf: Column, d2: Column) -> Column:
    """The CDF; where it is 0, the distance's place between the least and greatest one if that is more."""
    span = F.col("max_d2") - F.col("min_d2")
    place = F.when(span > 0, (d2 - F.col("min_d2")) / span)
    value = F.when(cdf > 0, cdf).otherwise(F.greatest(cdf, F.coalesce(place, F.lit(0.0))))
    return F.when(value < 0, 0.0).when(value >= 1, BELOW_ONE).otherwise(value)


def _wide_slot(bits: int):
    @F.pandas_udf("string")
    def slot(start: pd.Series, size: pd.Series, full: pd.Series, fraction: pd.Series) -> pd.Series:
        out = []
        for s, z, whole, f in zip(start, size, full, fraction, strict=True):
            q = W.fraction_to_q64(float(f))
            offset = q << 192 if whole else (int(z) * q) >> 64
            out.append(W.to_hex(int(s) + offset, bits))
        return pd.Series(out, dtype=object)

    return slot


def fit_cdf(assigned: DataFrame, k: int, spec: str = "linear,linear", leaves: int = 32) -> tuple[DataFrame, int]:
    """centroid_id, min_d2, max_d2, rows, top, leaf: a two-layer model of each centroid's distance ranks.

    The number of leaves is the smallest of ``leaves`` and the rows of any centroid with at
    least two. Distances that repeat keep their separate ranks.
    """
    names = parse_spec(spec)
    if len(names) != 2 or any(KINDS[n].integer_keys or not KINDS[n].empty for n in names):
        raise ValueError("a distance CDF takes two layers of parametric kinds")
    ranked = staged(with_group_rank(assigned.select("centroid_id", F.col("d2").alias("x"), "vec_id"), ["centroid_id"], ["x", "vec_id"], "y"), "distances")
    facts = staged(
        ranked.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("min_d2"), F.max("x").alias("max_d2")), "distance-facts"
    )
    smallest = facts.filter("rows >= 2").agg(F.min("rows")).first()[0]
    count = max(1, min(leaves, smallest or 1))
    view = ranked.withColumn("k", F.col("x").cast("bigint"))
    target = F.floor(F.col("y") * (F.lit(float(count)) / F.col("y_of"))).cast("bigint")
    top = KINDS[names[0]].fit(view.withColumn("y", target), ["centroid_id"]).withColumnRenamed("p", "top")
    placed = staged(
        view.join(F.broadcast(top) if k <= 100_000 else top, "centroid_id")
        .withColumn("leaf", F.least(to_position(KINDS[names[0]].predict(F.col("top"), F.col("x"))), F.lit(count - 1).cast("bigint")))
        .drop("top"),
        "cdf-placed",
    )
    stats = placed.groupBy("centroid_id", "leaf").agg(
        F.min(F.struct("y", "x")).alias("first"), F.max(F.struct("y", "x")).alias("last")
    )
    half = Window.partitionBy("centroid_id", (F.col("leaf") >= count // 2).cast("int")).orderBy("leaf")
    lent = stats.select("centroid_id", "leaf", F.lag("last").over(half).alias("a"), F.lead("first").over(half).alias("b"))
    shared = lent.select("centroid_id", "leaf", F.explode(F.array("a", "b")).alias("pt")).filter("pt IS NOT NULL")
    member = placed.select("centroid_id", "leaf", "x", "k", "y")
    data = member.unionByName(shared.select("centroid_id", "leaf", "pt.x", F.col("pt.x").cast("bigint").alias("k"), "pt.y"))
    fitted = KINDS[names[1]].fit(data, ["centroid_id", "leaf"])
    spark = assigned.sparkSession
    grid = facts.select("centroid_id", "rows").crossJoin(F.broadcast(spark.range(count).withColumnRenamed("id", "leaf")))
    after = Window.partitionBy("centroid_id").orderBy("leaf").rowsBetween(1, Window.unboundedFollowing)
    every = grid.join(stats.select("centroid_id", "leaf", F.col("first.y").alias("fy")), ["centroid_id", "leaf"], "left").withColumn(
        "next", F.coalesce(F.first("fy", True).over(after), F.col("rows"))
    )
    empty = F.array(*[F.lit(v) for v in KINDS[names[1]].empty])
    constant = KINDS[names[1]].constant(F.col("next"))
    patched = F.when(F.col("leaf") < count - 1, constant).otherwise(empty) if constant is not None else empty
    params = every.join(fitted, ["centroid_id", "leaf"], "left").withColumn("p", F.when(F.col("fy").isNull(), patched).otherwise(F.coalesce("p", empty)))
    lists = params.groupBy("centroid_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("leaf", "p"))), lambda s: s["p"]).alias("leaf")  # `count` entries
    )
    return facts.join(lists, "centroid_id").join(top, "centroid_id"), count


def fit_vector_hash(
    df: DataFrame,
    k: int,
    bits: int = 64,
    knn: int = 32,
    spec: str = "linear,linear",
    leaves: int = 32,
    two_opt: int = 8,
    iterations: int = 20,
    seed: int = 0,
    skeleton: DataFrame | None = None,
    graph: DataFrame | None = None,
    assignment: str = "full",
    sample_limit: int | None = None,
    centroids: np.ndarray | None = None,
    vector: str = "embedding",
) -> VectorHash:
    """Cluster (the skeleton's rows if given), assign, order, allocate ranges, fit distance CDFs.

    ``assignment``: "full" takes masses and distances from all rows, "skeleton" from the skeleton's;
    ``sample_limit`` from an evenly spaced sample. ``graph`` (src, dst) adds affinity to the order.
    """
    W.check_bits(bits)
    base = df if skeleton is None else df.join(skeleton.select("vec_id"), "vec_id", "left_semi")
    objectives: list[float] = []
    if centroids is None:
        centroids, objectives = C.kmeans(base, k, iterations, seed, vector=vector)
    centroids = C.checked(centroids)
    k = len(centroids)
    source = base if assignment == "skeleton" else df
    if sample_limit and sample_limit < source.count():
        from ranklore.operators.keys import even_sample
        from ranklore.plans.ranking import with_position

        source = even_sample(with_position(source, ["vec_id"], "__nth"), "__nth", sample_limit).drop("__nth")
    assigned = staged(C.assign(source, centroids, vector=vector), "assigned")
    counted = {r["centroid_id"]: r["mass"] for r in C.mass(assigned).collect()}  # one row a centroid
    masses = [counted.get(i, 0) for i in range(k)]
    affinity = None
    if graph is not None:
        rows = C.graph_affinity(graph, assigned.select("vec_id", "centroid_id")).collect()  # at most 128 a centroid
        affinity = {(r["from_id"], r["to_id"]): r["weight"] for r in rows}
    order = C.centroid_order(centroids, knn, two_opt, affinity)
    ranges = C.allocate_ranges(masses, order, bits)
    cdf, count = fit_cdf(assigned, k, spec, leaves)
    fitted = {r["centroid_id"]: r for r in cdf.collect()}  # one row a centroid
    names = parse_spec(spec)
    empty = ([0.0] * len(KINDS[names[0]].empty), [[0.0] * len(KINDS[names[1]].empty)] * count)

    def of(i, name, default):
        return fitted[i][name] if i in fitted else default

    return VectorHash(
        bits,
        names,
        centroids,
        order,
        masses,
        ranges,
        [of(i, "min_d2", None) for i in range(k)],
        [of(i, "max_d2", None) for i in range(k)],
        [of(i, "rows", 0) for i in range(k)],
        [list(of(i, "top", empty[0])) for i in range(k)],
        [[list(p) for p in of(i, "leaf", empty[1])] for i in range(k)],
        objectives,
    )
