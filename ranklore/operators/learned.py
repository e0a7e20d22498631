"""Learned indexes over sorted keys: two-layer and multi-layer training, errors, search.

Training works on the different keys and their multiplicities, so a key that a third of
all rows hold is one row with a large weight; every layer is a grouped fit and an equi
join on the group, whatever the number of models.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklore.functions.models import KINDS, parse_spec, to_position
from ranklore.operators.keys import key_view, scaled
from ranklore.plans.ranking import with_neighbours, with_position
from ranklore.plans.workspace import staged

MAX_LEAVES = 1_000_000
EPSILON = 2.220446049250313e-16
LARGEST = 1.7976931348623157e308


@dataclass
class LearnedIndex:
    """``layers``: one table (leaf, p) a layer, ``spec`` their kinds; ``errors``: (leaf, n, max_err)."""

    spec: list[str]
    leaves: int
    rows: int
    layers: list[DataFrame]
    errors: DataFrame
    metrics: DataFrame
    widths: list[int]

    def predict(self, keys: DataFrame, key: str) -> DataFrame:
        """``keys`` with leaf, raw (the prediction as a double), pred and err (the leaf's bound)."""
        out = keys.withColumn("__x", F.col(key).cast("double")).withColumn("__k", F.col(key).cast("bigint"))
        out = _walk(out, self.spec, self.layers, self.widths)
        return out.join(_side(self.errors.select("leaf", F.col("max_err").alias("err")), self.leaves), "leaf", "left").drop("__x", "__k")

    def size_bytes(self) -> int:
        """Parameters of all layers, eight bytes each, and eight bytes a leaf for its error."""
        total = 0
        for name, layer in zip(self.spec, self.layers, strict=True):
            total += layer.count() * 8 * max(len(KINDS[name].empty), 1)
        return total + 8 * self.leaves


def _input(kind: str) -> Column:
    return F.col("__k") if KINDS[kind].integer_keys else F.col("__x")


#: A layer's table is broadcast up to this many models (checked); beyond, an equi join on the leaf.
BROADCAST_MODELS = 100_000


def _side(df: DataFrame, models: int) -> DataFrame:
    return F.broadcast(df) if models <= BROADCAST_MODELS else df


def _walk(df: DataFrame, spec: list[str], layers: list[DataFrame], widths: list[int]) -> DataFrame:
    """Send rows with __x and __k through the layers; adds leaf, raw and pred."""
    out = df.withColumn("leaf", F.lit(0).cast("bigint"))
    for depth, (name, layer) in enumerate(zip(spec, layers, strict=True)):
        raw = KINDS[name].predict(F.col("p"), _input(name))
        out = out.join(_side(layer, widths[depth]), "leaf", "left")
        if depth == len(spec) - 1:
            return out.withColumn("raw", raw).withColumn("pred", to_position(raw)).drop("p")
        out = out.withColumn("leaf", F.least(to_position(raw), F.lit(widths[depth + 1] - 1).cast("bigint"))).drop("p")
    return out


def _fit_one(view: DataFrame, name: str, group: list[str]) -> DataFrame:
    return KINDS[name].fit(view, group)


def leaf_neighbours(stats: DataFrame, leaves: int, n: int, last_key: str = "x") -> DataFrame:
    """For every leaf (empty ones too) first and last key and position of its own, and
    next_pos, next_key (the next non-empty leaf's first; else n and the largest key) and
    prev_key (the previous non-empty leaf's last; else 0)."""
    spark = stats.sparkSession
    every = spark.range(leaves).select(F.col("id").alias("leaf")).join(stats, "leaf", "left")
    after = Window.orderBy("leaf").rowsBetween(1, Window.unboundedFollowing)  # one row a leaf, at most MAX_LEAVES
    before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    return (
        every.withColumn("next_pos", F.coalesce(F.first("first_pos", True).over(after), F.lit(n).cast("bigint")))
        .withColumn("next_key", F.coalesce(F.first("first_key", True).over(after), F.lit(LARGEST)))
        .withColumn("prev_key", F.coalesce(F.last("last_key", True).over(before), F.lit(0.0)))
    )


def leaf_stats(keys: DataFrame) -> DataFrame:
    """Per leaf of (leaf, x, y, copies): first and last key and position, rows, longest run of one key.
    The run of the last key of all is not counted, as the reference semantics have it."""
    top = keys.agg(F.max("x").alias("__last"))
    flagged = keys.crossJoin(F.broadcast(top))
    return flagged.groupBy("leaf").agg(
        F.min("x").alias("first_key"),
        F.max("x").alias("last_key"),
        F.min("y").alias("first_pos"),
        F.max("y").alias("last_pos"),
        F.sum("copies").alias("n"),
        F.max(F.when(F.col("x") < F.col("__last"), F.col("copies")).otherwise(0)).alias("longest_run"),
    )


def _clipped_error(a: Column, b: Column, n: int) -> Column:
    top = F.lit(n).cast("bigint")
    return F.abs(F.least(a, top) - F.least(b, top))


def _local(spark, columns: dict, schema: str) -> DataFrame:
    """A model table from driver arrays (one row a leaf)."""
    frame = pa.table({k: pa.array(v) for k, v in columns.items()})
    return spark.createDataFrame(frame).selectExpr(*[f"CAST({f.split(maxsplit=1)[0]} AS {f.split(maxsplit=1)[1]}) AS {f.split()[0]}" for f in schema.split(", ")])


class _Around:
    """For every leaf, what the non-empty leaves before and after it hold; from the collected leaf statistics."""

    def __init__(self, stats: pd.DataFrame, leaves: int, n: int):
        self.stats = stats.sort_values("leaf").reset_index(drop=True)
        held, every = self.stats["leaf"].to_numpy(), np.arange(leaves)
        after, before = np.searchsorted(held, every, "right"), np.searchsorted(held, every, "left") - 1
        first_pos, first_key = self.stats["first_pos"].to_numpy(), self.stats["first_key"].to_numpy()
        last_key = self.stats["last_key"].to_numpy()
        some = after < len(held)
        at = np.minimum(after, max(len(held) - 1, 0))
        self.next_pos = np.where(some, first_pos[at], n)
        self.next_key = np.where(some, first_key[at], LARGEST)
        self.prev_key = np.where(before >= 0, last_key[np.maximum(before, 0)], 0.0)
        self.rows, self.run = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        self.rows[held], self.run[held] = self.stats["n"].to_numpy(), self.stats["longest_run"].to_numpy()


def _finish(spec, widths, n, layers, keys: DataFrame, around: _Around, integer_keys: bool) -> LearnedIndex:
    """Per-leaf errors with the corrections for absent keys, and the metrics over all rows.

    Rows are reduced to one a leaf by Spark; the leaf tables are model-sized.
    """
    kind, table, leaves, spark = KINDS[spec[-1]], layers[-1], widths[-1], keys.sparkSession
    raw = kind.predict(F.col("p"), F.col("k") if kind.integer_keys else F.col("x"))
    e = _clipped_error(to_position(raw), F.col("y"), n)
    told = keys.join(_side(table, leaves), "leaf").select("leaf", "copies", e.alias("e"))
    w, d = F.col("copies"), F.col("e").cast("double")
    own = told.groupBy("leaf").agg(F.max("e").alias("own"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2")).toPandas()
    own_err = np.zeros(leaves, np.int64)
    own_err[own["leaf"].to_numpy()] = own["own"].to_numpy()
    step = 1.0 if integer_keys else EPSILON
    # a leaf looks at the first position after the leaf before it; leaf 0 at the one after itself
    first_after = np.concatenate((around.next_pos[:1], around.next_pos[:-1]))
    ends = _local(
        spark,
        {"leaf": np.arange(leaves), "hi": around.next_key - step, "lo": around.prev_key + step, "hi_pos": around.next_pos + 1, "lo_pos": first_after},
        "leaf bigint, hi double, lo double, hi_pos bigint, lo_pos bigint",
    )

    def off(x: str, pos: str) -> Column:
        point = F.col(x).cast("bigint") if kind.integer_keys and integer_keys else F.col(x)
        return _clipped_error(to_position(kind.predict(F.col("p"), point)), F.col(pos), n)

    gaps = ends.join(table, "leaf", "left").select("leaf", F.greatest(F.coalesce(off("hi", "hi_pos"), F.lit(0)), F.coalesce(off("lo", "lo_pos"), F.lit(0))).alias("g"))
    gap = gaps.toPandas().sort_values("leaf")["g"].to_numpy()
    max_err = np.maximum(own_err, gap) + around.run
    errors = _local(spark, {"leaf": np.arange(leaves), "n": around.rows, "own_err": own_err, "max_err": max_err}, "leaf bigint, n bigint, own_err bigint, max_err bigint")
    m = max_err.astype(float)
    metrics = spark.createDataFrame(
        [
            (
                float((around.rows * m).sum() / n),
                float((around.rows * m * m).sum() / n),
                float((around.rows * np.log2(2 * m + 2)).sum() / n),
                int(max_err.max()),
                float(own["s1"].sum() / n),
                float(np.sqrt(own["s2"].sum() / n)),
                float(np.log2(2 * m.max() + 2)),
            )
        ],
        "avg_err double, avg_l2_err double, avg_log2_err double, max_err bigint, mae double, rmse double, max_log2_err double",
    )
    return LearnedIndex(spec, widths[-1], n, layers, errors, metrics, widths)


@dataclass
class Keys:
    """The different keys of a table (x, k, y, copies), written once and shared by all fits over them."""

    frame: DataFrame
    rows: int
    integer: bool

    @classmethod
    def of(cls, df: DataFrame, key: str, copies: str | None = None) -> Keys:
        """``copies``: a column that says how many rows a row of ``df`` stands for."""
        frame = staged(key_view(df, key, copies), "keys")
        n = frame.agg(F.sum("copies")).first()[0]
        if not n:
            raise ValueError("cannot train on an empty table")
        return cls(frame, n, df.schema[key].dataType.typeName() != "double")

    def predicted(self, index: LearnedIndex) -> DataFrame:
        """The keys with leaf, raw and pred."""
        return _walk(self.frame.withColumn("__x", F.col("x")).withColumn("__k", F.col("k")), index.spec, index.layers, index.widths)


def fit_two_layer(df: DataFrame, key: str, spec: str = "linear,linear", leaves: int = 64, held: Keys | None = None) -> LearnedIndex:
    """Root model over trunc(y leaves / n), then one model a leaf over y.

    A leaf also sees the last point of the previous and the first point of the next
    non-empty leaf, but not across the middle, where training is split. An empty leaf
    predicts the next leaf's first position (the very last leaf is left as it is).
    ``held``: the keys of ``df``, where they have been made already.
    """
    names = parse_spec(spec)
    if len(names) != 2:
        raise ValueError("a two-layer index needs two model kinds")
    if leaves < 2:
        raise ValueError("the branching factor must be at least 2")
    held = held or Keys.of(df, key)
    keys, n, integer_keys = held.frame, held.rows, held.integer
    root = _fit_one(keys.withColumn("y", scaled(F.col("y"), leaves / n)), names[0], []).first()  # one row
    top = df.sparkSession.createDataFrame([(0, list(root["p"]))], "leaf bigint, p array<double>")
    raw = KINDS[names[0]].predict(F.col("p"), F.col("k") if KINDS[names[0]].integer_keys else F.col("x"))
    placed = (
        keys.crossJoin(F.broadcast(top.drop("leaf")))
        .withColumn("leaf", F.least(to_position(raw), F.lit(leaves - 1).cast("bigint")))
        .drop("p")
    )
    around = _Around(leaf_stats(placed).toPandas(), leaves, n)  # one row a leaf
    _require_monotone(around.stats)
    spark, full = df.sparkSession, around.stats["leaf"].to_numpy()
    upper_half = full[full >= leaves // 2]
    split = upper_half[0] if len(upper_half) and len(upper_half) < len(full) else leaves
    lend = np.flatnonzero((full[:-1] < split) == (full[1:] < split))  # neighbours in the same pass
    ends = {c: around.stats[c].to_numpy() for c in ("first_key", "last_key", "first_pos", "last_pos")}
    shared = _local(
        spark,
        {
            "leaf": np.concatenate((full[lend + 1], full[lend])),
            "x": np.concatenate((ends["last_key"][lend], ends["first_key"][lend + 1])),
            "y": np.concatenate((ends["last_pos"][lend], ends["first_pos"][lend + 1])),
        },
        "leaf bigint, x double, y bigint",
    )
    member = placed.select("leaf", "x", "k", "y", "copies")
    data = member.unionByName(shared.select("leaf", "x", F.col("x").cast("bigint").alias("k"), "y", F.lit(1).cast("bigint").alias("copies")))
    fitted = _fit_one(data, names[1], ["leaf"])
    after = _local(spark, {"leaf": np.arange(leaves), "n": around.rows, "next_pos": around.next_pos}, "leaf bigint, n bigint, next_pos bigint")
    empty = F.array(*[F.lit(v) for v in KINDS[names[1]].empty]).cast("array<double>")
    constant = KINDS[names[1]].constant(F.col("next_pos"))
    patched = F.when(F.col("leaf") < leaves - 1, constant).otherwise(empty) if constant is not None else empty
    leaf_table = staged(
        after.join(fitted, "leaf", "left").select(
            "leaf", F.when(F.col("n") == 0, patched).otherwise(F.coalesce("p", empty)).alias("p")
        ),
        "leaves",
    )
    return _finish(names, [1, leaves], n, [top, leaf_table], placed.select("leaf", "x", "k", "y", "copies"), around, integer_keys)


def _require_monotone(stats: pd.DataFrame) -> None:
    """Leaves must follow the keys; a root model that turns back is an error."""
    if (stats["first_key"].to_numpy()[1:] < stats["last_key"].to_numpy()[:-1]).any():
        raise ValueError("non-monotonic target index")


def fit_multi_layer(
    df: DataFrame, key: str, spec: str, branch: int, max_leaves: int = MAX_LEAVES, held: Keys | None = None
) -> LearnedIndex:
    """Three and more layers: each layer multiplies the models by ``branch``, models see only
    their own rows, empty ones keep their kind's empty parameters."""
    names = parse_spec(spec)
    if len(names) == 2:
        return fit_two_layer(df, key, spec, branch, held)
    if len(names) < 2 or branch < 2:
        raise ValueError("a learned index needs two layers and a branching factor of at least 2")
    held = held or Keys.of(df, key)
    n, integer_keys = held.rows, held.integer
    spark, layers, width, widths = df.sparkSession, [], 1, []
    now = held.frame.withColumn("leaf", F.lit(0).cast("bigint"))
    for depth, name in enumerate(names):
        last = depth == len(names) - 1
        wide = width * branch
        if not last and wide > min(max_leaves, n):
            raise ValueError(f"the next layer would hold {wide} models, over the limit of {min(max_leaves, n)}")
        view = now if last else now.withColumn("y", scaled(F.col("y"), wide / n))
        empty = F.array(*[F.lit(v) for v in KINDS[name].empty]).cast("array<double>")
        made = _fit_one(view, name, ["leaf"])
        table = staged(
            spark.range(width).select(F.col("id").alias("leaf")).join(made, "leaf", "left").select("leaf", F.coalesce("p", empty).alias("p")),
            "layer",
        )
        layers.append(table)
        widths.append(width)
        if not last:
            raw = KINDS[name].predict(F.col("p"), F.col("k") if KINDS[name].integer_keys else F.col("x"))
            now = staged(
                now.join(_side(table, width), "leaf")
                .withColumn("leaf", F.least(to_position(raw), F.lit(wide - 1).cast("bigint")))
                .drop("p"),
                "routed",
            )
            width = wide
    return _finish(names, widths, n, layers, now, _Around(leaf_stats(now).toPandas(), width, n), integer_keys)


def train(df: DataFrame, key: str, spec: str = "linear,linear", branch: int = 64, held: Keys | None = None) -> LearnedIndex:
    """Two or more layers by the spec's length."""
    return fit_multi_layer(df, key, spec, branch, held=held)


# bounded spline


def _greedy_spline(keys: np.ndarray, offsets: np.ndarray, line: int, previous: int = 0) -> list[tuple[int, int]]:
    """Points of a spline that finds the line (offset div ``line``) of every key.

    A key brings the point before it (key - 1 with its own offset), unless that is the key
    before (``previous`` for the first; none below it), and its own. From a segment's start every point
    passed allows a range of slopes, those that keep it in its line; the segment ends before
    the first point whose own slope leaves what all allow."""
    extra = np.concatenate(([previous], keys[:-1])) + 1 < keys
    at = np.cumsum(extra + 1) - 1  # where each key's own point goes
    x, y = np.empty(at[-1] + 1, np.int64), np.empty(at[-1] + 1, np.int64)
    x[at], y[at] = keys, offsets
    x[at[extra] - 1], y[at[extra] - 1] = keys[extra] - 1, offsets[extra]
    floor = y // line * line

    def fits(start: int, end: int) -> bool:
        inner = slice(start + 1, end)
        t = (x[inner] - x[start]) / (x[end] - x[start])
        return bool((((1.0 - t) * y[start] + t * y[end]).astype(np.int64) // line == y[inner] // line).all())

    kept, start, last = [0], 0, len(x) - 1
    while start < last:
        low, high, at, size, end = -np.inf, np.inf, start + 1, 64, last
        while at <= last:
            part = slice(at, min(at + size, last + 1))
            dx = (x[part] - x[start]).astype(np.float64)
            lows = np.maximum.accumulate(np.concatenate(([low], (floor[part] - y[start]) / dx)))
            highs = np.minimum.accumulate(np.concatenate(([high], (floor[part] + line - y[start]) / dx)))
            slope = (y[part] - y[start]) / dx
            out = (slope < lows[:-1]) | (slope >= highs[:-1])
            if out.any():
                end = at + int(out.argmax()) - 1
                break
            low, high, at, size = lows[-1], highs[-1], part.stop, 2 * size
        end = max(end, start + 1)
        while end > start + 1 and not fits(start, end):  # where rounding tells otherwise
            end -= 1
        kept.append(end)
        start = end
    return list(zip(x[kept].tolist(), y[kept].tolist(), strict=True))


SPLINE_BLOCK = 50_000


def bounded_spline(df: DataFrame, key: str, line: int, block: int = SPLINE_BLOCK) -> DataFrame:
    """key, value: spline points that give the right line of ``line`` rows for every key.

    The greedy fit is sequential, so it runs in blocks of consecutive keys, in parallel;
    every block starts a segment of its own, which costs at most two points a block. A block
    knows the last key before it, so that no two points share a key: a lookup between two
    blocks could not tell which of them ends its segment.
    """
    if df.count() <= line:
        raise ValueError("fewer rows than a line holds")
    nth = F.col("__nth")
    placed = with_position(key_view(df, key).select("k", "y"), ["k"], "__nth")
    placed = placed.withColumn("__block", F.explode(F.array_distinct(F.array(F.floor(nth / block), F.floor((nth + 1) / block)))))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__nth")
        lent = part["__nth"] < part["__block"] * block  # the last key of the block before
        own, previous = part[~lent], part["k"].iloc[0] if lent.any() else 0
        points = _greedy_spline(own["k"].to_numpy(), own["y"].to_numpy(), line, previous) if len(own) else []
        return pd.DataFrame(points, columns=["key", "value"], dtype="int64")

    return placed.groupBy("__block").applyInPandas(fit, "key bigint, value bigint")


def spline_lookup(points: DataFrame, keys: DataFrame, key: str, line: int, total: int) -> DataFrame:
    """``keys`` with start: the first row of the line that holds the key (its position is in [start, start + line))."""
    both = points.select(F.col("key").alias("__k"), F.lit(1).alias("__point"), F.col("value").alias("__v")).unionByName(
        keys.select(F.col(key).cast("bigint").alias("__k"), F.lit(0).alias("__point"), F.lit(None).cast("bigint").alias("__v"))
    )
    asked = with_neighbours(both, ["__k", "__point"], F.col("__point") == 1, ["__k", "__v"]).filter("__point = 0")
    share = (F.col("__k") - F.col("l.__k")).cast("double") / (F.col("r.__k") - F.col("l.__k")).cast("double")
    mixed = (1.0 - share) * F.col("l.__v") + share * F.col("r.__v")
    start = (
        F.when(F.col("r").isNull(), F.lit(total - 1))
        .when(F.col("l").isNull() | (F.col("l.__k") == F.col("r.__k")), F.floor(F.col("r.__v") / line) * line)
        .otherwise(F.floor(F.floor(mixed) / line) * line)
    )
    return asked.select(F.col("__k").alias(key), start.cast("bigint").alias("start"))


def fit_bounded(df: DataFrame, key: str, line: int, spec: str = "linear,linear", leaves: int = 64) -> tuple[DataFrame, LearnedIndex]:
    """The bounded spline and a learned index over its points."""
    points = staged(bounded_spline(df, key, line), "spline")
    return points, fit_two_layer(points.distinct(), "key", spec, leaves)


# choice of configurations


@dataclass(frozen=True)
class Vocabulary:
    """Kinds and branching factors that the search tries, by profile."""

    top_only: tuple[str, ...]
    anywhere: tuple[str, ...]
    first: int = 6
    stop: int = 25
    step: int = 1

    def branches(self, layers: int = 2) -> list[int]:
        return [1 << i for i in range(4 if layers > 2 else self.first, self.stop, self.step)]


#: What each profile tries.
PROFILES = {
    "": Vocabulary(("radix", "radix18", "radix22", "robust_linear"), ("linear", "cubic", "linear_spline")),
    "fast": Vocabulary(("robust_linear",), ("linear", "cubic"), step=2),
    "memory": Vocabulary(("radix", "radix18", "radix22", "robust_linear"), ("linear", "cubic", "linear_spline")),
    "disk": Vocabulary(
        ("radix", "radix18", "radix22", "robust_linear", "normal", "lognormal", "loglinear"),
        ("linear", "cubic", "linear_spline"),
        stop=28,
    ),
}


def within_leaf_limit(layers: int, branch: int, limit: int = MAX_LEAVES) -> bool:
    return layers <= 1 or branch ** (layers - 1) <= limit


def first_phase(profile: str = "") -> list[tuple[str, int]]:
    """Every top kind with every leaf kind, at every fifth branching factor."""
    words = PROFILES[profile]
    tops = [*words.top_only, *words.anywhere]
    return [(f"{top},{leaf}", b) for top in tops for leaf in words.anywhere for b in words.branches()[::5]]


def pareto_front(configs: DataFrame, size: str = "size", error: str = "avg_log2_err") -> DataFrame:
    """Configurations that no other beats on one of size and error without losing on the other."""
    other = configs.select(F.col(size).alias("__s"), F.col(error).alias("__e"))
    better = (F.col("__s") <= F.col(size)) & (F.col("__e") <= F.col(error)) & ((F.col("__s") < F.col(size)) | (F.col("__e") < F.col(error)))
    return configs.join(F.broadcast(other), better, "left_anti")  # configurations tried: tens to hundreds


def narrow_front(front: list[dict], wanted: int) -> list[dict]:
    """Drop the worse of the two neighbours closest in size until ``wanted`` are left; the smallest stays."""
    if wanted < 2:
        raise ValueError("a front is narrowed to at least 2")
    if len(front) <= wanted:
        return list(front)
    by_size = sorted(front, key=lambda c: c["size"])
    smallest, rest = by_size[0], by_size[1:]
    while len(rest) > wanted - 1:
        gaps = [b["size"] / a["size"] for a, b in zip(rest, rest[1:], strict=False)]
        at = gaps.index(min(gaps))
        rest.pop(at if rest[at]["avg_log2_err"] > rest[at + 1]["avg_log2_err"] else at + 1)
    return [smallest, *rest]


def select_balanced(configs: DataFrame, size_weight: float = 0.5, error_weight: float = 0.5) -> DataFrame:
    """The one configuration with the least weighted sum of min-max-normalised size and error."""
    bounds = configs.agg(
        F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("avg_log2_err").alias("e0"), F.max("avg_log2_err").alias("e1")
    )
    tiny = F.lit(1e-12)
    size = (F.col("size") - F.col("s0")) / F.greatest(F.col("s1") - F.col("s0"), tiny)
    error = (F.col("avg_log2_err") - F.col("e0")) / F.greatest(F.col("e1") - F.col("e0"), tiny)
    scored = configs.crossJoin(F.broadcast(bounds)).withColumn("score", size_weight * size + error_weight * error)
    return scored.drop("s0", "s1", "e0", "e1").orderBy("score", "size", "spec", "branch").limit(1)


#: Configurations that are trained side by side; their small jobs share the cluster.
TOGETHER = 4


def measure(df: DataFrame, key: str, configs: list[tuple[str, int]], held: Keys | None = None) -> DataFrame:
    """One row (spec, branch, size, metrics) for each configuration; those over the leaf limit are left out."""
    held = held or Keys.of(df, key)
    wanted = [(s, b) for s, b in configs if within_leaf_limit(len(parse_spec(s)), b) and all(n in KINDS for n in parse_spec(s))]

    def one(config: tuple[str, int]) -> tuple:
        index = train(df, key, *config, held)
        m = index.metrics.first()
        return (*config, index.size_bytes(), m["avg_log2_err"], m["max_err"], m["mae"])

    with ThreadPoolExecutor(TOGETHER) as pool:
        rows = list(pool.map(one, wanted))
    return df.sparkSession.createDataFrame(rows, "spec string, branch bigint, size bigint, avg_log2_err double, max_err bigint, mae double")


def train_for_size(df: DataFrame, key: str, configs: list[tuple[str, int]], max_bytes: int) -> LearnedIndex:
    """The Pareto configuration with the lowest error under ``max_bytes``, trained."""
    held = Keys.of(df, key)
    front = pareto_front(measure(df, key, configs, held)).filter(F.col("size") < max_bytes).orderBy("avg_log2_err").first()
    if front is None:
        raise ValueError("no configuration is small enough")
    return train(df, key, front["spec"], front["branch"], held)
