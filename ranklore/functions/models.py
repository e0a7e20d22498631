"""The model kinds of a learned index: grouped fits and predictions as column expressions.

A fit takes rows (group columns, ``x`` double, ``k`` bigint, ``y`` bigint) and gives one
row per group with ``p`` array<double>, the parameters in the order of ``predict``.
``x`` is the key as a double, ``k`` as an integer, ``y`` the target position. A column
``copies``, where there is one, says how many rows a row stands for: sums and ranks are
weighted, nothing is repeated. All fits are aggregates (with a partial step before the
shuffle) and equi joins on the group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the logistic approximation and the cap below one.
LOGISTIC_SLOPE = 1.65451
EXP_SQUARINGS = 6
BELOW_ONE = 0.9999999999999999
KNOTS = 32


def significant(x: Column, digits: int = 12) -> Column:
    """``x`` to so many significant digits: parameters that do not depend on the order in which
    a distributed sum was made."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull() | F.isnan(x), x).otherwise(F.round(x * scale) / scale)


def exp1(x: Column) -> Column:
    """(1 + x/64)^64 by squaring six times."""
    y = F.lit(1.0) + x / F.lit(64.0)
    for _ in range(EXP_SQUARINGS):
        y = y * y
    return y


def phi(x: Column) -> Column:
    """1 / (1 + exp1(-slope x)); 0 where exp1 has no positive value to add."""
    down = F.lit(1.0) + exp1(F.lit(-LOGISTIC_SLOPE) * x)
    return F.lit(1.0) / down


def to_position(prediction: Column) -> Column:
    """trunc(max(0, floor(v))) as bigint; values beyond bigint and NaN become the ends."""
    top = F.lit(9.0e18)
    return (
        F.when(prediction.isNull() | F.isnan(prediction), F.lit(0))
        .otherwise(F.floor(F.least(F.greatest(prediction, F.lit(0.0)), top)))
        .cast("bigint")
    )


def clamp_unit(x: Column) -> Column:
    """[0, 1): values of 1 and more become the double below 1."""
    return F.when(x < 0, 0.0).when(x >= 1, BELOW_ONE).otherwise(x)


def bit_length(largest: int) -> int:
    """Largest b with 2^b - 1 <= ``largest``."""
    bits = 0
    while (1 << (bits + 1)) - 1 <= largest:
        bits += 1
    return bits


def _groups(df: DataFrame, group: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def _join(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return a.join(b, group) if group else a.crossJoin(F.broadcast(b))  # without groups b is one row


def _line(x: str, y: Column | str) -> tuple[Column, Column]:
    """(intercept, slope) of least squares; a single point or equal keys: (mean, 0); nothing: (0, 0)."""
    y = F.col(y) if isinstance(y, str) else y
    yd = y.cast("double")
    slope = F.covar_samp(F.col(x), yd) / F.var_samp(x)
    flat = (F.count(x) <= 1) | (F.var_samp(x) == 0)
    beta = significant(F.when(flat | F.var_samp(x).isNull(), 0.0).otherwise(slope))
    alpha = significant(F.coalesce(F.avg(yd), F.lit(0.0))) - beta * significant(F.coalesce(F.avg(x), F.lit(0.0)))
    return significant(alpha), beta


def _weighted(df: DataFrame) -> bool:
    return "copies" in df.columns


def _weighted_line(df: DataFrame, group: list[str], y: Column) -> DataFrame:
    """``_line`` over rows with ``copies``: means first, then sums about them, so nothing cancels."""
    w = F.col("copies").cast("double")
    shaped = df.select(*group, "x", y.cast("double").alias("__y"), w.alias("__w"))
    means = _groups(
        shaped,
        group,
        (F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("__mx"),
        (F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).alias("__my"),
        (F.min("x") == F.max("x")).alias("__flat"),
    )
    dx, dy = F.col("x") - F.col("__mx"), F.col("__y") - F.col("__my")
    sums = _groups(
        _join(shaped, means, group),
        group,
        F.sum(F.col("__w") * dx * dy).alias("__xy"),
        F.sum(F.col("__w") * dx * dx).alias("__xx"),
        F.first("__mx").alias("__mx"),
        F.first("__my").alias("__my"),
        F.first("__flat").alias("__flat"),
    )
    flat = F.coalesce(F.col("__flat") | (F.col("__xx") == 0), F.lit(True))
    zero = F.lit(0.0)
    beta = significant(F.when(flat, zero).otherwise(F.col("__xy") / F.col("__xx")))
    alpha = significant(F.coalesce("__my", zero)) - beta * significant(F.coalesce("__mx", zero))
    return sums.select(*group, F.array(significant(alpha), beta).alias("p"))


def fit_linear(df: DataFrame, group: list[str]) -> DataFrame:
    if _weighted(df):
        return _weighted_line(df, group, F.col("y"))
    alpha, beta = _line("x", "y")
    return _groups(df, group, F.array(alpha, beta).alias("p"))


def _rows_before(df: DataFrame, group: list[str]) -> DataFrame:
    """``df`` with ``copies``, ``__n`` (rows of the group) and ``__before`` (rows before it in the group's
    order of x and y). One global order, cut into ranges: no group is sorted by one task."""
    from ranklore.plans.ranking import ONE_TASK_ROWS, one_task_limit, with_running_sum

    df = df if _weighted(df) else df.withColumn("copies", F.lit(1).cast("bigint"))
    running = with_running_sum(df, [*group, "x", *[c for c in ("y",) if c in df.columns]], "copies", "__run", df.count() <= one_task_limit(df.sparkSession, ONE_TASK_ROWS))
    firsts = _groups(running, group, F.min("__run").alias("__first"), F.sum("copies").alias("__n"))
    return _join(running, firsts, group).withColumn("__before", F.col("__run") - F.col("__first")).drop("__run", "__first")


def fit_robust_linear(df: DataFrame, group: list[str]) -> DataFrame:
    """Without the first and last max(1, n/10000) points of each group; at least three must be left."""
    placed = _rows_before(df, group)
    n, first = F.col("__n"), F.col("__before")
    cut = F.greatest(F.lit(1), F.floor(n * 0.0001))
    left = F.least(first + F.col("copies"), n - cut) - F.greatest(first, cut)  # copies that are not cut off
    kept = placed.withColumn("copies", left).filter((F.col("copies") > 0) & (2 * cut + 1 < n))
    return fit_linear(kept.drop("__n", "__before"), group)


def fit_log_linear(df: DataFrame, group: list[str]) -> DataFrame:
    if _weighted(df):
        return _weighted_line(df.filter("y > 0"), group, F.ln(F.col("y").cast("double")))
    alpha, beta = _line("x", F.ln(F.col("y").cast("double")))
    return _groups(df.filter("y > 0"), group, F.array(alpha, beta).alias("p"))


def fit_linear_spline(df: DataFrame, group: list[str]) -> DataFrame:
    """The line through the first and the last point."""
    ends = _groups(df, group, F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    slope = F.when(F.col("x1") == F.col("x0"), 0.0).otherwise((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return ends.select(*group, F.array(F.col("y0") - slope * F.col("x0"), slope).alias("p"))


def fit_cubic(df: DataFrame, group: list[str]) -> DataFrame:
    """Monotone Hermite cubic through the end points, slopes from the first and last different
    keys (capped at norm 3), or the line through the ends where that has the smaller total error."""
    ends = _groups(df, group, F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inner = _groups(
        _join(df, ends, group),
        group,
        F.min(F.when(F.col("x") > F.col("x0"), F.struct("x", "y"))).alias("second"),
        F.max(F.when(F.col("x") < F.col("x1"), F.struct("x", "y"))).alias("before"),
    )
    both = _join(ends, inner, group)
    width, height = F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")).cast("double")
    flat = width == 0

    def slope(dx: Column, dy: Column) -> Column:
        return F.when(flat | (height == 0), 0.0).otherwise((dy / height) / (dx / width))

    shaped = both.withColumn(
        "__m1", slope(F.col("second.x") - F.col("x0"), F.col("second.y") - F.col("y0"))
    ).withColumn("__m2", slope(F.col("x1") - F.col("before.x"), F.col("y1") - F.col("before.y")))
    length = F.col("__m1") * F.col("__m1") + F.col("__m2") * F.col("__m2")
    tau = F.when(length > 9, 3 / F.sqrt(length)).otherwise(1.0)
    shaped = shaped.withColumn("m1", F.col("__m1") * tau).withColumn("m2", F.col("__m2") * tau)
    lo, hi, m1, m2 = F.col("x0"), F.col("x1"), F.col("m1"), F.col("m2")
    unit = height / (width * width * width)
    a = (m1 + m2 - 2) * unit
    b = -(hi * (2 * m1 + m2 - 3) + lo * (m1 + 2 * m2 - 3)) * unit
    c = (m1 * hi * hi + m2 * lo * lo + hi * lo * (2 * m1 + 2 * m2 - 6)) * unit
    d = -lo * (m1 * hi * hi + hi * lo * (m2 - 3) + lo * lo) * unit + F.col("y0")
    line = height / width
    made = shaped.select(
        *group,
        flat.alias("__flat"),
        F.col("y0"),
        F.when(flat, None).otherwise(F.array(a, b, c, d)).alias("__cubic"),
        F.when(flat, None).otherwise(F.array(F.col("y0") - line * lo, line)).alias("__line"),
    )
    predicted = _join(df, made.drop("y0"), group)
    w = F.col("copies") if _weighted(df) else F.lit(1)
    errors = _groups(
        predicted,
        group,
        F.sum(w * F.abs(predict_cubic(F.col("__cubic"), F.col("x")) - F.col("y"))).alias("__ce"),
        F.sum(w * F.abs(predict_linear(F.col("__line"), F.col("x")) - F.col("y"))).alias("__le"),
    )
    zero = F.lit(0.0)
    return _join(made, errors, group).select(
        *group,
        F.when(F.col("__flat"), F.array(zero, zero, zero, F.col("y0").cast("double")))
        .when(F.col("__le") < F.col("__ce"), F.array(zero, zero, F.get("__line", F.lit(1)), F.get("__line", F.lit(0))))
        .otherwise(F.col("__cubic"))
        .alias("p"),
    )


def _normal(df: DataFrame, group: list[str], x: Column) -> DataFrame:
    if _weighted(df):
        w = F.col("copies").cast("double")
        shaped = df.select(*group, x.alias("__v"), "y", w.alias("__w"))
        means = _groups(shaped, group, (F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("__m"))
        off = F.col("__v") - F.col("__m")
        spread = F.sqrt(F.sum(F.col("__w") * off * off) / F.sum("__w"))
        joined = _join(shaped, means, group)
        return _groups(
            joined, group, F.array(significant(F.first("__m")), significant(spread), F.max("y").cast("double")).alias("p")
        )
    return _groups(
        df, group, F.array(significant(F.avg(x)), significant(F.stddev_pop(x)), F.max("y").cast("double")).alias("p")
    )


def fit_normal(df: DataFrame, group: list[str]) -> DataFrame:
    return _normal(df, group, F.col("x"))


def fit_log_normal(df: DataFrame, group: list[str]) -> DataFrame:
    """Logarithms that are not finite count as 0."""
    return _normal(df, group, F.when(F.col("x") > 0, F.ln("x")).otherwise(0.0))


def _prefix(df: DataFrame, group: list[str]) -> DataFrame:
    """prefix: number of leading bits that all keys share; ymax: the largest target."""
    both = _groups(df, group, F.bit_or("k").alias("any"), F.bit_and("k").alias("all"), F.max("y").alias("ymax"))
    differing = F.col("any").bitwiseXOR(F.col("all"))
    leading = F.when(differing == 0, 64).when(differing < 0, 0).otherwise(64 - F.length(F.bin(differing)))
    return both.select(*group, leading.cast("int").alias("prefix"), "ymax")


def _bits_of(y: Column) -> Column:
    """Largest b with 2^b - 1 <= y, by the length of y + 1 in binary."""
    return F.length(F.bin(y + 1)) - 1


def fit_radix(df: DataFrame, group: list[str]) -> DataFrame:
    return _prefix(df, group).select(
        *group, F.array(F.col("prefix").cast("double"), _bits_of(F.col("ymax")).cast("double")).alias("p")
    )


def _shifted(k: Column, prefix: Column, bits: Column) -> Column:
    """(k << prefix) >>> (64 - bits); no bits give 0."""
    left = F.call_function("shiftleft", k, prefix.cast("int"))
    return F.when(bits == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftrightunsigned", left, (F.lit(64) - bits).cast("int"))
    )


def radix_bucket(k: Column, prefix: Column, bits: int) -> Column:
    """((k << prefix) >>> prefix) >>> (64 - prefix - bits): the bits after the shared prefix."""
    p = prefix.cast("int")
    bare = F.call_function("shiftrightunsigned", F.call_function("shiftleft", k, p), p)
    return F.when(p + bits > 64, bare).otherwise(
        F.call_function("shiftrightunsigned", bare, F.greatest(F.lit(64 - bits) - p, F.lit(0)))
    )


def radix_table(df: DataFrame, bits: int) -> DataFrame:
    """bucket, hint: for each bucket the first target, gaps filled with the next bucket's, the
    rest with the table's size; bucket 0 stays 0. One row a bucket (2^bits, a parameter)."""
    prefix = _prefix(df, [])
    firsts = (
        df.crossJoin(F.broadcast(prefix.select("prefix")))
        .groupBy(radix_bucket(F.col("k"), F.col("prefix"), bits).alias("bucket"))
        .agg(F.min("y").alias("y"))
    )
    every = df.sparkSession.range(1 << bits).withColumnRenamed("id", "bucket")
    following = Window.orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    filled = every.join(firsts, "bucket", "left").withColumn(
        "hint", F.coalesce(F.first("y", ignorenulls=True).over(following), F.lit(1 << bits).cast("bigint"))
    )
    return filled.select("bucket", F.when(F.col("bucket") == 0, F.lit(0)).otherwise(F.col("hint")).cast("bigint").alias("hint"))


def balanced_radix(df: DataFrame, max_output: int) -> DataFrame:
    """bits, high, clamp, score of each tried setup: chi-square of the bucket counts against even ones."""
    spark, bits = df.sparkSession, bit_length(max_output)
    number = F.sum("copies") if _weighted(df) else F.count(F.lit(1))
    n = df.agg(number).first()[0] or 0
    prefix = _prefix(df, []).first()["prefix"]
    tried = []
    for test in range(bits, min(bits + 2, 64)):
        tried.append((test, True, max_output - 1))
        tried.append((test, False, max_output - ((1 << (test + 1)) - 1)))
    setups = spark.createDataFrame(tried, "bits int, high boolean, clamp bigint")
    raw = _shifted(F.col("k"), F.lit(prefix), F.col("bits"))
    clamped = predict_balanced_radix(raw, F.col("high"), F.col("clamp"))
    counts = df.crossJoin(F.broadcast(setups)).groupBy("bits", "high", "clamp", clamped.alias("bucket")).agg(number.alias("c"))
    expected = n / max_output
    held = counts.groupBy("bits", "high", "clamp").agg(
        F.sum((F.col("c") - expected) * (F.col("c") - expected) / expected).alias("some"), F.count(F.lit(1)).alias("buckets")
    )
    return held.select("bits", "high", "clamp", F.round(F.col("some") + (F.lit(max_output) - F.col("buckets")) * expected, 6).alias("score"))


def predict_balanced_radix(raw: Column, high: Column, clamp: Column) -> Column:
    return F.when(high, F.least(raw, clamp)).when(raw < clamp, F.lit(0)).otherwise(raw - clamp)


def histogram_splits(df: DataFrame) -> DataFrame:
    """bin, split: the key at every (n div bins)-th row, bins being the last row's target."""
    from ranklore.plans.ranking import with_position

    placed = with_position(df.select("k", "y"), ["k", "y"], "row")
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("bins"))
    per_bin = F.floor(F.col("n") / F.col("bins"))
    return (
        placed.crossJoin(F.broadcast(facts))
        .filter((F.col("row") % per_bin == 0) & (F.floor(F.col("row") / per_bin) < F.col("bins")))
        .select(F.floor(F.col("row") / per_bin).cast("bigint").alias("bin"), F.col("k").alias("split"))
    )


def quantile_knots(df: DataFrame, group: list[str], knots: int = KNOTS) -> DataFrame:
    """p: up to ``knots`` order statistics, at round(i (n - 1) / (knots - 1))."""
    slim = df.select(*group, "x", *[c for c in ("copies",) if c in df.columns])
    placed = _rows_before(slim, group)
    count = F.least(F.lit(knots), F.col("__n"))
    at = F.transform(
        F.sequence(F.lit(0), (count - 1).cast("int")),
        lambda i: F.floor(i * (F.col("__n") - 1) / F.greatest(count - 1, F.lit(1)) + 0.5).cast("bigint"),
    )
    held = F.filter(at, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("copies")))
    chosen = placed.withColumn("__i", F.explode(held))
    return _groups(chosen, group, F.array_sort(F.collect_list("x")).alias("p"))  # at most `knots` values a group


def predict_linear(p: Column, x: Column) -> Column:
    return F.get(p, F.lit(0)) + F.get(p, F.lit(1)) * x


def predict_log_linear(p: Column, x: Column) -> Column:
    return exp1(predict_linear(p, x))


def predict_cubic(p: Column, x: Column) -> Column:
    out = F.get(p, F.lit(0))
    for i in (1, 2, 3):
        out = out * x + F.get(p, F.lit(i))
    return out


def predict_normal(p: Column, x: Column) -> Column:
    z = (x - F.get(p, F.lit(0))) / F.get(p, F.lit(1))
    return F.when(F.get(p, F.lit(1)) <= 0, 0.0).otherwise(phi(z) * F.get(p, F.lit(2)))


def predict_log_normal(p: Column, x: Column) -> Column:
    logged = F.when(x > 0, F.greatest(F.ln(F.when(x > 0, x)), F.lit(0.0))).otherwise(0.0)
    return predict_normal(p, logged)


def predict_radix(p: Column, k: Column) -> Column:
    return _shifted(k, F.get(p, F.lit(0)), F.get(p, F.lit(1))).cast("double")


def predict_knots(p: Column, x: Column) -> Column:
    """Piecewise-linear CDF over sorted knots, in [0, 1)."""
    count = F.size(p)
    right = F.size(F.filter(p, lambda k: k <= x))  # knots not above x; the first above has this index
    d0, d1 = F.get(p, right - 1), F.get(p, right)
    share = F.when(d1 > d0, (x - d0) / (d1 - d0)).otherwise(0.0)
    inner = clamp_unit((right - 1 + share) / (count - 1))
    return (
        F.when(count < 2, 0.0)
        .when(x <= F.get(p, F.lit(0)), 0.0)
        .when(x >= F.get(p, count - 1), BELOW_ONE)
        .otherwise(inner)
    )


def predict_splits(splits: Column, k: Column) -> Column:
    """Index of the last split not above the key, at least 0."""
    return F.greatest(F.size(F.filter(splits, lambda s: s <= k)) - 1, F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Kind:
    """fit(df, group) and predict(p, x or k); ``place`` is "any" or "top"; ``constant`` makes parameters
    that always predict one value, or None where the kind cannot."""

    fit: Callable[[DataFrame, list[str]], DataFrame]
    predict: Callable[[Column, Column], Column]
    empty: tuple[float, ...]
    integer_keys: bool = False
    place: str = "any"
    bounded: bool = False

    def constant(self, value: Column) -> Column | None:
        v, zero = value.cast("double"), F.lit(0.0)
        if self.predict is predict_linear:
            return F.array(v, zero)
        if self.predict is predict_cubic:
            return F.array(zero, zero, zero, v)
        return None


KINDS: dict[str, Kind] = {
    "linear": Kind(fit_linear, predict_linear, (0.0, 0.0)),
    "robust_linear": Kind(fit_robust_linear, predict_linear, (0.0, 0.0)),
    "linear_spline": Kind(fit_linear_spline, predict_linear, (0.0, 0.0)),
    "cubic": Kind(fit_cubic, predict_cubic, (0.0, 0.0, 1.0, 0.0)),
    "loglinear": Kind(fit_log_linear, predict_log_linear, (0.0, 0.0)),
    "normal": Kind(fit_normal, predict_normal, (0.0, 0.0, 0.0)),
    "lognormal": Kind(fit_log_normal, predict_log_normal, (0.0, 0.0, 0.0)),
    "radix": Kind(fit_radix, predict_radix, (0.0, 0.0), integer_keys=True, place="top"),
    "cdf_piecewise": Kind(lambda df, group: quantile_knots(df, group), predict_knots, ()),
}
#: Kinds that hold a table beside parameters: radix tables by bits, and those with operators of their own.
TABLE_KINDS = {"radix8": 8, "radix18": 18, "radix22": 22, "radix26": 26, "radix28": 28}
OTHER_KINDS = ("bradix", "histogram")


def parse_spec(spec: str) -> list[str]:
    """Names of the layers, trimmed; empty names, unknown names and a radix below the top are errors."""
    layers = [part.strip() for part in spec.split(",")]
    known = {*KINDS, *TABLE_KINDS, *OTHER_KINDS}
    for i, name in enumerate(layers):
        if not name:
            raise ValueError("a model spec must not hold an empty layer")
        if name not in known:
            raise ValueError(f"unknown model kind: {name}")
        if i and (name.startswith(("radix", "bradix")) or name == "histogram"):
            raise ValueError(f"{name} must be the root model")
    return layers
