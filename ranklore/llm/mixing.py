"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; its mean repetition rate is
share * target rows / its rows. Every document turns its seeded hash into a uniform
number and that, by inverting the Poisson distribution with the source's rate, into
its own number of copies: no coordination, the same result on every attempt, and the
expected share is met, over different ids, whatever the order or the partitioning; rows
that share an id or have none are drawn as one, so many of them can miss it. Copies are exploded and
shuffled globally by a second hash (a range partitioning, so no key can be hot).

Default weights: the square root of each source's rows, which lifts small sources.

The distribution tables are cut to the counts that a double can tell from 0 and 1, so a
rate of r takes about 18 sqrt(r) numbers and some 60 more. Rates over
``MAX_RATE`` and more than ``MAX_NUMBERS`` numbers in all (16 MB, broadcast) are errors.

Defined results: a null source counts as the empty one; a source that ``weights``
does not name has weight 0 and leaves; rows that share a doc_id draw the same number;
null doc_ids draw that of the empty id; a null or empty text is a row like any other;
empty table: empty result. Input columns may have any names: columns that are added get
leading underscores until their name is free.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.plans.ranking import numbered

SEED = 11
MAX_SOURCES = 10_000  # the rate table is broadcast; more sources than that are an error
MAX_RATE, MAX_NUMBERS = 1_000_000.0, 2_000_000
_UNIT = 1 << 52


def least_copies(rate: float) -> int:
    """A count that is reached in all draws but one in 10^17: counts below need no entry."""
    return max(0, int(rate - 8.7 * math.sqrt(rate) - 30))


def poisson_cdf(rate: float, start: int = 0) -> list[float]:
    """P(X <= k) for k = ``start``, ... until it is 1 to double precision; what lies below ``start`` counts as 0."""
    out, total, k = [], 0.0, start
    while k <= rate or total < 1.0 - 1e-15:
        term = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        total += term
        out.append(min(total, 1.0))
        k += 1
        if k > rate + 1 and term < 1e-17:  # rounding may keep the sum from 1; no further term would change it
            break
    return out


def _distributions(rates: dict[str, float]) -> list[tuple[str, float, int, list[float]]]:
    if max(rates.values(), default=0.0) > MAX_RATE:
        raise ValueError(f"a source would be repeated over {MAX_RATE:.0f} times: lower its weight or the target")
    table = []
    for source, rate in rates.items():
        start = least_copies(rate)
        table.append((source, rate, start, poisson_cdf(rate, start)))
    if sum(len(row[3]) for row in table) > MAX_NUMBERS:
        raise ValueError(f"the distributions take more than {MAX_NUMBERS} numbers")
    return table


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None) -> dict[str, float]:
    """Mean copies of a document, by source. One count a source comes to the driver, at most ``MAX_SOURCES``."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: fold them into fewer before mixing")
    rows = {r["source"]: r["n"] for r in sorted(counts, key=lambda r: r["source"])}
    share = {s: math.sqrt(n) if weights is None else float(weights.get(s, 0.0)) for s, n in rows.items()}
    if any(w < 0 for w in share.values()):
        raise ValueError("weights must not be negative")
    total, target = sum(share.values()), sum(rows.values()) if target_rows is None else target_rows
    return {s: share[s] / total * target / n if total else 0.0 for s, n in rows.items()}


def _drawn(docs: DataFrame, weights: dict[str, float] | None, target_rows: int | None, seed: int) -> DataFrame:
    """row (a document with all its columns), source, copies, copy, rate and order: each row as often as it is drawn."""
    table = _distributions(source_rates(docs, weights, target_rows))
    lookup = docs.sparkSession.createDataFrame(table, "source string, rate double, least int, cdf array<double>")
    own = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")), 1, 13)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / _UNIT
    order = F.md5(F.concat(F.lit(f"{seed + 1}:"), own, F.lit(":"), F.col("copy").cast("string")).cast("binary"))
    return (
        docs.select(F.struct("*").alias("row"))
        .withColumn("source", F.coalesce("row.source", F.lit("")))
        .join(F.broadcast(lookup), "source")
        .withColumn("u", uniform)
        .withColumn("copies", F.expr("least + size(filter(cdf, c -> c < u))"))
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
        .select("row", "source", "copies", "copy", "rate", order.alias("order"))
    )


def _unpacked(drawn: DataFrame) -> DataFrame:
    """The columns of ``row`` and then the others, each with two underscores before its name, more where that is taken."""
    taken = {f.name.lower() for f in drawn.schema["row"].dataType}
    added = []
    for name in drawn.columns[1:]:
        free = f"__{name}"
        while free in taken:
            free = f"_{free}"
        taken.add(free)
        added.append(F.col(name).alias(free))
    return drawn.select("row.*", *added)


def replicated(
    docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """``docs`` with each row as often as it is drawn, not yet shuffled, and with the columns
    __source, __copies, __copy (from 0), __rate and __order (the global shuffle's key)."""
    return _unpacked(_drawn(docs, weights, target_rows, seed))


def shuffled(
    docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """The drawn rows, whole and packed as ``row``, in globally shuffled order."""
    drawn = _drawn(docs, weights, target_rows, seed)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartitionByRange(parts, "order", "copy").sortWithinPartitions("order", "copy")


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """The mixture: copies of the rows of ``docs``, all columns kept, in globally shuffled order."""
    return shuffled(docs, weights, target_rows, seed).select("row.*")


def written_mixture(
    docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """The rows of ``mixed``, written to a work table, with the columns of ``replicated`` and their __position."""
    return _unpacked(numbered(shuffled(docs, weights, target_rows, seed), "position", "mixture"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        F.col("__source").alias("source"),
        F.col("__copies").alias("copies"),
        F.col("__copy").alias("copy"),
        F.round("__rate", 6).alias("rate"),
        F.col("__order").alias("shuffle_key"),
        F.col("__position").alias("position"),
    )


OP9_SQL = f"""
WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
c AS (
  SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, range(0, 400) t(k)
),
u AS (
  SELECT doc_id, coalesce(source, '') AS source,
         (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
         / {_UNIT}::DOUBLE AS u
  FROM documents
),
d AS (
  SELECT doc_id, u.source, rate, CAST(count(*) AS INTEGER) AS copies
  FROM u JOIN c ON u.source = c.source AND cdf < u GROUP BY doc_id, u.source, rate, u
),
e AS (
  SELECT doc_id, source, copies, CAST(unnest(range(0, copies)) AS INTEGER) AS copy, round(rate, 6) AS rate FROM d
)
SELECT *, row_number() OVER (ORDER BY shuffle_key, doc_id, copy) - 1 AS position FROM (
  SELECT *, md5('{SEED + 1}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM e
)
"""
