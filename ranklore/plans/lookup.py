"""Joins of many rows to one row per key that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/SLICES of the rows, so fewer than SLICES keys can be hot.
SLICES = 500


def lookup_by_key(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row per non-null key).

    ``weight`` is a column of ``keyed``: the number of rows that carry the key;
    ``total`` is the number of rows. Hot keys number fewer than ``SLICES`` by
    arithmetic, whatever the data, so their rows of ``keyed`` are broadcast and the
    rows that carry them never meet in one task. The others go through a
    sort-merge join in which no key exceeds 1/``SLICES`` of the rows.
    """
    hot = keyed.filter(F.col(weight) * F.lit(SLICES) > F.lit(int(total)))
    cold = keyed.filter(F.col(weight) * F.lit(SLICES) <= F.lit(int(total)))
    columns = [*rows.columns, *[c for c in keyed.columns if c != key]]
    by_broadcast = rows.join(F.broadcast(hot), key).select(*columns)
    by_merge = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key).select(*columns)
    return by_broadcast.unionByName(by_merge)
