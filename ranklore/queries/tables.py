"""Table access for the registered queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ranklore.plans.ranking import ONE_TASK_CONF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def by_ranges(spark: SparkSession) -> Iterator[None]:
    """Inside, positions and running sums are made by range partitions however few the rows are."""
    before = spark.conf.get(ONE_TASK_CONF, None)
    spark.conf.set(ONE_TASK_CONF, "0")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ONE_TASK_CONF)
        else:
            spark.conf.set(ONE_TASK_CONF, before)
