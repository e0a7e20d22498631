"""Work tables in the folder that driver and executors share.

Long plans cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it back: a lost executor then costs a
re-read, never a recomputation, and every consumer sees the same rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder for work tables.

    The session's ``spark.checkpoint.dir`` is taken as it is. Where it is unset,
    a local master (tests) gets a folder of its own; a cluster master is an
    error, for a machine-local folder would not be seen by other machines.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ranklore-work")
    return base.rstrip("/")


#: Paths given out by this process and not yet deleted, in order.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call has returned."""
    path = f"{shared_dir(spark)}/ranklore/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, keep: Callable[[str], bool] = lambda path: False) -> Iterator[None]:
    """Work tables made inside are deleted at the end, those that ``keep`` holds for excepted.

    What is computed from them must have been consumed, or written to a table that is kept.
    After an error they stay, to look at."""
    first = len(_MADE)
    yield
    done = [path for path in _MADE[first:] if not keep(path)]
    for path in done:
        drop_path(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` has made and that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_work_path", None):
            drop_path(table.sparkSession, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table (missing paths are ignored)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if path in _MADE:
        _MADE.remove(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_marker(spark: SparkSession, folder: str, name: str, value: str) -> None:
    """Note a short ``value`` beside the data of ``folder``: an empty file that Spark's readers pass over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}-{value}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


def read_marker(spark: SparkSession, folder: str, name: str) -> str | None:
    """The value noted in ``folder`` under ``name``, or None."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}-*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [status.getPath().getName() for status in found or []]
    if len(names) > 1:
        raise ValueError(f"{folder} holds several notes of its {name}: {sorted(names)}")
    return names[0].split("-", 1)[1] if names else None


def child_paths(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths below ``folder`` whose name matches ``pattern``, in order of name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f"{folder}/{status.getPath().getName()}" for status in found or [])


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename ``source`` to ``target``; what another writer has put there meanwhile stays, and ``source`` goes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, there = hadoop(source), hadoop(target)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(there.getParent())
    if fs.exists(there) or not fs.rename(here, there):
        drop_path(spark, source)
    elif source in _MADE:
        _MADE.remove(source)
