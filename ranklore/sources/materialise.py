"""From a source to a checked dataset: ranged fetches that resume, digests, safe extraction, conversion, manifest.

Sources are read through ``pyarrow.fs`` (files, HDFS, S3, GCS) or any object with ``size``
and ``read_at``; there is no network code here. A fetch writes to ``<target>.part`` and
goes on where an earlier one ended.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import tarfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ranklore.sources import binary as B
from ranklore.sources import models as MD
from ranklore.sources import truth as T

STEP = 8 << 20


@dataclass
class FileSource:
    """A source behind a path or URI of ``pyarrow.fs``."""

    uri: str

    def size(self) -> int:
        return B.file_size(self.uri)

    def read_at(self, offset: int, length: int) -> bytes:
        return B.read_at(self.uri, offset, length)


def fetch(source, target: str, stop: int | None = None, step: int = STEP, retries: int = 3) -> int:
    """Copy the first ``stop`` bytes (unset: all) of a source to the local file ``target`` by ranges.

    What an earlier, broken fetch has left in ``<target>.part`` is kept; a short or failed
    range is asked for again up to ``retries`` times in a row. Returns the bytes read now."""
    size = source.size()
    stop = size if stop is None else min(stop, size)
    part, fetched, failures = f"{target}.part", 0, 0
    at = os.path.getsize(part) if os.path.exists(part) else 0
    if at > stop:
        raise ValueError(f"{part} is longer than what was asked for: it belongs to something else")
    with open(part, "ab") as out:
        while at < stop:
            try:
                data = source.read_at(at, min(step, stop - at))
                if not data:
                    raise OSError(f"nothing more at {at} of {stop}")
            except OSError:
                failures += 1
                if failures > retries:
                    raise
                continue
            out.write(data)
            at, fetched, failures = at + len(data), fetched + len(data), 0
    os.replace(part, target)
    return fetched


def digest_of(path: str, kind: str = "sha256") -> str:
    """Hex digest of a local file, read in steps."""
    made = hashlib.new(kind)
    with open(path, "rb") as f:
        while data := f.read(STEP):
            made.update(data)
    return made.hexdigest()


def verified(path: str, digest: str, kind: str = "sha256") -> str:
    found = digest_of(path, kind)
    if found != digest.lower():
        raise ValueError(f"{path} has {kind} {found}, not {digest}")
    return path


def safe_member(name: str) -> str:
    """A member's path inside the target folder; absolute paths and ways out of it are errors."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean in ("..", ".") or (len(clean) > 1 and clean[1] == ":"):
        raise ValueError(f"unsafe member {name!r}")
    return clean


def extract(archive: str, folder: str, wanted: Callable[[str], bool] = lambda name: True) -> list[str]:
    """Extract the regular files of a tar archive; links, devices and unsafe paths are errors. Returns their paths."""
    out = []
    with tarfile.open(archive) as tar:
        for member in tar:
            if member.isdir() or not wanted(member.name):
                continue
            name = safe_member(member.name)
            if not member.isfile():
                raise ValueError(f"{member.name!r} is no regular file")
            path = os.path.join(folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with tar.extractfile(member) as data, open(path, "wb") as target:
                while block := data.read(STEP):
                    target.write(block)
            out.append(path)
    return sorted(out)


def prefix_bytes(rows: int, dim: int, item: int) -> int:
    """Bytes of an xbin file's header and first rows."""
    return 8 + rows * dim * item


def convert_xbin_to_vecs(spark: SparkSession, path: str, folder: str, first: int | None = None) -> list[dict]:
    """xbin to fvecs parts."""
    return B.write_vecs(B.read_xbin(spark, path, first, exact=first is None), folder, "fvecs")


def truth_to_ivecs(truth: DataFrame, folder: str, k: int) -> list[dict]:
    """A ground-truth table (query_id, nn_rank, base_id) as ivecs parts, one row a query; queries with fewer
    than ``k`` neighbours are an error."""
    from pyspark.sql import functions as F

    lists = T.truth_lists(truth, k)
    short = lists.filter(F.size("neighbours") < k).count()
    if short:
        raise ValueError(f"{short} queries have fewer than {k} neighbours")
    return B.write_vecs(lists.select(F.col("query_id").alias("vec_id"), F.col("neighbours").cast("array<int>").alias("embedding")), folder, "ivecs")


def materialise(spark: SparkSession, name: str, base: str, queries: str, out: str, k: int = 100, rows: int | None = None, spot: int = 16) -> dict:
    """Read xbin base and queries, check them, compute and spot-check the truth, write all as Parquet
    below ``out`` with a manifest; returns the manifest. Faults are errors and write no manifest."""
    from ranklore.operators import search as S

    tables = {"base": B.read_xbin(spark, base, rows, exact=rows is None), "queries": B.read_xbin(spark, queries)}
    for part, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{part}")
        tables[part] = spark.read.parquet(f"{out}/{part}")
        told = B.vector_faults(tables[part], B.xbin_header(base)[1]).first()
        if told["wrong_dim"] or told["missing_ids"] or told["infinite"]:
            raise ValueError(f"{name} {part}: {told.asDict()}")
    S.knn(tables["queries"], tables["base"], k).write.mode("overwrite").parquet(f"{out}/truth")
    tables["truth"] = spark.read.parquet(f"{out}/truth")
    faults = T.truth_faults(tables["truth"], tables["base"].count()).first()
    wrong = S.spot_check(tables["queries"].limit(spot), tables["base"], tables["truth"].select("query_id", "base_id"), k).count()
    if faults["out_of_bounds"] or faults["unordered"] or wrong:
        raise ValueError(f"{name} truth: {faults.asDict()}, {wrong} too far")
    manifest = {"name": name, "k": k, "tables": [MD.table_manifest(df, part) for part, df in tables.items()]}
    MD.write_json(spark, manifest, f"{out}/manifest")
    return manifest


def build_bundle(spark: SparkSession, tables: dict[str, DataFrame], notes: dict, folder: str) -> dict:
    """Tables as Parquet, their manifests and notes as one JSON: what a reader can check by ``verify_bundle``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{MD.safe_component(name)}")
    held = {name: spark.read.parquet(f"{folder}/{MD.safe_component(name)}") for name in tables}
    bundle = {"notes": notes, "tables": [MD.table_manifest(df, name) for name, df in held.items()]}
    MD.write_json(spark, bundle, f"{folder}/bundle")
    return bundle


def verify_bundle(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """What differs from the bundle's manifests, by table; empty if nothing does."""
    bundle = MD.read_json(spark, f"{folder}/bundle")
    told = {m["name"]: MD.verify_manifest(spark.read.parquet(f"{folder}/{MD.safe_component(m['name'])}"), m) for m in bundle["tables"]}
    return {name: faults for name, faults in told.items() if faults}
