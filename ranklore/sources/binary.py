"""Readers and writers for the fixed-stride binary formats of keys and vectors.

A file is cut into row ranges on the driver from its length alone; each range is read
by one task with one range read, so a file of any size is read in parallel and no task
holds more than ``RANGE_BYTES``. All numbers are little-endian. Files are reached through
``pyarrow.fs``, so any store that it knows will do.

scalar:  u64 count, then the keys (u64, u32 or f64)
vecs:    per row i32 dim, then dim 4-byte entries (fvecs: float, ivecs: int)
xbin:    u32 rows, u32 dim, then rows x dim entries (f32, u8 or i8)
truth:   u32 queries, u32 k, then ids u32[queries, k], then distances f32[queries, k]
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 16 << 20
KEY_DTYPES = {"uint64": "<u8", "uint32": "<u4", "f64": "<f8"}
XBIN_DTYPES = {"fbin": "<f4", "u8bin": "u1", "i8bin": "i1"}
VEC_DTYPES = {"fvecs": "<f4", "ivecs": "<i4"}


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store, inner


def file_size(path: str) -> int:
    store, inner = _open(path)
    info = store.get_file_info(inner)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def read_at(path: str, offset: int, length: int) -> bytes:
    store, inner = _open(path)
    with store.open_input_file(inner) as f:
        data = f.read_at(length, offset)
    if len(data) != length:
        raise ValueError(f"{path} is shorter than its header says")
    return data


def _ranges(spark: SparkSession, rows: int, stride: int) -> DataFrame:
    """start, rows of every range; one partition a range."""
    per = max(1, RANGE_BYTES // max(stride, 1))
    starts = [(i, min(per, rows - i)) for i in range(0, rows, per)]
    return spark.createDataFrame(starts, "start bigint, rows bigint").repartition(max(1, len(starts)), "start")


def _vector_batch(start: int, values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    ids = pa.array(np.arange(start, start + len(values)))
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind))], ["vec_id", "embedding"])


def read_scalars(spark: SparkSession, path: str, dtype: str | None = None) -> DataFrame:
    """row, key of a count-prefixed key file. The type comes from ``dtype`` or a marker in the file name.

    u64 keys from 2^63 on do not fit a bigint and are an error.
    """
    name = dtype or next((m for m in ("uint32", "f64", "uint64") if m in path.rsplit("/", 1)[-1]), None)
    if name not in KEY_DTYPES:
        raise ValueError(f"no key type for {path}")
    kind = np.dtype(KEY_DTYPES[name])
    size = file_size(path)
    if size < 8:
        raise ValueError(f"{path} has no count")
    count = int(np.frombuffer(read_at(path, 0, 8), "<u8")[0])
    if size < 8 + count * kind.itemsize:
        raise ValueError(f"{path} is shorter than its count says")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(read_at(path, 8 + start * kind.itemsize, rows * kind.itemsize), kind)
                if name == "uint64" and len(keys) and keys.max() >= 1 << 63:
                    raise ValueError("a key of 2^63 or more does not fit a bigint")
                out = pa.array(keys.astype("f8" if name == "f64" else "i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + rows)), out], ["row", "key"])

    return _ranges(spark, count, kind.itemsize).mapInArrow(read, f"row bigint, key {'double' if name == 'f64' else 'bigint'}")


def read_vecs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """vec_id, embedding of an fvecs or ivecs file; every row header must hold the first one's dimension."""
    name = kind or path.rsplit(".", 1)[-1]
    if name not in VEC_DTYPES:
        raise ValueError(f"not a vecs file: {path}")
    size = file_size(path)
    if not size:
        return spark.createDataFrame([], f"vec_id bigint, embedding array<{'float' if name == 'fvecs' else 'int'}>")
    dim = int(np.frombuffer(read_at(path, 0, 4), "<i4")[0])
    stride = 4 + 4 * dim
    if dim <= 0 or size % stride:
        raise ValueError(f"{path} does not hold whole rows of dimension {dim}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(read_at(path, start * stride, rows * stride), "<i4").reshape(rows, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"{path} mixes dimensions")
                values = np.ascontiguousarray(raw[:, 1:]).view(VEC_DTYPES[name])
                yield _vector_batch(start, values, pa.float32() if name == "fvecs" else pa.int32())

    return _ranges(spark, size // stride, stride).mapInArrow(read, f"vec_id bigint, embedding array<{'float' if name == 'fvecs' else 'int'}>")


def xbin_header(path: str) -> tuple[int, int]:
    rows, dim = np.frombuffer(read_at(path, 0, 8), "<u4").tolist()
    return rows, dim


def read_xbin(spark: SparkSession, path: str, first: int | None = None, exact: bool = True) -> DataFrame:
    """vec_id, embedding (float) of an fbin, u8bin or i8bin file; ``first`` takes a prefix of the rows,
    ``exact`` asks for a file of exactly the header's size."""
    name = path.rsplit(".", 1)[-1]
    if name not in XBIN_DTYPES:
        raise ValueError(f"not an xbin file: {path}")
    kind = np.dtype(XBIN_DTYPES[name])
    rows, dim = xbin_header(path)
    size = file_size(path)
    if size < 8 + rows * dim * kind.itemsize or (exact and size != 8 + rows * dim * kind.itemsize):
        raise ValueError(f"{path} has {size} bytes, its header says {8 + rows * dim * kind.itemsize}")
    rows = rows if first is None else min(rows, first)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(read_at(path, 8 + start * dim * kind.itemsize, n * dim * kind.itemsize), kind)
                yield _vector_batch(start, raw.reshape(n, dim).astype("f4"), pa.float32())

    return _ranges(spark, rows, dim * kind.itemsize).mapInArrow(read, "vec_id bigint, embedding array<float>")


def read_truth(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """query_id, nn_rank (from 1), base_id, distance of a ground-truth file, the first ``k`` of each query."""
    queries, width = xbin_header(path)
    if file_size(path) != 8 + queries * width * 8:
        raise ValueError(f"{path} does not hold {queries} x {width} ids and distances")
    kept = min(k or width, width)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(read_at(path, 8 + start * width * 4, n * width * 4), "<u4").reshape(n, width)[:, :kept]
                far = np.frombuffer(read_at(path, 8 + (queries + start) * width * 4, n * width * 4), "<f4").reshape(n, width)[:, :kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(start, start + n), kept)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)),
                        pa.array(ids.ravel().astype("i8")),
                        pa.array(far.ravel().astype("f8")),
                    ],
                    ["query_id", "nn_rank", "base_id", "distance"],
                )

    return _ranges(spark, queries, width * 8).mapInArrow(read, "query_id bigint, nn_rank int, base_id bigint, distance double")


def _part_writer(folder: str, suffix: str, encode):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = _open(folder)
        store.create_dir(inner, recursive=True)
        out, first, rows, name = None, None, 0, f"part-{uuid.uuid4().hex}.{suffix}"
        for batch in batches:
            if batch.num_rows:
                out = out or store.open_output_stream(f"{inner}/{name}")
                first = batch.column(0)[0].as_py() if first is None else first
                out.write(encode(batch))
                rows += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([rows], pa.int64())], ["name", "first", "rows"])

    return write


def _vecs_bytes(batch: pa.RecordBatch, dtype: str) -> bytes:
    values = np.asarray(batch.column(1).flatten()).astype(dtype).reshape(batch.num_rows, -1)
    head = np.full((len(values), 1), values.shape[1], "<i4")
    return np.concatenate([head, values.view("<i4")], 1).tobytes()


def write_vecs(df: DataFrame, folder: str, kind: str = "fvecs", partitions: int = 8) -> list[dict]:
    """Write (vec_id, embedding) in id order as vecs parts (joined in the returned order they are one file).
    Returns name, first id and rows of each part; an empty table is an error."""
    dtype = VEC_DTYPES[kind]
    ordered = df.select("vec_id", "embedding").repartitionByRange(partitions, "vec_id").sortWithinPartitions("vec_id")
    parts = ordered.mapInArrow(_part_writer(folder, kind, lambda b: _vecs_bytes(b, dtype)), "name string, first bigint, rows bigint").collect()
    if not parts:
        raise ValueError("refusing to write an empty vector file")
    return [p.asDict() for p in sorted(parts, key=lambda p: p["first"])]


def write_scalars(df: DataFrame, key: str, path: str, dtype: str = "uint64") -> int:
    """Write sorted keys as one count-prefixed file (streamed through the driver, range by range)."""
    store, inner = _open(path)
    n = df.count()
    with store.open_output_stream(inner) as out:
        out.write(np.array([n], "<u8").tobytes())
        block: list = []
        for row in df.select(key).orderBy(key).toLocalIterator():
            block.append(row[0])
            if len(block) == 1 << 16:
                out.write(np.array(block, KEY_DTYPES[dtype]).tobytes())
                block = []
        out.write(np.array(block, KEY_DTYPES[dtype]).tobytes())
    return n


def convert_xbin(spark: SparkSession, path: str, out: str, first: int | None = None) -> DataFrame:
    """xbin to Parquet (vec_id, float embedding), the engine's own format."""
    read_xbin(spark, path, first, exact=first is None).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def vector_faults(df: DataFrame, dim: int) -> DataFrame:
    """rows, wrong_dim, missing_ids, infinite: what a converted vector table must have none of."""
    def count(c):
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")

    bad = F.exists("embedding", lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count(F.size("embedding") != dim).alias("wrong_dim"),
        (F.coalesce(F.max("vec_id") + 1, F.lit(0)) - F.count_distinct("vec_id")).alias("missing_ids"),
        count(bad).alias("infinite"),
    )
