"""Media columns: content-addressed payloads in tar shards.

A payload is a run of 8-bit samples; it is stored losslessly as a greyscale PNG of
width 192 (``PngCodec``) inside a tar shard, under its SHA-256. Rows carry digest,
shard, offset and length, never the payload. Each task writes shards of its own with
unbuffered appends and stores a payload that it has already stored once more only as
a reference, so a text that a third of all rows share costs one member a task. Digests
(not payloads) are then shuffled: of the members of one digest, from whatever task or
earlier call, the first by shard name and offset is the one that all rows refer to, and
the others are waste that ``compacted`` leaves out. Files of failed attempts are never
referred to: the index is written only by tasks that ended.

Metadata columns (width, height, bit depth, colour type) come from range reads of the
33 header bytes; payloads are read only by those who ask for them.

Shards live in the shared folder and are reached through ``pyarrow.fs``, so any store
that it knows (local or network mounts, HDFS, S3, GCS) can hold them.

Defined results: a null text is stored as the empty one (192 blanks); equal payloads
have equal digests, media bytes and features; empty table: no shard, empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.llm._batches import text_runs
from ranklore.plans.lookup import lookup_by_key
from ranklore.plans.workspace import child_paths, drop_path, fresh_path, staged

WIDTH, SHARD_BYTES = 192, 256 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_TAR_BLOCK = 512
INDEX_SCHEMA = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
_CACHED_DIGESTS = 200_000


class PngCodec:
    """8-bit greyscale PNG, one row of samples a line, filter type 0."""

    @staticmethod
    def _chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    @classmethod
    def encode(cls, samples: bytes, width: int = WIDTH) -> bytes:
        rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
        lines = np.zeros((len(rows), width + 1), np.uint8)
        lines[:, 1:] = rows
        head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
        body = zlib.compress(lines.tobytes(), 3)
        return _SIGNATURE + cls._chunk(b"IHDR", head) + cls._chunk(b"IDAT", body) + cls._chunk(b"IEND", b"")

    @staticmethod
    def header(data: bytes) -> tuple[int, int, int, int]:
        """(width, height, bit depth, colour type) from the first ``HEADER_BYTES`` bytes."""
        if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
            raise ValueError("not a PNG")
        return struct.unpack(">IIBB", data[16:26])

    @classmethod
    def decode(cls, data: bytes) -> bytes:
        width, height, depth, colour = cls.header(data)
        if (depth, colour) != (8, 0) or data[28]:
            raise ValueError("not a plain 8-bit greyscale PNG")
        at, packed = 8, []
        while at < len(data):
            size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
                raise ValueError("damaged PNG chunk")
            if kind == b"IDAT":
                packed.append(body)
            at += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
        if lines[:, 0].any():
            raise ValueError("filtered PNG lines are not written here")
        return lines[:, 1:].tobytes()


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with blanks up to the next positive multiple of ``width``."""
    return data.ljust(max(width, -(-len(data) // width) * width), b" ")


class TarShards:
    """Appends members to tar files of bounded size below a folder."""

    def __init__(self, folder: str, limit: int = SHARD_BYTES):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.size, self.name = limit, None, 0, ""

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        """Store one member; returns its shard and the offset of its data."""
        if self.out is None or self.size + len(data) > self.limit:
            self.close()
            self.fs.create_dir(self.folder, recursive=True)
            self.name, self.size = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.size + len(head)
        member = head + data + b"\0" * (-len(data) % _TAR_BLOCK)
        self.out.write(member)
        self.size += len(member)
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 2 * _TAR_BLOCK)
            self.out.close()
            self.out = None


class TarReader:
    """Range reads of members; keeps the shard that was read last open."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.folder}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = None, None


def _store_batches(folder: str, limit: int):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = TarShards(folder, limit), {}
        for batch in batches:
            rows = []
            for _, _, texts in text_runs(batch):
                for text in texts:
                    raw = text.encode("utf-8")
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if len(known) >= _CACHED_DIGESTS:
                            known.clear()
                        media = PngCodec.encode(payload)
                        known[digest] = (*shards.add(digest, media), len(media))
                    rows.append((len(raw), digest, *known[digest]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        shards.close()

    return store


def _move_batches(source: str, target: str, limit: int):
    """A batch function that copies members into new shards and returns their new places."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shards = TarReader(source), TarShards(target, limit)
        for batch in batches:
            digests, lengths = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            places = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), lengths, strict=True)
            new = [shards.add(digest, reader.read(*place)) for digest, place in zip(digests, places, strict=True)]
            names, offsets = [n for n, _ in new], [o for _, o in new]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), batch.column(3)], ["digest", "shard", "offset", "length"]
            )
        shards.close()
        reader.close()

    return move


def _scan(folder: str, names: list[str], kinds: list, one):
    """A batch function that appends to each row what ``one(reader, shard, offset, length)`` returns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, found = TarReader(folder), None, None
        for batch in batches:
            places = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True)
            rows = []
            for place in places:
                if place != last:
                    last, found = place, one(reader, *place)
                rows.append(found)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*batch.schema.names, *names]
            )
        reader.close()

    return scan


def _header(reader: TarReader, shard: str, offset: int, length: int) -> tuple:
    return PngCodec.header(reader.read(shard, offset, min(HEADER_BYTES, length)))


def _features(reader: TarReader, shard: str, offset: int, length: int) -> tuple:
    media = reader.read(shard, offset, length)
    payload = PngCodec.decode(media)
    samples = np.frombuffer(payload, np.uint8)
    total, squares = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    n = len(samples)
    mean = total / n
    spread = max(squares / n - mean * mean, 0.0) ** 0.5
    bands = np.bincount(samples >> 5, minlength=8).tolist()
    feature = f"mean={mean:.4f};sd={spread:.4f};min={samples.min()};max={samples.max()};bands={','.join(map(str, bands))}"
    return (
        n,
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-16:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        feature,
    )


class MediaStore:
    """Tar shards in ``folder`` and the index table of the rows that refer to them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, shard_bytes: int = SHARD_BYTES):
        self.spark, self.folder, self.shard_bytes = spark, folder or fresh_path(spark, "media"), shard_bytes

    def store(self, docs: DataFrame) -> DataFrame:
        """Store the texts of ``docs`` and return the index: one row per row of ``docs``."""
        slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        made = f"{self.folder}/made-{uuid.uuid4().hex}"
        slim.mapInArrow(_store_batches(f"{self.folder}/shards", self.shard_bytes), INDEX_SCHEMA).write.parquet(made)
        rows = self.spark.read.schema(INDEX_SCHEMA).parquet(made)
        index = f"{self.folder}/index-{uuid.uuid4().hex}"
        self._referred(rows).write.parquet(index)
        drop_path(self.spark, made)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(index)

    def members(self) -> DataFrame:
        """digest, shard, offset, length of every payload that an index of this store refers to."""
        return self._indexes().select("digest", "shard", "offset", "length").distinct()

    def _indexes(self) -> DataFrame:
        paths = child_paths(self.spark, self.folder, "index-*")
        if not paths:
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(*paths)

    def _referred(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the one place of their digest, ordered by place so that range reads follow each other."""
        place = F.struct("shard", "offset", "length")
        own = rows.groupBy("digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
        earlier = self.members().select("digest", place.alias("known"))
        one = staged(
            own.join(earlier.hint("merge"), "digest", "left").select("digest", F.coalesce("known", "place").alias("place"), "n"), "media-places"
        )
        found = lookup_by_key(rows.select("doc_id", "n_bytes", "digest"), one, "digest", "n", rows.count())
        placed = found.select("doc_id", "n_bytes", "digest", "place.*")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["shard", "offset", "doc_id"]  # the id splits a payload that very many rows share
        return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compacted(self, folder: str) -> MediaStore:
        """A new store in ``folder`` with the same index rows and each payload once."""
        copy = MediaStore(self.spark, folder, self.shard_bytes)
        schema = "digest string, shard string, offset bigint, length bigint"
        moved = staged(
            self.members().sort("shard", "offset").mapInArrow(_move_batches(f"{self.folder}/shards", f"{folder}/shards", self.shard_bytes), schema), "media-moved"
        )
        rows = self._indexes()
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        one = staged(moved.join(sizes.hint("merge"), "digest").select("digest", "shard", "offset", "length", "n"), "media-places")
        found = lookup_by_key(rows.select("doc_id", "n_bytes", "digest"), one, "digest", "n", rows.count())
        found.select(*rows.columns).write.parquet(f"{folder}/index-{uuid.uuid4().hex}")
        return copy

    def with_metadata(self, index: DataFrame) -> DataFrame:
        """Add width, height, bit_depth, colour_type from the members' headers alone."""
        names, kinds = ["width", "height", "bit_depth", "colour_type"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in index.schema]
        out = ", ".join([*fields, "width bigint, height bigint, bit_depth int, colour_type int"])
        return index.mapInArrow(_scan(f"{self.folder}/shards", names, kinds, _header), out)

    def with_features(self, index: DataFrame) -> DataFrame:
        """Add payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, read back whole."""
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in index.schema]
        out = (
            "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
        )
        return index.mapInArrow(_scan(f"{self.folder}/shards", names, kinds, _features), ", ".join([*fields, out]))


def read_member(data: bytes) -> list[tuple[str, bytes]]:
    """Names and contents of a whole shard, by the standard reader (for tests and tools)."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return [(m.name, tar.extractfile(m).read()) for m in tar.getmembers()]


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = MediaStore(spark)
    index = store.store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return store.with_features(store.with_metadata(index)).drop("digest")
