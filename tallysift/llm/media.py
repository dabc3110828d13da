"""Media columns: archives of media members, read as a table by a Spark data source.

An archive is a plain sequence of members; beside it stands an index of fixed-width entries
(offset, length, key), in offset order. The data source ``media_archives`` lists the folder, cuts
each archive into byte ranges and gives each range to a task; the task finds by bisection in the index
the members that start in its range, so planning handles archives, never members. A task streams members
in Arrow batches of bounded bytes and reads each again, by its offset alone, when a read fails or
its checksum is wrong.

A member is an 8-bit greyscale PNG of width 64 whose samples are the payload: lossless, and
smaller than the text.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallysift.llm.store import listed, opened, written
from tallysift.session import scratch, settle, table

#: Samples a row of the image.
WIDTH = 64
#: Stored bytes after which a task starts the next archive.
ARCHIVE_BYTES = 128 << 20
#: Bytes of an archive a read task gets.
RANGE_BYTES = 16 << 20
#: Media bytes of an Arrow batch; a longer member is a batch of its own.
BATCH_BYTES = 4 << 20
#: Reads of a member before the task fails, and the wait before the second.
READS, WAIT_S = 4, 0.1
#: Index entry: offset, length, key, whether there is a key, bytes of the text, CRC-32 of the member.
ENTRY = "<QQqBQI"
ENTRY_BYTES = struct.calcsize(ENTRY)
PNG = b"\x89PNG\r\n\x1a\n"


class BadMember(ValueError):
    """A member that is no image of the written form."""


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``WIDTH``."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def encode(samples: bytes) -> bytes:
    """PNG of 8-bit grey samples, ``WIDTH`` a row. Equal samples give equal bytes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """Samples of an image that ``encode`` wrote; ``BadMember`` for anything else."""
    if media[:8] != PNG:
        raise BadMember("no PNG signature")
    at, head, data = 8, None, []
    while at + 12 <= len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise BadMember(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[0] != WIDTH or head[2:] != (8, 0, 0, 0, 0):
        raise BadMember("not 8-bit grey of the written width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], WIDTH + 1)
    if lines[:, 0].any():
        raise BadMember("a filtered row")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 64-bit mean hash of 8 x 8 blocks of the image."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    edges = np.linspace(0, len(image), 9).astype(int)
    columns = image.reshape(len(image), 8, 8).sum(axis=2, dtype=np.int64)
    sums = np.zeros((9, 8), np.int64)
    np.cumsum(columns, axis=0, out=columns)
    sums[1:] = columns[np.maximum(edges[1:] - 1, 0)]
    sums[edges == 0] = 0
    heights = np.maximum(np.diff(edges), 1)[:, None]
    blocks = np.diff(sums, axis=0) / (heights * 8)
    bits = (blocks > blocks.mean()).ravel()
    value = image.astype(np.float64)
    return f"mean={value.mean():.4f} dev={value.std():.4f} hash={int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def write_media(items: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows of (key, text) as members; returns (archive, members). Null texts are empty."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in zip(b.column(0), b.column(1), strict=True))
        row = next(rows, None)
        while row is not None:
            uri, offset, n = f"{folder}/part-{part:06d}-{roll:04d}.media", 0, 0
            with written(uri + ".idx") as index, written(uri) as out:
                while row is not None and offset < archive_bytes:
                    key, raw = row[0].as_py(), (row[1].as_py() or "").encode()
                    media = encode(padded(raw))
                    out.write(media)
                    index.write(struct.pack(ENTRY, offset, len(media), key or 0, key is not None, len(raw), zlib.crc32(media)))
                    offset, n, row = offset + len(media), n + 1, next(rows, None)
            roll += 1
            yield pa.RecordBatch.from_pydict({"archive": [uri], "members": pa.array([n], pa.int64())})

    return items.select("key", "text").mapInArrow(write, "archive string, members long")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "key long, n_bytes long, media binary, archive string, offset long"

    def reader(self, schema):
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        step = self.range_bytes
        return [
            Range(uri, start, min(start + step, size))
            for uri, size in listed(self.folder, ".media")
            for start in range(0, size, step)
        ] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        names = ["key", "n_bytes", "media", "archive", "offset"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        rows, held = [], 0
        for offset, length, key, keyed, n, crc in entries(part):
            media = member(part.archive, offset, length, crc)
            rows.append((key if keyed else None, n, media, part.archive, offset))
            held += length
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def entries(part: Range) -> Iterator[tuple]:
    """Index entries of the members that start in the range, found by bisection."""
    with opened(part.archive + ".idx") as index:
        low, high = 0, index.size() // ENTRY_BYTES
        while low < high:
            mid = (low + high) // 2
            index.seek(mid * ENTRY_BYTES)
            if struct.unpack(ENTRY, index.read(ENTRY_BYTES))[0] < part.start:
                low = mid + 1
            else:
                high = mid
        index.seek(low * ENTRY_BYTES)
        while block := index.read(ENTRY_BYTES * 1024):
            for entry in struct.iter_unpack(ENTRY, block):
                if entry[0] >= part.end:
                    return
                yield entry


_open: dict[str, object] = {}


def member(archive: str, offset: int, length: int, crc: int, reads: int = READS) -> bytes:
    """One member, by offset. A failed read or a wrong checksum is tried again on a new stream."""
    for attempt in range(reads):
        try:
            stream = _open.get(archive)
            if stream is None:
                for old in _open.values():
                    old.close()
                _open.clear()
                stream = _open[archive] = opened(archive)
            stream.seek(offset)
            media = stream.read(length)
            if len(media) == length and zlib.crc32(media) == crc:
                return media
            problem = BadMember("short read" if len(media) < length else "checksum")
        except OSError as failed:
            problem = failed
        _open.pop(archive, None)
        if attempt + 1 < reads:
            time.sleep(WAIT_S * 2**attempt)
    raise BadMember(f"{archive} at {offset}: {problem}")


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archives").load(folder)


def describe(media: DataFrame) -> DataFrame:
    """Columns of features and digests of rows of (key, n_bytes, media), from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, stored in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                samples = decode(stored)
                rows.append(
                    {
                        "key": key,
                        "n_bytes": n,
                        "payload_bytes": len(samples),
                        "payload_sha256": hashlib.sha256(samples).hexdigest(),
                        "tail_crc32": zlib.crc32(samples[-WIDTH:]),
                        "media_bytes": len(stored),
                        "media_sha256": hashlib.sha256(stored).hexdigest(),
                        "feature": feature(samples),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())]
        + [("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )
    ddl = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("key", "n_bytes", "media").mapInArrow(run, ddl)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    settle(write_media(items, folder), "media-written")
    return describe(read_media(spark, folder)).withColumnRenamed("key", "doc_id")
