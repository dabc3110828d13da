"""WARC archives: writing whole-file gzip streams, splitting them into members, reading by offset.

``normalise`` is the operator: it inflates each whole-file gzip stream once, writes every record
as a gzip member of its own and, beside the archive, an index of offsets. The index makes each
record readable, and a failed read repeatable, on its own.

Everything streams: a task holds one record and the buffers of one archive. Archive names come from
the partition number, and files appear under their name only when complete, so a task that is run
again replaces its own files and nothing else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysift.llm.store import opened, written
from tallysift.session import scratch, settle, table

#: Inflated bytes after which a task starts the next archive.
ARCHIVE_BYTES = 128 << 20
#: Payloads shorter than this are never stored as revisits.
REVISIT_BYTES = 1000
GZIP_LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """An archive that is no sequence of WARC records."""


def record_head(page_id: int | None, url: str | None, digest: str, kind: str, refers_to: int | None, length: int) -> bytes:
    """Header block of a record. Control characters in a URL are percent-encoded."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    code = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{code}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {length}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {target}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header block, header fields by lower-case name, content block) of each record of an inflated stream."""
    while first := stream.readline():
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise BadArchive(f"a record starts with {first[:40]!r}")
        head, fields = [first], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise BadArchive("the archive ends within a record's header")
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        head.append(line)
        length = int(fields.get("content-length", "-1"))
        if length < 0:
            raise BadArchive("a record has no Content-Length")
        block = stream.read(length)
        if len(block) < length:
            raise BadArchive("the archive ends within a record")
        yield b"".join(head), fields, block


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def typed(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload, digest, record_type and refers_to to rows of (page_id, url, html).

    Of rows with equal payloads of at least ``least`` bytes the largest page_id is the response.
    Rows without page_id sort below all others; they revisit a row that has one, and where none has
    one all are responses. Rows that repeat the largest page_id are responses too. Only digests
    that occur more than once take part in the join, as a settled table: Spark sees its size and
    sends it to all executors only if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    digest = F.sha1("payload")
    repeated = settle(
        rows.filter(F.octet_length("payload") >= least)
        .groupBy(digest.alias("same"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .filter("n > 1 and last is not null")
        .select("same", "last"),
        "warc-repeated",
    )
    revisits: Column = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return (
        rows.withColumn("digest", digest)
        .join(repeated, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= least), "left")
        .select(
            "page_id",
            "url",
            "digest",
            F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
            F.when(revisits, F.col("last")).alias("refers_to"),
            F.when(~revisits, F.col("payload")).alias("payload"),
        )
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows of ``typed`` as whole-file gzip archives; returns (archive, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for s in range(0, b.num_rows, 64) for r in b.slice(s, 64).to_pylist())
        row = next(rows, None)
        while row is not None:
            uri, n, size = f"{folder}/part-{part:06d}-{roll:04d}.warc.gz", 0, 0
            with written(uri) as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=GZIP_LEVEL, mtime=0) as packed:
                while row is not None and size < archive_bytes:
                    block = row["payload"] or b""
                    head = record_head(row["page_id"], row["url"], row["digest"], row["record_type"], row["refers_to"], len(block))
                    packed.write(head + block + b"\r\n\r\n")
                    n, size, row = n + 1, size + len(head) + len(block), next(rows, None)
            roll += 1
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": pa.array([n], pa.int64())})

    return records.mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of column ``archive`` with a gzip member per record.

    Each stream is inflated once. Beside ``x.warc.gz`` stands ``x.warc.gz.idx``, a JSON line per
    record with id, type, offset and length of its member. Returns (archive, index, records). A
    damaged archive fails its task with the archive's name.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source in (x for b in batches for x in b.column(0).to_pylist()):
            uri, offset, n = f"{folder}/{source.rpartition('/')[2]}", 0, 0
            try:
                with opened(source) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream, written(uri) as out, written(uri + ".idx") as index:
                    for head, fields, block in read_records(stream):
                        member = gzip.compress(head + block + b"\r\n\r\n", GZIP_LEVEL, mtime=0)
                        out.write(member)
                        entry = {"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "offset": offset, "length": len(member)}
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
            except (BadArchive, EOFError, OSError) as bad:
                raise BadArchive(f"{source}: {bad}") from bad
            yield pa.RecordBatch.from_pydict({"archive": [uri], "index": [uri + ".idx"], "records": pa.array([n], pa.int64())})

    return archives.select("archive").mapInArrow(split, "archive string, index string, records long")


def by_archive(archives: DataFrame) -> DataFrame:
    """Rows of a list of archives (a settled table), a partition for each.

    The number of partitions is given, so adaptive execution does not merge these rows of few bytes.
    """
    return archives.repartitionByRange(max(1, archives.count()), "archive")


READ = "page_id long, url string, record_type string, refers_to long, stated_digest string, block_digest string, block_bytes long"


def read_members(archives: DataFrame) -> DataFrame:
    """Reads every record of normalised archives at its offset in the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("block_digest", pa.string()), ("block_bytes", pa.int64())])
        for archive, index in ((a, i) for b in batches for a, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            rows = []
            with opened(archive) as raw, io.BufferedReader(opened(index), 1 << 20) as lines:
                for entry in map(json.loads, lines):
                    raw.seek(entry["offset"])
                    member = gzip.decompress(raw.read(entry["length"]))
                    _, fields, block = next(read_records(io.BytesIO(member)))
                    stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], page_of(fields.get("warc-refers-to")), stated, hashlib.sha1(block).hexdigest(), len(block)))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return archives.select("archive", "index").mapInArrow(read, READ)


def op2_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    whole = settle(write_archives(typed(table(spark, sf_dir, "pages")), f"{folder}/whole"), "warc-whole")
    members = settle(normalise(by_archive(whole), f"{folder}/members"), "warc-members")
    read = settle(read_members(by_archive(members)), "warc-read")
    # a revisit's payload is that of the record it refers to; records may share a page_id, so its stated digest tells them apart
    sources = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("stated_digest").alias("as")).agg(
        F.max(F.struct("block_digest", "block_bytes")).alias("r")
    )
    revisits = read.filter("record_type = 'revisit'").join(sources, (F.col("refers_to") == F.col("to")) & (F.col("stated_digest") == F.col("as")), "left")
    done = read.filter("record_type = 'response'").select(
        "page_id", F.col("block_bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return done.unionByName(
        revisits.select(
            "page_id", F.col("r.block_bytes").alias("payload_bytes"), F.col("r.block_digest").alias("payload_digest"), "record_type", "refers_to"
        )
    )


OP2_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
  select *, max(page_id) over (partition by payload_digest) as last, count(*) over (partition by payload_digest) as n from p
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and n > 1 and last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and n > 1 and last is not null and page_id is distinct from last then last end as refers_to
from g
"""
