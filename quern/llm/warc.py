"""Deterministic sharded WARC archives: written by Spark tasks, committed by a manifest, read back in parallel.

Records are range-sorted by page id; each task writes its range as files that roll over at a compressed size, one gzip member for
each record, with headers and digests made anew. A file is written under a temporary name and moved to its own name when it is
whole; the manifest, committed by Spark as one table, names the files that count. A task that runs again after a lost executor
writes the same bytes under the same names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import slices

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, path string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, uncompressed. A revisit holds the HTTP head alone, which tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    """A gzip member without a time in its head, so that equal records give equal bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Files:
    """The archive files of one task."""

    def __init__(self, folder: str, shard: int, attempt: int, roll: int) -> None:
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll, self.part, self.out, self.done = shard, attempt, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"records-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary-{self.attempt}-{self.name}"
            self.out, self.records, self.size, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sum.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        path = f"{self.base}/{self.name}"
        if self.fs.get_file_info(path).type != fs.FileType.NotFound:  # of another attempt: whole, and the same bytes
            self.fs.delete_file(self.temporary)
        else:
            self.fs.move(self.temporary, path)
        self.done.append((self.shard, self.part, self.name, self.records, self.size, self.sum.hexdigest()))
        self.out, self.part = None, self.part + 1


def write(pages: DataFrame, folder: str, shard_bytes: int = 16 << 20, roll_bytes: int = 256 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive pages (page_id, url, html) under folder, a URI that all executors can write to; returns the manifest.

    Null html is an empty payload, a null url leaves its header out. Of equal payloads of at least 100 bytes the least page_id is
    stored (of rows that repeat it the first; null ids come last) and the others refer to it; smaller payloads are all stored.
    Extra columns are ignored. Without rows the manifest is empty.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    total = rows.agg(F.sum("size")).first()[0] or 0
    long = rows.where(F.col("size") >= LEAST_REVISIT).select("page_id", "digest")
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = long.join(groups, "digest").distinct()  # goes ahead of the pages it is about, so that texts are shuffled once
    none = F.lit(None).cast("string")
    pages_in = rows.select(F.lit(1).alias("is_page"), "page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first"))
    both = pages_in.union(shared.select(F.lit(0), "page_id", none, none, "digest", "first"))
    order = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    dealt = both.repartitionByRange(max(1, -(-total // shard_bytes)), *order).sortWithinPartitions(*order, "is_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, known, first, last = Files(folder, task.partitionId(), task.taskAttemptId(), roll_bytes), None, None, None
        for batch in slices(batches, 64):
            for x in batch.to_pylist():
                here = (x["page_id"], x["digest"])
                if not x["is_page"]:
                    known, first = here, x["first"]
                    continue
                stored = known != here or x["page_id"] == first and last != here
                if stored:
                    last = here
                files.add(packed(record(x["page_id"], x["url"], x["html"].encode(), x["digest"], first, not stored, date), level))
        files.close()
        if files.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files.done, strict=True), [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["shard", "part", "path", "records", "bytes", "sha256"])

    made, base = fs.FileSystem.from_uri(folder)
    made.create_dir(base, recursive=True)
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """The records of an archive, unpacked one by one; memory holds one record and a buffer."""
    unpack, found, rest = zlib.decompressobj(31), [], b""
    while rest or (rest := stream.read(1 << 20)):
        found.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(found)
            unpack, found = zlib.decompressobj(31), []
        else:
            rest = b""
    if any(found):
        raise ValueError("the archive ends within a record")


def parsed(data: bytes) -> dict:
    """The fields of one record; its digests and lengths are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    stored = fields["WARC-Type"] == "response"
    if stored and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if stored else None,
    }


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest under folder names; a file or record that does not match raises an error."""
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("path", "records")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size, n = [], 0, 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for data in members(stream):
                        held.append(parsed(data))
                        n, size = n + 1, size + len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if n != records:
                    raise ValueError(f"{path} has {n} records, its manifest {records}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    return listed.repartition(max(1, min(listed.count(), 10_000))).mapInArrow(run, RECORDS)
