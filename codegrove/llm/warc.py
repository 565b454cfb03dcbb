"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The writer puts archives of bounded size into a folder of the shared store. The reader opens an archive as a stream and goes
through it once: each gzip member is inflated in steps, its header block is parsed, the block is framed by
Content-Length while it is inflated, and its digest, made as it comes, is held against WARC-Payload-Digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, small, store

#: An archive ends after the record with which it reaches this size.
ARCHIVE_BYTES = 8 << 20
#: Bytes read at once, and bytes inflated at once.
STEP = 64 << 10
#: Tasks that read archives at most.
READ_TASKS = 10_000
#: Payloads of at least this size are written once and revisited.
REVISIT_FROM = 0
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format, or a payload that is not the one its digest names."""


@dataclass
class Record:
    version: str
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode(kind: str, uri: str, key: int | None, payload: bytes, full: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as one gzip member. A revisit has no payload; its digest and Full-Length are those of the full one."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(full)}", f"X-Full-Length: {len(full)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


class _Source:
    """Compressed bytes of a stream, STEP at a time; what one member leaves over belongs to the next."""

    def __init__(self, stream: BinaryIO, step: int):
        self.stream, self.step, self.left = stream, step, b""

    def take(self) -> bytes:
        out, self.left = self.left or self.stream.read(self.step), b""
        return out


def _chunks(source: _Source) -> Iterator[bytes]:
    """Inflated bytes of the next gzip member, no more than a step at a time."""
    z, full = zlib.decompressobj(31), False
    while not z.eof:
        data = z.unconsumed_tail
        if not data and not full:
            data = source.take()
            if not data:
                raise WarcError("the last gzip member is cut off")
        try:
            out = z.decompress(data, source.step)
        except zlib.error as e:
            raise WarcError(f"broken gzip member: {e}") from e
        full = len(out) == source.step
        if out:
            yield out
    source.left = z.unused_data + source.left


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    if not head.startswith(b"WARC/"):
        raise WarcError("no record header")
    lines = head.decode("utf-8").split("\r\n")
    headers: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no colon in header line {line!r}")
        last = name.strip().lower()
        headers[last] = value.strip()
    return lines[0], headers


def _frame(chunks: Iterator[bytes], check: bool) -> Record:
    """The record of one member: its header, as many bytes as Content-Length says, digested as they come, and the end."""
    buffer, end = bytearray(), -1
    while end < 0:
        piece = next(chunks, b"")
        if not piece:
            raise WarcError("no record header")
        seen = max(0, len(buffer) - 3)
        buffer += piece
        end = buffer.find(b"\r\n\r\n", seen)
    version, headers = _headers(bytes(buffer[:end]))
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise WarcError("no Content-Length")
    n, sha, payload, rest = int(length), hashlib.sha1(), bytearray(), bytes(buffer[end + 4 :])
    while True:
        part = rest[: n - len(payload)]
        sha.update(part)
        payload += part
        rest = rest[len(part) :]
        if len(payload) == n:
            break
        rest = next(chunks, b"")
        if not rest:
            raise WarcError("the block does not have its Content-Length")
    for piece in chunks:
        rest += piece
        if len(rest) > 4:
            break
    if rest != b"\r\n\r\n":
        raise WarcError("the block does not have its Content-Length")
    record = Record(version, headers, bytes(payload))
    said = headers.get("warc-payload-digest", "")
    if check and said and record.type != "revisit":
        if said.removeprefix("sha1:") != base64.b32encode(sha.digest()).decode():
            raise WarcError(f"payload of {headers.get('warc-record-id')} does not match its digest")
    return record


def parse(member: bytes, check: bool = True) -> Record:
    """The record of one inflated member."""
    return _frame(iter([member]), check)


def read_stream(stream: BinaryIO, check: bool = True, step: int = STEP) -> Iterator[Record]:
    """Records of an archive in order, from a stream that is read once; one record is held at a time."""
    source = _Source(stream, step)
    while first := source.take():
        source.left = first
        yield _frame(_chunks(source), check)


def read_archive(archive: bytes, check: bool = True, step: int = STEP) -> Iterator[Record]:
    """Records of an archive held in memory; an empty archive has none."""
    return read_stream(io.BytesIO(archive), check, step)


def _number(said: str | None) -> int | None:
    tail = (said or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def _clean(uri: str | None) -> str:
    return " ".join((uri or "").split())


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        buffer: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                for x in buffer:
                    f.write(x)
            done.append((name, len(buffer), size))
            buffer.clear()
            size = 0

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            html = cols["html"].cast(pa.binary()).to_pylist()
            for key, url, body, first in zip(cols["id"].to_pylist(), cols["url"].to_pylist(), html, cols["first"].to_pylist()):
                body = body or b""
                old = first is not None and first != key
                buffer.append(encode("revisit" if old else "response", _clean(url), key, b"" if old else body, body, first if old else None))
                size += len(buffer[-1])
                if size >= archive_bytes:
                    flush()
        if buffer:
            flush()
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["name", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; the stored list of archives (name, records, bytes) is returned.

    Of equal payloads of at least revisit_from bytes the one with the largest id is the response, the
    others revisit it (rows that repeat that id are each a response). A null html is an empty payload,
    a null url an empty one, a null id an empty record id that is read back as null. Archives of
    failed attempts are not in the list. An empty table has no archives.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    keyed = rows.select("id", F.sha1(F.col("html").cast("binary")).alias("key"), F.octet_length("html").alias("size"))
    again = keyed.filter(F.col("size") >= revisit_from).groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = store(again.select("key", "first"), "repeated")
    rows = rows.withColumn("key", F.sha1(F.col("html").cast("binary")))
    n = again.count()
    # archives follow the input's partitioning unless the list of repeated payloads is too long to broadcast
    found = rows.join(small(again, n), "key", "left").select("id", "url", "html", "first")
    jfs = folder if "://" in folder else f"file://{folder}"
    fs, base = pafs.FileSystem.from_uri(jfs)
    fs.create_dir(base, recursive=True)
    return store(arrow_map(found, _write(jfs, archive_bytes), "name string, records long, bytes long"), "archives")


#: Payload bytes and records a batch of the reader holds at most, but for one record.
BATCH_BYTES, BATCH_RECORDS = 4 << 20, 256


def _read(folder: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in read_stream(stream, check):
                        rows.append((_number(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), int(r.headers.get("x-full-length", len(r.payload))), r.headers.get("warc-payload-digest", "").removeprefix("sha1:"), r.type, _number(r.headers.get("warc-refers-to")), r.payload))
                        size += len(r.payload)
                        if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_archives(archives: DataFrame, folder: str, check: bool = True) -> DataFrame:
    """Records of the listed archives: id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each archive is streamed by one task, so its size is bounded by no row. Files of the folder that the list does not
    name (left by failed attempts) are not read.
    """
    jfs = folder if "://" in folder else f"file://{folder}"
    names = archives.select("name").repartition(max(1, min(archives.count(), READ_TASKS)), "name")
    return arrow_map(names, _read(jfs, check), "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose response is not among the records, or differs from them in digest or length."""
    known = records.filter("record_type = 'response'").select(F.col("id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.filter("record_type = 'revisit'").drop("payload").join(known, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archive_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"
