"""WARC archives, written from and read into a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import written

#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a header's line that the reader keeps; it needs no longer ones, and passes over the rest of a line.
LINE_KEPT = 1 << 16
READ_BYTES = 1 << 16

CHUNKS = "archive string, record long, page_id long, record_type string, refers_to long, chunk int, payload_bytes long, payload_digest string, last boolean, intact boolean, data binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_header(page_id: int | None, url: str | None, date: str, sha1: bytes, n_bytes: int, refers_to: int | None) -> bytes:
    """The WARC header and the HTTP header that stand before the payload; a revisit has no payload after them."""
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else n_bytes))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def _write(batches: Iterator[pa.RecordBatch], uri: str, date: str, archive_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, sha1, n_bytes, refers_to, chunk, chunks, data), a record's chunks in order.

    Each record is a gzip member of its own. An archive gets its name when it's complete, so a task that
    runs again replaces what an earlier attempt has left.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    out, names, records, size, pack, seen = None, [], [], 0, None, None

    def close() -> None:
        out.close()
        fs.move(f"{root}/.{names[-1]}.{attempt}", f"{root}/{names[-1]}")

    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] == 0:
                if out is not None and size >= archive_bytes:
                    close()
                    out = None
                if out is None:
                    names.append(f"part-{part:05d}-{len(names):04d}.warc.gz")
                    records.append(0)
                    size, out = 0, fs.open_output_stream(f"{root}/.{names[-1]}.{attempt}", compression=None)
                pack, seen = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                parts = [pack.compress(record_header(row["page_id"], row["url"], date, row["sha1"], row["n_bytes"], row["refers_to"]))]
                records[-1] += 1
            else:
                parts = []
            if row["refers_to"] is None:
                seen.update(row["data"])
                parts.append(pack.compress(row["data"]))
            if row["chunk"] + 1 == row["chunks"]:
                if row["refers_to"] is None and seen.digest() != row["sha1"]:
                    raise ValueError(f"page {row['page_id']}: the chunks don't have the payload's digest")
                parts.append(pack.compress(END) + pack.flush())
            for x in parts:
                size += out.write(x)
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{n}" for n in names], pa.string()), pa.array(records, pa.int64())], ["archive", "records"])


def write_archives(pages: DataFrame, uri: str, chunk_bytes: int = 1 << 20, archive_bytes: int = 1 << 30, date: str = "2000-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC archives below ``uri``; returns (archive, records), which is written already.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads, the empty one too, that with
    the largest id is a response and the others revisit it. Rows that repeat with the largest id are all
    responses; a null id is the smallest. ``uri`` is anything that ``pyarrow.fs`` opens and all executors share.
    Payloads beyond ``chunk_bytes`` pass as several rows, so the writer holds one chunk at a time; a url of any length
    stands whole in its header. Extra columns play no part; an empty table gives no archive.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("body")), "n_bytes": F.octet_length("body").cast("long")})
    first = written(rows.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeats")
    rows = rows.join(first, ["sha1", "n_bytes"], "left")
    rows = rows.withColumn("refers_to", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    chunks = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))).otherwise(1).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring("body", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = rows.select("page_id", "url", "sha1", "n_bytes", "refers_to", "chunk", "chunks", data.alias("data"))
    return written(rows.mapInArrow(lambda it: _write(it, uri, date, archive_bytes, level), "archive string, records long"), "warc-archives")


def _inflated(f: BinaryIO) -> Iterator[bytes]:
    """The bytes of a file of gzip members, in bounded parts."""
    member, raw = zlib.decompressobj(31), b""
    while raw or (raw := f.read(READ_BYTES)):
        if member.eof:
            member = zlib.decompressobj(31)
        yield member.decompress(raw, READ_BYTES * 4)
        raw = member.unused_data if member.eof else member.unconsumed_tail
    if not member.eof:
        raise ValueError("the archive ends within a record")


class _Reader:
    """Takes bytes from parts, up to a mark or a number at a time."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buffer = parts, bytearray()

    def fill(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.buffer += part
        return True

    def line(self) -> tuple[bytes, int] | None:
        """The next line, at most ``LINE_KEPT`` bytes of it, and its length with its end; None at the end of the archive."""
        kept, gone = b"", 0
        while (at := self.buffer.find(b"\r\n")) < 0:
            if len(self.buffer) > LINE_KEPT:
                kept = kept or bytes(self.buffer[:LINE_KEPT])
                gone += len(self.buffer) - 1
                del self.buffer[:-1]  # the last byte may be half of the line's end
            if not self.fill():
                if self.buffer or gone:
                    raise ValueError("the archive ends within a header")
                return None
        line, size = kept or bytes(self.buffer[: min(at, LINE_KEPT)]), gone + at + 2
        del self.buffer[: at + 2]
        return line, size

    def header(self) -> tuple[dict[str, str], int] | None:
        """A header's fields by their lower-case names, and its length with the empty line; None at the end of the archive."""
        fields: dict[str, str] = {}
        size = lines = 0
        while (found := self.line()) is not None:
            line, n = found
            size += n
            if line and lines:
                name, _, value = line.decode(errors="replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            elif not line and lines:
                return fields, size
            lines += bool(line)
        if lines:
            raise ValueError("the archive ends within a header")
        return None

    def take(self, most: int) -> bytes:
        """At least a byte, at most so many."""
        while not self.buffer:
            if not self.fill():
                raise ValueError("the archive ends within a payload")
        found = bytes(self.buffer[:most])
        del self.buffer[:most]
        return found


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_records(f: BinaryIO, archive: str, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Rows of CHUNKS for each record of an open archive. The digest and number of bytes are those so far; on a
    revisit's only row, those that the record states."""
    r, n = _Reader(_inflated(f)), 0
    while (header := r.header()) is not None:
        warc, inner = header[0], r.header()
        if inner is None:
            raise ValueError("the archive ends within a header")
        http, left = inner[0], int(warc["content-length"]) - inner[1]
        kind, stated = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
        row = (archive, n, _page(warc["warc-record-id"]), kind, _page(warc.get("warc-refers-to")))
        if kind == "revisit":
            yield *row, 0, int(http["content-length"]), stated, True, left == 0, b"" if with_data else None
        else:
            seen, done, chunk = hashlib.sha1(), 0, 0
            while True:
                some = []
                while left and sum(map(len, some)) < chunk_bytes:
                    some.append(r.take(min(left, chunk_bytes - sum(map(len, some)))))
                    seen.update(some[-1])
                    left -= len(some[-1])
                    done += len(some[-1])
                digest = base32(seen.digest())
                yield *row, chunk, done, digest, not left, None if left else digest == stated and done == int(http["content-length"]), b"".join(some) if with_data else None
                chunk += 1
                if not left:
                    break
        end = b""
        while len(end) < len(END):
            end += r.take(len(END) - len(end))
        if end != END:
            raise ValueError(f"record {n} doesn't end where it should")
        n += 1


def _read(batches: Iterator[pa.RecordBatch], chunk_bytes: int, with_data: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            rows, size = [], 0
            with fs.open_input_stream(path, compression=None) as f:
                for row in read_records(f, uri, chunk_bytes, with_data):
                    rows.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_chunks(archives: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The chunked record table of ``archives(archive)``: a row for each record and chunk, never a whole payload.

    Each row carries the payload's number of bytes and SHA-1 (bare base32) up to and with its chunk; the last
    one also whether they are those that the record states. with_data=False leaves the bytes out.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in CHUNKS.split(", "))])
    # by number: sizes of names say nothing about sizes of archives, so nothing may be coalesced by them
    spread = archives.select("archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(lambda it: _read(it, chunk_bytes, with_data, schema), CHUNKS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of the archives written below ``uri``."""
    chunks = read_chunks(write_archives(pages, uri), with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
