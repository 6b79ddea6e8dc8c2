"""WARC archives of pages (operator 3), written and read in chunks."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

CHUNK = 1 << 18
#: A new archive begins once the present one has so many bytes.
ARCHIVE = 1 << 28
#: One row of the manifest, and so one unit of reading, covers about so many bytes of an archive.
SEGMENT = 1 << 23
#: Payloads below this many bytes are never replaced by a reference.
LEAST = 100
#: WARC-Date of every record: a fixed value, so that a retried task writes the same bytes.
DATE = "2025-01-01T00:00:00Z"

MANIFEST = "archive string, start long, size long, records long"
CHUNKS = "page_id long, chunk int, bytes long, digest string, record_type string, refers_to long, declared string"


def _open(uri: str):
    """Filesystem and path of a URI, for the stores that Arrow knows (local, HDFS, S3, GCS)."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _head(page_id: int, url: str | None, kind: str, refers: int | None, digest: str, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:  # a URI in a header: no white space or controls
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


class Writer:
    """Appends records as gzip members to archives in a folder. A record's payload comes in chunks, and only one is held
    in compressed form at a time. rows(): what the manifest gets."""

    def __init__(self, folder: str):
        self.store, self.folder = _open(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.uri, self.out, self.done = folder, None, []

    def _begin(self) -> None:
        self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"  # of this attempt alone: a retried task never appends to it
        self.out, self.at, self.since, self.records = self.store.open_output_stream(self.name, compression=None), 0, 0, 0

    def _segment(self) -> None:
        if self.records:
            self.done.append((f"{self.uri}/{os.path.basename(self.name)}", self.since, self.at - self.since, self.records))
        self.since, self.records = self.at, 0

    def add(self, head: bytes, block: Iterator[bytes]) -> None:
        if self.out is None:
            self._begin()
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(pack.compress(head))
        for part in block:
            self._put(pack.compress(part))
        self._put(pack.compress(b"\r\n\r\n") + pack.flush())
        self.records += 1
        if self.at - self.since >= SEGMENT:
            self._segment()
        if self.at >= ARCHIVE:
            self.close()

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self._segment()
            self.out.close()
            self.out = None

    def rows(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["archive", "start", "size", "records"])


def _chunks(view: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(view), CHUNK):
        yield view[at : at + CHUNK]


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) and return the manifest (archive, start, size,
    records), which alone says what belongs to the result: files of failed attempts are not in it.

    The payload is the html in UTF-8 (null: empty). Of payloads of at least `least` bytes that are equal, the record
    with the smallest page_id holds the payload (response) and the others refer to it (revisit)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html")})
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # only payloads that occur more than once have a partner here: the join's other side is the small one
    # short payloads get a key each, so that one of them on many rows is no hot key
    rows = rows.withColumn("key", F.when(F.col("n") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    kept = rows.join(first.withColumnRenamed("digest", "key"), "key", "left")
    copy = F.col("first").isNotNull() & (F.col("page_id") != F.col("first")) & (F.col("n") >= least)
    kept = kept.select("page_id", "url", F.when(copy, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", F.when(copy, F.col("first")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for b in batches:
            html = b.column(2)
            for i in range(b.num_rows):
                page, url, digest, refers = (b.column(c)[i].as_py() for c in (0, 1, 3, 4))
                body = memoryview(html[i].as_buffer())  # a view on Arrow's memory, not a copy
                kind = "response" if refers is None else "revisit"
                top = _http(len(body)) if refers is None else b"HTTP/1.1 200 OK\r\n\r\n"
                out.add(_head(page, url, kind, refers, digest, len(top) + len(body)) + top, _chunks(body))
            yield out.rows()
        out.close()
        yield out.rows()

    return kept.mapInArrow(write, MANIFEST)


class _Source:
    """The bytes of one segment of an archive, member by member, at most CHUNK at a time."""

    def __init__(self, file, start: int, size: int):
        self.file, self.left, self.raw, self.text, self.unpack = file, size, b"", b"", None
        file.seek(start)

    def member(self) -> bool:
        """Go on to the next member; is there one?"""
        self.text = b""
        if not self.raw:
            self.raw = self._read()
        self.unpack = zlib.decompressobj(31)
        return bool(self.raw)

    def _read(self) -> bytes:
        got = self.file.read(min(CHUNK, self.left))
        self.left -= len(got)
        return bytes(got)

    def more(self) -> bytes:
        """Some decompressed bytes, at most CHUNK; empty at the member's end."""
        while not self.unpack.eof:
            if not self.raw and not self.unpack.unconsumed_tail:
                self.raw = self._read()
                if not self.raw:
                    raise ValueError("an archive ends within a record")
            out = self.unpack.decompress(self.unpack.unconsumed_tail + self.raw, CHUNK)
            self.raw = b""
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
            if out:
                return out
        return b""

    def until(self, end: bytes) -> bytes:
        """The text up to `end`, which is taken too."""
        while end not in self.text:
            got = self.more()
            if not got:
                raise ValueError("a record has no end of its header")
            self.text += got
        head, _, self.text = self.text.partition(end)
        return head

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            part = self.text or self.more()
            if not part:
                raise ValueError("a record is shorter than it says")
            self.text = part[length:]
            part = part[:length]
            length -= len(part)
            yield part

    def skip(self) -> None:
        while self.more():
            pass


def _chunk_rows(archive: str, start: int, size: int, records: int) -> Iterator[tuple]:
    store, path = _open(archive)
    with store.open_input_file(path) as file:
        source = _Source(file, start, size)
        for _ in range(records):
            if not source.member():
                raise ValueError(f"{archive} has fewer records than its manifest says")
            head = dict(x.split(": ", 1) for x in source.until(b"\r\n\r\n").decode().split("\r\n")[1:])
            length = int(head["Content-Length"])
            top = source.until(b"\r\n\r\n")
            length -= len(top) + 4
            page = int(head["WARC-Record-ID"][len("<urn:page:") : -1])
            refers = head.get("WARC-Refers-To")
            refers = int(refers[len("<urn:page:") : -1]) if refers else None
            total, n = hashlib.sha256(), 0
            row = lambda size: (page, n, size, total.hexdigest(), head["WARC-Type"], refers, head["WARC-Payload-Digest"].removeprefix("sha256:"))  # noqa: E731, B023
            held = 0
            for part in source.body(length):
                total.update(part)
                held += len(part)
                if held >= CHUNK:
                    yield row(held)
                    n, held = n + 1, 0
            if held or not n:
                yield row(held)
            source.skip()


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives: page_id, chunk (from 0), bytes (of this chunk), digest (SHA-256 of the payload
    up to and with this chunk), record_type, refers_to, declared (the digest in the header)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for b in batches:
            for seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = []
                for row in _chunk_rows(*seg):
                    held.append(row)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return manifest.mapInArrow(read, CHUNKS)


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. The bytes and digest of a
    revisit are those of the response it refers to. A payload whose digest is not the declared one ends the read."""
    chunks = read_chunks(manifest)
    last = F.max_by(F.struct("digest", "record_type", "refers_to", "declared"), "chunk")
    # a page_id may stand on several rows: then each has its own records, told apart by type, target and declared digest
    records = chunks.groupBy("page_id", "record_type", "refers_to", "declared").agg(F.sum("bytes").alias("bytes"), last.alias("last"), F.count_if(F.col("chunk") == 0).alias("copies"))
    records = records.select("page_id", "record_type", "refers_to", "declared", F.col("last.digest").alias("digest"), (F.col("bytes") / F.col("copies")).cast("long").alias("bytes"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    own = F.when(F.col("record_type") == "revisit", F.col("declared")).otherwise(
        F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its digest: page "), F.col("page_id").cast("string"))))
    )
    records = records.select("page_id", "record_type", "refers_to", "bytes", own.alias("payload_digest"))
    of = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.max("bytes").alias("of_bytes"))
    # the planner takes these tables for as small as the manifest they come from: without the hint it would broadcast one
    met = records.join(of.hint("merge"), (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    size = F.when(F.col("record_type") == "revisit", F.coalesce("of_bytes", F.raise_error(F.lit("a revisit refers to a record that is not there")).cast("long"))).otherwise(F.col("bytes"))
    return met.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages to WARC archives in a folder of the shared store, read them back, and return one row per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty html give an empty response of 0 bytes. A repeated page_id gives a record and a row each time; where
    it repeats a payload too, those with the smallest page_id are all responses. Rows without a page_id are left out,
    for a record needs an id. Extra columns are ignored; an empty table gives an empty result."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    manifest = staged(write_archives(pages.where(F.col("page_id").isNotNull()), folder), "warc-manifest")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_records(manifest.repartition(tasks))
