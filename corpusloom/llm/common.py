"""Helpers shared by the training-data operators: durable staging, Arrow columns and hashing of words in numpy."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary folder of this process, in
    local sessions alone. Raises a ValueError on a cluster, where executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master!r})")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Staged:
    """A DataFrame written as Parquet to the shared folder and read again. It cuts the lineage and, unlike blocks kept
    on executors, outlives a lost one. drop() frees its disk when no later step reads it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        with shuffles_freed(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, where the session does not say how: ten thousand long texts are no batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]) if len(column) else np.zeros(1, np.int64)


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system: Python workers live on between
    stages, and an executor's memory is shared by all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes in all, or one text: it bounds numpy's temporary arrays."""
    n = batch.num_rows
    if not n:
        return
    _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    if offs[-1] >= most:
        release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i modulo 2 ** 64 for i below n, kept up to 4 Mi entries."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 1 << 22:
            return up, down
        _POWERS.update(p=up, q=down)
    return _POWERS["p"], _POWERS["q"]


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts (runs of bytes outside `space`, never across texts), and the n + 1
    word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    up, down = _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word shingles in order, text by text, and their n + 1 offsets. A text of fewer words, but
    not none, has one: the whole sequence."""
    n = np.diff(offs)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    if not len(words):
        return np.zeros(0, np.uint64), to
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    at = np.arange(to[-1]) + np.repeat(offs[:-1] - to[:-1], many)
    left = np.repeat(offs[1:], many) - at
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        part = padded[at + j]
        if j:
            part = np.where(left > j, part, np.uint64(0))
        out = out * np.uint64(_P) + part
    return mix(out + np.minimum(left, size).astype(np.uint64)), to


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a string column (A-Z lower-cased; words are runs without ASCII white space), the offsets of
    the shingles, and the offsets of the words."""
    data, offs = utf8(column)
    low = LOWER[data]
    starts, ends, at = word_spans(low, offs)
    hashes, to = shingle_hashes(span_hashes(low, starts, ends), at, size)
    return hashes, to, at


#: Rows of a key table (some 30 bytes each in memory) up to which it is sent to every executor.
SMALL_ROWS = 500_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A staged key table with a broadcast hint where its counted rows are within the bound; beyond it joins shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df


def column_name(df: DataFrame, base: str) -> str:
    """A column name that df lacks, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
