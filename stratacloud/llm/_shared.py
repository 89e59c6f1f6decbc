"""Shared storage, packing and small relational helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.storage import shared_dir

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of a few numbers each that one task of a shuffle should get.
LIGHT_ROWS = 200_000


def light_partitions(rows: int) -> int:
    """How many partitions light rows are shuffled into: by their number, whatever the session has set for others."""
    return int(rows) // LIGHT_ROWS + 1


class Scratch:
    """Written tables that cut lineage. They lie in the shared folder, so a lost executor loses nothing of them.

    What is not dropped before, as a result still reads it or a run has failed, goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)

    def save(self, frame: DataFrame, name: str, batch_rows: int | None = None, partitions: int | None = None) -> DataFrame:
        """Write and read again. ``batch_rows`` is the size of Arrow batches while it is made, ``partitions`` that of its shuffles.

        The shuffle files of the write are removed at its end.
        """
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with self._batches(batch_rows, partitions):
            frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    @contextlib.contextmanager
    def _batches(self, rows: int | None, partitions: int | None = None):
        wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_ROWS: str(rows)} if rows else {}) | ({SHUFFLE_PARTITIONS: str(partitions)} if partitions else {})
        before = {k: self.spark.conf.get(k) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def save_split(self, frame: DataFrame, name: str, kind: str, values: tuple, batch_rows: int | None = None) -> list[DataFrame]:
        """One table per value of a column, in one pass; each can be dropped alone."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with self._batches(batch_rows):
            frame.write.option("compression", "zstd").partitionBy(kind).parquet(path)
        rest = frame.drop(kind).schema
        folders = {f.getPath().getName(): f.getPath().toString() for f in self._files(path)}
        found = [folders.get(f"{kind}={v}") for v in values]
        return [self.spark.read.schema(rest).parquet(f) if f else self.spark.createDataFrame([], rest) for f in found]

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)

    def drop(self, frame: DataFrame) -> None:
        """Delete a saved table that no later frame reads."""
        files = frame.inputFiles()
        if not files:
            return
        folder = files[0].rsplit("/", 1)[0]
        if "/" + self.root.rsplit("/", 1)[1] + "/" not in folder:
            raise ValueError("not a scratch table")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """Return freed memory to the system, as idle workers are kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_settled = 0


def _settle() -> None:
    """Take what has been imported out of the collection of garbage that a worker makes after every task.

    Once, and again where a later task has imported more: what lives at that time is not collected any more.
    """
    global _settled
    if TaskContext.get() and len(sys.modules) != _settled:
        gc.collect()
        gc.freeze()
        _settled = len(sys.modules)


def bounded(f):
    """Wrap a batch function, or a cogroup function of a key and two tables, so that its worker gives memory back after it."""
    if len(inspect.signature(f).parameters) == 1:

        @functools.wraps(f)
        def batches_(batches):
            _settle()
            yield from f(batches)
            _give_back()

        return batches_

    def group(key, left, right):
        _settle()
        out = f(key, left, right)
        _give_back()
        return out

    return group


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that a join may treat as hot: a key with more than 1 / HOT_KEYS of all rows; there cannot be more than that many.
HOT_KEYS, LEAST_HOT = 20_000, 1_000


def join_counted(left: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``left`` joined with a saved table of one row per key, whose ``key_rows`` says how many rows of ``left`` have it.

    Hot keys are broadcast, at most HOT_KEYS rows by their definition, so that their rows stay where they are; the rows of
    all others meet by shuffle.
    """
    least = max(total // HOT_KEYS, LEAST_HOT)
    hot = counted.filter(F.col("key_rows") > least)
    if hot.isEmpty():
        return left.join(counted, keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.filter(F.col("key_rows") <= least), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def binary_array(pieces: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are the slices of one byte buffer."""
    offs = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(pieces))])


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits in the fewest bytes that hold them."""
    if a.dtype == np.int64 and len(a) and a.min() >= 0:
        top = int(a.max())
        return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    return a


def bundle(*arrays: np.ndarray) -> bytes:
    """Several columns as one compressed value: their types and lengths, and byte planes of each."""
    code = lambda kind: np.dtype(kind).str[1:].encode().ljust(4)
    kept = [_narrow(np.ascontiguousarray(a)) for a in arrays]
    head = b"".join(code(a.dtype) + code(k.dtype) + len(a).to_bytes(8, "little") for a, k in zip(arrays, kept))
    planes = [np.ascontiguousarray(k.view(np.uint8).reshape(len(k), -1).T).tobytes() for k in kept if len(k)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([bytes([len(arrays)]), head, *planes]))


def unbundle(raw: bytes) -> list[np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(raw))
    kind = lambda at: np.dtype(bytes(data[at : at + 4]).decode().strip())
    out, at = [], 1 + 16 * data[0]
    for k in range(1, 1 + 16 * data[0], 16):
        wide, small, n = kind(k), kind(k + 4), int.from_bytes(data[k + 8 : k + 16], "little")
        planes = np.frombuffer(data, np.uint8, n * small.itemsize, at).reshape(small.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(small).reshape(-1).astype(wide, copy=False))
        at += n * small.itemsize
    return out


def packed(a: np.ndarray, rising: bool = False) -> bytes:
    """A compressed column: byte planes of the values, or of their differences where they rise."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising else a
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, kind, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    a = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(a, dtype=kind) if rising else a


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    starts = np.concatenate(([0], cut))
    return starts, np.concatenate((cut, [len(sorted_keys)]))


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets, nulls as empty, without a copy per row."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, one table per key; a key may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts, cuts[1:]):
            if x:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def pieces_of(data: np.ndarray, offs: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
