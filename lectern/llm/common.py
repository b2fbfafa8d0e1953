"""What the operators of this subpackage share: intermediate tables, size-checked broadcasts, Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.session import importable

#: Ids that a broadcast may hold (8 bytes each); beyond it the same join is a shuffle join.
BROADCAST_IDS = 1_000_000
#: Text bytes that one numpy pass looks at; a longer document is a pass of its own.
SLICE_BYTES = 1 << 18


#: Bytes of an Arrow batch, where the session has Spark's default of 64 MB: workers hold a few batches at once.
BATCH_BYTES = 1 << 20


def session_paths(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it through sys.path alone, and keeps their Arrow
    batches small where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    importable(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; set it to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lectern-")


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: later plans start from the files, whichever
    executors are lost. The files go when the session ends."""
    spark = df.sparkSession
    importable(spark)
    path = f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    for scope in _scopes[-1:]:
        scope.append((out, path))
    return out


#: Of each open passing(), the tables that were written in it, and where.
_scopes: list[list[tuple[DataFrame, str]]] = []


@contextmanager
def passing() -> Iterator[Callable[..., None]]:
    """Tables that are written inside are deleted at its end, but those that the function it yields was called with: what
    reads the others must be written by then. After a failure all stay until the session ends."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield lambda *tables: kept.extend(tables)
    except BaseException:
        _scopes.pop()
        raise
    for table_, path in _scopes.pop():
        if any(table_ is x for x in kept):
            for scope in _scopes[-1:]:
                scope.append((table_, path))
        else:
            spark = table_.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the session ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def table_n(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """table() and its number of rows, counted as they are written."""
    seen = Observation()
    out = table(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def only_ids(docs: DataFrame, ids: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is in ids (n rows): a broadcast semi-join up to BROADCAST_IDS, else a shuffle join."""
    ids = ids.select(key)
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), key, "left_semi")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, both starting at 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_holder: dict = {"name": None, "clear": None, "now": False}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Says that this worker keeps tables of name, which clear drops. They go when it serves another operator."""
    if _holder["name"] not in (None, name):
        _holder["clear"]()
    _holder.update(name=name, clear=clear, now=True)


def _drop_held() -> None:
    if not _holder["now"] and _holder["name"]:
        _holder["clear"]()
        _holder.update(name=None, clear=None)
    _holder["now"] = False


def released(run: Callable) -> Callable:
    """run, a function of batches, leaving no freed memory in its worker."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def _release() -> None:
    """Gives memory that a worker has freed back to the system: an idle worker shares its executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about limit bytes of text together."""
    limit = limit or SLICE_BYTES
    _drop_held()
    try:
        yield from _slices(batches, text, limit)
    finally:
        _release()


def _slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes offsets[i] to offsets[i + 1] of data."""
    if offsets[-1] >= 2**31:
        raise ValueError("a batch of more than 2 GB")
    data = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
