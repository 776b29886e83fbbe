"""Shared plumbing of the training-data operators: shared tables, text batches, words, hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of every operator: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that an operator works on at once in a Python worker.
CHUNK_BYTES = 6_000_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1500
#: Side of a join that may be broadcast, in rows of some tens of bytes (so 50 MB or so); larger sides
#: are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names
    one; a session without it (a local test) gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs
    a reread, not a recomputation. Returns the table and its path, for drop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that materialise() wrote, once nothing lazy reads them any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. Rows of documents are large: unless the session says otherwise, they go
    to Python workers in batches of BATCH_ROWS, which bounds what both sides hold."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if the counted rows allow it, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most about ``most`` bytes of text, one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, at = np.cumsum(n), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def released(run: Callable) -> Callable:
    """run, a function of batches, giving its memory back to the system when a task ends: idle
    Python workers live on beside those of later stages."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner


def kept(run: Callable) -> Callable:
    """released(run), with what run frees meanwhile kept for its next arrays: where every array comes
    from the system anew, page faults cost as much as the arithmetic on it."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tune = getattr(ctypes.CDLL(None), "mallopt", lambda what, value: 0)
        mapped, trimmed = -3, -1  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        tune(mapped, 1 << 28), tune(trimmed, 1 << 28)
        yield from run(batches)
        tune(mapped, 1 << 25), tune(trimmed, 1 << 26)  # the most that they adapt to by themselves

    return released(functools.wraps(run)(inner))


class Numbering(dict):
    """Numbers keys in the order of their first lookup."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i] .. starts[i]+lengths[i]-1 of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
