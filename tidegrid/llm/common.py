"""Helpers that the text operators share: durable intermediate tables and block-wise shuffles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that an operator handles at once; bounds the memory of a Python worker together with
#: spark.sql.execution.arrow.maxBytesPerBatch.
SLICE_BYTES = 8 << 20
#: The same where a few 64-bit numbers are held for each byte.
HASH_SLICE = 1 << 18
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh local one where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go when each action ends; else they stay until the driver's garbage is collected,
    however much of the disk they take."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, frees shuffles and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Number of buckets of a block-wise shuffle: the session's shuffle partitions, which grow with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds much more than ``most`` bytes of the named column (one long text may)."""
    if batch.num_rows == 0:
        return
    sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def released(run: Callable) -> Callable:
    """A function of a partition's batches after which its worker gives back what it freed.

    Spark keeps Python workers for later tasks, of other stages too; the allocators would keep the most that any of these
    tasks took, beside the executor's heap.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for the buckets that have keys; a hash of the key chooses the bucket."""
    if not len(keys):
        return
    keys = mix64(keys)
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, a, z in zip(found.tolist(), first, [*first[1:], len(order)]):
        yield b, order[a:z]
