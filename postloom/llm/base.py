"""What the operators share: tables, the shared folder, bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Rows in an Arrow batch handed to Python; batches are cut further by bytes.
BATCH_ROWS = 1000
#: Text bytes that Python works on at once.
SLICE_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            import tempfile

            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="postloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames: nothing may read them any more."""
    for df in frames:
        if path := getattr(df, "_written", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Give back what the driver's Python holds but doesn't use after a fit."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on, and what it holds counts beside the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches of this session's Python operators small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at least one row and about ``limit`` bytes in ``column``, whole rows only.

    What the worker's last task has freed is given back before the first, what this one has after the last.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if k > at and total + n > limit:
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += n
        yield batch.slice(at)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.string()), "")
