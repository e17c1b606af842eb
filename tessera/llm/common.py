"""Shared folders, hashing and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset
    and all runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table_path(df: DataFrame) -> str | None:
    """The folder of a table of written(); None if it has no files."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and losing an executor loses nothing."""
    path = path or shared_dir(df.sparkSession)
    with while_writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Within written() Spark deletes shuffle files as soon as a table is written, and hands Python few rows at once: rows of
#: texts and of sets are wide.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in WHILE_WRITING}
    for key, value in WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def give_back() -> None:
    """Memory that Arrow and the allocator hold for later goes back to the system: idle workers keep little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def discard(spark: SparkSession, *paths: str | None) -> None:
    """Deletes tables of written() that no later step reads."""
    jvm = spark.sparkContext._jvm
    for p in filter(None, paths):
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column holds about limit bytes in each; a longer single text stays whole."""
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = batch.column(batch.schema.get_field_index(column))
            sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
            at, total = 0, 0
            for i in range(n):
                if i > at and total + sizes[i] > limit:
                    yield batch.slice(at, i - at)
                    at, total = i, 0
                total += int(sizes[i])
            yield batch.slice(at, n - at)
    finally:
        give_back()


def signed(x: int) -> int:
    """The signed 64-bit value of the same bits."""
    return x - (1 << 64) if x >> 63 else x
