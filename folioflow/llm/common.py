"""Shared plumbing of the training-data operators: table access and staged intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python workers stay under this size, so that a run of very long texts cannot
#: fill a worker's memory (the row limit alone does not bound it).
ARROW_BATCH_BYTES = 16 << 20
ARROW_BATCH_ROWS = 2000
#: Rows of keys (of a few numbers each) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of texts that are broadcast at most.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def give_back() -> None:
    """Hands memory that numpy and Arrow have freed back to the system; a worker keeps it while it waits otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of our own only if everything is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of staged tables that nobody has removed yet.
_STAGED: set[str] = set()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the steps before the table. The shuffle files
    of the write go when it ends and do not wait for the driver's garbage collector.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    _STAGED.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _STAGED.discard(folder)


def drop_staged(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``stage`` once nothing reads them any more."""
    for df in tables:
        if "_staged" in df.__dict__ and df._staged in _STAGED:
            _delete(df.sparkSession, df._staged)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Removes on exit what was staged inside, but for the folders put into the set that it yields."""
    before, keep = set(_STAGED), set()
    try:
        yield keep
    finally:
        for folder in _STAGED - before - keep:
            _delete(spark, folder)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
