"""Tables written to the folder that driver and executors share, and row placement by content."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder: `spark.checkpoint.dir`; where it is unset (local sessions, tests) a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="rillworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/rillworks-{uuid.uuid4().hex}"


@contextmanager
def few_at_once(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs that run inside hand Python workers at most `rows` rows at once: whole texts otherwise stand in batches of 10,000, in the executor and in each worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and returns a reader of it.

    The lineage ends there: executors lost later cost nothing of what went before.
    """
    path = new_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(groups: int, *columns: str) -> Column:
    """A group number from the content of `columns`: the same on every run, even for one key that holds many rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def training(key: str, modulus: int) -> Column:
    """True for rows that models may learn from: crc32 of the key as text is no multiple of `modulus`. NULL keys don't train."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus != 0, F.lit(False))


def held_out(key: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def trim() -> None:
    """Gives memory that this worker has freed back to the system: workers live on through later stages and hold it otherwise."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time: texts become Python objects only for so many rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of `columns` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
