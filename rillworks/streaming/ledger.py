"""The configuration that each micro-batch was routed with.

Configuration may change at any time, also between a micro-batch and its repetition after a failure. So the tables a batch uses
are written before it routes anything, and one row then names them for the batch number; a batch that runs
again finds that row and reads the same tables. A job that broke off before the row leaves tables that nothing names.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAKEN = "batch bigint, taken string"


class ConfigLedger:
    """Configuration tables by batch number, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], _TAKEN).write.mode("ignore").parquet(f"{self.folder}/taken")

    def taken(self, batch_id: int) -> str | None:
        rows = self.spark.read.schema(_TAKEN).parquet(f"{self.folder}/taken").filter(F.col("batch") == batch_id)
        return rows.agg(F.min("taken")).first()[0]

    def at(self, batch_id: int, read: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """The tables of the batch: those it was first run with, else as they are now."""
        name = self.taken(batch_id)
        if name is None:
            name = uuid.uuid4().hex
            for table, current in read.items():
                current().write.parquet(f"{self.folder}/tables/{name}/{table}")
            self.spark.createDataFrame([(batch_id, name)], _TAKEN).coalesce(1).write.mode("append").parquet(f"{self.folder}/taken")
        return {table: self.spark.read.parquet(f"{self.folder}/tables/{name}/{table}") for table in read}
