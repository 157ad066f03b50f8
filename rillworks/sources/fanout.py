"""`fanout` sink: queue rows of all clusters in one job, published together.

options: path (a folder that driver and executors share), batch (a number, for a batch that may run again). Tasks write
one file per cluster and topic they meet; nothing refers to these files until the job commits, when one manifest names
them all. A failed task or job leaves no manifest, so nothing of it is visible for any cluster. A batch that runs
again replaces its own manifest. As a stream, the batch number is the micro-batch's. `delivered` reads what manifests name.
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "cluster_id STRING, topic STRING, key BINARY, value BINARY, headers ARRAY<STRUCT<key: STRING, value: BINARY>>"
_BATCH_ROWS = 4096


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer:
    def __init__(self, options: dict):
        self.root, self.batch = options["path"].rstrip("/"), options.get("batch")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file per cluster and topic of the task's rows."""
        system, root = fs.FileSystem.from_uri(self.root)
        task, open_files, sinks = uuid.uuid4().hex, {}, []
        try:
            for batch in batches:
                pairs = pa.table([batch.column("cluster_id"), batch.column("topic")], ["c", "t"]).group_by(["c", "t"]).aggregate([])
                for cluster, topic in zip(pairs.column("c").to_pylist(), pairs.column("t").to_pylist()):
                    mask = pc.and_(pc.equal(batch.column("cluster_id"), cluster), pc.equal(batch.column("topic"), topic))
                    if (cluster, topic) not in open_files:
                        folder = f"{root}/data/{quote(cluster, safe='')}/{quote(topic, safe='')}"
                        system.create_dir(folder, recursive=True)
                        path = f"{folder}/{task}.parquet"
                        sinks.append(system.open_output_stream(path))
                        open_files[cluster, topic] = (path, pq.ParquetWriter(sinks[-1], batch.schema))
                    open_files[cluster, topic][1].write_batch(batch.filter(mask))
        finally:
            for _, writer in open_files.values():
                writer.close()
            for sink in sinks:
                sink.close()
        return Written([path for path, _ in open_files.values()])

    def publish(self, messages: list, name: str) -> None:
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(f"{root}/manifests", recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        draft = f"{root}/manifests/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"name": name, "files": files}).encode())
        system.move(draft, f"{root}/manifests/{name}.json")

    def drop(self, messages: list) -> None:
        """Files of tasks that ended; others stay unnamed, and so unseen."""
        system, _ = fs.FileSystem.from_uri(self.root)
        for path in [f for m in messages if m is not None for f in m.files]:
            try:
                system.delete_file(path)
            except FileNotFoundError:
                pass


class FanOutWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self.publish(messages, f"batch-{self.batch}" if self.batch is not None else uuid.uuid4().hex)

    def abort(self, messages) -> None:
        self.drop(messages)


class FanOutStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self.publish(messages, f"batch-{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self.drop(messages)


class FanOutSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fanout"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FanOutWriter:
        return FanOutWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> FanOutStreamWriter:
        return FanOutStreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FanOutSink)


def deliver(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Writes queue rows (see `routing.queue_rows`) for all clusters at once."""
    register(rows.sparkSession)
    shaped = rows.select(*StructType.fromDDL(SCHEMA).names)
    writer = shaped.write.format("fanout").mode("append").option("path", path)
    (writer if batch_id is None else writer.option("batch", str(batch_id))).save()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(batch, cluster_id, topic, key, value, headers) of all published rows; files are read by the tasks."""
    schema = f"batch STRING, {SCHEMA}"
    named = to_arrow_schema(StructType.fromDDL(schema))
    texts = spark.read.option("pathGlobFilter", "*.json").text(f"{path.rstrip('/')}/manifests", wholetext=True)
    told = texts.select(F.from_json("value", "name STRING, files ARRAY<STRING>").alias("m"))
    files = told.select(F.col("m.name").alias("name"), F.explode("m.files").alias("file")).repartition("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, file in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(file) as source:
                    for part in pq.ParquetFile(source).iter_batches(_BATCH_ROWS):
                        columns = [pa.array([name] * part.num_rows), *[part.column(f.name).cast(f.type) for f in list(named)[1:]]]
                        yield pa.RecordBatch.from_arrays(columns, schema=named)

    return files.mapInArrow(read, schema)
