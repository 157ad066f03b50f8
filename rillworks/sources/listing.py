"""Listings of large directory trees: taken by executors, kept as versions of a table, followed as a stream of changes.

The driver never holds paths. Directories are listed by tasks; a task goes on into what it finds until it has listed
DIRS_PER_TASK directories and hands the rest on, so that deep, broad and lopsided trees are dealt out anew each round.
A listing is a version in a folder: its files, and the changes against the version before with the bytes that are new.
The changes are written last and hold one row for the version, which is what makes it one: a listing that broke off is
taken again under the same number. `Listings.stream` follows the changes, `new_chunks` reads the bytes they name; the
position of such a stream is a place in that table, however many files there are.
"""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.model import CHUNK_SCHEMA
from rillworks.operators import offsets
from rillworks.sources.tail import ROW_BYTES, SPLIT_BYTES, Range, _Reader

FILES = "path string, size bigint, mtime bigint, digest string"
EVENTS = "version bigint, path string, event string, from_path string, start bigint, stop bigint"
DIRS_PER_TASK = 256
_LISTED = "LISTED"
_ENTRIES = "path string, size bigint, mtime bigint, is_dir boolean"
_ENTRIES_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("is_dir", pa.bool_())])
_READ_BYTES = 1 << 20
_ROWS = 10_000


def _entries(limit: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column(0).to_pylist():
                waiting, seen, rows = [root], 0, []
                while waiting and seen < limit:
                    system, path = fs.FileSystem.from_uri(waiting.pop())
                    seen += 1
                    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                        if info.type == fs.FileType.Directory:
                            waiting.append(info.path)
                        elif info.type == fs.FileType.File:
                            rows.append((info.path, info.size, (info.mtime_ns or 0) // 1000, False))
                        if len(rows) >= _ROWS:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows + [(path, None, None, True) for path in waiting])

    return listed


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _ENTRIES_ARROW.types)], schema=_ENTRIES_ARROW)


def listed(spark: SparkSession, roots: list[str], work: str, dirs_per_task: int = DIRS_PER_TASK) -> DataFrame:
    """(path, size, mtime in microseconds) of all files under the roots; roots that are not there have none.

    Each round is written to a folder of its own below `work`, which executors and driver share."""
    waiting, found, n = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string"), [], 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        target = f"{work}/round={n}"
        waiting.repartition(tasks, "path").mapInArrow(_entries(dirs_per_task), _ENTRIES).write.mode("overwrite").parquet(target)
        entries = spark.read.schema(_ENTRIES).parquet(target)
        found.append(entries.filter("NOT is_dir").drop("is_dir"))
        waiting, n = entries.filter("is_dir").select("path"), n + 1
        if waiting.isEmpty():
            break
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files.dropDuplicates(["path"]) if len(roots) > 1 else files


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills in missing digests; a file that is gone has none."""
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        for i, path in enumerate(batch.column("path").to_pylist()):
            if digests[i] is None:
                digests[i] = _digest(path)
        yield batch.set_column(batch.schema.get_field_index("digest"), "digest", pa.array(digests, pa.string()))


def _digest(path: str) -> str | None:
    system, name = fs.FileSystem.from_uri(path)
    h = sha256()
    try:
        with system.open_input_stream(name) as file:
            while data := file.read(_READ_BYTES):
                h.update(data)
    except FileNotFoundError:
        return None
    return h.hexdigest()


class Listings:
    """Versions of a listing in a folder that driver and executors share. One process takes listings at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], EVENTS).write.mode("ignore").parquet(f"{self.folder}/events")

    def current(self) -> int:
        """The newest version, 0 if there is none."""
        return self._events().filter(F.col("event") == _LISTED).agg(F.max("version")).first()[0] or 0

    def take(self, roots: list[str], patterns: DataFrame | None = None, excludes: list[str] | None = None, digests: bool = True) -> int:
        """Lists the roots as the next version and returns its number.

        `patterns` (task_id, pattern) and `excludes` choose files as `offsets.match_files` does. With `digests`, contents that are
        new are hashed, once each, so that moved files are known as such; the digest of a file whose size and time are as before is kept."""
        before = self.current()
        version = before + 1
        files = listed(self.spark, roots, f"{self.folder}/work/{version}")
        if patterns is not None or excludes:
            chosen = patterns if patterns is not None else self.spark.createDataFrame([("", "/**")], "task_id string, pattern string")
            files = files.join(offsets.match_files(files.select("path"), chosen, excludes).select("path").distinct(), "path", "left_semi")
        old = self.files(before)
        same = old.select("path", "size", "mtime", "digest")
        files = files.join(same, ["path", "size", "mtime"], "left").select("path", "size", "mtime", "digest")
        if digests:
            files = files.mapInArrow(_digested, FILES)
        files.write.mode("overwrite").parquet(f"{self.folder}/files/{version}")
        changes = offsets.listing_changes(old, self.files(version)).withColumn("version", F.lit(version).cast("bigint"))
        mark = self.spark.createDataFrame([(version, None, _LISTED, None, None, None)], EVENTS)
        changes.select(*mark.columns).unionByName(mark).write.mode("append").parquet(f"{self.folder}/events")
        return version

    def files(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/files/{version}")

    def _events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events")

    def events(self, after: int = 0) -> DataFrame:
        """Changes of all versions after the given one."""
        return self._events().filter((F.col("event") != _LISTED) & (F.col("version") > after))

    def stream(self) -> DataFrame:
        """The changes as they come."""
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.folder}/events").filter(F.col("event") != _LISTED)


def new_chunks(events: DataFrame, task_id: str | None = None, split_bytes: int = SPLIT_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Chunk rows of the new bytes of changed files, for a batch or a stream of changes.

    Long ranges are cut into parts of `split_bytes`, which are dealt out over all tasks."""
    parts = events.filter("stop > start").select("path", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(split_bytes).cast("bigint"))).alias("from"), "stop")
    bounded = parts.select("path", "from", F.least("stop", F.col("from") + split_bytes).alias("to")).repartition(F.col("path"), F.col("from"))
    reader = _Reader({"row_bytes": row_bytes} | ({} if task_id is None else {"task_id": task_id}))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                yield from reader.read(Range(path, start, stop))

    return bounded.mapInArrow(read, CHUNK_SCHEMA)
