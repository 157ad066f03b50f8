"""`tail` data source: bytes appended to growing files, as chunk rows.

options: path (file, directory or glob; several separated by commas), task_id, exclude (name globs),
recursive, split_bytes (largest byte range per task), row_bytes (largest chunk per row), and for a
batch read start_offsets (JSON, path -> byte). Paths may be of any file system pyarrow opens; on a
cluster they must be readable from every executor.

As a stream, the position is {path: [bytes read, size seen]}. It is kept in Spark's checkpoint, so a restart goes on
where the last batch ended. A file smaller than when it was last seen was rotated and is read from 0; one that is gone
at the time of reading gives nothing. With max_bytes a batch takes that many new bytes at most (a byte per file with
news at least), dealt evenly over the files: what a file doesn't need of its share goes to the others, so a large
backlog is many batches and no file waits for another. Nothing is left out: what was not admitted comes next. The
trigger `availableNow` takes one batch per run; use a processing-time trigger to catch up. Long ranges become several
tasks and bounded rows. For more files than a position should list, see `listing`.
"""

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from rillworks.model import CHUNK_SCHEMA

SPLIT_BYTES = 64 * 1024 * 1024
ROW_BYTES = 1024 * 1024
_WILDCARDS = re.compile(r"[*?\[]")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def path_regex(pattern: str) -> str:
    """`*` and `?` stay within a directory, `**` does not."""
    parts = re.split(r"(\*\*|\*|\?|\[[^\]]*\])", pattern)
    spelled = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(spelled.get(p, p.replace("[!", "[^") if p.startswith("[") else re.escape(p)) for p in parts)


def list_sizes(options: dict) -> dict[str, int]:
    """Current size of every file the options select; missing paths are simply not there yet."""
    recursive = options.get("recursive", "false").lower() == "true"
    excluded = [re.compile(path_regex(p.strip())) for p in options.get("exclude", "").split(",") if p.strip()]
    found: dict[str, int] = {}
    for pattern in filter(None, (p.strip() for p in options["path"].split(","))):
        cut = _WILDCARDS.search(pattern)
        base = pattern[:cut.start()].rsplit("/", 1)[0] if cut else pattern
        system, root = fs.FileSystem.from_uri(base or "/")
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            infos = [info]
        elif info.type == fs.FileType.Directory:
            deep = recursive or (cut is not None and "/" in pattern[cut.start():]) or "**" in pattern
            infos = system.get_file_info(fs.FileSelector(root, recursive=deep))
        else:
            infos = []
        wanted = re.compile(re.escape(root) + path_regex(pattern[len(base):])) if cut else None
        for f in infos:
            name = f.path.rsplit("/", 1)[-1]
            if (f.type == fs.FileType.File and (wanted is None or wanted.fullmatch(f.path))
                    and not any(e.fullmatch(name) for e in excluded)):
                found[f.path] = f.size
    return found


def admitted(position: dict, sizes: dict[str, int], limit: int | None) -> dict[str, list[int]]:
    """The position after the next batch: {path: [bytes read, size seen]}."""
    starts = {}
    for path, size in sizes.items():
        read, seen = position.get(path, (0, 0))
        starts[path] = 0 if size < seen else read
    left, stops = limit, {}
    waiting = sorted(sizes, key=lambda p: (sizes[p] - starts[p], p))
    for i, path in enumerate(waiting):
        pending = sizes[path] - starts[path]
        if limit is not None and pending:
            pending = min(pending, max(1, left // (len(waiting) - i)))
            left = max(0, left - pending)
        stops[path] = [starts[path] + pending, sizes[path]]
    return stops


def ranges(path: str, start: int, stop: int, split: int) -> list[Range]:
    return [Range(path, at, min(at + split, stop)) for at in range(start, stop, split)]


class _Reader:
    def __init__(self, options: dict):
        self.options = dict(options)
        self.split = int(self.options.get("split_bytes", SPLIT_BYTES))
        self.row = int(self.options.get("row_bytes", ROW_BYTES))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("task_id", pa.string()), ("file_path", pa.string()), ("offset", pa.int64()), ("data", pa.binary())])
        system, path = fs.FileSystem.from_uri(part.path)
        try:
            opened = system.open_input_file(path)
        except FileNotFoundError:  # gone since it was listed
            return
        with opened as file:
            file.seek(part.start)
            at = part.start
            while at < part.stop:
                data = file.read(min(self.row, part.stop - at))
                if not data:
                    break
                row = {"task_id": [self.options.get("task_id")], "file_path": [part.path], "offset": [at], "data": [data]}
                yield pa.RecordBatch.from_pydict(row, schema=schema)
                at += len(data)


class TailReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        starts = json.loads(self.options.get("start_offsets", "{}"))
        parts = [r for path, size in list_sizes(self.options).items()
                 for r in ranges(path, starts.get(path, 0) if starts.get(path, 0) <= size else 0, size, self.split)]
        return parts or [Range("/", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.stop > part.start else iter(())


class TailStreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        limit = self.options.get("max_bytes")
        self.limit = None if limit is None else int(limit)
        self.position: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # after a restart, `partitions` of the last batch comes first and tells where it ended
        self.position = admitted(self.position or {}, list_sizes(self.options), self.limit)
        return self.position

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.position is None:
            self.position = end
        parts = []
        for path, (stop, size) in end.items():
            read, seen = start.get(path, (0, 0))
            parts += ranges(path, 0 if size < seen else read, stop, self.split)
        return parts

    def commit(self, end: dict) -> None:
        """Nothing to release: the position lives in Spark's checkpoint."""


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> TailStreamReader:
        return TailStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TailSource)
