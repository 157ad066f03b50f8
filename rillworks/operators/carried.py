"""Ordered walks over rows in Python, with only a small state carried from row to row."""

import ctypes
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def as_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; only the last column may be large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def give_back() -> None:
    """Gives memory that this worker has freed back to the system: workers live on through later stages and hold it otherwise."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def walk(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
         step: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """`step(key, rows)` for each key, with the key's rows in order as tuples of `columns`.

    Rows stream through the task: a key is never held as a whole. Keys should still be small parts of
    the data (a block, a segment, or one row per block), since one task walks each of them."""
    out = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = groupby(rows_of(batches), key=lambda r: r[:n])
        return as_batches((o for key, rows in grouped for o in step(key, (r[n:] for r in rows))), out)

    needed = list(dict.fromkeys([*keys, *order, *columns]))
    placed = df.select(*needed).repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.select(*keys, *columns).mapInArrow(run, schema)
