"""Token ids as compressed frames of blocks, written in key order as a Parquet table of binary frames and read back.

A frame holds whole rows in ascending key order: a head (magic, version, block size, vocabulary, counts), the
number of ids of each row, per block its coded length and crc32, a crc32 of all that, then the coded blocks. Every block starts
from an empty model, so frames and blocks decode alone. See `idcoder` for the coder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm import idcoder, shared
from rillworks.llm.tokens import encoder

MAGIC = b"RWID"
VERSION = 2
FRAME_IDS = 1 << 23
_BATCH = 2048
#: Texts are encoded so many bytes at a time, by an encoder with twice the usual bounds: knowing a word is cheaper than learning it again.
_BYTES, _ROOM = 1 << 24, 2
_HEAD = struct.Struct("<4sHHIQQQ")
_CRC = struct.Struct("<I")


def pack_frame(rows: list[bytes], vocabulary: int, block: int = idcoder.BLOCK) -> bytes:
    """One frame of rows of little-endian 32-bit ids."""
    sizes = np.array([len(r) // 4 for r in rows], "<u8")
    ids = np.frombuffer(b"".join(rows), "<u4")
    coded, crcs = idcoder.encode(ids, vocabulary, block)
    head = _HEAD.pack(MAGIC, VERSION, block, vocabulary, len(rows), len(ids), len(coded))
    index = np.array([[len(c) for c in coded], crcs], "<u4").tobytes()
    front = b"".join([head, sizes.tobytes(), index])
    return b"".join([front, _CRC.pack(zlib.crc32(front)), *coded])


def unpack_frame(data: bytes) -> list[np.ndarray]:
    """The ids of each row; idcoder.Damaged if the frame isn't whole."""
    flat, sizes = _unpacked(data)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and how many are each row's."""
    if len(data) < _HEAD.size:
        raise idcoder.Damaged("a frame is too short")
    magic, version, block, vocabulary, rows, ids, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise idcoder.Damaged("no frame of this version")
    at = _HEAD.size
    front = at + 8 * rows + 8 * blocks
    if len(data) < front + _CRC.size or zlib.crc32(data[:front]) != _CRC.unpack_from(data, front)[0]:
        raise idcoder.Damaged("a frame's head is wrong")
    sizes = np.frombuffer(data, "<u8", rows, at)
    lengths, crcs = np.frombuffer(data, "<u4", 2 * blocks, at + 8 * rows).reshape(2, blocks)
    ends = front + _CRC.size + np.cumsum(lengths.astype(np.int64))
    if int(sizes.sum()) != ids or int(lengths.sum()) != len(data) - front - _CRC.size:
        raise idcoder.Damaged("a frame's lengths don't fit")
    coded = [data[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
    return idcoder.decode(coded, crcs.tolist(), ids, vocabulary, block), sizes.astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, cuts: str, end_id: int, key: str = "doc_id", text: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Writes the ids of every row and `end_id` after each, in ascending key order, to a table of frames at `path`.

    Columns: part and frame give the order, keys those of the frame's rows, n_ids its ids, data the frame.
    NULL texts have the end id only, NULL keys come first, repeated rows are written as often as they occur.
    A frame ends at the first row that brings it to `frame_ids`, so one row is never in two frames.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("frame", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, cuts, _ROOM)
        vocabulary = max(own.vocabulary, end_id + 1)
        part, frame, keys, rows, size = 0, 0, [], [], 0

        def frame_row():
            columns = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([keys], schema_keys), pa.array([size], pa.int64()), pa.array([pack_frame(rows, vocabulary)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "frame", "keys", "n_ids", "data"])

        for whole in batches:
            schema_keys = pa.list_(whole.schema.field(1).type)
            group = np.cumsum(pc.binary_length(whole.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // _BYTES
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), whole.num_rows]
            for at, edge in zip(edges, edges[1:]):
                b = whole.slice(at, edge - at)
                for p, k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own.encode(b.column(2).to_pylist())):
                    part = p
                    keys.append(k), rows.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= frame_ids:
                        yield frame_row()
                        frame, keys, rows, size = frame + 1, [], [], 0
        if rows:
            yield frame_row()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    placed = rows.repartitionByRange(shared.partitions(docs.sparkSession), "key").sortWithinPartitions("key", F.xxhash64("text"))
    placed.select(F.spark_partition_id().alias("part"), "key", "text").mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every row written at `path`; start counts the ids of all rows before it.

    Without `with_ids` all ids are decoded for their checksums, but they don't leave the Python workers.

    Places come from the frames' counts: summed per part, then running over the parts (one row per written
    partition) and within each part. Reading fails with `idcoder.Damaged` if a block's checksum is wrong.
    """
    frames = spark.read.parquet(path)
    kind = frames.schema["keys"].dataType.elementType
    counts = frames.select("part", "frame", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "frame", (F.col("at") + F.col("part_start")).alias("start"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("frame", T.IntegerType()), T.StructField("key", kind), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                flat, sizes = _unpacked(b.column(3)[i].as_py())
                at = np.cumsum(sizes) - sizes
                raw = memoryview(flat.tobytes())
                crcs = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(at.tolist(), (at + sizes).tolist())]
                keys = b.column(2).slice(i, 1).flatten()
                for j in range(0, len(sizes), _BATCH):
                    n = len(sizes[j:j + _BATCH])
                    columns = [b.column(0).take(pa.array([i] * n)), b.column(1).take(pa.array([i] * n)), keys.slice(j, n), pa.array(at[j:j + n]), pa.array(sizes[j:j + n]), pa.array(crcs[j:j + n], pa.int64())]
                    if with_ids:
                        ends = np.append(at[j:j + n], at[j + n - 1] + sizes[j + n - 1])
                        own = flat[ends[0]:ends[-1]].astype(np.uint32, copy=False).view(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(own)))
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = frames.select("part", "frame", "keys", "data").mapInArrow(run, schema)
    return rows.join(starts, ["part", "frame"]).select("key", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
