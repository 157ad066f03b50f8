"""Compression and decompression of payload columns."""

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillworks.operators.carried import BATCH_BYTES, as_batches, give_back, rows_of


def codec_name(column: Column) -> Column:
    """NONE, ZLIB or SNAPPY from a configured name, whatever its case; unknown names mean NONE."""
    lowered = F.lower(column)
    return F.when(lowered == "zlib", "ZLIB").when(lowered == "snappy", "SNAPPY").otherwise("NONE")


def codec_warned(column: Column) -> Column:
    return ~F.coalesce(F.lower(column).isin("none", "off", "zlib", "snappy"), F.lit(False))


def _snappy_size(data: bytes) -> int:
    """Output size: the little-endian base-128 number at the start of raw snappy data."""
    size = shift = 0
    for byte in data[:5]:
        size |= (byte & 0x7F) << shift
        if byte < 0x80:
            return size
        shift += 7
    raise ValueError("bad length")


def _deflate(codec: str, data: bytes, level: int, snappy) -> bytes:
    if not data or codec == "NONE":
        return data
    return zlib.compress(data, level) if codec == "ZLIB" else snappy.compress(data, asbytes=True)


class _TooLarge(ValueError):
    pass


def _inflate(codec: str, data: bytes, level: int, snappy, most: int | None) -> bytes:
    if not data or codec == "NONE":
        return data
    if codec == "SNAPPY":
        size = _snappy_size(data)
        if most is not None and size > most:
            raise _TooLarge
        return snappy.decompress(data, size, asbytes=True)
    stream = zlib.decompressobj()
    out = stream.decompress(data, 0 if most is None else most + 1)
    if most is not None and len(out) > most:
        raise _TooLarge
    if not stream.eof:
        raise ValueError("incomplete")
    return out


def _apply(step, codec_col: str, data_col: str, level: int):
    """Rows leave in batches of about BATCH_BYTES of payloads and outputs, so that memory follows these and not the batches that come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        snappy = pa.Codec("snappy")
        for batch in batches:
            out: list[bytes | None] = []
            reasons: list[str | None] = []
            codecs, payloads, start, size = batch.column(codec_col), batch.column(data_col), 0, 0
            for i in range(batch.num_rows):
                data, result, reason = payloads[i].as_py(), None, None
                try:
                    result = None if data is None else step(codecs[i].as_py(), data, level, snappy)
                except _TooLarge:
                    reason = "too_large"
                except (ValueError, OSError, zlib.error):
                    reason = "damaged"
                out.append(result)
                reasons.append(reason)
                size += len(data or b"") + len(result or b"")
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(out, pa.binary()), pa.array(reasons, pa.string())], names=[*batch.schema.names, "output", "output_reason"])
                    start, size, out, reasons = i + 1, 0, [], []
        give_back()

    return run


def _job(df: DataFrame, step, codec: str, data: str, level: int) -> DataFrame:
    named = df.withColumn("codec_used", codec_name(F.col(codec)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
    return named.mapInArrow(_apply(step, "codec_used", data, level), f"{fields}, output binary, output_reason string")


def compress(df: DataFrame, codec: str, data: str, level: int = 6) -> DataFrame:
    """Adds `codec_used` and `output`; the zlib level is held within 1 to 9."""
    return _job(df, _deflate, codec, data, max(1, min(9, level))).drop("output_reason")


def decompress(df: DataFrame, codec: str, data: str, max_bytes: int | None = None) -> DataFrame:
    """Adds `codec_used`, `output` and `output_reason`.

    Data that can't be read gives a NULL output and the reason `damaged`. A caller may set `max_bytes`;
    what inflates beyond it gives a NULL output and the reason `too_large`.
    """
    return _job(df, partial(_inflate, most=max_bytes), codec, data, 0)


#: Raw snappy data can't grow further than this: a copy of 64 bytes takes 3.
_SNAPPY_GROWTH = 64


def _parts(codec: str | None, data: bytes | None, size: int, snappy) -> Iterator[bytes]:
    """The output of one payload in parts of at most `size` bytes, without more than one of them in memory for zlib."""
    if not data:
        return
    if codec == "ZLIB":
        stream = zlib.decompressobj()
        while not stream.eof:
            out = stream.decompress(data, size)
            data = stream.unconsumed_tail
            if out:
                yield out
            elif not data and not stream.eof:
                raise ValueError("incomplete")
        return
    if codec == "SNAPPY":
        if _snappy_size(data) > _SNAPPY_GROWTH * len(data):
            raise ValueError("impossible length")
        data = _inflate(codec, data, 0, snappy, None)
    for at in range(0, len(data), size):
        yield data[at:at + size]


def decompress_parts(df: DataFrame, keys: list[str], codec: str, data: str, part_bytes: int = 1 << 20) -> DataFrame:
    """(keys, part, status, bytes): the output of each payload in numbered parts of at most `part_bytes`, so that an output of any
    size takes no memory of its size.

    A row without bytes comes last and says how it ended: `ok`, or `damaged` after the parts that could be read. A NULL or empty
    payload has that row alone. Raw snappy data can be no more than 64 times its size, and is opened whole."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, part int, status string, bytes binary"
    out = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)

    def opened(rows: Iterator[tuple]) -> Iterator[tuple]:
        snappy = pa.Codec("snappy")
        for row in rows:
            part, status = 0, "ok"
            try:
                for piece in _parts(row[n], row[n + 1], part_bytes, snappy):
                    yield (*row[:n], part, None, piece)
                    part += 1
            except (ValueError, OSError, zlib.error):
                status = "damaged"
            yield (*row[:n], part, status, None)

    chosen = df.select(*keys, codec_name(F.col(codec)), F.col(data))
    return chosen.mapInArrow(lambda batches: as_batches(opened(rows_of(batches)), out), schema)


def compression_ratio(df: DataFrame, by: list[str], original: Column, compressed: Column) -> DataFrame:
    """Compressed size as a percentage of the original size."""
    sums = df.groupBy(*by).agg(F.sum(original).alias("original_bytes"), F.sum(compressed).alias("compressed_bytes"))
    return sums.withColumn("ratio", F.when(
        F.col("original_bytes") > 0, F.col("compressed_bytes") / F.col("original_bytes") * 100).otherwise(F.lit(0.0)))
