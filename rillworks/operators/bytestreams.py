"""Frames and lines from chunks of byte streams that are cut at arbitrary places.

A single connection or file may hold a large share of all bytes, so no stream is walked by one task:
streams are cut into fixed segments that are worked on independently, and only one small row per
segment is combined per stream.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillworks.model import HEADER_BYTES, LARGEST_FRAME, MAGIC, VERSION
from rillworks.operators.carried import as_batches, rows_of, walk
from rillworks.operators.ordered import block_of, running_sums

SEGMENT_BYTES = 1 << 20
_START = MAGIC.to_bytes(4, "little") + VERSION.to_bytes(2, "little")


def segments(chunks: DataFrame, stream: str, seq: str, data: str, size: int = SEGMENT_BYTES,
             block_bits: int = 16) -> DataFrame:
    """(stream, segment, body): the stream cut every `size` bytes, each body followed by the bytes of
    the next segment that a header starting at its last byte may need."""
    halo = HEADER_BYTES - 1
    sized = chunks.select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), F.col(data).alias("data"),
                          F.octet_length(data).cast("bigint").alias("n")).filter("n > 0")
    placed = running_sums(sized, ["stream"], ["seq"], {"at": F.col("n")}, block_of("seq", block_bits))
    cut = placed.withColumn("segment", F.explode(F.expr(
        f"sequence(greatest(at - {halo}, 0) div {size}, (at + n - 1) div {size})")))
    ends = cut.select(
        "stream", "segment", "at", "data",
        F.greatest("at", F.col("segment") * size).alias("lo"),
        F.least(F.col("at") + F.col("n"), (F.col("segment") + 1) * size + halo).alias("hi"))
    piece = F.substring("data", (F.col("lo") - F.col("at") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    parts = ends.select("stream", "segment", "lo", piece.alias("piece"))
    return parts.groupBy("stream", "segment").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY lo)").alias("body"))


def _frame_end(body: bytes, at: int) -> int | None:
    """End of the frame at a local position, None where no header of this version starts, or of too long a frame."""
    if body[at:at + 6] != _START or at + HEADER_BYTES > len(body):
        return None
    size = HEADER_BYTES + int.from_bytes(body[at + 8:at + 12], "little")
    return at + size if size <= LARGEST_FRAME else None


def _marks(size: int):
    """For each segment: (stream, at, segment, last, leave) for every place that looks like a header, where
    `leave` is where the frames from there leave the segment and `last` the frame that does; and
    (stream, leave, NULL, NULL, NULL) for each such exit, once."""
    def marks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for stream, segment, body in rows:
            starts, at = [], body.find(_START)
            while 0 <= at < size:
                starts.append(at)
                at = body.find(_START, at + 1)
            leaves: dict[int, tuple[int, int]] = {}
            for at in reversed(starts):
                end = _frame_end(body, at)
                if end is not None:
                    leaves[at] = (at, end) if end >= size else leaves.get(end, (at, -1))
            base = segment * size
            for at, (last, end) in leaves.items():
                yield stream, base + at, segment, base + last, base + end if end >= 0 else -1
            for end in {end for _, end in leaves.values() if end >= 0}:
                yield stream, base + end, None, None, None

    return marks


def _path(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The places that are reached from position 0."""
    reached = 0
    for at, segment, last, leave in rows:
        if at == reached:
            yield (*key, segment, at, last, leave)
            reached = leave


def _cut(size: int):
    """The frames that lie within their segment, from the segment's entry on."""
    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        for stream, segment, entry, body in rows:
            at = entry - segment * size
            while at < size:
                end = _frame_end(body, at)
                if end is None or end > size:
                    break
                yield stream, segment * size + at, body[at:end]
                at = end

    return found


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    out = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: as_batches(function(rows_of(batches)), out), schema)


def frames(chunks: DataFrame, stream: str, seq: str, data: str, size: int = SEGMENT_BYTES,
           block_bits: int = 16) -> DataFrame:
    """(stream, position, raw) of every complete frame; a bad header ends its stream.

    A frame start is only known once the frame before it is, so it is found in two passes over the
    segments. Pass one computes, for every place in a segment that looks like a header, where the
    frames from there leave the segment. Almost all places share one exit, so the places that are
    themselves exits form a short path per stream. Pass two cuts each segment from its entry on the
    path. The frame that leaves a segment is put together from the segments it covers.
    """
    kind = chunks.schema[stream].dataType.simpleString()
    cut = segments(chunks, stream, seq, data, size, block_bits).select("stream", "segment", "body")
    marks = _mapped(cut, _marks(size), f"stream {kind}, at bigint, segment bigint, last bigint, leave bigint")
    places = marks.groupBy("stream", "at").agg(
        F.max("segment").alias("segment"), F.max("last").alias("last"), F.max("leave").alias("leave"),
        F.bool_or(F.col("segment").isNull()).alias("is_exit")).filter("segment IS NOT NULL AND (is_exit OR at = 0)")
    path = walk(places, ["stream"], ["at"], ["at", "segment", "last", "leave"], _path,
                f"stream {kind}, segment bigint, entry bigint, last bigint, leave bigint")
    inside = _mapped(cut.join(path, ["stream", "segment"]).select("stream", "segment", "entry", "body"), _cut(size),
                     f"stream {kind}, position bigint, raw binary")

    crossing = path.filter(F.col("leave") > (F.col("segment") + 1) * size).select(
        "stream", F.col("last").alias("position"), "leave",
        F.explode(F.expr(f"sequence(last div {size}, (leave - 1) div {size})")).alias("segment"))
    lo = F.greatest("position", F.col("segment") * size)
    hi = F.least("leave", (F.col("segment") + 1) * size)
    piece = F.substring("body", (lo - F.col("segment") * size + 1).cast("int"), (hi - lo).cast("int"))
    joined = (cut.join(crossing, ["stream", "segment"])
              .select("stream", "position", "leave", "segment", piece.alias("piece"))
              .groupBy("stream", "position", "leave")
              .agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY segment)").alias("raw"))
              .filter(F.octet_length("raw") == F.col("leave") - F.col("position")))
    columns = [F.col("stream").alias(stream), "position", "raw"]
    return inside.select(*columns).unionByName(joined.select(*columns))


def lines(chunks: DataFrame, keys: list[str], seq: str, data: str, block_bits: int = 16) -> DataFrame:
    """(keys, line_no, line BINARY, complete) from chunks cut at arbitrary bytes.

    The number of line feeds before a chunk numbers its lines. Lines inside one chunk stay where they
    are; only the first and last piece of a chunk are shuffled, by line, to be joined with their other
    parts. Bytes are handled as ISO-8859-1 text, one character per byte, so characters cut in half
    are whole again in the line. The last line of a stream is not complete without its line feed.
    """
    text = F.decode(data, "ISO-8859-1")
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    counted = chunks.select(*keys, F.col(seq).alias("_seq"), text.alias("_text"), feeds.cast("bigint").alias("_feeds"))
    numbered = running_sums(counted, keys, ["_seq"], {"_first": F.col("_feeds")}, block_of("_seq", block_bits))
    pieces = numbered.select(*keys, "_seq", "_first", "_feeds",
                             F.posexplode(F.split("_text", "\n", -1)).alias("_i", "_piece"))
    row = pieces.select(
        *keys, (F.col("_first") + F.col("_i")).alias("line_no"), "_seq", "_piece",
        ((F.col("_i") > 0) & (F.col("_i") < F.col("_feeds"))).alias("_whole"),
        (F.col("_i") < F.col("_feeds")).alias("_ended"))
    inner = row.filter("_whole").select(*keys, "line_no", F.col("_piece").alias("_line"), F.lit(True).alias("complete"))
    edges = (row.filter("NOT _whole AND (_ended OR _piece <> '')").groupBy(*keys, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_piece"))),
                                 lambda p: p["_piece"]), "").alias("_line"),
        F.bool_or("_ended").alias("complete")))
    return inner.unionByName(edges).select(
        *keys, "line_no", F.encode("_line", "ISO-8859-1").alias("line"), "complete")
