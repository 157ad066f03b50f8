"""Binary frames: a little-endian header and a payload."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions.binary import read_le, write_le
from rillworks.functions.once import once
from rillworks.model import HEADER_BYTES, MAGIC, MESSAGE_TYPES, VERSION

# Header fields as (name, byte offset, size); "v1_compress" is the layout with a codec byte.
LAYOUTS = {
    "v1": [("magic", 0, 4), ("version", 4, 2), ("type", 6, 2), ("length", 8, 4),
           ("task_id", 12, 8), ("offset", 20, 8)],
    "v1_compress": [("magic", 0, 4), ("version", 4, 2), ("type", 6, 2), ("codec", 8, 1), ("reserved", 9, 3),
                    ("length", 12, 4), ("task_id", 16, 8), ("offset", 24, 8)],
}
TYPE_CODES = {name: code for code, name in MESSAGE_TYPES.items()}


def header_bytes(layout: str = "v1") -> int:
    _, start, size = LAYOUTS[layout][-1]
    return start + size


def type_label(code: Column) -> Column:
    label = F.lit("UNKNOWN")
    for value, name in MESSAGE_TYPES.items():
        label = F.when(code == value, name).otherwise(label)
    return label


def message(kind: str | Column, task_id: Column | None = None, offset: Column | None = None,
            payload: Column | None = None) -> Column:
    """Message struct of one kind, or of the kind that a column of type codes names: DATA takes everything, ACK no
    payload, METRICS only a payload, HEARTBEAT nothing."""
    code = F.lit(TYPE_CODES[kind]) if isinstance(kind, str) else kind
    none, zero = F.lit(b""), F.lit(0).cast("decimal(20,0)")
    of = lambda names, value, default: default if value is None else F.when(code.isin(*[TYPE_CODES[n] for n in names]), value).otherwise(default)
    body = of(("DATA", "METRICS"), None if payload is None else payload.cast("binary"), none)
    number = lambda value: of(("DATA", "ACK"), None if value is None else value.cast("decimal(20,0)"), zero)
    return F.struct(
        F.lit(MAGIC).cast("bigint").alias("magic"),
        F.lit(VERSION).alias("version"),
        code.cast("int").alias("type"),
        F.octet_length(body).cast("bigint").alias("length"),
        number(task_id).alias("task_id"),
        number(offset).alias("offset"),
        body.alias("payload"),
    )


def encode(msg: Column, layout: str = "v1", codec: Column | None = None) -> Column:
    """Frame bytes of a message struct."""
    extra = {"codec": codec if codec is not None else F.lit(0), "reserved": F.lit(0)}
    fields = [write_le(extra.get(name, msg[name] if name not in extra else None), size)
              for name, _, size in LAYOUTS[layout]]
    return F.concat(*fields, msg["payload"])


def decode(df: DataFrame, raw: str = "raw", layout: str = "v1") -> DataFrame:
    """Adds the header fields, `reject` (reason, or NULL for a good frame) and `payload`.

    Bytes after the payload are ignored. Fields are NULL where the frame is too small."""
    size = header_bytes(layout)
    body = F.col(raw)
    whole = F.octet_length(body) >= size
    header = once(df, **{name: F.when(whole, read_le(body, start, width))
                         for name, start, width in LAYOUTS[layout]})
    reject = (
        F.when(~F.coalesce(whole, F.lit(False)), "data too small")
        .when(F.col("magic") != MAGIC, "wrong magic number")
        .when(F.col("version") != VERSION, "unsupported version")
        .when(F.octet_length(body) < size + F.col("length"), "incomplete payload")
    )
    marked = header.withColumn("reject", reject)
    return marked.withColumn("payload", F.when(
        F.col("reject").isNull(), F.substring(body, F.lit(size + 1), F.col("length").cast("int"))))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject").isNull()).drop("reject")


def quarantined(decoded: DataFrame, keep: list[str]) -> DataFrame:
    """Rejected frames with their reason."""
    return decoded.filter(F.col("reject").isNotNull()).select(*keep, "reject")


def dispatch(frames: DataFrame) -> dict[str, DataFrame]:
    """Accepted frames per handled type; ACK and unknown types have no handler here."""
    return {name: frames.filter(F.col("type") == code)
            for code, name in MESSAGE_TYPES.items() if name != "ACK"}


def type_counts(frames: DataFrame) -> DataFrame:
    handled = F.col("type_label").isin("DATA", "HEARTBEAT", "METRICS")
    return (frames.groupBy(type_label(F.col("type")).alias("type_label"))
            .agg(F.count(F.lit(1)).alias("frames"), F.sum("length").alias("payload_bytes"))
            .withColumn("handled", handled))
