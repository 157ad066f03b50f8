"""Schemas and fixed values shared by the operators."""

from pyspark.sql import types as T

# Wire format.
MAGIC = 0xCAFEBABE
VERSION = 0x0100
HEADER_BYTES = 28
MESSAGE_TYPES = {1: "DATA", 2: "ACK", 3: "HEARTBEAT", 4: "METRICS"}
CODEC_TYPES = {0: "NONE", 1: "ZLIB", 2: "SNAPPY"}

#: Bytes of a frame at most, header included: a longer one can be no row and ends its stream.
LARGEST_FRAME = 1 << 30

# Audit rules.
REQUIRED_FIELDS = ["timestamp", "level", "message"]
MAX_MESSAGE_CHARS = 1024 * 1024
LATE_SECONDS = 5
PASS_RATE = 95.0

# Flow control.
HIGH_WATERMARK_BYTES = 64 * 1024 * 1024
LOW_WATERMARK_BYTES = 32 * 1024 * 1024
FULL_SECONDS = 30

# Log levels and output rolling.
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
ROLL_SECONDS = 3600
ROLL_BYTES = 100 * 1024 * 1024

KAFKA_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
])

CHUNK_SCHEMA = "task_id STRING, file_path STRING, offset BIGINT, data BINARY"

JSON_LOG_STRUCT = (
    "STRUCT<timestamp: STRING, level: STRING, message: STRING, service: STRING, "
    "host: STRING, request_id: STRING, user_id: STRING, duration_ms: BIGINT, "
    "status_code: INT, metadata: STRUCT<cpu_usage: INT, memory_usage: INT, disk_usage: INT>>"
)

SYSTEM_SAMPLE_SCHEMA = (
    "timestamp TIMESTAMP, cpu_percent DOUBLE, memory_used_mb DOUBLE, disk_io_read_mb DOUBLE, "
    "disk_io_write_mb DOUBLE, network_rx_mb DOUBLE, network_tx_mb DOUBLE, kafka_messages BIGINT"
)

TEST_RESULT_SCHEMA = "timestamp TIMESTAMP, test_name STRING, result STRING, message STRING"
