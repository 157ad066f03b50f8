"""Readers for configuration, listings, reports and topics, each with an explicit schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.model import SYSTEM_SAMPLE_SCHEMA, TEST_RESULT_SCHEMA


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of text files, one row per file: configuration documents, properties, checkpoints."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def file_listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size, mtime, content) of files. Content is only read by plans that use it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), "content")


def system_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SYSTEM_SAMPLE_SCHEMA).csv(path, header=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_system_metrics\.csv$", 1).alias("run"), "*")


def test_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows; a message may hold commas, so the line is split at its first three only."""
    lines = spark.read.text(path).select(F.split("value", ",", 4).alias("p")).filter(
        (F.size("p") == 4) & (F.col("p")[0] != "timestamp"))
    columns = [c.split()[0] for c in TEST_RESULT_SCHEMA.split(", ")]
    return lines.select(F.try_to_timestamp(F.col("p")[0]).alias(columns[0]),
                        *[F.col("p")[i].alias(c) for i, c in enumerate(columns) if i])


def topic(spark: SparkSession, servers: str, name: str, streaming: bool = False) -> DataFrame:
    """Topic rows from the earliest offset. Needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option(
        "startingOffsets", "earliest").load()


def messages(topic_rows: DataFrame) -> DataFrame:
    """Audit messages from rows with the topic schema; key and value are UTF-8 text."""
    return topic_rows.select("topic", "partition", "offset", F.col("timestamp").alias("arrival"),
                             F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
