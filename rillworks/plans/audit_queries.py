"""Audit queries over the messages view."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.functions.once import once
from rillworks.operators import audit
from rillworks.plans.bridge import ctes, view


def messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_messages")
    return once(rows.withColumnRenamed("value", "text"), value=F.col("text")).select(
        "topic", "partition", "offset", F.timestamp_micros("arrival_us").alias("arrival"), "value")


def classify(spark, sf):
    return audit.classify(messages(spark, sf)).drop("late")


def duplicates(spark, sf):
    return audit.duplicates(messages(spark, sf))


def late(spark, sf):
    return audit.late_messages(messages(spark, sf))


def validation_summary(spark, sf):
    out = audit.validation_summary(audit.classify(messages(spark, sf)))
    return out.withColumn("topic", F.coalesce("topic", F.lit("ALL")))


def error_breakdown(spark, sf):
    return audit.error_breakdown(audit.classify(messages(spark, sf)), ["topic"])


def validation_report(spark, sf):
    """The nested report of each topic, its parts as columns; the breakdown as text."""
    rows = messages(spark, sf)
    out = audit.report(audit.classify(rows), rows, ["topic"])
    pairs = F.transform(F.array_sort(F.map_entries("error_breakdown")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("topic", "validation_summary.*", "performance_metrics.*", F.array_join(pairs, ",").alias("errors"))


def throughput(spark, sf):
    return audit.throughput(messages(spark, sf), ["topic"])


def bounded_read(spark, sf):
    out = audit.bounded_read(messages(spark, sf), 10 * 86400, 100)
    return out.select("topic", "partition", "offset", "read_no")


QUERIES = {
    "classify": classify,
    "duplicates": duplicates,
    "late": late,
    "validation_summary": validation_summary,
    "error_breakdown": error_breakdown,
    "validation_report": validation_report,
    "throughput": throughput,
    "bounded_read": bounded_read,
}

# Expected reasons from the source columns, not from the message text.
_CLASSIFIED = ctes("v_messages") + """,
expected AS (SELECT topic, partition, "offset", arrival_us, k, event_id, strlen(value) AS n,
  CASE WHEN event_id % 5000 = 9 THEN 'oversize' ELSE CASE event_id % 50 WHEN 0 THEN 'missing:level'
    WHEN 1 THEN 'bad_timestamp' WHEN 2 THEN 'empty' WHEN 3 THEN 'blank' WHEN 6 THEN 'exception'
    WHEN 7 THEN 'missing:level' WHEN 8 THEN 'exception' ELSE 'valid' END END AS base FROM v_messages),
classified AS (SELECT *, CASE WHEN event_id % 50 = 5 AND row_number() OVER (
    PARTITION BY topic, event_id % 50 ORDER BY arrival_us, partition, "offset") > 1
  THEN 'duplicate' ELSE base END AS reason,
  CASE WHEN event_id % 5000 = 9 THEN false WHEN event_id % 50 IN (1, 2, 3, 4, 6, 7, 8) THEN false
    WHEN event_id % 50 = 5 THEN arrival_us - epoch_us(TIMESTAMP '2024-01-01 00:00:00') > 5000000
    ELSE k > 50 END AS late FROM expected)
"""

ORACLE = {
    "classify": _CLASSIFIED + 'SELECT topic, partition, "offset", reason FROM classified',
    "duplicates": _CLASSIFIED + "SELECT topic, partition, \"offset\" FROM classified WHERE reason = 'duplicate'",
    "late": _CLASSIFIED + 'SELECT topic, partition, "offset" FROM classified WHERE late',
    "validation_summary": _CLASSIFIED + """
SELECT coalesce(topic, 'ALL') AS topic, count(*) AS total_messages,
  count(*) FILTER (reason = 'valid') AS valid_messages, count(*) FILTER (reason <> 'valid') AS invalid_messages,
  count(*) FILTER (reason = 'duplicate') AS duplicate_messages, count(*) FILTER (late) AS late_messages,
  count(*) FILTER (reason = 'valid') / count(*) * 100 AS success_rate
FROM classified GROUP BY ROLLUP (topic)""",
    "error_breakdown": _CLASSIFIED + """
SELECT topic, reason, count(*) AS messages FROM classified WHERE reason <> 'valid' GROUP BY topic, reason""",
    "validation_report": _CLASSIFIED + """,
t AS (SELECT topic, count(*) AS total_messages, cast(sum(n) AS bigint) AS bytes_received, (max(arrival_us) - min(arrival_us)) / 1e6 AS duration_seconds,
  count(*) FILTER (reason = 'valid') AS valid_messages, count(*) FILTER (reason <> 'valid') AS invalid_messages,
  count(*) FILTER (reason = 'duplicate') AS duplicate_messages, count(*) FILTER (late) AS late_messages FROM classified GROUP BY topic),
e AS (SELECT topic, string_agg(reason || '=' || c, ',' ORDER BY reason) AS errors FROM (
  SELECT topic, reason, count(*) AS c FROM classified WHERE reason <> 'valid' GROUP BY ALL) GROUP BY topic)
SELECT t.*, valid_messages / total_messages * 100 AS success_rate, total_messages / duration_seconds AS throughput_msgs_per_sec,
  bytes_received / duration_seconds AS bytes_per_sec, bytes_received / total_messages AS avg_msg_size, errors FROM t JOIN e USING (topic)""",
    "throughput": ctes("v_messages") + """
, t AS (SELECT topic, count(*) AS messages, cast(sum(strlen(value)) AS bigint) AS bytes_received,
  (max(arrival_us) - min(arrival_us)) / 1e6 AS duration_seconds FROM v_messages GROUP BY topic)
SELECT *, CASE WHEN duration_seconds > 0 THEN messages / duration_seconds ELSE 0.0 END AS throughput_msgs_per_sec,
  CASE WHEN duration_seconds > 0 THEN bytes_received / duration_seconds ELSE 0.0 END AS bytes_per_sec,
  bytes_received / messages AS avg_msg_size FROM t""",
    "bounded_read": ctes("v_messages") + """
, opened AS (SELECT topic, min(arrival_us) AS o FROM v_messages GROUP BY topic)
SELECT topic, partition, "offset", read_no FROM (SELECT m.topic, partition, "offset",
  cast(row_number() OVER (PARTITION BY m.topic ORDER BY arrival_us, partition, "offset") AS int) AS read_no
  FROM v_messages m JOIN opened USING (topic) WHERE arrival_us <= o + 864000000000) WHERE read_no <= 100""",
}
