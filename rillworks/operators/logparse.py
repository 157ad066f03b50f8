"""Log line layouts, breakdowns of parsed logs, keyword alerts and resource limits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions.jsontext import with_document
from rillworks.functions.once import once
from rillworks.model import JSON_LOG_STRUCT, LEVELS
from rillworks.operators.ordered import neighbour, time_block

# Text layouts as (name, start of the message, fields in order).
TEXT_LAYOUTS = [
    ("request", "Request processed: ", ["method", "path", "status", "latency"]),
    ("query", "Database query: ", ["query", "duration", "rows"]),
    ("cache", "Cache operation: ", ["operation", "key", "hit"]),
    ("user", "User action: ", ["user_id", "action", "ip"]),
    ("system", "System metric: ", ["cpu", "memory", "disk"]),
    ("network", "Network traffic: ", ["src", "dst", "bytes", "protocol"]),
    ("error", "Error occurred: ", ["error_type", "message", "stack"]),
    ("auth", "Authentication: ", ["user", "result", "method"]),
    ("default", "Default log entry ", []),
]
TEXT_PATTERN = r"^\[([0-9-]{10} [0-9:]{8}\.[0-9]{3})\] (DEBUG|INFO|WARN|ERROR|FATAL) (.*)$"
SHELL_PATTERN = r"^([0-9-]{10} [0-9:]{8}) - ([A-Z]+) - (.*)$"
# Keyword alerts.
KEYWORDS = {
    "backpressure": r"(?i)backpressure|buffer.*full|slow.*consumer|kafka.*slow",
    "reconnect": r"(?i)reconnect|connection.*lost|connection.*restored",
}
# Resource limits.
CPU_LIMIT = 80
MEMORY_LIMIT_MB = 2048
RECOVERY_LIMIT_SECONDS = 60


def parse_text(df: DataFrame, line: str) -> DataFrame:
    """Adds stamp, level, layout and `fields`, a map of the layout's fields.

    Values may hold `=` and spaces, so each field ends where the next field of its layout begins."""
    part = lambda i: F.regexp_extract(line, TEXT_PATTERN, i)
    split = once(df, stamp=F.nullif(part(1), F.lit("")), level=F.nullif(part(2), F.lit("")), _rest=part(3))
    layout, fields = F.lit(None).cast("string"), F.create_map().cast("map<string, string>")
    for name, start, names in TEXT_LAYOUTS:
        hit = F.col("_rest").startswith(start)
        layout = F.when(hit, name).otherwise(layout)
        if names:
            pattern = ", ".join(f"{n}=(.*{'?' if n != names[-1] else ''})" for n in names)
            body = F.substring("_rest", F.lit(len(start) + 1), F.length("_rest"))
            value = lambda i, b=body, p=pattern: F.regexp_replace(F.regexp_extract(b, f"^{p}$", i), r"(?<=^[0-9]{1,9})(ms|%)$", "")
            pairs = [x for i, n in enumerate(names) for x in (F.lit(n), value(i + 1))]
            fields = F.when(hit, F.create_map(*pairs)).otherwise(fields)
    return split.select(*df.columns, "stamp", "level", layout.alias("layout"), fields.alias("fields"))


def parse_shell(df: DataFrame, line: str) -> DataFrame:
    """Adds stamp TIMESTAMP, level and message of `time - LEVEL - message` lines; NULL where not of that layout."""
    part = lambda i: F.regexp_extract(line, SHELL_PATTERN, i)
    split = once(df, _stamp=part(1), level=F.nullif(part(2), F.lit("")), message=F.nullif(part(3), F.lit("")))
    return split.withColumn("stamp", F.try_to_timestamp("_stamp", F.lit("yyyy-MM-dd HH:mm:ss"))).drop("_stamp")


def parse_json(df: DataFrame, line: str) -> DataFrame:
    """Adds the members of a JSON log line; NULL where not JSON."""
    strict = with_document(df, F.col(line), "_whole")
    whole = F.col("_whole").isNotNull()
    return once(strict, _log=F.when(whole, F.from_json(line, JSON_LOG_STRUCT))).select(*df.columns, "_log.*")


def level_counts(logs: DataFrame, by: list[str]) -> DataFrame:
    """One column of counts per level."""
    return logs.groupBy(*by).agg(*[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS])


def breakdown(logs: DataFrame, by: list[str], exact: bool = False) -> DataFrame:
    """Counts, server errors and duration percentiles. Exact percentiles keep a count per distinct
    duration, so they suit bounded durations; the default is the mergeable approximation."""
    at = lambda p: (F.percentile("duration_ms", p) if exact else F.percentile_approx("duration_ms", p))
    return logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("logs"), F.count_if(F.col("status_code") >= 500).alias("server_errors"),
        F.max("duration_ms").alias("max_duration"), at(0.5).alias("p50"), at(0.95).alias("p95"),
        *[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS])


def keyword_alerts(lines: DataFrame, line: str, time: str, by: list[str], every: str = "1 hour") -> DataFrame:
    """Lines per alert and interval; a line may raise several alerts."""
    hits = F.array_compact(F.array(*[F.when(F.col(line).rlike(p), n) for n, p in KEYWORDS.items()]))
    found = lines.select(*by, time, F.explode(hits).alias("alert"))
    return found.groupBy(*by, "alert", F.window(time, every).alias("_w")).agg(
        F.count(F.lit(1)).alias("lines")).select(*by, "alert", F.col("_w.start").alias("interval_start"), "lines")


def resource_breaches(samples: DataFrame, run: str) -> DataFrame:
    """Samples over the processor or memory limit and the peaks, per run."""
    cpu, memory = F.col("cpu_percent") > CPU_LIMIT, F.col("memory_used_mb") > MEMORY_LIMIT_MB
    return samples.groupBy(run).agg(
        F.count_if(cpu).alias("cpu_breaches"), F.count_if(memory).alias("memory_breaches"),
        F.max("cpu_percent").alias("cpu_peak"), F.max("memory_used_mb").alias("memory_peak"))


def recoveries(rows: DataFrame, key: str, time: str, seq: str, outage_seconds: int, block_seconds: int = 3600) -> DataFrame:
    """Outages (no row for longer than `outage_seconds`) with the time to the first row after them."""
    linked = neighbour(rows, [key], [time, seq], {"before": F.col(time)}, time_block(time, block_seconds))
    gap = (F.unix_micros(time) - F.unix_micros("before")) / 1e6
    return linked.filter(gap > outage_seconds).select(
        key, F.col("before").alias("outage_start"), F.col(time).alias("outage_end"), gap.alias("recovery_seconds"),
        (gap <= RECOVERY_LIMIT_SECONDS).alias("within_limit"))
