"""Log parsing queries."""

from pyspark.sql import functions as F

from rillworks.functions.once import once
from rillworks.operators import logparse
from rillworks.plans.bridge import ctes, view
from rillworks.plans.config_queries import pairs_text


def parse_text_logs(spark, sf):
    rows = view(spark, sf, "v_log_text").select("event_id", "line")
    out = logparse.parse_text(once(rows.withColumnRenamed("line", "text"), line=F.col("text")).drop("text"), "line")
    return out.select("event_id", "stamp", "level", "layout", pairs_text("fields").alias("fields"))


def parse_shell_logs(spark, sf):
    out = logparse.parse_shell(view(spark, sf, "v_lines").select("event_id", "line"), "line")
    return out.select("event_id", F.unix_seconds("stamp").alias("second"), "level", "message")


def _json_logs(spark, sf):
    return logparse.parse_json(view(spark, sf, "v_json_logs").select("event_id", "line"), "line")


def parse_json_logs(spark, sf):
    return _json_logs(spark, sf).select(
        "event_id", "timestamp", "level", "message", "service", "host", "request_id", F.col("user_id").alias("user"),
        "duration_ms", "status_code", "metadata.cpu_usage", "metadata.memory_usage", "metadata.disk_usage")


def log_breakdown(spark, sf):
    return logparse.breakdown(_json_logs(spark, sf), ["service", "host"], exact=True)


def level_counts(spark, sf):
    return logparse.level_counts(_json_logs(spark, sf), ["status_code"])


def keyword_alerts(spark, sf):
    rows = view(spark, sf, "v_ops_lines").select("task_id", "line", F.timestamp_micros("us").alias("ts"))
    return logparse.keyword_alerts(rows, "line", "ts", ["task_id"], "1 day").select(
        "task_id", "alert", F.unix_seconds("interval_start").alias("interval_start"), "lines")


def resource_breaches(spark, sf):
    rows = view(spark, sf, "v_reports").select(
        F.col("d").alias("run"), F.col("k").cast("double").alias("cpu_percent"), (F.col("k") * 25).cast("double").alias("memory_used_mb"))
    return logparse.resource_breaches(rows, "run")


def recoveries(spark, sf):
    rows = view(spark, sf, "v_reports").select("task_id", "seq", F.timestamp_micros("us").alias("ts"))
    out = logparse.recoveries(rows, "task_id", "ts", "seq", 3600)
    return out.select("task_id", F.unix_micros("outage_start").alias("outage_start"),
                      F.unix_micros("outage_end").alias("outage_end"), "recovery_seconds", "within_limit")


QUERIES = {f.__name__: f for f in (
    parse_text_logs, parse_shell_logs, parse_json_logs, log_breakdown, level_counts, keyword_alerts,
    resource_breaches, recoveries)}

_LOGS = ctes("v_json_logs") + """,
logs AS (SELECT line ->> '$.service' AS service, line ->> '$.host' AS host, line ->> '$.level' AS level,
  cast(line ->> '$.duration_ms' AS bigint) AS duration, cast(line ->> '$.status_code' AS int) AS status_code FROM v_json_logs)
"""
_LEVELS = ", ".join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL"))

ORACLE = {
    "parse_text_logs": ctes("ev") + """
SELECT event_id, t_ms AS stamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  ['request', 'query', 'cache', 'user', 'system', 'network', 'error', 'auth', 'default'][event_id % 9 + 1] AS layout,
  CASE event_id % 9 WHEN 0 THEN 'latency=' || k || ',method=GET,path=/api/' || event_type || ',status=200'
    WHEN 1 THEN 'duration=' || k || ',query=SELECT * FROM table_' || user_id || ' WHERE id = ' || event_id || ',rows=' || (k % 7)
    WHEN 2 THEN 'hit=true,key=cache:key:' || user_id || ',operation=SET' WHEN 3 THEN 'action=' || event_type || ',ip=10.0.0.' || k || ',user_id=user_' || user_id
    WHEN 4 THEN 'cpu=' || k || ',disk=' || (k % 9) || ',memory=' || (k % 50) WHEN 5 THEN 'bytes=' || event_id || ',dst=10.0.0.2,protocol=TCP,src=10.0.0.1'
    WHEN 6 THEN 'error_type=TimeoutError,message=Error message ' || k || ',stack=stack_trace_' || k
    WHEN 7 THEN 'method=token,result=success,user=user_' || user_id ELSE '' END AS fields FROM ev""",
    "parse_shell_logs": ctes("v_lines") + """
SELECT event_id, us // 1000000 AS second, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  event_type || ' {"k": ' || k || '}' AS message FROM v_lines""",
    "parse_json_logs": ctes("v_json_logs", "ev") + """
SELECT e.event_id, t_iso AS timestamp, CASE WHEN e.k = 99 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
    WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  event_type || ' ' || e.event_id AS message, 'service-' || (e.user_id % 10) AS service, 'host-' || (e.user_id % 5) AS host,
  'req-' || e.event_id AS request_id, 'user_' || e.user_id AS "user", cast(e.k * 7 + 1 AS bigint) AS duration_ms,
  cast([200, 201, 400, 401, 403, 404, 500, 502, 503][e.k % 9 + 1] AS int) AS status_code,
  e.k AS cpu_usage, e.k % 50 AS memory_usage, e.k % 30 AS disk_usage FROM ev e""",
    "log_breakdown": _LOGS + f"""
SELECT service, host, count(*) AS logs, count(*) FILTER (status_code >= 500) AS server_errors, max(duration) AS max_duration,
  quantile_cont(duration, 0.5) AS p50, quantile_cont(duration, 0.95) AS p95, {_LEVELS} FROM logs GROUP BY ALL""",
    "level_counts": _LOGS + f"SELECT status_code, {_LEVELS} FROM logs GROUP BY ALL",
    "keyword_alerts": ctes("v_ops_lines") + """
SELECT task_id, alert, us // 86400000000 * 86400 AS interval_start, count(*) AS lines FROM (
  SELECT task_id, us, 'backpressure' AS alert FROM v_ops_lines WHERE event_id % 11 IN (0, 1, 2, 3)
  UNION ALL SELECT task_id, us, 'reconnect' FROM v_ops_lines WHERE event_id % 11 IN (3, 4, 5, 6)) GROUP BY ALL""",
    "resource_breaches": ctes("v_reports") + """
SELECT d AS run, count(*) FILTER (k > 80) AS cpu_breaches, count(*) FILTER (k * 25 > 2048) AS memory_breaches,
  cast(max(k) AS double) AS cpu_peak, cast(max(k * 25) AS double) AS memory_peak FROM v_reports GROUP BY d""",
    "recoveries": ctes("v_reports") + """
SELECT task_id, before AS outage_start, us AS outage_end, (us - before) / 1e6 AS recovery_seconds,
  (us - before) / 1e6 <= 60 AS within_limit FROM (SELECT task_id, us, lag(us) OVER (PARTITION BY task_id ORDER BY us, seq) AS before
  FROM v_reports) WHERE us - before > 3600000000""",
}
