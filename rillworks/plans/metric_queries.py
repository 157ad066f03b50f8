"""Metrics, exposition, liveness and audit-report queries."""

from pyspark.sql import functions as F

from rillworks.functions.once import once
from rillworks.operators import audit, metrics
from rillworks.operators.ordered import block_of
from rillworks.plans.bridge import ctes, view

GAP_SECONDS = 12 * 3600  # longer silences end an agent's life
NOW_US = 1706659200_000000  # 2024-01-31, the end of the event period


def reports(spark, sf):
    return view(spark, sf, "v_reports")


def delta_reports(spark, sf):
    return metrics.delta_reports(reports(spark, sf), ["agent_id", "task_id"], "seq", {
        "lines_collected": "lines", "bytes_collected": "bytes", "error_count": "errors"}, "ok", block_of("seq"))


def counters(spark, sf):
    return reports(spark, sf).groupBy("agent_id", "task_id").agg(
        F.sum("lines").alias("lines_collected"), F.sum("bytes").alias("bytes_collected"), F.sum("errors").alias("error_count"),
        F.max_by("fast_files", "seq").alias("fast_files"), F.max_by("slow_files", "seq").alias("slow_files"))


def metrics_doc(spark, sf):
    return metrics.metrics_documents(counters(spark, sf), "agent_id", F.lit(NOW_US // 1_000_000))


def nested_reports(spark, sf):
    """A nested report per event with its own and a second task; some members missing, some broken."""
    text = """concat('{"timestamp": ', us div 1000000, ', "tasks": [{"task_id": "', task_id, '"',
      CASE WHEN k % 5 = 0 THEN '' ELSE concat(', "lines_collected": ', lines) END, ', "bytes_collected": ', bytes,
      ', "error_count": ', errors, CASE WHEN k % 6 = 0 THEN '' ELSE concat(', "fast_files": ', fast_files) END,
      ', "slow_files": ', slow_files, '}, {"task_id": "all", "lines_collected": 1}]}')"""
    broken = F.when(F.col("k") % 29 == 0, F.lit('{"timestamp": 1, "tasks": [')).otherwise(F.expr(text))
    return once(reports(spark, sf).select("agent_id", "seq", "us", "k", "task_id", "lines", "bytes", "errors",
                                          "fast_files", "slow_files"), document=broken).select(
        "agent_id", "us", "seq", "document")


def metrics_accumulate(spark, sf):
    return metrics.accumulate(nested_reports(spark, sf), "agent_id", ["us", "seq"], "document")


def metrics_last(spark, sf):
    text = """concat('{"lines_collected": ', lines, CASE WHEN k % 4 = 0 THEN '' ELSE concat(', "bytes_collected": ', bytes) END,
      ', "files_watched": ', fast_files + slow_files, '}')"""
    broken = F.when(F.col("k") % 29 == 0, F.lit('{"lines_collected": 5')).otherwise(F.expr(text))
    rows = once(reports(spark, sf).select("agent_id", "us", "seq", "k", "lines", "bytes", "fast_files", "slow_files"), document=broken)
    return metrics.last_values(rows, "agent_id", ["us", "seq"], "document")


def connections(spark, sf):
    changes = reports(spark, sf).select(
        (F.col("user_id") % 3).alias("relay_id"), "seq", "us", F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("change"))
    return metrics.connection_gauge(changes, "relay_id", ["seq"], block_of("seq"))


def active_connections(spark, sf):
    return metrics.connection_summary(connections(spark, sf), "relay_id", ["seq"])


def status_30s(spark, sf):
    gauge = connections(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    return metrics.status_rows(gauge, "relay_id", "ts", ["seq"], until=F.timestamp_micros(F.lit(NOW_US))).select(
        "relay_id", F.unix_seconds("interval_start").alias("interval_start"), "active")


def report_window(spark, sf):
    rows = reports(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    return metrics.report_intervals(rows, ["task_id"], "ts", {"lines_collected": "lines", "bytes_collected": "bytes"}).select(
        "task_id", F.unix_seconds("interval_start").alias("interval_start"), "lines_collected", "bytes_collected")


def agent_liveness(spark, sf):
    return _alive(spark, sf).withColumn("last_seen", F.unix_micros("last_seen"))


def _alive(spark, sf):
    beats = reports(spark, sf).select("agent_id", "seq", F.timestamp_micros("us").alias("ts"))
    return metrics.liveness(beats, "agent_id", "ts", "seq", gap_seconds=GAP_SECONDS)


def agent_registry(spark, sf):
    rows = reports(spark, sf).select(
        "agent_id", "seq", F.concat(F.lit("host-"), F.col("k")).alias("hostname"), F.lit("active").alias("status"))
    now = F.timestamp_micros(F.lit(NOW_US))
    return metrics.registry(rows, _alive(spark, sf), "agent_id", ["seq"], now, ["hostname", "status"],
                            gap_seconds=GAP_SECONDS).withColumn("last_seen", F.unix_micros("last_seen"))


def agent_events(spark, sf):
    """Every report is a beat; those of some kinds carry the host and its state."""
    rows = reports(spark, sf).select("agent_id", "seq", F.timestamp_micros("us").alias("ts"), "event_type", "k")
    info = F.when(F.col("event_type").isin("signup", "view"), F.concat(F.lit("host-"), (F.col("k") % 3).cast("string")))
    return metrics.life_events(rows, "agent_id", "ts", "seq", info, F.timestamp_micros(F.lit(NOW_US)), GAP_SECONDS, 86_400)


def agents_up(spark, sf):
    return metrics.registered(agent_events(spark, sf), "agent_id")


FAMILIES = {
    "agent_lines_collected_total": ("counter", "Lines read so far per agent and task"),
    "agent_bytes_collected_total": ("counter", "Bytes read so far per agent and task"),
    "agent_error_count_total": ("counter", "Failed reads so far per agent and task"),
    "agent_fast_files": ("gauge", "Files polled at the short interval now"),
}


def exposition_lines(spark, sf):
    named = counters(spark, sf).withColumnsRenamed({
        "lines_collected": "agent_lines_collected_total", "bytes_collected": "agent_bytes_collected_total",
        "error_count": "agent_error_count_total", "fast_files": "agent_fast_files"})
    return metrics.exposition(named, FAMILIES, ["agent_id", "task_id"])


RELAY_FAMILIES = {"relay_active_connections": ("gauge", "Agent connections open now"), "relay_connections_opened_total": ("counter", "Agent connections opened so far")}
QUEUE_FAMILIES = {"queue_messages_sent_total": ("counter", "Messages the queue confirmed, per cluster"), "queue_messages_failed_total": ("counter", "Messages the queue refused, per cluster")}
WATCH_FAMILIES = {"agent_files_watched": ("gauge", "Files watched now, per polling kind")}


def exposition_fleet(spark, sf):
    """Connections per relay, queue counts per cluster, and files watched per agent, task and kind."""
    rows = reports(spark, sf)
    relays = active_connections(spark, sf).select("relay_id", F.col("active").alias("relay_active_connections"), F.col("opened").alias("relay_connections_opened_total"))
    queues = rows.groupBy(F.col("task_id").alias("cluster_id")).agg(
        F.count_if("ok").alias("queue_messages_sent_total"), F.count_if(~F.col("ok")).alias("queue_messages_failed_total"))
    watched = counters(spark, sf).select("agent_id", "task_id", F.inline(F.array(
        F.struct(F.lit("fast").alias("kind"), F.col("fast_files").alias("agent_files_watched")),
        F.struct(F.lit("slow").alias("kind"), F.col("slow_files").alias("agent_files_watched")))))
    return metrics.exposition_of(spark, [(relays, RELAY_FAMILIES, ["relay_id"]), (queues, QUEUE_FAMILIES, ["cluster_id"]), (watched, WATCH_FAMILIES, ["agent_id", "task_id", "kind"])])


def metrics_json(spark, sf):
    """A document per relay and page of 500 users."""
    keys = ["relay_id", "page"]
    rows = reports(spark, sf).withColumn("relay_id", F.col("user_id") % 3).withColumn("page", F.expr("user_id div 500"))
    agents = rows.groupBy(*keys, "agent_id").agg(
        F.sum("lines").alias("lines_collected"), F.sum("bytes").alias("bytes_collected"), F.sum("errors").alias("error_count"),
        F.max("fast_files").alias("files_watched"))
    queues = rows.groupBy(*keys, F.col("task_id").alias("cluster_id")).agg(
        F.count_if("ok").alias("messages_sent"), F.count_if(~F.col("ok")).alias("messages_failed"))
    return metrics.metrics_json(agents, queues, keys)


def topic_positions(spark, sf):
    m = view(spark, sf, "v_messages").select(
        "topic", "partition", "offset", F.when(F.col("us") < F.lit(1705276800_000000), "before").otherwise("after").alias("phase"))
    seen = m.unionByName(m.filter("phase = 'before'").withColumn("phase", F.lit("after")))
    return audit.topic_positions(seen)


def completeness(spark, sf):
    rows = reports(spark, sf).select("agent_id", "k", "seq")
    return audit.completeness(rows, rows.filter("k % 13 <> 5 OR seq % 3 = 0"), "agent_id")


def runs(spark, sf):
    return reports(spark, sf).groupBy(F.col("d").alias("run")).agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(F.col("k") % 30 != 4).alias("valid_messages"),
        ((F.max("us") - F.min("us")).cast("decimal(20,0)") / 1000000).cast("decimal(20,6)").alias("duration_seconds"))


def run_rollup(spark, sf):
    """Runs of both halves of the month as one set, per week and over all."""
    week = F.concat(F.lit("w"), F.expr("cast(substr(run, 9, 2) AS int) div 7"))
    first = runs(spark, sf).filter("run < '2024-01-15'")
    second = runs(spark, sf).filter("run >= '2024-01-15'")
    return audit.run_rollup(first.unionByName(second).withColumn("week", week), ["week"])


def verdicts(spark, sf):
    rated = runs(spark, sf).select(
        "run", audit.percent("valid_messages", "total_messages").alias("success_rate"),
        (F.col("total_messages") * 5).cast("double").alias("throughput"))
    return audit.verdicts(rated, F.lit(2100.0), 1000.0)


def session_verdict(spark, sf):
    """The runs of each week as one set."""
    week = F.concat(F.lit("w"), F.expr("cast(substr(run, 9, 2) AS int) div 7"))
    return audit.session_verdict(runs(spark, sf).withColumn("week", week), ["week"], 0.0039)


def suite_verdict(spark, sf):
    """Tests named by agent: some pass always, some fail."""
    rows = reports(spark, sf).select(F.col("agent_id").alias("suite"), F.when(F.col("k") < 90 + F.col("user_id") % 11, "PASS").otherwise("FAIL").alias("result"))
    return audit.suite_verdict(audit.result_tally(rows, ["suite"]))


def result_tally(spark, sf):
    rows = reports(spark, sf).select(F.col("task_id").alias("test_name"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("result"))
    return audit.result_tally(rows, ["test_name"])


QUERIES = {f.__name__: f for f in (
    delta_reports, metrics_doc, metrics_accumulate, metrics_last, active_connections, status_30s, report_window,
    agent_liveness, agent_registry, exposition_lines, metrics_json, topic_positions, completeness, run_rollup,
    verdicts, result_tally, agent_events, agents_up, exposition_fleet, session_verdict, suite_verdict)}

_REPORTS = ctes("v_reports")
_COUNTERS = _REPORTS + """,
counters AS (SELECT agent_id, task_id, cast(sum(lines) AS bigint) AS l, cast(sum(bytes) AS bigint) AS b,
  cast(sum(errors) AS bigint) AS e, arg_max(fast_files, seq) AS ff, arg_max(slow_files, seq) AS sf FROM v_reports GROUP BY ALL)
"""
_RUNS = _REPORTS + """,
runs AS (SELECT d AS run, count(*) AS total, count(*) FILTER (k % 30 <> 4) AS valid,
  cast(max(us) - min(us) AS decimal(20,0)) / 1000000 AS secs FROM v_reports GROUP BY d)
"""
_GAUGE = """,
changes AS (SELECT user_id % 3 AS relay_id, seq, us, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS change FROM v_reports),
gauge AS (SELECT *, cast(sum(change) OVER (PARTITION BY relay_id ORDER BY seq) AS bigint) AS active FROM changes)
"""
_BEATS = _REPORTS + f""",
beats AS (SELECT agent_id, us, us - lag(us) OVER (PARTITION BY agent_id ORDER BY us, seq) AS silence
  FROM v_reports),
alive AS (SELECT agent_id, count(*) AS beats, count(*) FILTER (silence > {GAP_SECONDS * 1_000_000}) AS silences,
  coalesce(max(silence), 0) AS longest_silence_us, max(us) AS last_seen FROM beats GROUP BY ALL)
"""

_CONNECTIONS = _REPORTS + _GAUGE
_LIFE = _REPORTS + f""",
told AS (SELECT agent_id, us, seq, CASE WHEN event_type IN ('signup', 'view') THEN 'host-' || (k % 3) END AS info FROM v_reports),
linked AS (SELECT *, lag(us) OVER w AS before, lead(us) OVER w AS after, last_value(info IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS known,
  last_value(info IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old
  FROM told WINDOW w AS (PARTITION BY agent_id ORDER BY us, seq)),
events AS (SELECT agent_id, CASE WHEN before IS NULL OR us - before > {GAP_SECONDS * 1_000_000} THEN 'up' ELSE 'changed' END AS event, us, known AS info FROM linked
  WHERE before IS NULL OR us - before > {GAP_SECONDS * 1_000_000} OR (info IS NOT NULL AND info IS DISTINCT FROM old)
  UNION ALL SELECT agent_id, 'down', us, known FROM linked WHERE coalesce(after, {NOW_US}) - us > {GAP_SECONDS * 1_000_000})
"""

ORACLE = {
    "delta_reports": _REPORTS + """,
numbered AS (SELECT *, cast(coalesce(sum(cast(ok AS int)) OVER (PARTITION BY agent_id, task_id ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS segment FROM v_reports)
SELECT agent_id, task_id, segment, max(seq) AS last_seq, bool_or(ok) AS sent, count(*) AS reports,
  cast(sum(lines) AS bigint) AS lines_collected, cast(sum(bytes) AS bigint) AS bytes_collected,
  cast(sum(errors) AS bigint) AS error_count FROM numbered GROUP BY agent_id, task_id, segment""",
    "metrics_doc": _COUNTERS + f"""
SELECT agent_id, '{{"timestamp":{NOW_US // 1_000_000},"tasks":[' || string_agg('{{"task_id":"' || task_id || '","lines_collected":' || l ||
  ',"bytes_collected":' || b || ',"error_count":' || e || ',"fast_files":' || ff || ',"slow_files":' || sf || '}}', ',' ORDER BY task_id)
  || ']}}' AS document FROM counters GROUP BY agent_id""",
    "metrics_accumulate": _REPORTS + """,
good AS (SELECT * FROM v_reports WHERE k % 29 <> 0)
SELECT agent_id, task_id, cast(sum(CASE WHEN k % 5 = 0 THEN 0 ELSE lines END) AS bigint) AS lines_collected,
  cast(sum(bytes) AS bigint) AS bytes_collected, cast(sum(errors) AS bigint) AS error_count,
  cast(coalesce(arg_max(fast_files, seq) FILTER (k % 6 <> 0), 0) AS bigint) AS fast_files,
  cast(arg_max(slow_files, seq) AS bigint) AS slow_files FROM good GROUP BY ALL
UNION ALL SELECT agent_id, 'all', count(*), 0, 0, 0, 0 FROM good GROUP BY ALL""",
    "metrics_last": _REPORTS + """,
last AS (SELECT agent_id, arg_max(k, seq) AS k, arg_max(lines, seq) AS lines, arg_max(bytes, seq) AS bytes,
  arg_max(fast_files + slow_files, seq) AS f FROM v_reports WHERE k % 29 <> 0 GROUP BY ALL)
SELECT agent_id, lines AS lines_collected, CASE WHEN k % 4 = 0 THEN 0 ELSE bytes END AS bytes_collected,
  cast(0 AS bigint) AS error_count, cast(f AS bigint) AS files_watched FROM last""",
    "active_connections": _CONNECTIONS + """
SELECT relay_id, count(*) FILTER (change > 0) AS opened, count(*) FILTER (change < 0) AS closed, max(active) AS peak,
  arg_max(active, seq) AS active FROM gauge GROUP BY relay_id""",
    "status_30s": _CONNECTIONS + f""",
ends AS (SELECT relay_id, unnest(generate_series(min(us) // 30000000 * 30, greatest(max(us), {NOW_US}) // 30000000 * 30, 30)) AS interval_start
  FROM changes GROUP BY relay_id)
SELECT e.relay_id, interval_start, active FROM ends e ASOF JOIN (SELECT relay_id, us, arg_max(active, seq) AS active FROM gauge GROUP BY ALL) g
  ON e.relay_id = g.relay_id AND (e.interval_start + 30) * 1000000 > g.us""",
    "report_window": _REPORTS + """
SELECT task_id, us // 10000000 * 10 AS interval_start, cast(sum(lines) AS bigint) AS lines_collected,
  cast(sum(bytes) AS bigint) AS bytes_collected FROM v_reports GROUP BY ALL""",
    "agent_liveness": _BEATS + "SELECT * FROM alive",
    "agent_registry": _BEATS + f"""
SELECT r.agent_id, 'host-' || arg_max(k, seq) AS hostname, 'active' AS status, last_seen
FROM v_reports r JOIN alive USING (agent_id) WHERE {NOW_US} - last_seen <= {GAP_SECONDS * 1_000_000}
GROUP BY r.agent_id, last_seen""",
    "exposition_lines": _COUNTERS + ", heads(i, name, kind, help) AS (VALUES " + ", ".join(
        f"({i}, '{n}', '{k}', '{h}')" for i, (n, (k, h)) in enumerate(FAMILIES.items())) + """)
SELECT cast(i AS int) AS family_no, 0 AS line_no, '# HELP ' || name || ' ' || help AS line FROM heads
UNION ALL SELECT cast(i AS int), 1, '# TYPE ' || name || ' ' || kind FROM heads
UNION ALL SELECT cast(i AS int), 2, name || '{agent_id="' || agent_id || '",task_id="' || task_id || '"} ' ||
  CASE i WHEN 0 THEN l WHEN 1 THEN b WHEN 2 THEN e ELSE ff END FROM counters, heads""",
    "metrics_json": _REPORTS + """,
base AS (SELECT *, user_id % 3 AS relay_id, user_id // 500 AS page FROM v_reports),
a AS (SELECT relay_id, page, string_agg('{"agent_id":"' || agent_id || '","lines_collected":' || l || ',"bytes_collected":' || b ||
  ',"error_count":' || e || ',"files_watched":' || f || '}', ',' ORDER BY agent_id) AS agents FROM (
  SELECT relay_id, page, agent_id, sum(lines) AS l, sum(bytes) AS b, sum(errors) AS e, max(fast_files) AS f FROM base GROUP BY ALL) GROUP BY ALL),
q AS (SELECT relay_id, page, string_agg('{"cluster_id":"' || task_id || '","messages_sent":' || s || ',"messages_failed":' || f || '}', ','
  ORDER BY task_id) AS queues FROM (SELECT relay_id, page, task_id, count(*) FILTER (ok) AS s, count(*) FILTER (NOT ok) AS f
  FROM base GROUP BY ALL) GROUP BY ALL)
SELECT relay_id, page, '{"agent_metrics":[' || agents || '],"mq_metrics":[' || queues || ']}' AS document FROM a JOIN q USING (relay_id, page)""",
    "topic_positions": ctes("v_messages") + """,
ends AS (SELECT topic, partition, coalesce(max("offset") FILTER (us < 1705276800000000) + 1, 0) AS b, max("offset") + 1 AS a
  FROM v_messages GROUP BY ALL)
SELECT topic, cast(sum(b) AS bigint) AS position_before, cast(sum(a) AS bigint) AS position_after,
  cast(sum(a - b) AS bigint) AS processed FROM ends GROUP BY topic""",
    "completeness": _REPORTS + """,
c AS (SELECT agent_id, count(*) AS produced, count(*) FILTER (k % 13 <> 5 OR seq % 3 = 0) AS consumed FROM v_reports GROUP BY ALL)
SELECT *, abs(produced - consumed) AS difference, CASE WHEN abs(produced - consumed) > 5 THEN 'mismatch'
  WHEN consumed < 10 THEN 'too_few' ELSE 'pass' END AS verdict FROM c""",
    "run_rollup": _RUNS + """
SELECT 'w' || (cast(substr(run, 9, 2) AS int) // 7) AS week, count(*) AS runs, cast(sum(total) AS bigint) AS total_messages,
  cast(sum(valid) AS bigint) AS valid_messages, cast(sum(cast(secs AS decimal(20,6))) AS double) AS duration_seconds,
  max(total / secs) AS peak_throughput, cast(sum(valid) / sum(total) * 100 AS double) AS success_rate,
  cast(sum(total) / cast(sum(cast(secs AS decimal(20,6))) AS double) AS double) AS average_throughput FROM runs GROUP BY ALL""",
    "verdicts": _RUNS + """,
r AS (SELECT run, valid / total * 100 AS success_rate, cast(total * 5 AS double) AS throughput FROM runs)
SELECT *, array_to_string(list_filter([CASE WHEN success_rate < 95 THEN 'low_success_rate' END,
    CASE WHEN throughput < 1680 THEN 'low_throughput' END, CASE WHEN throughput < 1000 THEN 'peak_below_high_rate' END],
    lambda x: x IS NOT NULL), ',') AS advice, success_rate >= 95 AS passed, floor(throughput) >= 1000 AS stress_passed,
  CASE WHEN success_rate = 100 THEN 'good' WHEN success_rate >= 75 THEN 'mostly_good' ELSE 'poor' END AS tier FROM r""",
    "session_verdict": _RUNS + """,
w AS (SELECT 'w' || (cast(substr(run, 9, 2) AS int) // 7) AS week, count(*) AS runs, cast(sum(total) AS bigint) AS total_messages,
  avg(valid / total * 100) AS average_success_rate, cast(sum(total) / cast(sum(cast(secs AS decimal(20,6))) AS double) AS double) AS average_throughput,
  cast(max(total / secs) AS double) AS peak_throughput FROM runs GROUP BY ALL)
SELECT *, array_to_string(list_filter([CASE WHEN average_success_rate < 95 THEN 'low_success_rate' END,
  CASE WHEN peak_throughput < 0.0039 THEN 'peak_below_high_rate' END], lambda x: x IS NOT NULL), ',') AS advice FROM w""",
    "suite_verdict": _REPORTS + """,
t AS (SELECT agent_id AS suite, count(*) AS total_tests, count(*) FILTER (k < 90 + user_id % 11) AS passed_tests,
  count(*) FILTER (NOT k < 90 + user_id % 11) AS failed_tests, count(*) FILTER (k < 90 + user_id % 11) / count(*) * 100 AS success_rate FROM v_reports GROUP BY ALL)
SELECT *, CASE WHEN success_rate = 100 THEN 'good' WHEN success_rate >= 75 THEN 'mostly_good' ELSE 'poor' END AS tier FROM t""",
    "agent_events": _LIFE + "SELECT * FROM events",
    "agents_up": _LIFE + """
SELECT agent_id, arg_max(info, us * 2 + CASE WHEN event = 'down' THEN 1 ELSE 0 END) AS info, max(us) FILTER (event = 'up') AS since
FROM events GROUP BY agent_id HAVING arg_max(event, us * 2 + CASE WHEN event = 'down' THEN 1 ELSE 0 END) <> 'down'""",
    "exposition_fleet": _COUNTERS + _GAUGE + ", heads(i, name, kind, help) AS (VALUES " + ", ".join(
        f"({i}, '{n}', '{k}', '{h}')" for i, (n, (k, h)) in enumerate((RELAY_FAMILIES | QUEUE_FAMILIES | WATCH_FAMILIES).items())) + """),
relays AS (SELECT relay_id, count(*) FILTER (change > 0) AS opened, arg_max(active, seq) AS active FROM gauge GROUP BY relay_id),
queues AS (SELECT task_id, count(*) FILTER (ok) AS sent, count(*) FILTER (NOT ok) AS failed FROM v_reports GROUP BY task_id)
SELECT cast(i AS int) AS family_no, 0 AS line_no, '# HELP ' || name || ' ' || help AS line FROM heads
UNION ALL SELECT cast(i AS int), 1, '# TYPE ' || name || ' ' || kind FROM heads
UNION ALL SELECT 0, 2, 'relay_active_connections{relay_id="' || relay_id || '"} ' || active FROM relays
UNION ALL SELECT 1, 2, 'relay_connections_opened_total{relay_id="' || relay_id || '"} ' || opened FROM relays
UNION ALL SELECT 2, 2, 'queue_messages_sent_total{cluster_id="' || task_id || '"} ' || sent FROM queues
UNION ALL SELECT 3, 2, 'queue_messages_failed_total{cluster_id="' || task_id || '"} ' || failed FROM queues
UNION ALL SELECT 4, 2, 'agent_files_watched{agent_id="' || agent_id || '",task_id="' || task_id || '",kind="fast"} ' || ff FROM counters
UNION ALL SELECT 4, 2, 'agent_files_watched{agent_id="' || agent_id || '",task_id="' || task_id || '",kind="slow"} ' || sf FROM counters""",
    "result_tally": _REPORTS + """
SELECT task_id AS test_name, count(*) AS total_tests, count(*) FILTER (ok) AS passed_tests, count(*) FILTER (NOT ok) AS failed_tests,
  count(*) FILTER (ok) / count(*) * 100 AS success_rate FROM v_reports GROUP BY task_id""",
}
