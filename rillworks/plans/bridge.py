"""Log-domain views over the given tables, spelled once for both SQL dialects.

The base tables differ per dialect; every further view is the same text, with a few function names
substituted. Views are row-wise (no window), so they add no shuffle to the queries that read them.
"""

from pyspark.sql import DataFrame, SparkSession

BASES = ("events", "documents", "orders", "customer")

_FUNCTIONS = {
    "spark": {"@bytes(": "octet_length(", "@lf": "char(10)"},
    "duck": {"@bytes(": "strlen(", "@lf": "chr(10)"},
}

_EV = {
    "spark": """SELECT event_id, ts, user_id, event_type, value, props,
  k, unix_micros(cast(ts AS timestamp)) AS us,
  date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS t_iso,
  date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') AS t_ms,
  date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS t_s, date_format(ts, 'yyyy-MM-dd') AS d
FROM events LATERAL VIEW inline(array(named_struct('k', cast(get_json_object(props, '$.k') AS int)))) p AS k""",
    "duck": """SELECT event_id, ts, user_id, event_type, value, props,
  cast(json_extract_string(props, '$.k') AS int) AS k, epoch_us(ts) AS us,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t_iso,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS t_ms,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS t_s, strftime(ts, '%Y-%m-%d') AS d
FROM events""",
}

# One pair of (columns, rows) for the small dimensions.
TASKS = """SELECT * FROM (VALUES
  ('1001', '/var/log/app/*.log', 'clicks', 'near'),
  ('1002', '/var/log/app/err*.log', 'faults', 'near'),
  ('1003', '/var/log/orders/*.log', 'orders', 'far'),
  ('1004', '/var/log/signups/*.log', 'signups', 'other')) AS t(task_id, log_path, topic, cluster_id)"""
CLUSTERS = """SELECT * FROM (VALUES
  ('near', 'kafka'), ('far', 'kafka')) AS t(cluster_id, kind)"""


def _swapped(digits: str, size: int) -> str:
    """SQL for big-endian hex digits in little-endian byte order."""
    return " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size)))


# Hex digits of the header integers; in Spark behind a one-row generator, so they are computed once.
_DIGITS = {
    "dt": "lpad(hex(cast(mtype AS bigint)), 4, '0')",
    "dn": "lpad(hex(cast(@bytes(payload) AS bigint)), 8, '0')",
    "dk": """CASE WHEN wire_task = '18446744073709551615' THEN 'FFFFFFFFFFFFFFFF' ELSE lpad(hex(CASE
    WHEN wire_task = '18446744073709551615' THEN cast(0 AS bigint) ELSE cast(wire_task AS bigint) END), 16, '0') END""",
    "dof": "lpad(hex(cast(wire_offset AS bigint)), 16, '0')",
    "dp": "hex(payload)",
}
_FRAME_DIGITS = {
    "duck": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _DIGITS.items()) + " FROM v_frame_parts",
    "spark": "SELECT * FROM v_frame_parts LATERAL VIEW inline(array(named_struct("
    + ", ".join(f"'{n}', {e}" for n, e in _DIGITS.items()) + "))) x AS " + ", ".join(_DIGITS),
}

_LOG_JSON = """'", "message": "' || event_type || ' ' || event_id ||
  '", "service": "service-' || (user_id % 10) || '", "host": "host-' || (user_id % 5) ||
  '", "request_id": "req-' || event_id || '", "user_id": "user_' || user_id ||
  '", "duration_ms": ' || (k * 7 + 1) || ', "status_code": ' ||
  CASE k % 9 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 400 WHEN 3 THEN 401 WHEN 4 THEN 403
    WHEN 5 THEN 404 WHEN 6 THEN 500 WHEN 7 THEN 502 ELSE 503 END ||
  ', "metadata": {"cpu_usage": ' || k || ', "memory_usage": ' || (k % 50) ||
  ', "disk_usage": ' || (k % 30) || '}}'"""

_LEVEL = """CASE WHEN k = 99 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
  WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END"""

_VIEWS = {
    "v_tasks": TASKS,
    "v_clusters": CLUSTERS,
    "v_lines": """SELECT event_id, us, user_id, event_type, k, d, t_s, 'agent-' || user_id AS agent_id,
  CASE event_type WHEN 'click' THEN '1001' WHEN 'error' THEN '1002' WHEN 'purchase' THEN '1003'
    WHEN 'signup' THEN '1004' ELSE '1005' END AS task_id,
  '/var/log/' || user_id || '.log' AS file_path,
  t_s || ' - ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' - ' ||
    event_type || ' ' || props AS line FROM ev""",
    "v_chunks": """SELECT user_id, agent_id, task_id, file_path, event_id AS seq, us, event_id, line,
  cast(@bytes(line) + 1 AS bigint) AS length FROM v_lines""",
    "v_frame_parts": """SELECT event_id, us, user_id, event_type, k, agent_id, line, event_id % 41 AS defect,
  CASE WHEN event_id % 41 = 5 THEN 9 WHEN event_id % 37 = 0 THEN 3 WHEN event_id % 37 = 1 THEN 4
    WHEN event_id % 37 = 2 THEN 2 ELSE 1 END AS mtype,
  CASE WHEN event_id % 41 <> 5 AND event_id % 37 IN (0, 2) THEN ''
    WHEN event_id % 41 <> 5 AND event_id % 37 = 1
      THEN '{"lines_collected": ' || k || ', "bytes_collected": ' || (k * 10) || '}'
    ELSE line END AS payload,
  CASE WHEN event_id % 41 <> 5 AND event_id % 37 IN (0, 1) THEN '0'
    WHEN event_type = 'view' THEN '18446744073709551615' ELSE task_id END AS wire_task,
  CASE WHEN event_id % 41 <> 5 AND event_id % 37 IN (0, 1) THEN 0 ELSE event_id * 4096 END AS wire_offset
FROM v_lines""",
    "v_frame_hex": "SELECT *, 'BEBAFECA0001' || " + " || ".join(
        _swapped(n, size) for n, size in (("dt", 2), ("dn", 4), ("dk", 8), ("dof", 8)))
    + " || dp AS clean_hex FROM v_frame_digits",
    "v_frames": """SELECT *, CASE defect
    WHEN 0 THEN '00' || substr(clean_hex, 3) WHEN 1 THEN substr(clean_hex, 1, 8) || '0002' || substr(clean_hex, 13)
    WHEN 2 THEN substr(clean_hex, 1, 40) WHEN 3 THEN substr(clean_hex, 1, length(clean_hex) - 2)
    WHEN 4 THEN clean_hex || 'FFFF' ELSE clean_hex END AS raw_hex FROM v_frame_hex""",
    "v_messages": """SELECT event_id, user_id, us, k, event_type,
  CASE event_type WHEN 'click' THEN 'clicks' WHEN 'error' THEN 'faults'
    WHEN 'purchase' THEN 'orders' WHEN 'signup' THEN 'signups' ELSE 'views' END AS topic,
  cast(user_id % 3 AS int) AS partition, event_id AS offset, us + k * 100000 AS arrival_us,
  CASE WHEN event_id % 5000 = 9 THEN t_iso || ' ' || repeat('x', 1048577 - 27)
    WHEN event_id % 50 = 0 THEN '{"timestamp": "' || t_iso || '", "message": "no level ' || event_id || '"}'
    WHEN event_id % 50 = 2 THEN ''
    WHEN event_id % 50 = 3 THEN '   '
    WHEN event_id % 50 = 4 THEN 'plain text ' || event_id || ' ' || t_iso
    WHEN event_id % 50 = 5 THEN '{"timestamp": "2024-01-01T00:00:00Z", "level": "INFO", "message": "same"}'
    WHEN event_id % 50 = 6 THEN '' || event_id
    WHEN event_id % 50 = 7 THEN '["timestamp", ' || event_id || ']'
    WHEN event_id % 50 = 8 THEN '{"timestamp": ' || us || ', "level": "INFO", "message": "numeric"}'
    ELSE '{"timestamp": "' || CASE WHEN event_id % 50 = 1 THEN '2024-13-45 ' ELSE '' END || t_iso ||
      '", "level": "' || @level || @json END AS value
FROM ev""".replace("@level", f"({_LEVEL})").replace("@json", _LOG_JSON),
    "v_json_logs": """SELECT event_id, user_id, k, us, '{"timestamp": "' || t_iso || '", "level": "' || @level || @json AS line
FROM ev""".replace("@level", f"({_LEVEL})").replace("@json", _LOG_JSON),
    "v_reports": """SELECT event_id AS seq, us, user_id, event_type, k, d, 'agent-' || user_id AS agent_id,
  CASE event_type WHEN 'click' THEN '1001' WHEN 'error' THEN '1002' WHEN 'purchase' THEN '1003'
    WHEN 'signup' THEN '1004' ELSE '1005' END AS task_id,
  cast(k AS bigint) AS lines, cast(k * 10 AS bigint) AS bytes, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS errors,
  k % 4 AS fast_files, k % 3 AS slow_files, k % 10 <> 3 AS ok FROM ev""",
    "v_files": """SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN '/var/log/app/new/' ELSE '/var/log/app/' || source || '/' END
    || doc_id || CASE WHEN doc_id % 23 = 0 THEN '.tmp' ELSE '.log' END AS path,
  cast(@bytes(text) AS bigint) AS size, 1704067200 + doc_id * 60 AS mtime, text AS content, source
FROM documents WHERE doc_id % 17 <> 1""",
    "v_files_prev": """SELECT doc_id, '/var/log/app/' || source || '/' || doc_id ||
    CASE WHEN doc_id % 23 = 0 THEN '.tmp' ELSE '.log' END AS path,
  cast(CASE WHEN doc_id % 13 = 0 AND doc_id % 19 <> 0 THEN @bytes(text) - 1 ELSE @bytes(text) END AS bigint) AS size,
  1704067200 + doc_id * 60 - CASE WHEN doc_id % 13 = 0 AND doc_id % 19 <> 0 THEN 30 ELSE 0 END AS mtime,
  text AS content FROM documents WHERE doc_id % 11 <> 0""",
    "v_checkpoints": """SELECT doc_id, path, size // 2 AS offset,
  CASE WHEN doc_id % 14 = 0 THEN size + 1 ELSE size END AS file_size FROM v_files WHERE doc_id % 7 <> 3""",
    "v_task_docs": """SELECT o_orderkey, o_orderkey AS doc_id, o_custkey, o_orderstatus,
  '{"tasks": [{"task_id": ' || CASE WHEN o_orderkey % 13 = 0 THEN '' || o_custkey ELSE '"' || o_custkey || '"' END ||
  ', "log_path_pattern": "' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/var/log/' || o_orderkey || '/*.log' END ||
  '", "kafka_topic": "t-' || o_orderstatus || '", "properties": {"kafka_cluster_id": "c1", "p": ' ||
  CASE WHEN o_orderkey % 11 = 0 THEN '5' ELSE '"5"' END || '}}, {"task_id": "' || (o_custkey + o_orderkey % 2) ||
  '", "log_path_pattern": "/data/b.log", "kafka_topic": "u"' ||
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ', "properties": {"kafka_cluster_id": "c2"}' END ||
  '}, {"task_id": "z", "log_path_pattern": "/data/z.log", "kafka_topic": "v", "properties": {"kafka_cluster_id": "c3"}}]' ||
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '}' END AS document FROM orders""",
    "v_control_docs": """SELECT o_orderkey, o_orderkey AS doc_id, o_custkey, o_orderstatus,
  '{' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"cversion": ' || o_orderkey || ', ' END ||
  '"tasks": [{"task_id": ' || CASE WHEN o_orderkey % 13 = 0 THEN '"' || o_custkey || '"' ELSE '' || o_custkey END ||
  ', "task_name": "task ' || o_custkey || '", "log_path_pattern": "/var/log/a.log", "version": ' || (o_orderkey % 4) ||
  ', "message_queue": {' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '"type": "pulsar", ' END ||
  '"version": "3.x", "cluster_id": "c-' || o_orderstatus || '", "topic": "t"}, "properties": {"x": 1}}, ' ||
  '{"log_path_pattern": "/b.log"}]' || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '}' END AS document FROM orders""",
    "v_task_ids": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' || (o_orderkey + 1) WHEN 1 THEN '18446744073709551615'
  WHEN 2 THEN '00' || (o_custkey + 1) WHEN 3 THEN '18446744073709551616' ELSE 'task-' || o_custkey END AS task_id FROM orders""",
    "v_task_sets": """SELECT o_orderkey, 'agent-' || o_custkey AS agent, 't-' || o_orderkey AS task_id,
  '/var/log/' || o_orderkey || '.log' AS log_path_pattern, 'topic-' || o_orderstatus AS kafka_topic, o_orderstatus FROM orders""",
    "v_prop_files": """SELECT c_custkey, c_nationkey, c_name AS host, '# Relay ' || c_custkey || @lf || @lf ||
  'relay.id = relay-' || c_custkey || @lf || 'server.io_threads = 1' || @lf || '  server.io_threads =  ' ||
  CASE c_custkey % 4 WHEN 0 THEN '16x' WHEN 1 THEN 'abc' WHEN 2 THEN '4' ELSE '99999999999' END || '  ' || @lf ||
  '! note' || @lf || 'noequals' || @lf || 'kafka.enable_compression = ' ||
  CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' ELSE 'TRUE' END || @lf || 'zookeeper.hosts = a:1, b:2,,c' || c_nationkey ||
  ':3 ' || @lf || 'kafka.default_props.acks=1=x' || @lf || 'mq.kafka.cluster.kc-' || c_nationkey || '.brokers = k1:9092,k2:9092' ||
  @lf || 'mq.kafka.cluster.kc-' || c_nationkey || '.version = 3.x' || @lf || 'mq.kafka.cluster.kc-' || c_nationkey ||
  '.props.compression.type = snappy' || @lf || 'mq.rabbitmq.cluster.rb-1.hosts = rabbit1:5672' AS content FROM customer""",
    "v_log_text": """SELECT event_id, '[' || t_ms || '] ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' ||
  CASE event_id % 9 WHEN 0 THEN 'Request processed: method=GET, path=/api/' || event_type || ', status=200, latency=' || k || 'ms'
    WHEN 1 THEN 'Database query: query=SELECT * FROM table_' || user_id || ' WHERE id = ' || event_id || ', duration=' || k || 'ms, rows=' || (k % 7)
    WHEN 2 THEN 'Cache operation: operation=SET, key=cache:key:' || user_id || ', hit=true'
    WHEN 3 THEN 'User action: user_id=user_' || user_id || ', action=' || event_type || ', ip=10.0.0.' || k
    WHEN 4 THEN 'System metric: cpu=' || k || '%, memory=' || (k % 50) || '%, disk=' || (k % 9) || '%'
    WHEN 5 THEN 'Network traffic: src=10.0.0.1, dst=10.0.0.2, bytes=' || event_id || ', protocol=TCP'
    WHEN 6 THEN 'Error occurred: error_type=TimeoutError, message=Error message ' || k || ', stack=stack_trace_' || k
    WHEN 7 THEN 'Authentication: user=user_' || user_id || ', result=success, method=token'
    ELSE 'Default log entry ' || event_id END AS line FROM ev""",
    "v_ops_lines": """SELECT event_id, us, task_id, CASE event_id % 11 WHEN 0 THEN 'Backpressure applied to session'
  WHEN 1 THEN 'send BUFFER is now full' WHEN 2 THEN 'slow kafka consumer group' WHEN 3 THEN 'kafka too slow, reconnecting'
  WHEN 4 THEN 'Reconnect attempt ' || k WHEN 5 THEN 'Connection to relay lost' WHEN 6 THEN 'connection was restored'
  WHEN 7 THEN 'buffer low' WHEN 8 THEN 'full buffer' ELSE line END AS line FROM v_lines""",
}

_NEEDS = {
    "v_lines": ["ev"], "v_chunks": ["v_lines"], "v_frame_parts": ["v_lines"], "v_frame_digits": ["v_frame_parts"], "v_frame_hex": ["v_frame_digits"],
    "v_frames": ["v_frame_hex"], "v_messages": ["ev"], "v_json_logs": ["ev"], "v_reports": ["ev"],
    "v_checkpoints": ["v_files"], "v_log_text": ["ev"], "v_ops_lines": ["v_lines"],
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in seen:
            seen.append(name)

    for n in names:
        visit(n)
    return seen


def _text(name: str, dialect: str) -> str:
    sql = {"ev": _EV, "v_frame_digits": _FRAME_DIGITS}[name][dialect] if name not in _VIEWS else _VIEWS[name]
    for token, spelled in _FUNCTIONS[dialect].items():
        sql = sql.replace(token, spelled)
    return sql.replace("size // 2", "size div 2") if dialect == "spark" else sql


def ctes(*names: str) -> str:
    """DuckDB prelude `WITH view AS (...), ...` for the views and what they need."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_text(n, 'duck')})" for n in _order(list(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes at most.
TASK_ROWS = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Input of few splits (small or unsplittable files, large row groups) over all cores, and as many tasks as its rows need,
    before shuffles and after them."""
    spark = df.sparkSession
    needed = -(-df.count() // TASK_ROWS)
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", needed)
    tasks = max(spark.sparkContext.defaultParallelism, needed)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge view as a DataFrame."""
    sql = "WITH " + ",\n".join(f"{n} AS ({_text(n, 'spark')})" for n in _order([name])) + f" SELECT * FROM {name}"
    used = {}
    for base in BASES:
        if f"FROM {base}" in sql:
            used[base] = spread(table(spark, sf_dir, base))
            sql = sql.replace(f"FROM {base}", f"FROM {base}_rows")
    for base, rows in used.items():
        rows.createOrReplaceTempView(f"{base}_rows")
    return spark.sql(sql)
