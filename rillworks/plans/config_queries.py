"""Configuration queries: task documents, differences, versions and fleet settings."""

from pyspark.sql import functions as F

from rillworks.operators import settings, tasks
from rillworks.plans.bridge import ctes, view


def pairs_text(column):
    """A map as `k=v` pairs in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def tasks_agent(spark, sf):
    out = tasks.agent_tasks(view(spark, sf, "v_task_docs"), "doc_id", "document")
    return out.withColumn("properties", pairs_text("properties"))


def tasks_agent_failed(spark, sf):
    docs = view(spark, sf, "v_task_docs")
    return tasks.failed_documents(docs, "doc_id", "document")


def tasks_required(spark, sf):
    return tasks.required_tasks(view(spark, sf, "v_task_docs"), "doc_id", "document")


def tasks_control(spark, sf):
    return tasks.control_tasks(view(spark, sf, "v_control_docs"), "doc_id", "document")


def _task_sets(spark, sf):
    rows = view(spark, sf, "v_task_sets")
    old = rows.filter("o_orderkey % 9 <> 0").select(
        "agent", "task_id", "log_path_pattern", "kafka_topic",
        F.create_map(F.lit("a"), "o_orderstatus", F.lit("b"), F.lit("1")).alias("properties"))
    new = rows.filter("o_orderkey % 8 <> 0").select(
        "agent", "task_id", "log_path_pattern",
        F.when(F.col("o_orderkey") % 6 == 0, "moved").otherwise(F.col("kafka_topic")).alias("kafka_topic"),
        F.when(F.col("o_orderkey") % 10 == 3, F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), "o_orderstatus"))
        .otherwise(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), "o_orderstatus")).alias("properties"))
    return old, new


def task_diff(spark, sf):
    old, new = _task_sets(spark, sf)
    return tasks.diff(old, new, ["agent", "task_id"])


def task_sets(spark, sf):
    old, new = _task_sets(spark, sf)
    return tasks.id_sets(old, new, ["agent", "task_id"])


def config_since(spark, sf):
    history = view(spark, sf, "v_reports").select(
        F.concat(F.lit("t"), F.col("user_id")).alias("task_id"), F.col("seq").alias("cversion"), "k", "event_type")
    return tasks.changed_since(history, "task_id", "cversion", 2000, ["k", "event_type"])


def _settings(spark, sf):
    return settings.parse_properties(view(spark, sf, "v_prop_files"), "host", "content")


def props_scan(spark, sf):
    return _settings(spark, sf)


def _hosts(spark, sf):
    """All hosts; one in ten has no file."""
    return view(spark, sf, "v_prop_files").select("host", "c_custkey")


def props_typed(spark, sf):
    rows = view(spark, sf, "v_prop_files").filter("c_custkey % 10 <> 0")
    prefix = "kafka.default_props."
    wide = settings.typed(settings.parse_properties(rows, "host", "content"), "host", {
        "server.io_threads": ("int", 8), "server.backlog": ("int", 128), "relay.id": ("text", "relay-0"),
        "kafka.enable_compression": ("bool", True), "zookeeper.hosts": ("list", None)}, [prefix], _hosts(spark, sf))
    shown = lambda key: F.array_join(F.col(f"`{key}`"), "|") if key == "zookeeper.hosts" else F.col(f"`{key}`").cast("string")
    single = F.array(*[F.struct(F.lit(k).alias("key"), shown(k).alias("typed")) for k in wide.columns if k not in ("host", prefix)])
    under = F.transform(F.map_entries(F.col(f"`{prefix}`")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("typed")))
    return wide.select("host", F.inline(F.concat(single, under)))


def cluster_dim(spark, sf):
    out = settings.clusters(_settings(spark, sf), ["host"])
    return out.withColumn("endpoints", F.array_join("endpoints", "|")).withColumn("options", pairs_text("options"))


#: Defaults of the layered settings, and the variables that override keys.
DEFAULTS = {"relay.id": "relay-001", "server.io_threads": "8", "server.listen_port": "9090", "monitor.host": "127.0.0.1", "kafka.enable_compression": "true"}
VARIABLES = {"RELAY_ID": "relay.id", "IO_THREADS": "server.io_threads", "MONITOR_HOST": "monitor.host"}


def config_layers(spark, sf):
    """All files and variables; listed hosts of their own have no file, half of them no variable either."""
    filed = _hosts(spark, sf)
    bare = filed.filter("c_custkey % 10 = 0").select(F.concat("host", F.lit("-new")).alias("host"), "c_custkey")
    env = filed.unionByName(bare.filter("c_custkey % 20 = 0")).select("host", F.inline(F.array(
        F.struct(F.lit("IO_THREADS").alias("name"), F.when(F.col("c_custkey") % 4 == 0, "16").alias("value")),
        F.struct(F.lit("RELAY_ID").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("r-env").alias("value")),
        F.struct(F.lit("HOME").alias("name"), F.lit("/root").alias("value")))))
    return settings.effective(env, _settings(spark, sf), "host", VARIABLES, DEFAULTS, bare)


QUERIES = {f.__name__: f for f in (
    tasks_agent, tasks_agent_failed, tasks_required, tasks_control, task_diff, task_sets, config_since, props_scan,
    props_typed, cluster_dim, config_layers)}

_FIRST = "o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0"
_SETS = ctes("v_task_sets") + """,
old AS (SELECT * FROM v_task_sets WHERE o_orderkey % 9 <> 0), new AS (SELECT * FROM v_task_sets WHERE o_orderkey % 8 <> 0)
"""
_SETTINGS = ctes("v_prop_files") + """,
wide AS (SELECT host, c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN '16x' WHEN 1 THEN 'abc' WHEN 2 THEN '4' ELSE '99999999999' END AS io,
  CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' ELSE 'TRUE' END AS comp FROM v_prop_files),
kv AS (SELECT host, c_custkey, unnest([
    {'key': 'relay.id', 'value': 'relay-' || c_custkey}, {'key': 'server.io_threads', 'value': io},
    {'key': 'kafka.enable_compression', 'value': comp}, {'key': 'zookeeper.hosts', 'value': 'a:1, b:2,,c' || c_nationkey || ':3'},
    {'key': 'kafka.default_props.acks', 'value': '1=x'},
    {'key': 'mq.kafka.cluster.kc-' || c_nationkey || '.brokers', 'value': 'k1:9092,k2:9092'},
    {'key': 'mq.kafka.cluster.kc-' || c_nationkey || '.version', 'value': '3.x'},
    {'key': 'mq.kafka.cluster.kc-' || c_nationkey || '.props.compression.type', 'value': 'snappy'},
    {'key': 'mq.rabbitmq.cluster.rb-1.hosts', 'value': 'rabbit1:5672'}], recursive := true) FROM wide)
"""

ORACLE = {
    "tasks_agent": ctes("v_task_docs") + """,
ok AS (SELECT * FROM v_task_docs WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0)
SELECT doc_id, cast(o_custkey AS varchar) AS task_id, '/var/log/' || o_orderkey || '/*.log' AS log_path_pattern,
  't-' || o_orderstatus AS kafka_topic, 'kafka_cluster_id=c1,p=5' AS properties FROM ok WHERE o_orderkey % 5 <> 0
UNION ALL SELECT doc_id, cast(o_custkey + o_orderkey % 2 AS varchar), '/data/b.log', 'u',
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'kafka_cluster_id=c2' END FROM ok
UNION ALL SELECT doc_id, 'z', '/data/z.log', 'v', 'kafka_cluster_id=c3' FROM ok""",
    "tasks_agent_failed": ctes("v_task_docs") + """
SELECT doc_id FROM v_task_docs WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 17 = 0""",
    "tasks_required": ctes("v_task_docs") + f""",
ok AS (SELECT * FROM v_task_docs WHERE {_FIRST})
SELECT doc_id, cast(o_custkey AS varchar) AS task_id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/var/log/' || o_orderkey || '/*.log' END
  AS log_path, 't-' || o_orderstatus AS topic, 'c1' AS cluster_id FROM ok WHERE o_orderkey % 7 = 0 OR o_orderkey % 2 = 1
UNION ALL SELECT doc_id, cast(o_custkey + o_orderkey % 2 AS varchar), '/data/b.log', 'u', 'c2' FROM ok WHERE o_orderkey % 7 <> 0
UNION ALL SELECT doc_id, 'z', '/data/z.log', 'v', 'c3' FROM ok WHERE o_orderkey % 7 <> 0""",
    "tasks_control": ctes("v_control_docs") + """,
ok AS (SELECT * FROM v_control_docs WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0)
SELECT doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS cversion, o_custkey AS task_id,
  'task ' || o_custkey AS task_name, '/var/log/a.log' AS log_path_pattern, o_orderkey % 4 AS version,
  CASE WHEN o_orderkey % 5 = 0 THEN 'kafka' ELSE 'pulsar' END AS mq_type, '3.x' AS mq_version, 'c-' || o_orderstatus AS mq_cluster_id,
  't' AS mq_topic, '{"x":1}' AS properties FROM ok
UNION ALL SELECT doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END, 0, '', '/b.log', 0, '', '', '', '', '{}' FROM ok""",
    "task_diff": _SETS + """
SELECT agent, task_id, CASE WHEN o_orderkey % 8 = 0 THEN 'stop' WHEN o_orderkey % 9 = 0 THEN 'start'
  WHEN o_orderkey % 6 = 0 OR o_orderkey % 10 = 3 THEN 'restart' ELSE 'keep' END AS action
FROM v_task_sets WHERE o_orderkey % 72 <> 0""",
    "task_sets": _SETS + """
SELECT agent, task_id, 'removed' AS membership FROM (SELECT agent, task_id FROM old EXCEPT SELECT agent, task_id FROM new)
UNION ALL SELECT agent, task_id, 'added' FROM (SELECT agent, task_id FROM new EXCEPT SELECT agent, task_id FROM old)
UNION ALL SELECT agent, task_id, 'kept' FROM (SELECT agent, task_id FROM new INTERSECT SELECT agent, task_id FROM old)""",
    "config_since": ctes("v_reports") + """
SELECT 't' || user_id AS task_id, max(seq) AS cversion, arg_max(k, seq) AS k, arg_max(event_type, seq) AS event_type
FROM v_reports WHERE seq > 2000 GROUP BY user_id""",
    "props_scan": _SETTINGS + "SELECT host, key, value FROM kv",
    "props_typed": _SETTINGS + """,
h AS (SELECT *, c_custkey % 10 <> 0 AS has FROM wide)
SELECT host, 'server.io_threads' AS key, CASE WHEN has AND io = '16x' THEN '16' WHEN has AND io = '4' THEN '4' ELSE '8' END AS typed FROM h
UNION ALL SELECT host, 'server.backlog', '128' FROM h
UNION ALL SELECT host, 'relay.id', CASE WHEN has THEN 'relay-' || c_custkey ELSE 'relay-0' END FROM h
UNION ALL SELECT host, 'kafka.enable_compression', CASE WHEN has AND comp = '0' THEN 'false' ELSE 'true' END FROM h
UNION ALL SELECT host, 'zookeeper.hosts', CASE WHEN has THEN 'a:1|b:2|c' || c_nationkey || ':3' ELSE '' END FROM h
UNION ALL SELECT host, 'acks', '1=x' FROM h WHERE has""",
    "cluster_dim": _SETTINGS + """
SELECT host, 'kafka' AS kind, 'kc-' || c_nationkey AS cluster_id, '3.x' AS version, 'k1:9092|k2:9092' AS endpoints,
  'compression.type=snappy' AS options FROM wide
UNION ALL SELECT host, 'rabbitmq', 'rb-1', NULL, 'rabbit1:5672', '' FROM wide""",
    "config_layers": _SETTINGS + ", defaults(key, value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS.items()) + """),
env AS (SELECT host, 'server.io_threads' AS key, '16' AS value FROM wide WHERE c_custkey % 4 = 0
  UNION ALL SELECT host, 'relay.id', 'r-env' FROM wide WHERE c_custkey % 5 <> 0
  UNION ALL SELECT host || '-new', 'server.io_threads', '16' FROM wide WHERE c_custkey % 20 = 0),
layered AS (SELECT host, key, value, 'env' AS layer, 1 AS r FROM env UNION ALL SELECT host, key, value, 'file', 2 FROM kv
  UNION ALL SELECT host, d.key, d.value, 'default', 3 FROM wide, defaults d
  UNION ALL SELECT host || '-new', d.key, d.value, 'default', 3 FROM wide, defaults d WHERE c_custkey % 10 = 0)
SELECT host, key, arg_min(value, r) AS value, arg_min(layer, r) AS layer FROM layered GROUP BY host, key""",
}
