"""Frame, routing and codec queries over the frames view."""

from pyspark.sql import functions as F

from rillworks.functions.once import once
from rillworks.operators import bytestreams, codecs, frames, metrics, offsets, ranges, routing
from rillworks.plans.bridge import ctes, table, view

#: Small blocks, so that files of the given tables have several.
RANGE_BITS = 12


def raw_frames(spark, sf):
    framed = view(spark, sf, "v_frames").select("event_id", "us", "user_id", "agent_id", "raw_hex")
    return once(framed, raw=F.unhex("raw_hex")).drop("raw_hex")


def good_frames(spark, sf):
    return frames.accepted(frames.decode(raw_frames(spark, sf)))


def data_frames(spark, sf):
    return frames.dispatch(good_frames(spark, sf))["DATA"]


def routed(spark, sf):
    return routing.route(data_frames(spark, sf), view(spark, sf, "v_tasks"), view(spark, sf, "v_clusters"))


def delivered():
    """The queue confirmed all but every twentieth event."""
    return F.col("event_id") % 20 != 0


def frames_built(spark, sf):
    parts = view(spark, sf, "v_frame_parts")
    task, offset = F.col("wire_task").cast("decimal(20,0)"), F.col("wire_offset")
    known = parts.filter(F.col("mtype").isin(*frames.TYPE_CODES.values()))
    rows = known.select("event_id", frames.message(F.col("mtype"), task, offset, F.col("payload")).alias("m"))
    return rows.select("event_id", "m.magic", "m.version", "m.type", "m.length",
                       F.col("m.task_id").cast("string").alias("task_id"),
                       F.col("m.offset").cast("string").alias("offset"), F.col("m.payload").cast("string").alias("payload"))


def frame_roundtrip(spark, sf):
    parts = view(spark, sf, "v_frame_parts")
    known = parts.filter(F.col("mtype").isin(*frames.TYPE_CODES.values()))
    built = known.select("event_id", frames.message(
        F.col("mtype"), F.col("wire_task").cast("decimal(20,0)"), F.col("wire_offset"), F.col("payload")).alias("m"))
    encoded = built.select("event_id", frames.encode(F.col("m")).alias("raw"))
    return frames.accepted(frames.decode(encoded)).select(
        "event_id", F.hex("raw").alias("raw_hex"), F.col("task_id").cast("string").alias("task_id"),
        F.col("offset").cast("string").alias("offset"), F.col("payload").cast("string").alias("payload"))


def frame_decode(spark, sf):
    return good_frames(spark, sf).select(
        "event_id", "magic", "version", "type", "length", F.col("task_id").cast("string").alias("task_id"),
        F.col("offset").cast("string").alias("offset"), F.col("payload").cast("string").alias("payload"))


def frame_rejects(spark, sf):
    return frames.quarantined(frames.decode(raw_frames(spark, sf)), ["event_id"])


def type_dispatch(spark, sf):
    return frames.type_counts(good_frames(spark, sf))


def wire_chunks(spark, sf):
    """Clean frames as byte chunks per agent connection, cut away from the frame borders: each frame's
    last 9 bytes travel with the next event's row position."""
    clean = once(view(spark, sf, "v_frame_hex").select("event_id", "user_id", "clean_hex"), raw=F.unhex("clean_hex"))
    cut = F.octet_length("raw") - 9
    head = clean.select("user_id", (F.col("event_id") * 2).alias("seq"), F.substring("raw", F.lit(1), cut).alias("data"))
    tail = clean.select("user_id", (F.col("event_id") * 2 + 1).alias("seq"), F.substring("raw", cut + 1, F.lit(9)).alias("data"))
    return head.unionByName(tail)


def frame_reassembly(spark, sf):
    whole = bytestreams.frames(wire_chunks(spark, sf), "user_id", "seq", "data")
    return frames.accepted(frames.decode(whole)).select(
        "user_id", "position", "type", "length", F.col("task_id").cast("string").alias("task_id"),
        F.col("payload").cast("string").alias("payload"))


def chunk_lines(spark, sf):
    lines = view(spark, sf, "v_lines")
    data = F.encode(F.concat("line", F.lit("\n")), "UTF-8")
    sized = lines.select("task_id", "file_path", "event_id", data.alias("data"))
    cut = F.octet_length("data") - 7
    head = sized.select("task_id", "file_path", (F.col("event_id") * 2).alias("seq"), F.substring("data", F.lit(1), cut).alias("data"))
    tail = sized.select("task_id", "file_path", (F.col("event_id") * 2 + 1).alias("seq"), F.substring("data", cut + 1, F.lit(7)).alias("data"))
    out = bytestreams.lines(head.unionByName(tail), ["task_id", "file_path"], "seq", "data")
    return out.withColumn("line", F.decode("line", "UTF-8"))


def codec_rows(spark, sf):
    names = F.array(*[F.lit(n) for n in ("zlib", "Snappy", "NONE", "off", "gzip")])
    return table(spark, sf, "documents").select(
        "doc_id", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("codec"),
        F.encode("text", "UTF-8").alias("payload"))


def codec_roundtrip(spark, sf):
    packed = codecs.compress(codec_rows(spark, sf), "codec", "payload").withColumnsRenamed(
        {"output": "packed", "codec_used": "codec_sent"})
    opened = codecs.decompress(packed, "codec", "packed")
    return opened.groupBy("codec").agg(
        F.max("codec_used").alias("codec_used"), F.bool_or(codecs.codec_warned(F.col("codec"))).alias("warned"),
        F.count(F.lit(1)).alias("payloads"), F.count_if(F.col("output") == F.col("payload")).alias("lossless"),
        F.sum(F.octet_length("payload")).alias("bytes"))


def codec_parts(spark, sf):
    """Compressed documents opened in parts of 256 bytes, every seventh without its last bytes."""
    packed = codecs.compress(codec_rows(spark, sf), "codec", "payload").select("doc_id", "codec", F.when(
        (F.col("doc_id") % 7 == 0) & (F.col("codec_used") == "ZLIB"), F.substring("output", F.lit(1), F.octet_length("output") - 6)).otherwise(F.col("output")).alias("packed"))
    parts = codecs.decompress_parts(packed, ["doc_id"], "codec", "packed", 256)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("part", F.hex("bytes").alias("h"))))), lambda p: p["h"]), "")
    out = parts.groupBy("doc_id").agg(F.max("status").alias("status"), F.count("bytes").alias("parts"), F.sha2(F.unhex(whole), 256).alias("digest"))
    sound = F.col("status") == "ok"
    return out.select("doc_id", "status", F.when(sound, F.col("parts")).alias("parts"), F.when(sound, F.col("digest")).alias("digest"))


def codec_ratio(spark, sf):
    packed = codecs.compress(codec_rows(spark, sf), "codec", "payload")
    sums = codecs.compression_ratio(packed, ["codec_used"], F.octet_length("payload"), F.octet_length("output"))
    return sums.select("codec_used", "original_bytes", (F.col("compressed_bytes") < F.col("original_bytes")).alias("smaller"), F.when(F.col("codec_used") == "NONE", F.col("ratio")).alias("none_ratio"))


def route(spark, sf):
    return routed(spark, sf).select("event_id", F.col("task_id").cast("string").alias("task_id"), "topic", "cluster_id")


def route_status(spark, sf):
    return routed(spark, sf).groupBy("cluster_id", "topic", "status").agg(F.count(F.lit(1)).alias("frames"))


def unroutable(spark, sf):
    return routing.unroutable(data_frames(spark, sf), view(spark, sf, "v_tasks")).select("event_id")


def acks(spark, sf):
    told = routing.acks_of_modes(routed(spark, sf), delivered())
    return told.select("mode", F.col("task_id").cast("string").alias("task_id"), F.col("offset").cast("string").alias("offset"))


def unacked(spark, sf):
    r = routed(spark, sf)
    sent = r.select("task_id", "offset", "event_id")
    return routing.unacked(sent, routing.acks(r, "on_delivery", delivered()), ["task_id", "offset"]).select("event_id")


def mq_rows(spark, sf):
    return routing.queue_rows(routed(spark, sf)).select(
        "cluster_id", "topic", F.col("value").cast("string").alias("value"),
        F.concat_ws(",", F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string")))).alias("headers"))


def mq_rows_keyed(spark, sf):
    return routing.keyed_queue_rows(data_frames(spark, sf)).select(
        "topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def fanout_counts(spark, sf):
    return routing.fanout_counts(routed(spark, sf))


def mq_counts(spark, sf):
    return routing.queue_counts(routed(spark, sf), delivered())


def config_history(spark, sf):
    """One configuration version per nation row, a day apart."""
    return table(spark, sf, "nation").selectExpr(
        "n_nationkey AS version",
        "timestamp '2024-01-01 06:00:00' + make_dt_interval(n_nationkey) AS valid_from")


def route_asof(spark, sf):
    lines = view(spark, sf, "v_lines").select("event_id", "us", "user_id", "d", "task_id")
    sessions = lines.groupBy("user_id", "d").agg(F.timestamp_micros(F.min("us")).alias("armed_at"))
    versioned = routing.session_versions(sessions, config_history(spark, sf))
    listed = config_history(spark, sf).select("version", F.explode(F.array(*map(F.lit, ("1001", "1002", "1003")))).alias("task_id"))
    history = listed.join(view(spark, sf, "v_tasks"), "task_id", "left").select(
        "version", "task_id", F.concat("topic", F.lit("-v"), F.col("version")).alias("topic"))
    placed = lines.join(versioned.select("user_id", "d", "version"), ["user_id", "d"])
    return placed.join(history, ["version", "task_id"], "left").select("event_id", "version", "task_id", "topic")


def active_tasks(spark, sf):
    sent = view(spark, sf, "v_lines").filter("event_type <> 'signup'").select("task_id")
    return routing.active_tasks(view(spark, sf, "v_tasks"), sent).select("task_id", "topic")


def duplicate_delivery(spark, sf):
    """Chunks delivered again after a restart: one row per (task, file, offset) is kept."""
    chunks = view(spark, sf, "v_chunks").select("task_id", "file_path", (F.col("seq") * 4096).alias("offset"), "seq")
    sent_again = chunks.filter("seq % 101 = 0")
    keys = ["task_id", "file_path", "offset"]
    merged = chunks.unionByName(sent_again).groupBy(*keys).agg(F.count(F.lit(1)).alias("deliveries"))
    return merged.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("deliveries").alias("deliveries"),
        F.sum(F.col("deliveries") - 1).alias("repeated"))


def sent_ranges(spark, sf):
    """The bytes of each line in its file."""
    placed = offsets.line_offsets(view(spark, sf, "v_lines").select("task_id", "file_path", "event_id", "line"), "file_path", "event_id", "line")
    return placed.select("task_id", "file_path", "event_id", F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.octet_length("line") + 1).alias("stop"))


def arrived_ranges(spark, sf):
    """Deliveries: some lines don't arrive, some arrive again together with the bytes around them."""
    rows = sent_ranges(spark, sf)
    again = rows.filter("event_id % 101 = 0").select("file_path", F.greatest(F.col("start") - 100, F.lit(0)).alias("start"), (F.col("stop") + 40).alias("stop"))
    return rows.filter("event_id % 20 <> 0").select("file_path", "start", "stop").unionByName(again)


def delivered_ranges(spark, sf):
    return ranges.union(arrived_ranges(spark, sf), ["file_path"], block_bits=RANGE_BITS)


def unacked_ranges(spark, sf):
    return ranges.missing(sent_ranges(spark, sf), arrived_ranges(spark, sf), ["file_path"], block_bits=RANGE_BITS)


def repeated_ranges(spark, sf):
    return ranges.repeated(arrived_ranges(spark, sf), ["file_path"], block_bits=RANGE_BITS)


def delivery_accounts(spark, sf):
    return ranges.accounts(sent_ranges(spark, sf), arrived_ranges(spark, sf), ["file_path"], block_bits=RANGE_BITS)


def ack_frames(spark, sf):
    acked = routing.acks(routed(spark, sf))
    return routing.ack_frames(acked).select(
        F.col("task_id").cast("string").alias("task_id"), F.col("offset").cast("string").alias("offset"), F.hex("raw").alias("raw_hex"))


def frame_metrics(spark, sf):
    """METRICS frames, decoded, as the latest values per agent."""
    reports = frames.dispatch(good_frames(spark, sf))["METRICS"].select(
        "agent_id", "us", "event_id", F.col("payload").cast("string").alias("document"))
    return metrics.last_values(reports, "agent_id", ["us", "event_id"], "document")


def _task_ids(spark, sf):
    return view(spark, sf, "v_task_ids")


def task_wire_ids(spark, sf):
    good, _ = routing.wire_tasks(_task_ids(spark, sf))
    return good.select("o_orderkey", "task_id", F.col("wire_task").cast("string").alias("wire_task"))


def task_id_rejects(spark, sf):
    _, rejected = routing.wire_tasks(_task_ids(spark, sf))
    return rejected.select("o_orderkey", "task_id")


QUERIES = {f.__name__: f for f in (
    frames_built, frame_roundtrip, frame_decode, frame_rejects, type_dispatch, frame_reassembly, chunk_lines,
    codec_roundtrip, codec_ratio, codec_parts, route, route_status, unroutable, acks, unacked, mq_rows, mq_rows_keyed,
    fanout_counts, mq_counts, route_asof, active_tasks, duplicate_delivery, delivered_ranges, unacked_ranges, repeated_ranges, delivery_accounts,
    ack_frames, frame_metrics, task_wire_ids, task_id_rejects)}

_GOOD = ctes("v_frame_parts", "v_tasks", "v_clusters") + """,
expected AS (SELECT *, cast(strlen(payload) AS bigint) AS n, CASE
    WHEN defect = 2 OR (defect = 3 AND payload = '') THEN 'data too small' WHEN defect = 0 THEN 'wrong magic number'
    WHEN defect = 1 THEN 'unsupported version' WHEN defect = 3 THEN 'incomplete payload' END AS reject FROM v_frame_parts),
good AS (SELECT * FROM expected WHERE reject IS NULL),
data AS (SELECT * FROM good WHERE mtype = 1),
routed AS (SELECT d.*, t.topic, t.cluster_id, CASE WHEN t.task_id IS NULL THEN 'no_task'
    WHEN c.cluster_id IS NULL THEN 'no_producer' ELSE 'ok' END AS status
  FROM data d LEFT JOIN v_tasks t ON d.wire_task = t.task_id LEFT JOIN v_clusters c ON t.cluster_id = c.cluster_id)
"""
_FIELDS = """event_id, cast(3405691582 AS bigint) AS magic, 256 AS version, mtype AS type, n AS length,
 wire_task AS task_id, cast(wire_offset AS varchar) AS "offset", payload"""
_OK = "status = 'ok'"

_SENT = """SELECT file_path, unnest([{'p': start, 's': 1, 'a': 0}, {'p': stop, 's': -1, 'a': 0}]) AS x FROM sent UNION ALL """
_RANGES = ctes("v_lines") + """,
sent AS (SELECT file_path, event_id, cast(stop - n AS bigint) AS start, cast(stop AS bigint) AS stop FROM (SELECT file_path, event_id, strlen(line) + 1 AS n,
  sum(strlen(line) + 1) OVER (PARTITION BY file_path ORDER BY event_id) AS stop FROM v_lines)),
arrived AS (SELECT file_path, start, stop FROM sent WHERE event_id % 20 <> 0
  UNION ALL SELECT file_path, greatest(start - 100, 0), stop + 40 FROM sent WHERE event_id % 101 = 0),
edges AS (SELECT file_path, x.p AS p, sum(x.s) AS s, sum(x.a) AS a FROM (
  """ + _SENT + """SELECT file_path, unnest([{'p': start, 's': 0, 'a': 1}, {'p': stop, 's': 0, 'a': -1}]) AS x FROM arrived) GROUP BY ALL),
pieces AS (SELECT file_path, p AS start, lead(p) OVER w AS stop, sum(s) OVER w AS sent, sum(a) OVER w AS arrived FROM edges WINDOW w AS (PARTITION BY file_path ORDER BY p))
"""
_JOINED = """SELECT file_path, min(start) AS start, max(stop) AS stop FROM (
  SELECT *, sum(CASE WHEN before = start THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY start) AS run FROM (
    SELECT *, lag(stop) OVER (PARTITION BY file_path ORDER BY start) AS before FROM pieces WHERE stop IS NOT NULL AND {})) GROUP BY file_path, run"""

ORACLE = {
    "delivered_ranges": _RANGES + _JOINED.format("arrived > 0"),
    "unacked_ranges": _RANGES + _JOINED.format("sent > 0 AND arrived = 0"),
    "repeated_ranges": _RANGES.replace(_SENT, "") + """
SELECT file_path, start, stop, cast(arrived AS bigint) AS deliveries FROM pieces WHERE arrived > 1 AND stop IS NOT NULL""",
    "delivery_accounts": _RANGES + """
SELECT file_path, cast(coalesce(sum(stop - start) FILTER (sent > 0), 0) AS bigint) AS sent, cast(coalesce(sum(stop - start) FILTER (sent > 0 AND arrived > 0), 0) AS bigint) AS delivered,
  cast(coalesce(sum(stop - start) FILTER (sent > 0 AND arrived = 0), 0) AS bigint) AS missing, cast(coalesce(sum((arrived - 1) * (stop - start)) FILTER (arrived > 0), 0) AS bigint) AS repeated,
  cast(coalesce(sum(stop - start) FILTER (sent = 0 AND arrived > 0), 0) AS bigint) AS unexpected FROM pieces WHERE stop IS NOT NULL GROUP BY file_path""",
    "frames_built": _GOOD + f"SELECT {_FIELDS} FROM expected WHERE mtype <= 4",
    "frame_roundtrip": ctes("v_frame_hex") + """
SELECT event_id, clean_hex AS raw_hex, wire_task AS task_id, cast(wire_offset AS varchar) AS "offset", payload
FROM v_frame_hex WHERE mtype <= 4""",
    "frame_decode": _GOOD + f"SELECT {_FIELDS} FROM good".replace("mtype AS type", "cast(mtype AS bigint) AS type").replace("256 AS", "cast(256 AS bigint) AS"),
    "frame_rejects": _GOOD + "SELECT event_id, reject FROM expected WHERE reject IS NOT NULL",
    "type_dispatch": _GOOD + """
SELECT CASE mtype WHEN 1 THEN 'DATA' WHEN 2 THEN 'ACK' WHEN 3 THEN 'HEARTBEAT' WHEN 4 THEN 'METRICS' ELSE 'UNKNOWN' END
    AS type_label, count(*) AS frames, cast(sum(n) AS bigint) AS payload_bytes, mtype IN (1, 3, 4) AS handled
FROM good GROUP BY mtype""",
    "frame_reassembly": _GOOD + """
SELECT user_id, cast(coalesce(sum(28 + n) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS position,
  cast(mtype AS bigint) AS type, n AS length, wire_task AS task_id, payload FROM expected""",
    "chunk_lines": ctes("v_lines") + """
SELECT task_id, file_path, row_number() OVER (PARTITION BY task_id, file_path ORDER BY event_id) - 1 AS line_no,
  line, true AS complete FROM v_lines""",
    "codec_ratio": """
SELECT codec_used, cast(sum(strlen(text)) AS bigint) AS original_bytes, codec_used <> 'NONE' AS smaller, CASE WHEN codec_used = 'NONE' THEN 100.0::double END AS none_ratio
FROM (SELECT text, ['ZLIB', 'SNAPPY', 'NONE', 'NONE', 'NONE'][doc_id % 5 + 1] AS codec_used FROM documents) GROUP BY codec_used""",
    "codec_parts": """
SELECT doc_id, CASE WHEN bad THEN 'damaged' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN cast((strlen(text) + 255) // 256 AS bigint) END AS parts,
  CASE WHEN NOT bad THEN sha256(text) END AS digest FROM (SELECT *, doc_id % 7 = 0 AND doc_id % 5 = 0 AS bad FROM documents)""",
    "codec_roundtrip": """
SELECT codec, CASE codec WHEN 'zlib' THEN 'ZLIB' WHEN 'Snappy' THEN 'SNAPPY' ELSE 'NONE' END AS codec_used,
  codec = 'gzip' AS warned, count(*) AS payloads, count(*) AS lossless, cast(sum(strlen(text)) AS bigint) AS bytes
FROM (SELECT text, ['zlib', 'Snappy', 'NONE', 'off', 'gzip'][doc_id % 5 + 1] AS codec FROM documents) GROUP BY codec""",
    "route": _GOOD + "SELECT event_id, wire_task AS task_id, topic, cluster_id FROM routed",
    "route_status": _GOOD + "SELECT cluster_id, topic, status, count(*) AS frames FROM routed GROUP BY ALL",
    "unroutable": _GOOD + "SELECT event_id FROM data WHERE event_type = 'view'",
    "acks": _GOOD + f"""
SELECT 'on_route' AS mode, wire_task AS task_id, cast(wire_offset AS varchar) AS "offset" FROM data WHERE event_type <> 'view'
UNION ALL SELECT 'on_delivery', wire_task, cast(wire_offset AS varchar) FROM routed WHERE {_OK} AND event_id % 20 <> 0""",
    "unacked": _GOOD + f"SELECT event_id FROM routed WHERE NOT ({_OK} AND event_id % 20 <> 0)",
    "mq_rows": _GOOD + f"""
SELECT cluster_id, topic, payload AS value, 'task_id=' || wire_task || ',offset=' || wire_offset AS headers
FROM routed WHERE {_OK}""",
    "mq_rows_keyed": _GOOD + "SELECT 'logs' AS topic, wire_task AS key, payload AS value FROM data",
    "fanout_counts": _GOOD + f"""
SELECT cluster_id, topic, count(*) AS rows, cast(sum(n) AS bigint) AS bytes FROM routed WHERE {_OK} GROUP BY ALL""",
    "mq_counts": _GOOD + f"""
SELECT cluster_id, topic, count(*) FILTER ({_OK} AND event_id % 20 <> 0) AS messages_sent,
  count(*) FILTER (NOT ({_OK} AND event_id % 20 <> 0)) AS messages_failed
FROM routed WHERE status <> 'no_task' GROUP BY ALL""",
    "route_asof": ctes("v_lines", "v_tasks") + """,
sessions AS (SELECT user_id, d, min(us) AS armed FROM v_lines GROUP BY ALL),
history AS (SELECT n_nationkey AS version, epoch_us(TIMESTAMP '2024-01-01 06:00:00' + to_days(n_nationkey)) AS valid_from FROM nation),
versioned AS (SELECT s.user_id, s.d, h.version FROM sessions s ASOF LEFT JOIN history h ON s.armed >= h.valid_from)
SELECT event_id, version, l.task_id, CASE WHEN version IS NOT NULL THEN t.topic || '-v' || version END AS topic
FROM v_lines l JOIN versioned USING (user_id, d) LEFT JOIN v_tasks t ON l.task_id = t.task_id AND t.task_id <> '1004'""",
    "active_tasks": ctes("v_lines", "v_tasks") + """
SELECT task_id, topic FROM v_tasks WHERE task_id IN (SELECT task_id FROM v_lines WHERE event_type <> 'signup')""",
    "duplicate_delivery": ctes("v_lines") + """
SELECT task_id, count(*) AS chunks, count(*) + count(*) FILTER (event_id % 101 = 0) AS deliveries,
  count(*) FILTER (event_id % 101 = 0) AS repeated FROM v_lines GROUP BY task_id""",
    "ack_frames": ctes("v_frame_hex") + """
SELECT wire_task AS task_id, cast(wire_offset AS varchar) AS "offset",
  'BEBAFECA0001020000000000' || substr(clean_hex, 25, 32) AS raw_hex
FROM v_frame_hex WHERE mtype = 1 AND defect NOT IN (0, 1, 2, 3) AND event_type <> 'view'""",
    "frame_metrics": _GOOD + """
SELECT agent_id, cast(arg_max(k, event_id) AS bigint) AS lines_collected, cast(arg_max(k * 10, event_id) AS bigint) AS bytes_collected,
  cast(0 AS bigint) AS error_count, cast(0 AS bigint) AS files_watched FROM good WHERE mtype = 4 GROUP BY agent_id""",
    "task_wire_ids": ctes("v_task_ids") + """
SELECT o_orderkey, task_id, ltrim(task_id, '0') AS wire_task FROM v_task_ids WHERE o_orderkey % 5 IN (0, 1, 2)""",
    "task_id_rejects": ctes("v_task_ids") + "SELECT o_orderkey, task_id FROM v_task_ids WHERE o_orderkey % 5 IN (3, 4)",
}
