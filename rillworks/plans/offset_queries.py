"""Offset, checkpoint, listing and flow-control queries."""

from pyspark.sql import functions as F

from rillworks.operators import offsets, shedding
from rillworks.operators.ordered import block_of
from rillworks.plans.bridge import ctes, view

# Parameters of the queries; the same values are in the SQL below.
ROLL_BYTES = 16_384
HIGH = 2_000
CLOSE_SECONDS = 86_400
QUOTA = 60


def lines(spark, sf):
    return view(spark, sf, "v_lines")


def line_offsets(spark, sf):
    return offsets.line_offsets(lines(spark, sf).select("file_path", "event_id", "line"), "file_path", "event_id", "line").select(
        "file_path", "event_id", "byte_offset")


def collect_totals(spark, sf):
    data = lines(spark, sf).select("task_id", F.concat("line", F.lit("\n")).alias("data"))
    return offsets.collect_totals(data, ["task_id"], "data")


def offset_gaps(spark, sf):
    """Chunks as sent, then with some lost (gap) and some sent twice (overlap)."""
    sent = offsets.line_offsets(lines(spark, sf).select("file_path", "event_id", "line"), "file_path", "event_id", "line")
    chunks = sent.select("file_path", (F.col("event_id") * 2).alias("seq"), F.col("byte_offset").alias("offset"),
                         (F.octet_length("line") + 1).cast("bigint").alias("length"), "event_id")
    kept = chunks.filter("event_id % 97 <> 0")
    copies = F.when(F.col("event_id") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    received = kept.withColumn("_copy", F.explode(copies)).withColumn("seq", F.col("seq") + F.col("_copy"))
    return offsets.continuity(received, ["file_path"], "seq").groupBy("file_path", "state").agg(
        F.count(F.lit(1)).alias("chunks"))


def resume_plan(spark, sf):
    return offsets.resume_plan(view(spark, sf, "v_files"), view(spark, sf, "v_checkpoints"))


def checkpoint_latest(spark, sf):
    log = view(spark, sf, "v_reports").select(
        F.concat("task_id", F.lit(":"), "agent_id").alias("key"), "seq", (F.col("k") % 9 == 0).alias("deleted"),
        (F.col("seq") * 100).alias("offset"), "k")
    return offsets.latest_checkpoints(log, "key", "seq", "deleted", ["offset", "k"])


def checkpoint_rows(spark, sf):
    """Fifty files per agent host."""
    return view(spark, sf, "v_checkpoints").select(
        F.expr("concat('agent-', doc_id div 50)").alias("agent"), F.concat(F.lit("k"), F.lpad("doc_id", 8, "0")).alias("key"),
        "offset", F.col("path").alias("file_path"), F.lit(0).cast("bigint").alias("inode"), "file_size",
        F.col("doc_id").cast("string").alias("last_modified"))


def checkpoint_doc(spark, sf):
    return offsets.checkpoint_documents(checkpoint_rows(spark, sf), "agent", "key")


def checkpoint_parse(spark, sf):
    """Documents written and read back; one in seven agents has a cut-off document, one in five a member of a wrong type."""
    docs = offsets.checkpoint_documents(checkpoint_rows(spark, sf), "agent", "key")
    number = F.substring("agent", F.lit(7), F.length("agent")).cast("bigint")
    cut = F.when(number % 7 == 3, F.substring("document", F.lit(1), F.length("document") - 1)).otherwise(F.col("document"))
    wrong = F.when(number % 5 == 1, F.replace(cut, F.lit('"inode":0'), F.lit('"inode":"0"'))).otherwise(cut)
    return offsets.parse_checkpoint_documents(docs.withColumn("document", wrong), "agent", "document")


def file_changes(spark, sf):
    return offsets.file_changes(view(spark, sf, "v_files_prev"), view(spark, sf, "v_files"))


def listing_changes(spark, sf):
    listing = lambda name: view(spark, sf, name).select("path", "size", "mtime", F.sha2("content", 256).alias("digest"))
    return offsets.listing_changes(listing("v_files_prev"), listing("v_files"))


def task_file_match(spark, sf):
    rows = [("1001", "/var/log/app/src1/*.log"), ("1002", "/var/log/app/*/1?.log"), ("1003", "/var/log/app/**"),
            ("1004", "/var/log/app/src[2-4]/*9.log"), ("1005", "/opt/none/*.log")]
    patterns = spark.createDataFrame(rows, "task_id STRING, pattern STRING")
    return offsets.match_files(view(spark, sf, "v_files").select("path"), patterns, ["*.tmp", "*.swp"])


def files_watched(spark, sf):
    files = view(spark, sf, "v_files").select(F.concat(F.lit("t-"), "source").alias("task_id"), "mtime", "doc_id")
    now = F.lit(1704067200 + 20 * 86400)
    return offsets.files_watched(files, ["task_id"], now, 20 * 86400 - 30000)


def roll_index(spark, sf):
    rows = lines(spark, sf).select("task_id", "event_id", "us", F.octet_length("line").alias("n"))
    return offsets.roll_index(
        rows, ["task_id"], ["event_id"], F.expr("us div 1000000"), (F.col("n") + 1).cast("bigint"),
        block_of("event_id"), ROLL_BYTES).select("task_id", "event_id", "hour_index", "size_index")


def tail_lines(spark, sf):
    return offsets.last_rows(lines(spark, sf).select("file_path", "event_id", "line"), ["file_path"], ["event_id"], 50)


def samples(spark, sf):
    """System samples, one run per day."""
    return view(spark, sf, "v_reports").select(
        F.col("d").alias("run"), "seq", "us", F.col("k").cast("double").alias("cpu_percent"),
        (F.col("k") * 25).cast("double").alias("memory_used_mb"), (F.col("seq") * 3 + F.col("k")).alias("kafka_messages"))


def last_samples(spark, sf):
    return offsets.last_rows(samples(spark, sf).select("run", "seq", "cpu_percent"), ["run"], ["seq"], 10)


def sample_delta(spark, sf):
    return offsets.since_start(samples(spark, sf).select("run", "seq", "kafka_messages"), ["run"], "seq",
                               "kafka_messages", "messages_since_start")


def sized_rows(spark, sf):
    return lines(spark, sf).select("user_id", F.col("event_id").alias("seq"), "us",
                                   F.octet_length("line").cast("bigint").alias("size"))


def shed_cumulative(spark, sf):
    return shedding.shed_cumulative(sized_rows(spark, sf), "user_id", "seq", F.col("size"), high=HIGH).select(
        "user_id", "seq", "accepted")


def session_close(spark, sf):
    rows = shedding.shed_cumulative(sized_rows(spark, sf), "user_id", "seq", F.col("size"), high=HIGH)
    timed = rows.withColumn("ts", F.timestamp_micros("us"))
    return shedding.session_close(timed, "user_id", "seq", "ts", ~F.col("accepted"), CLOSE_SECONDS).groupBy("user_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted") & ~F.col("closed")).alias("dropped"),
        F.count_if("closed").alias("after_close"))


def shed_hysteresis(spark, sf):
    """Two records per event: k + 1 MiB are buffered at its time and delivered k times 8 minutes later."""
    size = (F.col("k").cast("bigint") + 1) * F.lit(1 << 20)
    record = lambda side, at, change: F.struct((F.col("event_id") * 2 + side).alias("seq"), at.alias("at"), change.alias("change"))
    records = view(spark, sf, "ev").select("user_id", F.inline(F.array(
        record(0, F.col("us"), size), record(1, F.col("us") + F.col("k").cast("bigint") * 480_000_000, -size))))
    return shedding.shed_hysteresis(records, "user_id", ["at", "seq"], "change", block=block_of("at", 38)).select(
        "user_id", "seq", "accepted", "level")


def quota_breach(spark, sf):
    rows = lines(spark, sf).select("task_id", F.timestamp_micros("us").alias("ts"), F.octet_length("line").alias("size"))
    return shedding.quota_breaches(rows, "task_id", "ts", F.col("size"), QUOTA).select(
        "task_id", F.unix_seconds("second_start").alias("second"), "bytes")


QUERIES = {f.__name__: f for f in (
    line_offsets, collect_totals, offset_gaps, resume_plan, checkpoint_latest, checkpoint_doc, checkpoint_parse,
    file_changes, listing_changes, task_file_match, files_watched, roll_index, tail_lines, last_samples, sample_delta,
    shed_cumulative, session_close, shed_hysteresis, quota_breach)}

_OFFSETS = ctes("v_lines") + """,
placed AS (SELECT file_path, event_id, line, cast(strlen(line) + 1 AS bigint) AS n,
  cast(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_path ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS byte_offset FROM v_lines)
"""
_SHED = ctes("v_lines") + f""",
shed AS (SELECT user_id, event_id AS seq, us, coalesce(sum(strlen(line)) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {HIGH} AS accepted FROM v_lines)
"""
_CHECKPOINTS = ctes("v_checkpoints") + """,
cp AS (SELECT 'agent-' || (doc_id // 50) AS agent, doc_id // 50 AS number, 'k' || lpad(cast(doc_id AS varchar), 8, '0') AS key,
  "offset", path AS file_path, file_size, cast(doc_id AS varchar) AS last_modified FROM v_checkpoints)
"""

_CHANGES = ctes("v_files", "v_files_prev") + """,
came AS (SELECT path, size, sha256(content) AS h FROM v_files ANTI JOIN v_files_prev USING (path)),
went AS (SELECT path, size, sha256(content) AS h FROM v_files_prev ANTI JOIN v_files USING (path)),
moved AS (SELECT c.path, w.path AS from_path FROM
  (SELECT size, h, min(path) AS path FROM came GROUP BY ALL HAVING count(*) = 1) c JOIN
  (SELECT size, h, min(path) AS path FROM went GROUP BY ALL HAVING count(*) = 1) w USING (size, h)),
changes AS (SELECT path, CASE WHEN from_path IS NULL THEN 'CREATED' ELSE 'MOVED' END AS event, from_path FROM came LEFT JOIN moved USING (path)
UNION ALL SELECT path, 'DELETED', NULL FROM went WHERE path NOT IN (SELECT from_path FROM moved)
UNION ALL SELECT n.path, 'MODIFIED', NULL FROM v_files n JOIN v_files_prev o USING (path) WHERE n.size <> o.size OR n.mtime <> o.mtime)
"""

ORACLE = {
    "line_offsets": _OFFSETS + "SELECT file_path, event_id, byte_offset FROM placed",
    "collect_totals": ctes("v_lines") + """
SELECT task_id, count(*) AS lines_collected, cast(sum(strlen(line) + 1) AS bigint) AS bytes_collected
FROM v_lines GROUP BY task_id""",
    "offset_gaps": _OFFSETS + """,
received AS (SELECT *, unnest(CASE WHEN event_id % 101 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM placed WHERE event_id % 97 <> 0),
linked AS (SELECT *, lead(byte_offset) OVER (PARTITION BY file_path ORDER BY event_id, copy) AS nxt FROM received)
SELECT file_path, CASE WHEN nxt IS NULL THEN 'last' WHEN nxt = byte_offset + n THEN 'ok'
  WHEN nxt = 0 AND byte_offset > 0 THEN 'reset' WHEN nxt > byte_offset + n THEN 'gap' ELSE 'overlap' END AS state,
  count(*) AS chunks FROM linked GROUP BY ALL""",
    "resume_plan": ctes("v_files", "v_checkpoints") + """
SELECT path, size, CASE WHEN size < coalesce(c.file_size, 0) THEN 0 ELSE coalesce(c."offset", 0) END AS start_offset,
  size < coalesce(c.file_size, 0) AS rotated,
  size - CASE WHEN size < coalesce(c.file_size, 0) THEN 0 ELSE coalesce(c."offset", 0) END AS pending_bytes
FROM v_files f LEFT JOIN (SELECT path, "offset", file_size FROM v_checkpoints) c USING (path)""",
    "checkpoint_latest": ctes("v_reports") + """
SELECT key, "offset", k FROM (SELECT task_id || ':' || agent_id AS key, seq * 100 AS "offset", k,
  row_number() OVER (PARTITION BY task_id, agent_id ORDER BY seq DESC) AS rn FROM v_reports) WHERE rn = 1 AND k % 9 <> 0""",
    "checkpoint_doc": _CHECKPOINTS + """
SELECT agent, '{' || string_agg('"' || key || '":{"offset":' || "offset" || ',"file_path":"' || file_path ||
  '","inode":0,"file_size":' || file_size || ',"last_modified":"' || last_modified || '"}', ',' ORDER BY key) || '}' AS document
FROM cp GROUP BY agent""",
    "checkpoint_parse": _CHECKPOINTS + """
SELECT agent, false AS failed, key, "offset", file_path, cast(0 AS bigint) AS inode, file_size, last_modified
FROM cp WHERE number % 7 <> 3 AND number % 5 <> 1
UNION ALL SELECT DISTINCT agent, true, NULL, cast(0 AS bigint), '', cast(0 AS bigint), cast(0 AS bigint), '' FROM cp WHERE number % 7 = 3 OR number % 5 = 1""",
    "file_changes": _CHANGES + "SELECT * FROM changes",
    "listing_changes": _CHANGES + """
SELECT c.path, event, from_path, CASE event WHEN 'DELETED' THEN NULL WHEN 'CREATED' THEN 0 WHEN 'MOVED' THEN n.size
    ELSE CASE WHEN n.size < o.size THEN 0 ELSE o.size END END::bigint AS start, n.size AS stop
FROM changes c LEFT JOIN v_files n USING (path) LEFT JOIN v_files_prev o ON c.path = o.path""",
    "task_file_match": ctes("v_files") + """,
p AS (SELECT * FROM (VALUES ('1001', '^/var/log/app/src1/[^/]*[.]log$'), ('1002', '^/var/log/app/[^/]*/1[^/][.]log$'),
  ('1003', '^/var/log/app/.*$'), ('1004', '^/var/log/app/src[2-4]/[^/]*9[.]log$')) t(task_id, re))
SELECT task_id, path FROM v_files JOIN p ON regexp_matches(path, re) WHERE path NOT LIKE '%.tmp' AND path NOT LIKE '%.swp'""",
    "files_watched": ctes("v_files") + """
SELECT 't-' || source AS task_id, count(*) FILTER (1704067200 + 20 * 86400 - mtime <= 20 * 86400 - 30000) AS fast_files,
  count(*) FILTER (NOT 1704067200 + 20 * 86400 - mtime <= 20 * 86400 - 30000) AS slow_files FROM v_files GROUP BY ALL""",
    "roll_index": ctes("v_lines") + f"""
SELECT task_id, event_id, (us // 1000000 - min(us // 1000000) OVER (PARTITION BY task_id)) // 3600 AS hour_index,
  cast(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY task_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {ROLL_BYTES} AS bigint) AS size_index FROM v_lines""",
    "tail_lines": ctes("v_lines") + """
SELECT * FROM (SELECT file_path, event_id, line, cast(row_number() OVER (PARTITION BY file_path ORDER BY event_id DESC) AS int)
  AS row_from_end FROM v_lines) WHERE row_from_end <= 50""",
    "last_samples": ctes("v_reports") + """
SELECT * FROM (SELECT d AS run, seq, cast(k AS double) AS cpu_percent,
  cast(row_number() OVER (PARTITION BY d ORDER BY seq DESC) AS int) AS row_from_end FROM v_reports) WHERE row_from_end <= 10""",
    "sample_delta": ctes("v_reports") + """
SELECT d AS run, seq, seq * 3 + k AS kafka_messages,
  seq * 3 + k - first_value(seq * 3 + k) OVER (PARTITION BY d ORDER BY seq) AS messages_since_start FROM v_reports""",
    "shed_cumulative": _SHED + "SELECT user_id, seq, accepted FROM shed",
    "session_close": _SHED + f""",
f AS (SELECT user_id, min(us) AS since FROM shed WHERE NOT accepted GROUP BY ALL),
c AS (SELECT s.user_id, min(us) AS closed_at FROM shed s JOIN f USING (user_id)
  WHERE NOT accepted AND us - since > {CLOSE_SECONDS} * 1000000::bigint GROUP BY ALL)
SELECT user_id, count(*) FILTER (accepted) AS accepted,
  count(*) FILTER (NOT accepted AND NOT coalesce(us > closed_at, false)) AS dropped,
  count(*) FILTER (coalesce(us > closed_at, false)) AS after_close
FROM shed LEFT JOIN c USING (user_id) GROUP BY user_id""",
    "shed_hysteresis": ctes("ev") + """,
records AS (SELECT user_id, event_id * 2 AS seq, us AS moment, (k + 1) * 1048576::bigint AS change FROM ev
  UNION ALL SELECT user_id, event_id * 2 + 1, us + k * 480000000::bigint, -(k + 1) * 1048576::bigint FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, seq) AS rn FROM records),
walk AS (SELECT user_id, seq, rn, change, cast(0 AS bigint) AS level, false AS shed FROM r WHERE rn = 1
  UNION ALL SELECT user_id, seq, rn, change, level, CASE WHEN was THEN level >= 33554432 ELSE level > 67108864 END FROM (
    SELECT r.*, w.level + w.change AS level, w.shed AS was FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1))
SELECT user_id, seq, CASE WHEN change >= 0 THEN NOT shed END AS accepted, level FROM walk""",
    "quota_breach": ctes("v_lines") + f"""
SELECT task_id, us // 1000000 AS second, cast(sum(strlen(line)) AS bigint) AS bytes FROM v_lines GROUP BY ALL HAVING sum(strlen(line)) > {QUOTA}""",
}
