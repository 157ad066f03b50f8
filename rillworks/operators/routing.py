"""Routing of frames to topics and clusters, acknowledgement and delivery accounting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.operators.frames import encode, message
from rillworks.operators.ordered import balanced_block, neighbour, running

TOPIC_KEYED = "logs"
#: Blocks of a timeline that has no key.
BLOCKS = 256


def task_key(task_id: Column) -> Column:
    """Wire task number as the decimal text that configured tasks are keyed by."""
    return task_id.cast("decimal(20,0)").cast("string")


def wire_task(task_id: Column) -> Column:
    """Configured task id as the unsigned 64-bit number used on the wire, NULL when it is not one."""
    number = F.when(task_id.rlike("^[0-9]{1,20}$"), task_id.cast("decimal(20,0)"))
    return F.when(number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), number)


def wire_tasks(rows: DataFrame, task_id: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Rows with `wire_task`, and the rows whose task id cannot go on the wire."""
    numbered = rows.withColumn("wire_task", wire_task(F.col(task_id)))
    return numbered.filter("wire_task IS NOT NULL"), numbered.filter("wire_task IS NULL").drop("wire_task")


def ack_frames(acked: DataFrame) -> DataFrame:
    """Acknowledgements as frame bytes."""
    return acked.select("task_id", "offset", encode(message("ACK", F.col("task_id"), F.col("offset"))).alias("raw"))


def route(frames: DataFrame, tasks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds topic, cluster_id and status: 'ok', 'no_producer' (cluster unknown) or 'no_task'.

    Frames carry `task_id`; tasks (task_id STRING, topic, cluster_id); clusters (cluster_id)."""
    keyed = frames.withColumn("_task", task_key(F.col("task_id")))
    known = clusters.select(F.col("cluster_id"), F.lit(True).alias("_producer"))
    configured = tasks.select(F.col("task_id").alias("_task"), "topic", "cluster_id")
    targets = configured.join(known, "cluster_id", "left").withColumn("_known", F.lit(True))
    joined = keyed.join(targets, "_task", "left").drop("_task")
    status = (F.when(F.col("_known").isNull(), "no_task")
              .when(F.col("_producer").isNull(), "no_producer").otherwise("ok"))
    return joined.withColumn("status", status).drop("_producer", "_known")


def unroutable(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    keyed = frames.withColumn("_task", task_key(F.col("task_id")))
    return keyed.join(tasks.select(F.col("task_id").alias("_task")), "_task", "left_anti").drop("_task")


def acks(routed: DataFrame, mode: str = "on_route", delivered: str | Column = "delivered") -> DataFrame:
    """(task_id, offset) to acknowledge: every frame of a known task ('on_route'), or only what the
    queue confirmed ('on_delivery')."""
    if mode == "on_route":
        kept = routed.filter(F.col("status") != "no_task")
    else:
        confirmed = F.col(delivered) if isinstance(delivered, str) else delivered
        kept = routed.filter((F.col("status") == "ok") & confirmed)
    return kept.select("task_id", "offset")


def acks_of_modes(routed: DataFrame, delivered: Column) -> DataFrame:
    """(mode, task_id, offset): what each mode acknowledges, in one pass over the routed frames."""
    known, done = F.col("status") != "no_task", (F.col("status") == "ok") & delivered
    modes = F.array_compact(F.array(F.when(known, "on_route"), F.when(done, "on_delivery")))
    return routed.select(F.explode(modes).alias("mode"), "task_id", "offset")


def unacked(sent: DataFrame, acked: DataFrame, keys: list[str]) -> DataFrame:
    """Sent rows without an acknowledgement; the keys are unique per sent row, so none is hot."""
    return sent.join(acked.select(*keys), keys, "left_anti")


def queue_rows(routed: DataFrame) -> DataFrame:
    """Rows for a topic sink: no key, routed topic, task and offset as headers."""
    header = lambda name: F.struct(F.lit(name).alias("key"), F.col(name).cast("string").cast("binary").alias("value"))
    return routed.filter(F.col("status") == "ok").select(
        "cluster_id", "topic", F.lit(None).cast("binary").alias("key"), F.col("payload").alias("value"),
        F.array(header("task_id"), header("offset")).alias("headers"))


def keyed_queue_rows(frames: DataFrame, topic: str = TOPIC_KEYED) -> DataFrame:
    """Rows for one fixed topic, keyed by task."""
    return frames.select(F.lit(topic).alias("topic"), task_key(F.col("task_id")).cast("binary").alias("key"),
                         F.col("payload").alias("value"))


def fanout_counts(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("status") == "ok").groupBy("cluster_id", "topic").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("payload")).alias("bytes"))


def queue_counts(routed: DataFrame, delivered: Column) -> DataFrame:
    """Messages sent and failed per cluster and topic, counted as rows."""
    return routed.filter(F.col("status") != "no_task").groupBy("cluster_id", "topic").agg(
        F.count_if((F.col("status") == "ok") & delivered).alias("messages_sent"),
        F.count_if(~((F.col("status") == "ok") & delivered)).alias("messages_failed"))


def version_spans(versions: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(version, valid_from, valid_to) of a configuration history, valid_to NULL for the last."""
    starts = versions.select("version", "valid_from").distinct()
    return neighbour(starts.withColumn("_all", F.lit(0)), ["_all"], ["valid_from", "version"], {"valid_to": F.col("valid_from")},
                     balanced_block(starts, "valid_from", blocks), ahead=True).drop("_all")


def session_versions(sessions: DataFrame, versions: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds the version in force when each session was armed, NULL before the first version; of versions that begin at the same
    time the greatest.

    Rows: sessions (.., armed_at TIMESTAMP), versions (version, valid_from). Both stand in one timeline, and the last version is carried
    along it: over the rows inside each of `blocks` blocks of about as many rows, and over one row per block. So neither
    a burst of versions nor the sessions after the last change meet in one task."""
    columns = sessions.columns
    event = versions.select("version", F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"))
    asked = sessions.select(F.struct(*columns).alias("_row"), F.col("armed_at").alias("_at"), F.lit(1).alias("_kind"))
    timeline = event.unionByName(asked, allowMissingColumns=True).filter("_at IS NOT NULL").withColumn("_all", F.lit(0))
    placed = running(timeline, ["_all"], ["_at", "_kind", "version"], {"_last": ("last", F.col("version"))}, balanced_block(timeline.select("_at"), "_at", blocks))
    known = placed.filter("_kind = 1").select("_row.*", F.col("_last").alias("version"))
    kind = versions.schema["version"].dataType
    return known.unionByName(sessions.filter("armed_at IS NULL").withColumn("version", F.lit(None).cast(kind)))


def active_tasks(tasks: DataFrame, data: DataFrame) -> DataFrame:
    """Tasks that produced data; the data side is reduced to its distinct tasks first."""
    return tasks.join(data.select("task_id").distinct(), "task_id", "left_semi")
