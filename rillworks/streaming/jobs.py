"""Streaming forms of the batch operators."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.operators import metrics, routing
from rillworks.operators.audit import content_checks
from rillworks.operators.shedding import FULL_SECONDS, HIGH_WATERMARK_BYTES, LOW_WATERMARK_BYTES
from rillworks.sources import fanout, sinks
from rillworks.streaming.ledger import ConfigLedger
from rillworks.streaming.processors import HELD_BYTES, AgentLife, FirstContents, FrameAssembler, LineAssembler, Shedder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Bytes that a Python worker gets at once, whatever the number of rows.
ARROW_BYTES = 8 << 20


def use_keyed_state(spark) -> None:
    """The keyed processors need this state store, and batches bounded by bytes: chunks may be large."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _keyed(chunks: DataFrame, stream: str | Column, seq: str, data: str):
    key = F.col(stream) if isinstance(stream, str) else stream
    return chunks.select(key.cast("string").alias("stream"), F.col(seq).alias("seq"), F.col(data).alias("data")).groupBy("stream")


def _time_mode(idle_ms: int | None) -> str:
    """State that expires needs processing time. Such a query has always another batch to run, so it is for
    continuous triggers, not for `availableNow`."""
    return "none" if idle_ms is None else "processingTime"


def frames(chunks: DataFrame, stream: str | Column, seq: str, data: str, idle_ms: int | None = None, held: int = HELD_BYTES) -> DataFrame:
    """Complete frames per stream. A key's chunks of a micro-batch are ordered with at most `held` bytes in memory."""
    return _keyed(chunks, stream, seq, data).transformWithStateInPandas(
        FrameAssembler(idle_ms, held), "stream string, raw binary", "append", _time_mode(idle_ms))


def lines(chunks: DataFrame, stream: str | Column = "file_path", seq: str = "offset", data: str = "data",
          keep_cut: bool = True, held: int = HELD_BYTES) -> DataFrame:
    """Complete lines per stream, ordered as in `frames`; `keep_cut` tells whether the last line of a file that was replaced is one."""
    out = _keyed(chunks, stream, seq, data).transformWithStateInPandas(
        LineAssembler(keep_cut, held), "stream string, line binary", "append", "none")
    return out.withColumn("line", F.decode("line", "UTF-8"))


def shed(rows: DataFrame, session: str, seq: str, us: str, change: str,
         high: int = HIGH_WATERMARK_BYTES, low: int = LOW_WATERMARK_BYTES, full_seconds: int = FULL_SECONDS,
         idle_ms: int | None = None) -> DataFrame:
    keyed = rows.select(F.col(session).cast("string").alias("session"), F.col(seq).cast("bigint").alias("seq"),
                        F.col(us).cast("bigint").alias("us"), F.coalesce(F.col(change), F.lit(0)).cast("bigint").alias("change")).groupBy("session")
    return keyed.transformWithStateInPandas(
        Shedder(high, low, full_seconds, idle_ms),
        "session string, seq bigint, accepted boolean, level bigint, closed boolean", "append", _time_mode(idle_ms))


def report_intervals(reports: DataFrame, by: list[str], time: str, sums: dict[str, str], seconds: int = 10,
                     delay: str = "1 minute") -> DataFrame:
    """Counters per tumbling interval; late reports within the delay still count."""
    return metrics.report_intervals(reports.withWatermark(time, delay), by, time, sums, seconds)


def live_sessions(beats: DataFrame, agent: str, time: str, gap: str = "60 seconds", delay: str = "1 minute") -> DataFrame:
    """Unbroken stretches of heartbeats per agent; a stretch ends when two beats in a row are missed."""
    return beats.withWatermark(time, delay).groupBy(agent, F.session_window(time, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("beats")).select(agent, F.col("_w.start").alias("alive_from"), F.col("_w.end").alias("alive_to"), "beats")


def agent_life(beats: DataFrame, agent: str, time: str, seq: str, info: str | Column, gap_seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """(agent, event, us, info): `up`, `changed` and `down` of agents, as `metrics.life_events` has them; `metrics.registered` of what
    came so far is the registry, from which a silent agent is gone once the watermark has passed its last beat by the gap."""
    told = F.col(info) if isinstance(info, str) else info
    rows = beats.withWatermark(time, delay).select(F.col(agent).cast("string").alias("agent"), F.col(seq).cast("bigint").alias("seq"),
                                                   F.unix_micros(time).alias("us"), told.alias("told"), time)
    return rows.groupBy("agent").transformWithStateInPandas(AgentLife(gap_seconds), "agent string, event string, us bigint, info string", "append", "eventTime")


def first_contents(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Accepted messages without repeats of the same content within the watermark delay. State holds
    digests of that period only; the exact rule over all time is the batch audit."""
    sound = content_checks(messages).filter("problem IS NULL").withColumn("digest", F.sha2("value", 256))
    return sound.withWatermark("arrival", delay).dropDuplicatesWithinWatermark(["topic", "digest"])


def duplicate_flags(messages: DataFrame, delay: str = "10 minutes", retention_seconds: int | None = None, shards: int = 64) -> DataFrame:
    """(topic, partition, offset, duplicate) of accepted messages, by the exact rule of the batch audit: of equal contents of a topic
    the first by (arrival, partition, offset) is none. A message is judged when the watermark has passed it; only later ones than
    `delay` are left out. Digests stay for `retention_seconds`, for ever if None. A topic's contents are dealt to `shards`."""
    sound = content_checks(messages).filter("problem IS NULL AND arrival IS NOT NULL").withWatermark("arrival", delay)
    rows = sound.select("topic", F.pmod(F.xxhash64("value"), F.lit(shards)).cast("int").alias("shard"), F.col("partition").cast("int").alias("partition"),
                        F.col("offset").cast("bigint").alias("offset"), F.unix_micros("arrival").alias("us"), F.sha2("value", 256).alias("digest"), "arrival")
    return rows.groupBy("topic", "shard").transformWithStateInPandas(
        FirstContents(None if retention_seconds is None else retention_seconds * 1_000_000),
        "topic string, partition int, offset bigint, duplicate boolean", "append", "eventTime")


def late_flags(messages: DataFrame) -> DataFrame:
    """Messages with their lateness flag; late ones are kept."""
    return content_checks(messages)


def route_batches(read_tasks: Callable[[], DataFrame], read_clusters: Callable[[], DataFrame],
                  writers_for: Callable[[int], dict[str, sinks.Writer]] | None = None, ledger: ConfigLedger | None = None,
                  deliver_to: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that routes frames with the configuration as it is at that batch.

    A batch that runs again after a failure has the same number. With a `ledger` it meets the configuration of its first run,
    whatever changed since; without one it meets the current. Rows go to the writers of each cluster's kind,
    which replace what the first run left if they key their output by the number; or, with `deliver_to`, to the `fanout`
    sink there, which publishes all clusters in one step."""
    if (writers_for is None) == (deliver_to is None):
        raise ValueError("give either writers_for or deliver_to")

    def run(batch: DataFrame, batch_id: int) -> None:
        read = {"tasks": read_tasks, "clusters": read_clusters}
        config = ledger.at(batch_id, read) if ledger else {name: f() for name, f in read.items()}
        routed = routing.route(batch, config["tasks"], config["clusters"])
        if deliver_to is not None:
            fanout.deliver(routing.queue_rows(routed), deliver_to, batch_id)
        else:
            known = [row.asDict(recursive=True) for row in config["clusters"].collect()]
            sinks.fan_out(routed, known, writers_for(batch_id))

    return run
