"""Collection counters, gauges, reports and their text and JSON forms."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.functions import jsontext
from rillworks.operators.ordered import neighbour, running, running_sums, time_block

COUNTERS = ["lines_collected", "bytes_collected", "error_count"]
GAUGES = ["fast_files", "slow_files"]


def delta_reports(reports: DataFrame, keys: list[str], seq: str, sums: dict[str, str], ok: str,
                  block: Column) -> DataFrame:
    """Counters as sent: what a failed report held is part of the next one that succeeds.

    A segment is the run of reports up to and including a success, so rows are numbered by the
    successes before them. A segment without success is still pending (`sent` false)."""
    numbered = running_sums(reports, keys, [seq], {"segment": F.col(ok).cast("bigint")}, block)
    return numbered.groupBy(*keys, "segment").agg(
        F.max(seq).alias("last_seq"), F.bool_or(ok).alias("sent"), F.count(F.lit(1)).alias("reports"),
        *[F.sum(c).alias(n) for n, c in sums.items()])


def metrics_documents(counters: DataFrame, agent: str, timestamp: Column) -> DataFrame:
    """One JSON report per agent from one row per (agent, task); tasks in id order."""
    task = F.struct("task_id", *[F.col(c).cast("bigint").alias(c) for c in COUNTERS + GAUGES])
    return counters.groupBy(agent).agg(F.to_json(F.struct(
        timestamp.alias("timestamp"), F.array_sort(F.collect_list(task)).alias("tasks"))).alias("document"))


def accumulate(reports: DataFrame, agent: str, order: list[str], document: str) -> DataFrame:
    """Counters summed and gauges last per (agent, task) from nested reports.

    A member that a report does not have leaves the old value; reports that are not JSON are ignored."""
    number = "BIGINT"
    fields = ", ".join(f"{c}: {number}" for c in COUNTERS + GAUGES)
    strict = jsontext.with_document(reports.select(agent, *order, document), F.col(document)).filter("_doc IS NOT NULL")
    parsed = strict.select(agent, *order, F.from_json(
        document, f"STRUCT<tasks: ARRAY<STRUCT<task_id: STRING, {fields}>>>").alias("_doc"))
    rows = parsed.select(agent, *order, F.posexplode("_doc.tasks").alias("_pos", "_t"))
    latest = lambda c: F.max_by(F.col(f"_t.{c}"), F.when(F.col(f"_t.{c}").isNotNull(), F.struct(*order, "_pos")))
    return rows.groupBy(agent, F.coalesce("_t.task_id", F.lit("")).alias("task_id")).agg(
        *[F.sum(F.coalesce(F.col(f"_t.{c}"), F.lit(0))).alias(c) for c in COUNTERS],
        *[F.coalesce(latest(c), F.lit(0)).alias(c) for c in GAUGES])


def last_values(reports: DataFrame, agent: str, order: list[str], document: str) -> DataFrame:
    """Latest flat report per agent; missing members are 0; reports that are not JSON or have a member that is no number are ignored."""
    names = [*COUNTERS, "files_watched"]
    doc = F.col("_doc")
    parsed = jsontext.with_document(reports.select(agent, *order, document), F.col(document)).filter(
        doc.isNotNull() & (jsontext.kind(doc) == "OBJECT"))
    values = F.struct(*[F.coalesce(jsontext.member(doc, f".{c}", "bigint"), F.lit(0)).alias(c) for c in names])
    for c in names:  # a member that is no number rejects its report
        shape = F.schema_of_variant(jsontext.member(doc, f".{c}", "variant"))
        parsed = parsed.filter(F.coalesce(shape.isin("BIGINT", "DOUBLE", "VOID") | shape.startswith("DECIMAL"), F.lit(True)))
    last = parsed.groupBy(agent).agg(F.max_by(values, F.struct(*order)).alias("_last"))
    return last.select(agent, *[F.col(f"_last.{c}").alias(c) for c in names])


def connection_gauge(changes: DataFrame, relay: str, order: list[str], block: Column) -> DataFrame:
    """Adds `active`, the open connections after each change (+1 open, -1 close)."""
    return running_sums(changes, [relay], order, {"active": F.col("change").cast("bigint")}, block, inclusive=True)


def connection_summary(gauge: DataFrame, relay: str, order: list[str]) -> DataFrame:
    return gauge.groupBy(relay).agg(
        F.count_if(F.col("change") > 0).alias("opened"), F.count_if(F.col("change") < 0).alias("closed"),
        F.max("active").alias("peak"), F.max_by("active", F.struct(*order)).alias("active"))


def status_rows(gauge: DataFrame, relay: str, time: str, order: list[str], seconds: int = 30,
                until: Column | None = None) -> DataFrame:
    """Gauge value at the end of every tumbling interval from a relay's first change to its last one, or to
    the interval that holds `until`; an interval without a change has the value of the one before."""
    changed = gauge.groupBy(relay, F.window(time, f"{seconds} seconds").alias("_w")).agg(
        F.max_by("active", F.struct(*order)).alias("active")).select(
        relay, (F.unix_seconds("_w.start")).alias("_start"), "active")
    linked = neighbour(changed, [relay], ["_start"], {"_next": F.col("_start")},
                       F.floor(F.col("_start") / F.lit(seconds << 16)).cast("bigint"), ahead=True)
    end = F.col("_start") if until is None else F.greatest("_start", F.unix_seconds(until))
    last = F.coalesce(F.col("_next") - seconds, end)
    filled = linked.select(relay, "active", F.explode(F.sequence("_start", last, F.lit(seconds).cast("bigint"))).alias("_at"))
    return filled.select(relay, F.timestamp_seconds("_at").alias("interval_start"), "active")


def report_intervals(reports: DataFrame, by: list[str], time: str, sums: dict[str, str], seconds: int = 10) -> DataFrame:
    """Counters per tumbling report interval."""
    return reports.groupBy(*by, F.window(time, f"{seconds} seconds").alias("_w")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]).select(*by, F.col("_w.start").alias("interval_start"), *sums)


def liveness(beats: DataFrame, agent: str, time: str, seq: str, gap_seconds: int = 60, block_seconds: int = 3600) -> DataFrame:
    """Beats, silences longer than two missed beats, the longest one, and the last beat per agent."""
    linked = neighbour(beats, [agent], [time, seq], {"_before": F.col(time)}, time_block(time, block_seconds))
    silence = F.unix_micros(time) - F.unix_micros("_before")
    return linked.groupBy(agent).agg(
        F.count(F.lit(1)).alias("beats"),
        F.count_if(silence > gap_seconds * 1_000_000).alias("silences"),
        F.coalesce(F.max(silence), F.lit(0)).alias("longest_silence_us"),
        F.max(time).alias("last_seen"))


def life_events(beats: DataFrame, agent: str, time: str, seq: str, info: Column, now: Column, gap_seconds: int = 60,
                block_seconds: int = 3600) -> DataFrame:
    """(agent, event, us, info): when agents came up, registered anew, and went silent.

    Every row is a beat; one with `info` (text, NULL for a plain beat) registers. An agent is `up` at its first beat and at the first after
    a silence longer than `gap_seconds`; `changed` at a beat in between with an info other than the one before; `down`, at its
    last beat, once it has been silent that long, up to `now`. Each event has the info in force."""
    gap = gap_seconds * 1_000_000
    rows = beats.select(F.col(agent), F.col(time), F.col(seq), F.unix_micros(time).alias("_us"), info.alias("_told"))
    block = time_block(time, block_seconds)
    known = running(rows, [agent], [time, seq], {"_before": ("last", F.col("_us")), "_old": ("last", F.col("_told"))}, block)
    linked = neighbour(known, [agent], [time, seq], {"_next": F.col("_us")}, block, ahead=True)
    came = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > gap)
    changed = F.col("_told").isNotNull() & ~F.col("_told").eqNullSafe(F.col("_old"))
    gone = F.coalesce("_next", F.unix_micros(now)) - F.col("_us") > gap
    event = lambda when, name: F.when(when, F.lit(name))
    told = F.array_compact(F.array(F.when(came, "up").when(changed, "changed"), event(gone, "down")))
    return linked.select(agent, F.explode(told).alias("event"), F.col("_us").alias("us"), F.coalesce("_told", "_old").alias("info"))


def registered(events: DataFrame, agent: str) -> DataFrame:
    """(agent, info, since) of the agents that are up, from the events of `life_events` or of the stream that tells them."""
    rank = F.when(F.col("event") == "down", 1).otherwise(0)
    last = events.groupBy(agent).agg(F.max_by(F.struct("event", "info"), F.struct("us", rank)).alias("_last"),
                                     F.max(F.when(F.col("event") == "up", F.col("us"))).alias("since"))
    return last.filter("_last.event <> 'down'").select(agent, F.col("_last.info").alias("info"), "since")


def registry(registrations: DataFrame, alive: DataFrame, agent: str, order: list[str], now: Column,
             columns: list[str], gap_seconds: int = 60) -> DataFrame:
    """Latest registration per agent; an agent whose last beat is too old is gone (status row absent)."""
    last = registrations.groupBy(agent).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    seen = alive.filter(F.unix_micros(now) - F.unix_micros("last_seen") <= gap_seconds * 1_000_000)
    return last.join(seen.select(agent, "last_seen"), agent).select(
        agent, *[F.col(f"_last.{c}").alias(c) for c in columns], "last_seen")


def exposition(metrics: DataFrame, families: dict[str, tuple[str, str]], labels: list[str]) -> DataFrame:
    """Text exposition of one table, see `exposition_of`."""
    return exposition_of(metrics.sparkSession, [(metrics, families, labels)])


def exposition_of(spark: SparkSession, sources: list[tuple[DataFrame, dict[str, tuple[str, str]], list[str]]]) -> DataFrame:
    """Text exposition, one row per line: (family_no, line_no, line).

    Each source is (table, families, labels): `families` maps a column, which names the family, to (kind, help), and its samples carry
    the label columns. HELP and TYPE lines come first in each family, families in the order given; samples are ordered by
    their label text, so no row needs a global number: sort by (family_no, line_no, line)."""
    heads, parts, number = [], [], 0
    for table, families, labels in sources:
        pairs = [F.concat(F.lit(f'{n}="'), _escaped(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit('"')) for n in labels]
        shown = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit("")
        values = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("value")) for n in families])
        stacked = table.select(shown.alias("_labels"), F.posexplode(values).alias("_no", "_m"))
        parts.append(stacked.select((F.col("_no") + number).alias("family_no"), F.lit(2).alias("line_no"), F.concat(
            "_m.name", "_labels", F.lit(" "), F.coalesce("_m.value", F.lit(0)).cast("string")).alias("line")))
        heads += [(number + i, j, text) for i, (name, (kind, text_help)) in enumerate(families.items())
                  for j, text in enumerate([f"# HELP {name} {text_help}", f"# TYPE {name} {kind}"])]
        number += len(families)
    lines = spark.createDataFrame(heads, "family_no INT, line_no INT, line STRING")
    for part in parts:
        lines = lines.unionByName(part)
    return lines


def _escaped(value: Column) -> Column:
    slashed = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slashed, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metrics_json(agents: DataFrame, queues: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per key (a relay, or a page of its agents) with agent and queue arrays, both
    in id order."""
    agent = F.struct("agent_id", *COUNTERS, "files_watched")
    queue = F.struct("cluster_id", "messages_sent", "messages_failed")
    left = agents.groupBy(*keys).agg(F.array_sort(F.collect_list(agent)).alias("agent_metrics"))
    right = queues.groupBy(*keys).agg(F.array_sort(F.collect_list(queue)).alias("mq_metrics"))
    joined = left.join(right, keys, "full")
    return joined.select(*keys, F.to_json(F.struct(
        F.coalesce("agent_metrics", F.array()).alias("agent_metrics"),
        F.coalesce("mq_metrics", F.array()).alias("mq_metrics"))).alias("document"))
