"""Audit of what arrived in the topics: validity, duplicates, lateness, completeness, throughput.

Messages are rows (topic, partition, offset, arrival TIMESTAMP, value STRING);
(topic, partition, offset) is unique, and arrival order is (arrival, partition, offset).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillworks.functions import jsontext
from rillworks.operators.offsets import cut_by_share
from rillworks.operators.ordered import shuffle_partitions
from rillworks.functions.once import once
from rillworks.functions.clock import iso_instant
from rillworks.model import LATE_SECONDS, MAX_MESSAGE_CHARS, PASS_RATE, REQUIRED_FIELDS

POSITION = ["topic", "partition", "offset"]


def _first(pairs: list[tuple[Column, str]]) -> Column:
    """Name of the first condition that holds, else NULL."""
    return F.coalesce(*[F.when(condition, name) for condition, name in pairs])


def _missing(present) -> Column:
    return _first([(~present(f), f"missing:{f}") for f in REQUIRED_FIELDS])


def content_checks(messages: DataFrame) -> DataFrame:
    """Adds `problem` (first failing rule that looks at the message alone, NULL if none),
    `oversize`, `late` and `digest`. Each value is parsed once."""
    value, doc = F.col("value"), F.col("_doc")
    stamp = jsontext.member(doc, ".timestamp", "variant")
    shaped = once(jsontext.with_document(messages, value), _kind=F.when(doc.isNotNull(), jsontext.kind(doc)))
    is_object = F.col("_kind") == "OBJECT"
    stamped = once(shaped, _stamp=F.when(
        is_object & jsontext.is_string(stamp), jsontext.member(doc, ".timestamp")))
    dated = once(stamped, _instant=iso_instant(F.col("_stamp")))

    elements = F.try_variant_get(doc, "$", "array<variant>")
    listed = F.filter(elements, lambda e: F.coalesce(jsontext.is_string(e), F.lit(False)))
    names = F.transform(listed, lambda e: F.try_variant_get(e, "$", "string"))
    json_problem = (
        F.when(is_object, F.coalesce(
            _missing(lambda f: jsontext.has_member(doc, f)),
            F.when(F.col("_stamp").isNull(), "exception"),
            F.when(F.col("_instant").isNull(), "bad_timestamp")))
        .when(F.col("_kind") == "ARRAY", F.coalesce(
            _missing(lambda f: F.array_contains(names, f)), F.lit("exception")))
        .when(F.col("_kind") == "STRING", F.coalesce(
            _missing(lambda f: F.contains(jsontext.member(doc, ""), F.lit(f))), F.lit("exception")))
        .otherwise("exception")
    )
    problem = (
        F.when(value.isNull() | (value == ""), "empty")
        .when(doc.isNotNull(), json_problem)
        .when(value.rlike(r"\A\s*\z"), "blank")
    )
    late = F.col("arrival") - F.col("_instant") > F.expr(f"INTERVAL {LATE_SECONDS} SECONDS")
    return dated.select(
        *messages.columns,
        problem.alias("problem"),
        F.coalesce(F.length(value) > MAX_MESSAGE_CHARS, F.lit(False)).alias("oversize"),
        F.coalesce(late, F.lit(False)).alias("late"),
    )


def classify(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per message: position, `keep` columns, `late`, and `reason` ('valid' or the first rule
    it fails).

    The message text is read and parsed once: what is left of a row (flags and a digest) is placed by
    its unique position, and both uses below take all of its columns so that they share that one
    exchange. First arrivals are found by a partial aggregation per task, so a content that makes up
    a large share of the rows is reduced before it is shuffled, and rows meet the first arrivals on
    the position, never on the content. There are about as many first arrivals as messages, so they are never
    broadcast: the size of the files says little about them.
    """
    carried = [c for c in keep or [] if c not in POSITION]
    checked = content_checks(messages)
    digest = F.when(F.col("problem").isNull(), F.sha2("value", 256)).alias("digest")
    flags = ["problem", "oversize", "late", *[c for c in carried if c != "arrival"]]
    placed = checked.select(*POSITION, "arrival", *flags, digest).repartition(shuffle_partitions(messages), *POSITION)

    order = F.struct("arrival", "partition", "offset", *flags, "topic")
    firsts = (
        placed.groupBy("topic", "digest")
        .agg(F.min(F.when(F.col("problem").isNull(), order)).alias("_p"))
        .filter(F.col("_p").isNotNull())
        .select(*[F.col(f"_p.{c}").alias(c) for c in POSITION], F.lit(True).alias("_first"))
    )
    whole = F.xxhash64("arrival", *flags, "digest").bitwiseOR(F.lit(1)) != 0  # always true: a caller that drops columns reads the exchange too
    repeats = F.col("_first").isNull() & F.col("digest").isNotNull() & whole
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(repeats, "duplicate")
        .when(F.col("oversize"), "oversize")
        .otherwise("valid")
    )
    return placed.join(firsts.hint("merge"), POSITION, "left").select(
        *POSITION, *carried, "late", reason.alias("reason"))


def duplicates(messages: DataFrame) -> DataFrame:
    """Positions of messages that repeat an earlier accepted content of their topic."""
    return classify(messages).filter(F.col("reason") == "duplicate").select(*POSITION)


def late_messages(messages: DataFrame) -> DataFrame:
    return content_checks(messages).filter("late").select(*POSITION)


def validation_summary(classified: DataFrame) -> DataFrame:
    """Totals per topic plus one row over all topics (`topic` NULL)."""
    counts = {
        "total_messages": F.lit(True), "valid_messages": F.col("reason") == "valid", "invalid_messages": F.col("reason") != "valid",
        "duplicate_messages": F.col("reason") == "duplicate", "late_messages": F.col("late")}
    per_topic = classified.groupBy("topic").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    totals = per_topic.rollup("topic").agg(*[F.sum(n).alias(n) for n in counts])
    return totals.withColumn("success_rate", percent("valid_messages", "total_messages"))


def report(classified: DataFrame, messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The whole audit as one nested row, or one per `by`: validation_summary, performance_metrics, error_breakdown.

    `classified` is what `classify` gives for `messages`, with the `by` columns. Rows of no messages give a row of zeros if there is
    no `by`. error_breakdown maps each reason to its messages."""
    by = by or []
    reasons = classified.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("_n"), F.count_if("late").alias("_late"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    reason = F.col("reason")
    tallied = reasons.groupBy(*by).agg(
        n(F.lit(True)).alias("total_messages"), n(reason == "valid").alias("valid_messages"), n(reason != "valid").alias("invalid_messages"),
        n(reason == "duplicate").alias("duplicate_messages"), F.coalesce(F.sum("_late"), F.lit(0)).alias("late_messages"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(reason != "valid", F.struct("reason", "_n"))))).alias("error_breakdown"))
    summary = F.struct("total_messages", "valid_messages", "invalid_messages", "duplicate_messages", "late_messages",
                       percent("valid_messages", "total_messages").alias("success_rate")).alias("validation_summary")
    timed = throughput(messages, by)
    columns = ["duration_seconds", "throughput_msgs_per_sec", "bytes_received", "bytes_per_sec", "avg_msg_size"]
    speed = timed.select(*by, F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) if c == "duration_seconds" else F.col(c) for c in columns]).alias("performance_metrics"))
    if not by:  # both are one row
        return tallied.select(summary, "error_breakdown", F.lit(0).alias("_one")).join(speed.withColumn("_one", F.lit(0)), "_one").select(
            "validation_summary", "performance_metrics", "error_breakdown")
    return tallied.select(*by, summary, "error_breakdown").join(speed, by).select(*by, "validation_summary", "performance_metrics", "error_breakdown")


def percent(part: str, whole: str) -> Column:
    """part / whole x 100, 0 when the whole is 0."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(0.0))


def error_breakdown(classified: DataFrame, by: list[str]) -> DataFrame:
    return classified.filter(F.col("reason") != "valid").groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("messages"))


def throughput(messages: DataFrame, by: list[str]) -> DataFrame:
    """Messages, bytes, duration and rates from the arrival times; 0 where the divisor is 0."""
    totals = messages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes_received"),
        ((F.unix_micros(F.max("arrival")) - F.unix_micros(F.min("arrival"))) / 1e6).alias("duration_seconds"),
    )
    rate = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return totals.select(
        "*",
        rate("messages", "duration_seconds").alias("throughput_msgs_per_sec"),
        rate("bytes_received", "duration_seconds").alias("bytes_per_sec"),
        rate("bytes_received", "messages").alias("avg_msg_size"),
    )


def bounded_read(messages: DataFrame, seconds: int, max_messages: int | None = None) -> DataFrame:
    """Per topic: the first `max_messages` that arrive within `seconds` of the topic's first message; all of them if None.

    Rows are cut within shares of a topic before they meet per topic, whatever the limit. `read_no` is
    given with a limit only.
    """
    opened = messages.groupBy("topic").agg(F.min("arrival").alias("_opened"))
    inside = messages.join(opened, "topic").filter(
        F.col("arrival") <= F.col("_opened") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    inside = inside.drop("_opened")
    if max_messages is None:
        return inside
    by = ["arrival", "partition", "offset"]
    return cut_by_share(inside, ["topic"], [F.col(c) for c in by], max_messages, "read_no", 64, by)


def topic_positions(snapshots: DataFrame) -> DataFrame:
    """Log-end positions summed over partitions, before and after, and the difference.

    Rows: (topic, partition, offset, phase 'before' | 'after')."""
    ends = snapshots.groupBy("topic", "partition").agg(*[
        F.coalesce(F.max(F.when(F.col("phase") == p, F.col("offset") + 1)), F.lit(0)).alias(p)
        for p in ("before", "after")])
    return ends.groupBy("topic").agg(
        F.sum("before").alias("position_before"), F.sum("after").alias("position_after"),
        F.sum(F.col("after") - F.col("before")).alias("processed"))


def completeness(produced: DataFrame, consumed: DataFrame, key: str, tolerance: int = 5,
                 minimum: int = 10) -> DataFrame:
    """Counts on both sides per key with the verdict: difference within tolerance and enough consumed."""
    left = produced.groupBy(key).agg(F.count(F.lit(1)).alias("produced"))
    right = consumed.groupBy(key).agg(F.count(F.lit(1)).alias("consumed"))
    both = left.join(right, key, "full").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("produced", "consumed")])
    gap = F.abs(F.col("produced") - F.col("consumed"))
    verdict = (F.when(gap > tolerance, "mismatch").when(F.col("consumed") < minimum, "too_few").otherwise("pass"))
    return both.select("*", gap.alias("difference"), verdict.alias("verdict"))


def run_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    """Totals over runs, one row per run, from real durations.

    Rows: (total_messages, valid_messages, duration_seconds)."""
    rated = runs.select(
        "*",
        F.when(F.col("duration_seconds") > 0, F.col("total_messages") / F.col("duration_seconds"))
        .otherwise(F.lit(0.0)).alias("_rate"))
    out = rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total_messages").alias("total_messages"),
        F.sum("valid_messages").alias("valid_messages"),
        F.sum(F.col("duration_seconds").cast("decimal(20,6)")).cast("double").alias("duration_seconds"),
        F.max("_rate").alias("peak_throughput"))
    return out.select(
        "*", percent("valid_messages", "total_messages").alias("success_rate"),
        F.when(F.col("duration_seconds") > 0, F.col("total_messages") / F.col("duration_seconds"))
        .otherwise(F.lit(0.0)).alias("average_throughput"))


def verdicts(runs: DataFrame, rate: Column, high_rate: float, stress_floor: float = 1000.0) -> DataFrame:
    """Advice, verdict and tier columns per run; `session_verdict` judges runs as a set.

    Rows: (success_rate, throughput, ...); `rate` is the offered rate of the run, whose own peak is its throughput."""
    advice = F.array_compact(F.array(
        F.when(F.col("success_rate") < PASS_RATE, "low_success_rate"),
        F.when(F.col("throughput") < rate * 0.8, "low_throughput"),
        F.when(F.col("throughput") < high_rate, "peak_below_high_rate")))
    judged = runs.select(
        "*", F.array_join(advice, ",").alias("advice"),
        (F.col("success_rate") >= PASS_RATE).alias("passed"),
        (F.floor("throughput") >= stress_floor).alias("stress_passed"))
    return judged.withColumn("tier", _tier())


def _tier() -> Column:
    return F.when(F.col("success_rate") == 100, "good").when(F.col("success_rate") >= 75, "mostly_good").otherwise("poor")


def session_verdict(runs: DataFrame, by: list[str], high_rate: float) -> DataFrame:
    """Totals and advice over a set of runs, one row per `by`.

    Rows: (total_messages, valid_messages, duration_seconds) per run. The success rate is the mean over the runs, each counting
    alike; the average throughput is that of all messages over all run time; the peak is that of the best run."""
    rated = runs.select(*by, "total_messages", "duration_seconds", percent("valid_messages", "total_messages").alias("_rate"),
                        F.when(F.col("duration_seconds") > 0, F.col("total_messages") / F.col("duration_seconds")).otherwise(0.0).cast("double").alias("_speed"))
    seconds = F.sum(F.col("duration_seconds").cast("decimal(20,6)")).cast("double")
    out = rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total_messages").alias("total_messages"), F.avg(F.col("_rate").cast("decimal(20,12)")).cast("double").alias("average_success_rate"),
        F.when(seconds > 0, F.sum("total_messages") / seconds).otherwise(0.0).alias("average_throughput"), F.max("_speed").alias("peak_throughput"))
    advice = F.array_compact(F.array(F.when(F.col("average_success_rate") < PASS_RATE, "low_success_rate"),
                                     F.when(F.col("peak_throughput") < high_rate, "peak_below_high_rate")))
    return out.withColumn("advice", F.array_join(advice, ","))


def suite_verdict(tally: DataFrame) -> DataFrame:
    """Adds `tier` by the share of tests that passed to rows of `result_tally`: all, three quarters, or fewer."""
    return tally.withColumn("tier", _tier())


def result_tally(results: DataFrame, by: list[str]) -> DataFrame:
    """Tests run, passed and failed. Rows: (result 'PASS' | 'FAIL')."""
    out = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(F.col("result") == "PASS").alias("passed_tests"),
        F.count_if(F.col("result") != "PASS").alias("failed_tests"))
    return out.withColumn("success_rate", percent("passed_tests", "total_tests"))
