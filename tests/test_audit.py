import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rillworks.operators import audit

BASE = dt.datetime(2024, 1, 1, 12, 0, 0)


def messages(spark, values, topic="t", step=1.0):
    rows = [(topic, 0, i, BASE + dt.timedelta(seconds=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, arrival timestamp, value string")


def doc(ts):
    return json.dumps({"timestamp": ts, "level": "INFO", "message": "m"})


VALUES = [
    None, "", "  \n\t ", "plain", "plain", '{"a":1}x', '{"a":1} {"b":2}', "true false", '"x" y', '1],[2', '{"a":1}] [{"b":2}',
    "[1, 2]", '["timestamp", "level", "message"]', '["timestamp", "level"]', '"timestamp level message"', '"timestamp"',
    "5", "null", "true", "-1.5e3", '{"timestamp": null, "level": 1, "message": 2}', '{"timestamp": 5, "level": 1, "message": 2}',
    '{"level": null, "message": null}', '{"timestamp": "2024-01-01", "message": 1}', '{"timestamp": "2024-01-01", "level": 1}',
    '{"timestamp": "x", "timestamp": "2024-01-01", "level": 1, "message": 1}', ' {"timestamp": "2024-01-01", "level": 1, "message": 1} ',
    '{"timestamp": ["2024-01-01"], "level": 1, "message": 1}', "{}", "[]", '{"timestamp": "2024-01-01", "level": {"x": [1]}, "message": []}',
    "x" * (1024 * 1024 + 1), "x" * (1024 * 1024 + 1), "é" * (1024 * 1024), '{"unclosed": "', "[", "]", "}", '{"a"}',
] + [doc(t) for t in (
    "2024-01-01", "2024-01-01T10", "2024-01-01T10:11", "2024-01-01 10:11:12", "2024-01-01T10:11:12.123456", "2024-01-01T10:11:12Z",
    "2024-01-01T10:11:12.5+02:00", "2024-01-01T10:11:12-0330", "2024-13-01", "2024-02-30", "2024-01-01T25:00", "2024", "2024-01", "",
    "2024-01-01T10:11:12 ", "not a date", "2024-01-01T10Z", "2024-01-01T10:61", "01/02/2024", "2024-1-1", "2024-02-29T00:00:00", "2023-02-29")]

#: What each of the values is, in order.
REASONS = [
    "empty", "empty", "blank", "valid", "duplicate", "valid", "valid", "valid", "valid", "valid", "valid", "missing:timestamp", "exception",
    "missing:message", "exception", "missing:level", "exception", "exception", "exception", "exception", "exception", "exception",
    "missing:timestamp", "missing:level", "missing:message", "valid", "valid", "exception", "missing:timestamp", "missing:timestamp", "valid",
    "oversize", "duplicate", "valid", "valid", "valid", "valid", "valid", "valid", "valid", "valid", "valid", "valid", "valid", "valid", "valid",
    "valid", "bad_timestamp", "bad_timestamp", "bad_timestamp", "bad_timestamp", "bad_timestamp", "bad_timestamp", "bad_timestamp", "bad_timestamp",
    "valid", "bad_timestamp", "bad_timestamp", "bad_timestamp", "valid", "bad_timestamp",
]


def test_rules(spark):
    assert len(VALUES) == len(REASONS)
    got = {r.offset: r.reason for r in audit.classify(messages(spark, VALUES)).collect()}
    assert {i: (VALUES[i] and VALUES[i][:60], got[i], want) for i, want in enumerate(REASONS) if got[i] != want} == {}


def test_duplicates_count_per_topic_and_follow_arrival(spark):
    a, b = messages(spark, ["same"] * 50 + ["other"]), messages(spark, ["same"], "u")
    backwards = a.withColumn("arrival", F.timestamp_seconds(F.lit(1704110400) - F.col("offset")))
    out = audit.classify(backwards.unionByName(b))
    assert out.filter("reason = 'valid'").select("topic", "offset").sort("topic", "offset").collect() == [("t", 49), ("t", 50), ("u", 0)]


def test_failed_messages_do_not_count_as_first(spark):
    bad = doc("nope")
    reasons = [r.reason for r in audit.classify(messages(spark, [bad, bad])).sort("offset").collect()]
    assert reasons == ["bad_timestamp", "bad_timestamp"]


def test_late(spark):
    stamps = [BASE - dt.timedelta(seconds=s) for s in (4, 5, 6)]
    values = [doc(s.isoformat()) for s in stamps] + [json.dumps({"timestamp": "2024-01-01T00:00:00"}), "text", "[1]"]
    assert sorted(r.offset for r in audit.late_messages(messages(spark, values, step=0)).collect()) == [2, 3]


def test_summary(spark):
    out = {r.topic: r for r in audit.validation_summary(audit.classify(messages(spark, ["a", "a", "", "b"]))).collect()}
    assert (out["t"].total_messages, out["t"].valid_messages, out["t"].duplicate_messages, out["t"].success_rate) == (4, 2, 1, 50.0)
    assert out[None].invalid_messages == 2


def test_throughput_without_duration(spark):
    r = audit.throughput(messages(spark, ["é"]), ["topic"]).first()
    assert (r.bytes_received, r.throughput_msgs_per_sec, r.bytes_per_sec, r.avg_msg_size) == (2, 0.0, 0.0, 2.0)


def test_bounded_read(spark):
    m = messages(spark, [str(i) for i in range(30)])
    assert audit.bounded_read(m, 10, 100).count() == 11
    assert sorted(r.offset for r in audit.bounded_read(m, 100, 3).collect()) == [0, 1, 2]


@pytest.mark.parametrize("produced, consumed, verdict", [(20, 15, "pass"), (20, 14, "mismatch"), (9, 9, "too_few"), (0, 7, "mismatch")])
def test_completeness(spark, produced, consumed, verdict):
    side = lambda n: spark.range(n).selectExpr("'k' AS k")
    assert audit.completeness(side(produced), side(consumed), "k").first().verdict == verdict


def test_classify_reads_the_messages_once(spark):
    out = audit.classify(messages(spark, ["a", "b"]))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_report_is_one_nested_row(spark):
    rows = messages(spark, [doc("2024-01-01T00:00:00"), "", "plain", "plain", "{}"])
    r = audit.report(audit.classify(rows), rows).first()
    assert r.validation_summary.asDict() == {"total_messages": 5, "valid_messages": 2, "invalid_messages": 3, "duplicate_messages": 1,
                                             "late_messages": r.validation_summary.late_messages, "success_rate": 40.0}
    assert r.error_breakdown == {"duplicate": 1, "empty": 1, "missing:timestamp": 1}
    assert r.performance_metrics.duration_seconds == 4.0 and r.performance_metrics.throughput_msgs_per_sec == 1.25
    none = rows.limit(0)
    r = audit.report(audit.classify(none), none).first()
    assert (r.validation_summary.total_messages, r.validation_summary.success_rate, r.error_breakdown, r.performance_metrics.duration_seconds) == (0, 0.0, {}, 0.0)
    assert audit.report(audit.classify(none), none, ["topic"]).count() == 0


def test_verdicts_over_a_set_of_runs(spark):
    runs = spark.createDataFrame([("s", 100, 100, 10.0), ("s", 300, 270, 10.0), ("t", 10, 10, 0.0)], "s string, total_messages bigint, valid_messages bigint, duration_seconds double")
    out = {r.s: r for r in audit.session_verdict(runs, ["s"], 40.0).collect()}
    assert (out["s"].runs, out["s"].total_messages, out["s"].average_success_rate, out["s"].average_throughput, out["s"].peak_throughput, out["s"].advice) == (2, 400, 95.0, 20.0, 30.0, "peak_below_high_rate")
    assert (out["t"].average_throughput, out["t"].peak_throughput) == (0.0, 0.0)
    tests = spark.createDataFrame([("a", "PASS")] * 4 + [("b", "PASS")] * 3 + [("b", "FAIL"), ("c", "FAIL")], "k string, result string")
    assert {r.k: r.tier for r in audit.suite_verdict(audit.result_tally(tests, ["k"])).collect()} == {"a": "good", "b": "mostly_good", "c": "poor"}


def test_verdicts_of_single_runs(spark):
    runs = spark.createDataFrame([("a", 100.0, 3000.0), ("b", 80.0, 1200.0), ("c", 50.0, 900.0)], "run string, success_rate double, throughput double")
    out = {r.run: (r.advice, r.passed, r.stress_passed, r.tier) for r in audit.verdicts(runs, F.lit(2000.0), 1000.0).collect()}
    assert out == {"a": ("", True, True, "good"), "b": ("low_success_rate,low_throughput", False, True, "mostly_good"),
                   "c": ("low_success_rate,low_throughput,peak_below_high_rate", False, False, "poor")}


def test_first_arrivals_are_not_broadcast_and_dropped_columns_cost_no_second_read(spark):
    rows = messages(spark, ["a", "b", "a"])
    for out in (audit.classify(rows).drop("late"), audit.duplicates(rows), audit.error_breakdown(audit.classify(rows), ["topic"])):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "ReusedExchange" in plan
