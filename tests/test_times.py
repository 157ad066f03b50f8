"""Operators ordered by time: blocks follow the time, whatever the sequence numbers are."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillworks.operators import logparse, metrics
from rillworks.operators.ordered import block_of, neighbour, running
from rillworks.plans import bridge


def beats(spark, n=300):
    rng = random.Random(4)
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([1, 20, 61, 400])
        out.append(("hot" if rng.random() < 0.6 else f"a{rng.randrange(3)}", at, rng.randrange(10**6)))
    return out, spark.createDataFrame(out, "agent string, t bigint, seq bigint").withColumn("ts", F.timestamp_seconds("t"))


def gaps(rows, over):
    last, found = {}, []
    for agent, t, _ in rows:
        if agent in last and t - last[agent] > over:
            found.append((agent, last[agent], t))
        last[agent] = t
    return found


@pytest.mark.parametrize("block_seconds", [1, 100, 10**6])
def test_silences_do_not_depend_on_blocks(spark, block_seconds):
    rows, df = beats(spark)
    out = metrics.liveness(df, "agent", "ts", "seq", 60, block_seconds).collect()
    for r in out:
        mine = [b - a for k, a, b in gaps(rows, 0) if k == r.agent]
        assert (r.silences, r.longest_silence_us) == (sum(g > 60 for g in mine), max(mine) * 1_000_000)
    assert sum(r.beats for r in out) == len(rows)


@pytest.mark.parametrize("block_seconds", [7, 10**6])
def test_recoveries_do_not_depend_on_blocks(spark, block_seconds):
    rows, df = beats(spark)
    out = logparse.recoveries(df, "agent", "ts", "seq", 300, block_seconds).select(
        "agent", F.unix_seconds("outage_start").alias("a"), F.unix_seconds("outage_end").alias("b"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(gaps(rows, 300))


def test_blocks_against_the_order_fail(spark):
    _, df = beats(spark)
    with pytest.raises(PySparkException, match="blocks do not follow"):
        neighbour(df, ["agent"], ["ts", "seq"], {"x": F.col("t")}, block_of("seq", 10)).collect()


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_running_last(spark, bits):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "i bigint, v bigint").withColumn("k", F.lit("k"))
    out = running(df, ["k"], ["i"], {"last_v": ("last", F.col("v"))}, block_of("i", bits), inclusive=True)
    seen, want = None, {}
    for i, v in rows:
        seen = v if v is not None else seen
        want[i] = seen
    assert {r.i: r.last_v for r in out.collect()} == want


def test_status_of_quiet_intervals(spark):
    df = spark.createDataFrame([("r", 1, 5, 1), ("r", 2, 7, 2), ("r", 3, 100, 1), ("q", 4, 31, 1)], "relay string, seq bigint, t bigint, active bigint")
    gauge = df.withColumn("ts", F.timestamp_seconds("t"))
    got = lambda **more: sorted((r.relay, r.at, r.active) for r in metrics.status_rows(gauge, "relay", "ts", ["seq"], **more).select(
        "relay", F.unix_seconds("interval_start").alias("at"), "active").collect())
    assert got() == [("q", 30, 1), ("r", 0, 2), ("r", 30, 2), ("r", 60, 2), ("r", 90, 1)]
    assert got(until=F.timestamp_seconds(F.lit(125))) == [
        ("q", 30, 1), ("q", 60, 1), ("q", 90, 1), ("q", 120, 1), ("r", 0, 2), ("r", 30, 2), ("r", 60, 2), ("r", 90, 1), ("r", 120, 1)]


def test_lines_of_nothing(spark):
    gauge = spark.createDataFrame([], "relay string, seq bigint, ts timestamp, active bigint")
    assert metrics.status_rows(gauge, "relay", "ts", ["seq"]).count() == 0


def test_large_tables_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(bridge, "TASK_ROWS", 100)
    try:
        assert bridge.spread(spark.range(1000, numPartitions=8)).rdd.getNumPartitions() == 10
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
        assert bridge.spread(spark.range(50, numPartitions=1)).rdd.getNumPartitions() == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
