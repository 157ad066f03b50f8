import random

import pytest
from pyspark.sql import functions as F
from test_streams import feed, run

from rillworks.operators import audit, metrics, ordered, routing
from rillworks.operators.ordered import block_of
from rillworks.sources import fanout
from rillworks.streaming import jobs
from rillworks.streaming.ledger import ConfigLedger

FRAMES = "task_id bigint, offset bigint, payload binary"


def shown(spark, path):
    return sorted((r.batch, r.cluster_id, r.topic, bytes(r.value), {h.key: bytes(h.value) for h in r.headers}["offset"]) for r in fanout.delivered(spark, path).collect())


def routed(spark, n=40):
    tasks = spark.createDataFrame([(str(i), f"t/{i % 3}", f"c{i % 4}") for i in range(8)], "task_id string, topic string, cluster_id string")
    clusters = spark.createDataFrame([("c0",), ("c1",), ("c2",)], "cluster_id string")
    rows = [(i % 9, i, b"%d" % i) for i in range(n)]
    want = sorted((f"c{i % 9 % 4}", f"t/{i % 9 % 3}", b"%d" % i, b"%d" % i) for i in range(n) if i % 9 < 8 and i % 9 % 4 < 3)
    return routing.queue_rows(routing.route(spark.createDataFrame(rows, FRAMES).repartition(3), tasks, clusters)), want


def test_all_clusters_are_published_together(spark, tmp_path):
    rows, want = routed(spark)
    fanout.deliver(rows, str(tmp_path / "out"), 7)
    fanout.deliver(rows, str(tmp_path / "out"), 7)  # the batch again
    assert [r[1:] for r in shown(spark, str(tmp_path / "out"))] == want
    fanout.deliver(rows, str(tmp_path / "out"))
    assert len(shown(spark, str(tmp_path / "out"))) == 2 * len(want)
    fanout.deliver(rows.limit(0), str(tmp_path / "out"), 8)
    assert len(shown(spark, str(tmp_path / "out"))) == 2 * len(want)


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    rows, want = routed(spark)
    fanout.deliver(rows, str(tmp_path / "out"), 0)
    broken = rows.withColumn("value", F.when(F.col("value").cast("string") == "28", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        fanout.deliver(broken, str(tmp_path / "out"), 1)
    assert [r[1:] for r in shown(spark, str(tmp_path / "out"))] == want


def test_fanout_as_a_stream(spark, tmp_path):
    fanout.register(spark)
    rows = [("c", f"t{i % 2}", b"k", b"%d" % i) for i in range(12)]
    stream = feed(spark, tmp_path / "in", rows, "cluster_id string, topic string, key binary, value binary", 3)
    shaped = stream.withColumn("headers", F.array(F.struct(F.lit("offset").alias("key"), F.lit(b"0").alias("value"))))
    shaped.writeStream.format("fanout").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = shown(spark, str(tmp_path / "out"))
    assert sorted(r[3] for r in got) == sorted(b"%d" % i for i in range(12)) and {r[0] for r in got} == {"batch-0", "batch-1", "batch-2"}


def test_a_batch_that_runs_again_meets_its_configuration(spark, tmp_path):
    tasks = {"rows": [("1001", "one", "c1")]}
    read_tasks = lambda: spark.createDataFrame(tasks["rows"], "task_id string, topic string, cluster_id string")
    read_clusters = lambda: spark.createDataFrame([("c1", "file"), ("c2", "file")], "cluster_id string, kind string")
    ledger, out = ConfigLedger(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    batch = spark.createDataFrame([(1001, 0, b"x"), (1002, 1, b"y")], FRAMES)
    fail = {"now": True}

    def deliver(rows, path, number):
        if fail["now"]:
            raise OSError("lost between routing and commit")
        fanout_deliver(rows, path, number)

    fanout_deliver, jobs.fanout.deliver = jobs.fanout.deliver, deliver
    try:
        job = jobs.route_batches(read_tasks, read_clusters, ledger=ledger, deliver_to=out)
        with pytest.raises(OSError):
            job(batch, 0)
        tasks["rows"] = [("1001", "moved", "c2"), ("1002", "two", "c1")]
        fail["now"] = False
        jobs.route_batches(read_tasks, read_clusters, ledger=ConfigLedger(spark, str(tmp_path / "ledger")), deliver_to=out)(batch, 0)
        job(batch, 1)
    finally:
        jobs.fanout.deliver = fanout_deliver
    assert [r[:4] for r in shown(spark, out)] == [("batch-0", "c1", "one", b"x"), ("batch-1", "c1", "two", b"y"), ("batch-1", "c2", "moved", b"x")]
    with pytest.raises(ValueError):
        jobs.route_batches(read_tasks, read_clusters)


# in time order: what is older than the watermark is late, and left out
BEATS = [("a", 100, "h1"), ("b", 105, None), ("a", 110, None), ("a", 110, "h1"), ("quiet", 112, "q"), ("a", 120, "h2"), ("b", 130, "x"), ("a", 300, None), ("a", 330, "h2"), ("clock", 4000, None)]


@pytest.mark.parametrize("step", [1, 4])
def test_agents_that_fall_silent_are_told_by_timers(spark, tmp_path, step):
    rows = [(a, i, t, v) for i, (a, t, v) in enumerate(BEATS)]
    schema = "agent string, seq bigint, t bigint, host string"
    stream = feed(spark, tmp_path / "in", rows, schema, step).withColumn("ts", F.timestamp_seconds("t"))
    out = run(jobs.agent_life(stream, "agent", "ts", "seq", "host", 60, "1 second"), tmp_path, "out")
    # batches until the clock has passed all others
    tick = spark.createDataFrame([("clock", 99, 4000, None)], schema)
    tick.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = run(jobs.agent_life(stream, "agent", "ts", "seq", "host", 60, "1 second"), tmp_path, "out")
    batch = metrics.life_events(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")), "agent", "ts", "seq", F.col("host"), F.timestamp_seconds(F.lit(4000)), 60, 30)
    plain = lambda df: sorted((r.agent, r.us // 1_000_000, r.event, r.info or "") for r in df.collect())
    assert plain(out) == plain(batch)
    assert ("quiet", 112, "down", "q") in plain(out) and ("a", 300, "up", "h2") in plain(out) and ("a", 120, "changed", "h2") in plain(out)
    assert [tuple(r)[:2] for r in metrics.registered(out, "agent").collect()] == [("clock", None)]


def test_exact_duplicates_whatever_the_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), i % 2, i, 1000 + i // 2, rng.choice(["a", "b", "c", "d", "", None, f"once {i}"])) for i in range(90)]
    schema = "topic string, partition int, offset bigint, t bigint, value string"
    dated = lambda df: df.withColumn("arrival", F.timestamp_seconds("t"))
    mixed = rows[:]
    rng.shuffle(mixed)
    stream = feed(spark, tmp_path / "in", mixed, schema, 2)
    for n, t in ((900, 10**6), (901, 2 * 10**6)):
        spark.createDataFrame([("clock", 0, n, t, "tick")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = run(jobs.duplicate_flags(dated(stream), "10 minutes", shards=2), tmp_path, "out").filter("topic <> 'clock'")
    got = sorted((r.topic, r.offset) for r in out.filter("duplicate").collect())
    want = sorted((r.topic, r.offset) for r in audit.duplicates(dated(spark.createDataFrame(rows, schema))).collect())
    assert got == want and len(want) > 20
    assert out.count() == sum(1 for r in rows if r[4])
    kept = run(jobs.duplicate_flags(dated(stream), "10 minutes", retention_seconds=5, shards=1), tmp_path, "kept").filter("topic <> 'clock'")
    first, flags = {}, set()
    for topic, partition, offset, t, value in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if value:
            if t - first.get((topic, value), -10**9) <= 5:
                flags.add((topic, offset))
            else:
                first[topic, value] = t
    assert {(r.topic, r.offset) for r in kept.filter("duplicate").collect()} == flags


def test_ordered_operators_read_their_input_once(spark, tmp_path):
    spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.col("id").alias("i"), (F.col("id") * 7 % 50).alias("v"), F.lit("unused").alias("w")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sums = ordered.running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "f": ("first", F.col("v"))}, block_of("i", 4), inclusive=True)
    for out in (sums, sums.select("i", "s"), ordered.neighbour(df, ["k"], ["i"], {"n": F.col("v")}, block_of("i", 4)).select("i", "n")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1
    first = {r.k: r.f for r in sums.select("k", "f").distinct().collect()}
    assert first == {"k0": 0, "k1": 7, "k2": 14}
