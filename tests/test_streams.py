import json
import random
import time

import pytest
from pyspark.sql import functions as F
from test_frames import chop, streams, wire

from rillworks.operators import bytestreams, frames, offsets, routing, shedding
from rillworks.operators.ordered import block_of
from rillworks.sources import readers, sinks, tail
from rillworks.streaming import jobs


@pytest.fixture(autouse=True)
def registered(spark):
    tail.register(spark)


def run(df, folder, name):
    """Runs the stream over what is there now and returns all rows the sink holds."""
    df.writeStream.format("parquet").option("path", f"{folder}/{name}").option(
        "checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def tailing(spark, path, **options):
    return spark.readStream.format("tail").options(path=str(path), task_id="1001", **options).load()


def text_of(df):
    return b"".join(bytes(r.data) for r in df.sort("offset").collect())


def test_tail_appends_and_resumes(spark, tmp_path):
    log = tmp_path / "a.log"
    stream = tailing(spark, tmp_path / "*.log", split_bytes="10", row_bytes="4", exclude="x*.log")
    (tmp_path / "x1.log").write_bytes(b"not this")
    log.write_bytes(b"one\ntwo\nthr")
    assert text_of(run(stream, tmp_path, "out")) == b"one\ntwo\nthr"
    log.write_bytes(b"one\ntwo\nthree\nfour and more\n")
    out = run(stream, tmp_path, "out")
    assert text_of(out) == b"one\ntwo\nthree\nfour and more\n"
    assert out.agg(F.max(F.length("data"))).first()[0] <= 4 and out.count() == out.select("offset").distinct().count()
    assert run(stream, tmp_path, "out").count() == out.count()


def test_tail_starts_over_after_rotation(spark, tmp_path):
    log = tmp_path / "a.log"
    stream = tailing(spark, log)
    log.write_bytes(b"first file\n")
    run(stream, tmp_path, "out")
    log.write_bytes(b"new\n")
    rows = [(r.offset, bytes(r.data)) for r in run(stream, tmp_path, "out").collect()]
    assert sorted(rows) == [(0, b"first file\n"), (0, b"new\n")]


def test_tail_waits_for_missing_file_and_sees_new_ones(spark, tmp_path):
    stream = tailing(spark, tmp_path / "**.log")
    run(stream, tmp_path, "out")
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "b.log").write_bytes(b"deep")
    assert text_of(run(stream, tmp_path, "out")) == b"deep"


def test_backlog_is_read_in_bounded_batches(spark, tmp_path):
    rng = random.Random(8)
    want = {f"{i}.log": rng.randbytes(rng.choice([0, 1, 700, 5000])) for i in range(8)}
    for name, data in want.items():
        (tmp_path / name).write_bytes(data)
    total = sum(map(len, want.values()))
    stream = tailing(spark, tmp_path / "*.log", max_bytes="900", row_bytes="100")
    for taken in range(1, 60):  # each run starts anew from the checkpoint
        out = run(stream, tmp_path, "out")
        size = out.agg(F.sum(F.length("data"))).first()[0] or 0
        assert size == min(total, 900 * taken)
        if taken == 3:  # no file waits for a larger one
            assert out.select("file_path").distinct().count() == sum(bool(d) for d in want.values())
        if size == total:
            break
    assert {n: text_of(out.filter(F.col("file_path").endswith("/" + n))) for n in want} == want


def test_files_that_go_or_shrink_while_read(spark, tmp_path):
    reader = tail.TailStreamReader({"path": str(tmp_path / "*.log")})
    log = tmp_path / "a.log"
    log.write_bytes(b"0123456789")
    end = reader.latestOffset()
    assert end == {str(log): [10, 10]}
    log.write_bytes(b"new")
    data = lambda start, stop: b"".join(b.column("data")[0].as_py() for p in reader.partitions(start, stop) for b in reader.read(p))
    assert data({}, end) == b"new"
    later = reader.latestOffset()
    assert later == {str(log): [3, 3]} and data(end, later) == b"new"
    log.unlink()
    assert data({}, end) == b""


def test_batch_range_read(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"0123456789")
    read = lambda start: text_of(spark.read.format("tail").options(
        path=str(log), start_offsets=json.dumps({str(log): start})).load())
    assert (read(0), read(4), read(10), read(11)) == (b"0123456789", b"456789", b"", b"0123456789")


def test_tailed_lines_equal_batch_lines(spark, tmp_path):
    rng = random.Random(3)
    whole = "".join(f"{i} é{'€' * rng.randrange(4)}\n" for i in range(200)).encode() + b"tail"
    log, parts = tmp_path / "a.log", chop(rng, whole, 900)
    stream = jobs.lines(tailing(spark, log, row_bytes="7"))
    for i in range(len(parts)):
        log.write_bytes(b"".join(parts[:i + 1]))
        out = run(stream, tmp_path, "lines")
    chunks = spark.read.format("tail").options(path=str(log), row_bytes="7").load()
    batch = bytestreams.lines(chunks, ["file_path"], "offset", "data").filter("complete")
    assert sorted(r.line for r in out.collect()) == sorted(bytes(r.line).decode() for r in batch.collect())
    assert out.count() == 200


def feed(spark, folder, rows, schema, step):
    """Writes the rows as `step` files, one micro-batch each, and opens them as a stream."""
    for i in range(step):
        part = rows[len(rows) * i // step: len(rows) * (i + 1) // step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_frames_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    made = streams(rng, 3, 12)
    made["bad"] = [wire(1, 0, b"ok"), b"junk that is no header at all....", wire(1, 1, b"lost")]
    rows = [(c, i, part) for c, fs in made.items() for i, part in enumerate(chop(rng, b"".join(fs), 40))]
    rows.sort(key=lambda r: r[1])
    chunks = feed(spark, tmp_path / "in", rows, "c string, i bigint, data binary", 3)
    out = run(jobs.frames(chunks, "c", "i", "data"), tmp_path, "frames")
    got = sorted((r.stream, bytes(r.raw)) for r in out.collect())
    made["bad"] = made["bad"][:1]
    assert got == sorted((c, f) for c, fs in made.items() for f in fs)
    assert frames.decode(out).filter("reject IS NOT NULL").count() == 0


@pytest.mark.parametrize("held", [1, 3000, 1 << 25])
def test_backlog_of_one_connection_is_ordered_by_runs(spark, tmp_path, held):
    rng = random.Random(held)
    whole = [wire(1, i, rng.randbytes(rng.choice([0, 10, 4000]))) for i in range(60)] + [wire(1, 99, rng.randbytes(2_500_000))]
    rng.shuffle(whole)
    parts = chop(rng, b"".join(whole), 150)
    rows = [("c", i * 3, p) for i, p in enumerate(parts)]
    half = len(rows) // 2
    early, late = rows[:half], rows[half:]
    rng.shuffle(early)
    rng.shuffle(late)
    chunks = feed(spark, tmp_path / "in", early + late, "c string, i bigint, data binary", 1 if held == 3000 else 2)
    got = [bytes(r.raw) for r in run(jobs.frames(chunks, "c", "i", "data", held=held), tmp_path, "f").collect()]
    assert sorted(got) == sorted(whole)
    text = b"\n".join(rng.randbytes(rng.choice([0, 5, 900])).replace(b"\n", b"") for _ in range(200)) + b"\n" + b"y" * 2_300_000 + b"\nrest"
    rows = [("c", i, p) for i, p in enumerate(chop(rng, text, 90))]
    chunks = feed(spark, tmp_path / "in2", rows[:40][::-1] + rows[40:][::-1], "c string, i bigint, data binary", 1)
    out = jobs._keyed(chunks, "c", "i", "data").transformWithStateInPandas(
        jobs.LineAssembler(True, held), "stream string, line binary", "append", "none")
    assert sorted(bytes(r.line) for r in run(out, tmp_path, "l").collect()) == sorted(text.split(b"\n")[:-1])


def test_frames_too_long_for_a_row_end_their_stream(spark, tmp_path):
    huge = wire(1, 1, b"")[:8] + (1 << 30).to_bytes(4, "little") + wire(1, 1, b"")[12:]
    rows = [("c", 0, wire(1, 0, b"ok") + huge), ("c", 1, b"x" * 100 + wire(1, 2, b"lost"))]
    chunks = feed(spark, tmp_path / "in", rows, "c string, i bigint, data binary", 2)
    assert [bytes(r.raw) for r in run(jobs.frames(chunks, "c", "i", "data"), tmp_path, "f").collect()] == [wire(1, 0, b"ok")]
    batch = bytestreams.frames(spark.createDataFrame(rows, "c string, i bigint, data binary"), "c", "i", "data", size=64)
    assert [bytes(r.raw) for r in batch.collect()] == [wire(1, 0, b"ok")]


def test_stream_shedding_equals_batch(spark, tmp_path):
    rows = [("s", i, i * 1_000_000, 50 if i % 3 else -60 if i else 0) for i in range(120)]
    schema = "s string, i bigint, us bigint, n bigint"
    stream = feed(spark, tmp_path / "in", rows, schema, 3)
    out = run(jobs.shed(stream, "s", "i", "us", "n", 200, 100, full_seconds=30), tmp_path, "shed")
    told = shedding.shed_hysteresis(spark.createDataFrame(rows, schema), "s", ["i"], "n", 200, 100, block_of("i", 3))
    batch = shedding.session_close(told.withColumn("ts", F.timestamp_micros("us")), "s", "i", "ts", ~F.col("accepted"), 30, block_of("i", 3))
    want = sorted((r.i, r.accepted, r.level, r.closed) for r in batch.collect())
    assert sorted((r.seq, r.accepted, r.level, r.closed) for r in out.collect()) == want
    assert {True, False, None} == {w[1] for w in want} and {True, False} == {w[3] for w in want}


@pytest.mark.parametrize("keep_cut", [True, False])
def test_lines_are_not_glued_across_a_rotation(spark, tmp_path, keep_cut):
    log = tmp_path / "a.log"
    stream = jobs.lines(tailing(spark, log), keep_cut=keep_cut)
    log.write_bytes(b"old 1\nunfinished")
    run(stream, tmp_path, "lines")
    log.write_bytes(b"new 1\nnew")
    run(stream, tmp_path, "lines")
    log.write_bytes(b"new 1\nnew 2\n")
    out = run(stream, tmp_path, "lines")
    assert sorted(r.line for r in out.collect()) == ["new 1", "new 2", "old 1"] + ["unfinished"] * keep_cut


def test_batches_without_a_complete_frame_or_line(spark, tmp_path):
    whole = wire(1, 0, b"abc")
    rows = [("c", i, whole[i:i + 1]) for i in range(len(whole))]
    chunks = feed(spark, tmp_path / "in", rows, "c string, i bigint, data binary", 3)
    assert [bytes(r.raw) for r in run(jobs.frames(chunks, "c", "i", "data"), tmp_path, "f").collect()] == [whole]
    rows = [("c", i, b"%d" % i if i < 5 else b"\n") for i in range(6)]
    chunks = feed(spark, tmp_path / "in2", rows, "c string, i bigint, data binary", 3)
    assert [r.line for r in run(jobs.lines(chunks, "c", "i", "data"), tmp_path, "l").collect()] == ["01234"]


def test_idle_connections_expire(spark, tmp_path):
    whole = wire(1, 0, b"abc")
    chunks = feed(spark, tmp_path / "in", [("c", 0, whole[:9])], "c string, i bigint, data binary", 1)
    query = jobs.frames(chunks, "c", "i", "data", idle_ms=1).writeStream.format("memory").queryName("idle").option(
        "checkpointLocation", str(tmp_path / "checkpoint")).start()
    def wait(done):
        end = time.time() + 25
        while not done() and time.time() < end:
            time.sleep(0.3)

    try:
        wait(lambda: sum(p.numInputRows for p in query.recentProgress) == 1)
        spark.createDataFrame([("c", 1, whole)], "c string, i bigint, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        wait(lambda: spark.table("idle").count() == 1)
        assert [bytes(r.raw) for r in spark.table("idle").collect()] == [whole]
    finally:
        query.stop()


def test_stream_intervals_and_sessions(spark, tmp_path):
    rows = [("a", t, 1) for t in (0, 5, 12, 100, 101, 1000)]
    stream = feed(spark, tmp_path / "in", rows, "k string, t bigint, n bigint", 2).withColumn("ts", F.timestamp_seconds("t"))
    out = run(jobs.report_intervals(stream, ["k"], "ts", {"n_sum": "n"}, delay="1 second"), tmp_path, "w")
    assert {r.t: r.n_sum for r in out.select(F.unix_seconds("interval_start").alias("t"), "n_sum").collect()} == {0: 2, 10: 1, 100: 2}
    out = run(jobs.live_sessions(stream, "k", "ts", delay="1 second"), tmp_path, "s")
    assert sorted(r.beats for r in out.collect()) == [2, 3]


def test_stream_dedup(spark, tmp_path):
    rows = [("t", 0, i, i, v) for i, v in enumerate(["a", "b", "a", "", "a", "c"])]
    stream = feed(spark, tmp_path / "in", rows, "topic string, partition int, offset bigint, t bigint, value string", 2)
    out = run(jobs.first_contents(stream.withColumn("arrival", F.timestamp_seconds("t"))), tmp_path, "d")
    assert sorted(r.value for r in out.collect()) == ["a", "b", "c"]


def test_hot_configuration_and_repeated_batch(spark, tmp_path):
    tasks = {"rows": [("1001", "one", "c1")]}
    read_tasks = lambda: spark.createDataFrame(tasks["rows"], "task_id string, topic string, cluster_id string")
    read_clusters = lambda: spark.createDataFrame([("c1", "file"), ("c2", "file")], "cluster_id string, kind string")
    job = jobs.route_batches(read_tasks, read_clusters, lambda batch: {"file": sinks.file_writer(str(tmp_path / "out"), batch)})
    batch = spark.createDataFrame([(1001, 0, b"x"), (1002, 1, b"y")], "task_id bigint, offset bigint, payload binary")
    job(batch, 0)
    tasks["rows"] = [("1001", "moved", "c2"), ("1002", "two", "c1")]
    job(batch, 1)
    job(batch, 1)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.batch, r.cluster_id, r.topic, bytes(r.value)) for r in out.collect()) == [
        (0, "c1", "one", b"x"), (1, "c1", "two", b"y"), (1, "c2", "moved", b"x")]


def test_readers_and_rolled_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "h1.properties").write_text("a = 1\n\nb = 2\n")
    r = readers.whole_files(spark, str(tmp_path / "c"), "*.properties").first()
    assert r.content == "a = 1\n\nb = 2\n" and r.path.endswith("h1.properties")
    listed = readers.file_listing(spark, str(tmp_path / "c")).first()
    assert listed.size == 13 and bytes(listed.content).startswith(b"a = 1")
    (tmp_path / "low_system_metrics.csv").write_text(
        "timestamp,cpu_percent,memory_used_mb,disk_io_read_mb,disk_io_write_mb,network_rx_mb,network_tx_mb,kafka_messages\n"
        "2024-01-01 00:00:00,12.5,100.00,0,0,1.5,2.5,7\n")
    s = readers.system_samples(spark, str(tmp_path / "low_system_metrics.csv")).first()
    assert (s.run, s.cpu_percent, s.kafka_messages) == ("low", 12.5, 7)
    (tmp_path / "r.csv").write_text("timestamp,test_name,result,message\n2024-01-01 00:00:00,t1,PASS,a, b, c\n")
    t = readers.test_results(spark, str(tmp_path / "r.csv")).first()
    assert (t.test_name, t.result, t.message) == ("t1", "PASS", "a, b, c")
    lines = spark.range(10).select(F.timestamp_seconds(F.col("id") * 1200).alias("ts"), F.col("id").cast("string").alias("line"))
    sinks.rolled_files(lines.coalesce(1), str(tmp_path / "rolled"), "ts", 2)
    files = spark.read.parquet(str(tmp_path / "rolled")).groupBy("hour", F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] == 2 and files.count() == 7


def test_files_rolled_by_hour_and_size(spark, tmp_path):
    rows = spark.range(40).select(F.lit("a").alias("k"), "id", F.lit("x" * 9).alias("line"))
    indexed = offsets.roll_index(rows, ["k"], ["id"], F.col("id") * 200, (F.length("line") + 1).cast("bigint"), block_of("id", 3), 100)
    sinks.rolled_by_size(indexed, str(tmp_path / "out"), ["k"])
    out = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.col("_metadata.file_path"))
    files = out.groupBy("hour_index", "size_index").agg(F.countDistinct("file").alias("files"), F.count("id").alias("n"))
    assert files.agg(F.max("files"), F.max("n"), F.sum("n")).first() == (1, 10, 40)
    assert out.filter("id = 25").select("hour_index", "size_index").first() == (1, 2)


@pytest.mark.parametrize("text, number", [
    ("1001", 1001), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), ("task-001", None), ("", None),
    ("12x", None), ("-1", None), (None, None)])
def test_task_ids_on_the_wire(spark, text, number):
    good, bad = routing.wire_tasks(spark.createDataFrame([(text,)], "task_id string"))
    assert [int(r.wire_task) for r in good.collect()] == ([] if number is None else [number])
    assert bad.count() == (number is None)


def test_acknowledgement_frames(spark):
    acked = spark.createDataFrame([(999, 50)], "task_id bigint, offset bigint")
    assert bytes(routing.ack_frames(acked).first().raw) == wire(999, 50, b"", kind=2)
