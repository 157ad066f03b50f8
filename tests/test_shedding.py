import random

import pytest
from pyspark.sql import functions as F

from rillworks.operators import shedding
from rillworks.operators.ordered import block_of


def rows(seed, n=400):
    rng = random.Random(seed)
    us, out = 0, []
    for i in range(n):
        us += rng.randrange(3_000_000)
        out.append(("hot" if rng.random() < 0.5 else f"s{rng.randrange(4)}", i, us, rng.randrange(100)))
    return out


@pytest.mark.parametrize("seed, bits, delivered", [(1, 3, 0.6), (2, 5, 0.5), (3, 16, 0.5), (4, 2, 0)])
def test_hysteresis_equals_one_by_one(spark, seed, bits, delivered):
    rng, high, low, held = random.Random(seed + 10), 300, 120, {}
    data = []
    for session, seq, _, size in rows(seed):
        back = min(held.get(session, 0), 2 * size) if rng.random() < delivered else 0
        change = rng.choice([None, 0]) if rng.random() < 0.05 else -back if back else size
        held[session] = held.get(session, 0) + (change or 0)
        data.append((session, seq, change))
    df = spark.createDataFrame(data, "session string, seq bigint, change bigint")
    out = shedding.shed_hysteresis(df, "session", ["seq"], "change", high, low, block_of("seq", bits))
    state, want = {}, {}
    for session, seq, change in data:
        level, full = state.get(session, (0, False))
        full = level >= low if full else level > high
        want[seq] = (None if (change or 0) < 0 else not full, level)
        state[session] = (level + (change or 0), full)
    assert {r.seq: (r.accepted, r.level) for r in out.collect()} == want
    assert {True, False} <= {a for a, _ in want.values()}


def test_hysteresis_of_nothing(spark):
    df = spark.createDataFrame([], "session string, seq bigint, change bigint")
    assert shedding.shed_hysteresis(df, "session", ["seq"], "change").count() == 0


def test_cumulative_equals_one_by_one(spark):
    data = rows(5)
    df = spark.createDataFrame(data, "session string, seq bigint, us bigint, size bigint")
    out = shedding.shed_cumulative(df, "session", "seq", F.col("size"), block_of("seq", 3), high=900)
    held, want = {}, {}
    for session, seq, _, size in data:
        want[seq] = held.get(session, 0) <= 900
        held[session] = held.get(session, 0) + (size if want[seq] else 0)
    assert {r.seq: r.accepted for r in out.collect()} == want


def test_close_after_thirty_seconds(spark):
    data = [("s", t, t < 5) for t in (0, 1, 5, 20, 35, 36, 40)] + [("u", 1, False)]
    df = spark.createDataFrame(data, "s string, t bigint, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    out = shedding.session_close(df, "s", "t", "ts", ~F.col("ok"), block=block_of("t", 2))
    assert sorted((r.s, r.t) for r in out.filter("closed").collect()) == [("s", 40)]


def test_quota(spark):
    df = spark.createDataFrame([("a", 10, 60_000), ("a", 10, 50_000), ("a", 11, 102_400)], "k string, t bigint, n bigint")
    out = shedding.quota_breaches(df.withColumn("ts", F.timestamp_seconds("t")), "k", "ts", F.col("n")).collect()
    assert [(r.k, r.bytes) for r in out] == [("a", 110_000)]
