import random

import pytest
from pyspark.sql import functions as F

from rillworks.operators.ordered import block_of, neighbour, running, running_sums


def rows_with_hot_key(n=600):
    rng = random.Random(1)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", i, rng.randrange(50)) for i in range(n)]


@pytest.mark.parametrize("bits", [0, 3, 16])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sums(spark, bits, inclusive):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = running_sums(df, ["k"], ["i"], {"s": F.col("v")}, block_of("i", bits), inclusive)
    total, want = {}, {}
    for k, i, v in rows:
        before = total.get(k, 0)
        total[k] = before + v
        want[i] = total[k] if inclusive else before
    assert {r.i: r.s for r in out.collect()} == want


@pytest.mark.parametrize("bits", [0, 3, 16])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(spark, bits, ahead):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = neighbour(df, ["k"], ["i"], {"n": F.col("v")}, block_of("i", bits), ahead)
    last, want = {}, {}
    for k, i, v in (reversed(rows) if ahead else rows):
        want[i] = last.get(k)
        last[k] = v
    assert {r.i: r.n for r in out.collect()} == want


@pytest.mark.parametrize("bits", [0, 4])
def test_running_extremes(spark, bits):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    out = running(df, ["k"], ["i"], {"lo": ("min", odd), "hi": ("max", odd)}, block_of("i", bits))
    seen, want = {}, {}
    for k, i, v in rows:
        before = seen.setdefault(k, [])
        want[i] = (min(before, default=None), max(before, default=None))
        if v % 2:
            before.append(v)
    assert {r.i: (r.lo, r.hi) for r in out.collect()} == want


def test_blocks_are_not_broadcast(spark):
    df = spark.createDataFrame(rows_with_hot_key(), "k string, i bigint, v bigint")
    for out in (running_sums(df, ["k"], ["i"], {"s": F.col("v")}, block_of("i", 3)), neighbour(df, ["k"], ["i"], {"n": F.col("v")}, block_of("i", 3))):
        out.collect()
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
