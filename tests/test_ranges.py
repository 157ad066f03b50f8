import random

import pytest
from pyspark.sql import functions as F

from rillworks.operators import ranges, routing


def frame(spark, rows):
    return spark.createDataFrame(rows, "task string, file string, start bigint, stop bigint")


def runs(points):
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(r) for r in out]


def got(df, *columns):
    return sorted(tuple(r[c] for c in ("task", "file", *columns)) for r in df.collect())


@pytest.mark.parametrize("bits, seed", [(2, 1), (4, 2), (24, 3)])
def test_ranges_equal_sets_of_positions(spark, bits, seed):
    rng = random.Random(seed)
    def some(n):
        rows = []
        for _ in range(n):
            a = rng.randrange(120)
            rows.append((rng.choice("tu"), rng.choice("fff" "g"), a, a + rng.choice([0, 1, 5, 30, -2])))
        return rows
    sent, came = some(25), some(40)
    came += [came[0]] * 3 + [("t", "f", 10, 40), ("t", "f", 15, 20), ("t", "f", None, 4), ("t", "f", 3, None)]
    def points(rows):
        out = {}
        for t, f, a, b in rows:
            for p in range(a, b) if a is not None and b is not None else ():
                out.setdefault((t, f), []).append(p)
        return out
    s, a = points(sent), points(came)
    keys = ["task", "file"]
    S, A = frame(spark, sent), frame(spark, came)
    assert got(ranges.union(A, keys, block_bits=bits), "start", "stop") == sorted((*k, *r) for k, ps in a.items() for r in runs(set(ps)))
    assert got(ranges.missing(S, A, keys, bits), "start", "stop") == sorted((*k, *r) for k, ps in s.items() for r in runs(set(ps) - set(a.get(k, ()))))
    again = {}
    for t, f, x, y, n in got(ranges.repeated(A, keys, bits), "start", "stop", "deliveries"):
        for p in range(x, y):
            assert again.setdefault((t, f, p), n) == n
    assert again == {(*k, p): ps.count(p) for k, ps in a.items() for p in set(ps) if ps.count(p) > 1}
    want = sorted((*k, len(set(s.get(k, ()))), len(set(s.get(k, ())) & set(a.get(k, ()))), len(set(s.get(k, ())) - set(a.get(k, ()))),
                   len(a.get(k, ())) - len(set(a.get(k, ()))), len(set(a.get(k, ())) - set(s.get(k, ())))) for k in s.keys() | a.keys())
    assert got(ranges.accounts(S, A, keys, bits), "sent", "delivered", "missing", "repeated", "unexpected") == want


def test_nothing_sent_or_delivered(spark):
    none = frame(spark, [])
    some = frame(spark, [("t", "f", 0, 10)])
    assert got(ranges.missing(some, none, ["task", "file"]), "start", "stop") == [("t", "f", 0, 10)]
    assert ranges.missing(none, some, ["task", "file"]).count() == ranges.union(none, ["task", "file"]).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 7, 256])
def test_versions_as_of_a_burst(spark, blocks):
    rng = random.Random(blocks)
    burst = [1000 + i for i in range(300)]
    starts = burst + [rng.randrange(10, 10**6) for _ in range(30)] + [1000, 1000]
    versions = list(enumerate(starts))
    armed = [0, 10, *[rng.randrange(900, 1400) for _ in range(200)], *[10**7] * 150, *[rng.randrange(10**6) for _ in range(50)], None]
    v = spark.createDataFrame(versions, "version bigint, s bigint").select("version", F.timestamp_seconds("s").alias("valid_from"))
    s = spark.createDataFrame([(i, a, "x") for i, a in enumerate(armed)], "id bigint, s bigint, _last string").select("id", F.timestamp_seconds("s").alias("armed_at"), "_last")
    out = routing.session_versions(s, v, blocks)
    assert out.columns == ["id", "armed_at", "_last", "version"]
    def at(t):
        return max(((f, n) for n, f in versions if f <= t), default=(None, None))[1] if t is not None else None
    assert {r.id: r.version for r in out.collect()} == {i: at(a) for i, a in enumerate(armed)}
    spans = {r.version: r.valid_to for r in routing.version_spans(v, blocks).collect()}
    assert len(spans) == len(versions) and sum(t is None for t in spans.values()) == 1


def test_versions_of_no_history(spark):
    s = spark.createDataFrame([(1,)], "id bigint").withColumn("armed_at", F.current_timestamp())
    v = spark.createDataFrame([], "version bigint, valid_from timestamp")
    assert [r.version for r in routing.session_versions(s, v).collect()] == [None]
    assert routing.version_spans(v).count() == 0
