import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillworks.operators import bytestreams, codecs, frames


def wire(task, offset, payload, kind=1, magic=0xCAFEBABE, version=0x0100):
    return (magic.to_bytes(4, "little") + version.to_bytes(2, "little") + kind.to_bytes(2, "little")
            + len(payload).to_bytes(4, "little") + task.to_bytes(8, "little") + offset.to_bytes(8, "little") + payload)


def raws(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "n int, raw binary")


def decoded(spark, value):
    return frames.decode(raws(spark, [value])).first()


def test_build_and_decode(spark):
    one = spark.range(1).select(frames.message("DATA", F.lit(12345), F.lit(100), F.lit("Test payload")).alias("m"))
    r = frames.decode(one.select(frames.encode(F.col("m")).alias("raw"))).first()
    assert bytes(r.raw) == wire(12345, 100, b"Test payload")
    assert (r.magic, r.version, r.type, r.length, int(r.task_id), int(r.offset), bytes(r.payload)) == (
        0xCAFEBABE, 0x0100, 1, 12, 12345, 100, b"Test payload")


@pytest.mark.parametrize("kind, code, task, offset, size", [
    ("ACK", 2, 999, 50, 0), ("HEARTBEAT", 3, 0, 0, 0), ("METRICS", 4, 0, 0, 5)])
def test_other_kinds(spark, kind, code, task, offset, size):
    m = spark.range(1).select(frames.message(kind, F.lit(999), F.lit(50), F.lit("hello")).alias("m")).first().m
    assert (m.type, int(m.task_id), int(m.offset), m.length) == (code, task, offset, size)


def test_largest_numbers_and_empty_payload(spark):
    top = 2**64 - 1
    r = decoded(spark, wire(top, top - 1, b""))
    assert (int(r.task_id), int(r.offset), bytes(r.payload), r.reject) == (top, top - 1, b"", None)
    built = spark.range(1).select(frames.encode(frames.message(
        "DATA", F.lit(str(top)).cast("decimal(20,0)"), F.lit(str(top - 1)).cast("decimal(20,0)"), F.lit(b""))).alias("raw"))
    assert bytes(built.first().raw) == wire(top, top - 1, b"")


def test_payload_over_64_kib(spark):
    body = bytes(range(256)) * 300
    assert bytes(decoded(spark, wire(1, 2, body)).payload) == body


@pytest.mark.parametrize("raw, reason", [
    (b"", "data too small"), (wire(1, 1, b"abc")[:27], "data too small"),
    (wire(1, 1, b"abc", magic=1, version=2), "wrong magic number"), (wire(1, 1, b"abc", version=2), "unsupported version"),
    (wire(1, 1, b"abc")[:-1], "incomplete payload"), (wire(1, 1, b"abc") + b"zz", None)])
def test_rejects(spark, raw, reason):
    r = decoded(spark, raw)
    assert r.reject == reason
    assert (r.payload is None) == (reason is not None)


def test_layout_with_codec(spark):
    one = spark.range(1).select(frames.message("DATA", F.lit(7), F.lit(8), F.lit("xy")).alias("m"))
    raw = one.select(frames.encode(F.col("m"), "v1_compress", F.lit(2)).alias("raw"))
    r = frames.decode(raw, layout="v1_compress").first()
    assert len(r.raw) == 34 and (r.codec, r.length, int(r.task_id), bytes(r.payload)) == (2, 2, 7, b"xy")


def chop(rng, data, most):
    out, at = [], 0
    while at < len(data):
        n = rng.randint(1, most)
        out.append(data[at:at + n])
        at += n
    return out


def streams(rng, count=5, per=40):
    made = {}
    for s in range(count):
        frames_of = []
        for i in range(per if s else per * 4):
            body = rng.randbytes(rng.choice([0, 3, 50, 400]))
            if rng.random() < 0.2:
                body += wire(1, 1, b"inner")[: rng.randint(6, 33)]
            frames_of.append(wire(s, i, body))
        made[f"c{s}"] = frames_of
    return made


@pytest.mark.parametrize("seed, segment, most", [(1, 64, 30), (2, 256, 7), (3, 1 << 20, 90), (4, 37, 200)])
def test_reassembly_of_any_cut(spark, seed, segment, most):
    rng = random.Random(seed)
    made = streams(rng)
    rows = [(c, i, part) for c, fs in made.items() for i, part in enumerate(chop(rng, b"".join(fs), most))]
    rng.shuffle(rows)
    out = bytestreams.frames(spark.createDataFrame(rows, "c string, i bigint, data binary"), "c", "i", "data", segment, 3)
    got = {}
    for r in out.orderBy("c", "position").collect():
        got.setdefault(r.c, []).append(bytes(r.raw))
    assert got == made


def test_reassembly_ends(spark):
    good = [wire(1, i, b"x" * 50) for i in range(6)]
    bad_header = b"".join(good[:3]) + b"junk" * 20 + b"".join(good[3:])
    cut = b"".join(good)[:-1]
    rows = [(name, i, part) for name, data in (("bad", bad_header), ("cut", cut), ("junk", b"no frames here" * 9))
            for i, part in enumerate(chop(random.Random(5), data, 11))]
    df = spark.createDataFrame(rows, "c string, i bigint, data binary")
    out = bytestreams.frames(df, "c", "i", "data", 64, 2).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in out} == {"bad": 3, "cut": 5}


@pytest.mark.parametrize("seed, most", [(1, 1), (2, 5), (3, 60)])
def test_lines_of_any_cut(spark, seed, most):
    rng = random.Random(seed)
    texts = {f"f{i}": "\n".join("é€😀 line" * rng.randint(0, 3) for _ in range(30)) for i in range(4)}
    texts["f0"] += "\n"
    rows = [(f, i, part) for f, t in texts.items() for i, part in enumerate(chop(rng, t.encode(), most))]
    out = bytestreams.lines(spark.createDataFrame(rows, "f string, i bigint, data binary"), ["f"], "i", "data", 2)
    got = {}
    for r in out.orderBy("f", "line_no").collect():
        got.setdefault(r.f, []).append((bytes(r.line).decode(), r.complete))
    for f, t in texts.items():
        *whole, rest = t.split("\n")
        assert got[f] == [(w, True) for w in whole] + ([(rest, False)] if rest else [])


@pytest.mark.parametrize("codec", ["zlib", "SNAPPY", "none", "off", "lz4"])
def test_codec_roundtrip(spark, codec):
    values = [b"Hello, World!", b"", b"This is test data for compression. " * 100, b"This is test data for snappy compression. " * 100]
    df = raws(spark, values).withColumn("codec", F.lit(codec))
    packed = codecs.compress(df, "codec", "raw", 99).withColumnsRenamed({"output": "packed", "codec_used": "sent"})
    out = codecs.decompress(packed, "codec", "packed").orderBy("n").collect()
    assert [bytes(r.output) for r in out] == values
    if codec in ("zlib", "SNAPPY"):
        assert len(out[2].packed) < len(values[2]) and len(out[3].packed) < len(values[3])
    assert out[0].packed is not None and (len(out[1].packed) == 0)
    assert df.select(codecs.codec_warned(F.col("codec"))).first()[0] == (codec == "lz4")


def test_zlib_damage_and_no_output_limit(spark):
    import zlib
    limit = 1024 * 1024
    values = [zlib.compress(b"a" * limit), zlib.compress(b"a" * (limit + 1)), b"damaged"]
    df = raws(spark, values).withColumn("codec", F.lit("zlib"))
    sizes = [r.output and len(r.output) for r in codecs.decompress(df, "codec", "raw").orderBy("n").collect()]
    assert sizes == [limit, limit + 1, None]


def test_decompress_has_no_cap_unless_asked_and_says_why(spark):
    from rillworks.operators import codecs

    big = b"five megabytes " * 350_000
    rows = [(1, "zlib", big), (2, "snappy", big), (3, "none", big), (4, "zlib", None)]
    packed = codecs.compress(spark.createDataFrame(rows, "n int, codec string, data binary"), "codec", "data").drop("codec_used").withColumnRenamed("output", "packed")
    broken = packed.union(spark.createDataFrame([(5, "zlib", b"", b"\x78\x9cxx")], packed.schema))
    opened = {r["n"]: r for r in codecs.decompress(broken, "codec", "packed").collect()}
    assert all(bytes(opened[n]["output"]) == big and opened[n]["output_reason"] is None for n in (1, 2, 3))
    assert (opened[4]["output"], opened[4]["output_reason"]) == (None, None) and opened[5]["output_reason"] == "damaged"
    capped = {r["n"]: r["output_reason"] for r in codecs.decompress(packed, "codec", "packed", max_bytes=1000).collect()}
    assert capped[1] == capped[2] == "too_large"


def test_payloads_opened_in_parts(spark):
    whole = {"zlib": bytes(range(256)) * 40, "snappy": b"ab" * 3000, "none": b"x" * 2500}
    rows = [(c, c, v) for c, v in whole.items()] + [("empty", "zlib", b""), ("null", "zlib", None)]
    packed = codecs.compress(spark.createDataFrame(rows, "n string, codec string, data binary"), "codec", "data").select("n", "codec", F.col("output").alias("packed"))
    cut = packed.filter("n = 'zlib'").select(F.lit("cut").alias("n"), "codec", F.expr("substring(packed, 1, octet_length(packed) - 5)"))
    junk = spark.createDataFrame([("junk", "zlib", b"junk"), ("lie", "snappy", b"\xff\xff\xff\x7f\x00")], "n string, codec string, packed binary")
    out = codecs.decompress_parts(packed.unionByName(cut.toDF(*packed.columns)).unionByName(junk), ["n"], "codec", "packed", 1000).collect()
    parts, status = {}, {}
    for r in sorted(out, key=lambda r: r.part):
        if r.bytes is None:
            assert r.part == len(parts.get(r.n, []))
            status[r.n] = r.status
        else:
            assert r.status is None and 0 < len(r.bytes) <= 1000
            parts.setdefault(r.n, []).append(bytes(r.bytes))
    assert status == {**dict.fromkeys([*whole, "empty", "null"], "ok"), "cut": "damaged", "junk": "damaged", "lie": "damaged"}
    assert {n: b"".join(p) for n, p in parts.items() if n in whole} == whole and set(parts) == {*whole, "cut"}


def test_zeros_take_no_memory_of_their_size():
    import tracemalloc
    import zlib
    packed = zlib.compress(bytes(64 << 20), 9)
    tracemalloc.start()
    assert sum(len(p) for p in codecs._parts("ZLIB", packed, 1 << 20, None)) == 64 << 20
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_codecs_give_out_rows_in_batches_of_bounded_size():
    data = [b"a" * (3 << 20), None, b""] * 5
    whole = pa.RecordBatch.from_pydict({"id": list(range(15)), "codec": ["NONE"] * 15, "p": data})
    parts = list(codecs._apply(codecs._deflate, "codec", "p", 6)(iter([whole, whole.slice(0, 0)])))
    assert len(parts) > 2 and max(p.nbytes for p in parts) < 32 << 20
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(15))
    assert [x for p in parts for x in p.column("output").to_pylist()] == data
