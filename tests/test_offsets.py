import pytest
from pyspark.sql import functions as F

from rillworks.operators import offsets


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_continuity(spark):
    rows = [("f", 1, 0, 10), ("f", 2, 10, 5), ("f", 3, 20, 5), ("f", 4, 22, 4), ("f", 5, 0, 3)]
    out = offsets.continuity(frame(spark, rows, "f string, s bigint, offset bigint, length bigint"), ["f"], "s")
    assert [r.state for r in out.sort("s").collect()] == ["ok", "gap", "overlap", "reset", "last"]


def test_resume_plan(spark):
    files = frame(spark, [("a", 100), ("b", 10), ("new", 7)], "path string, size bigint")
    saved = frame(spark, [("a", 60, 60), ("b", 40, 50)], "path string, offset bigint, file_size bigint")
    out = {r.path: (r.start_offset, r.rotated, r.pending_bytes) for r in offsets.resume_plan(files, saved).collect()}
    assert out == {"a": (60, False, 40), "b": (0, True, 10), "new": (0, False, 7)}


def test_offset_beyond_32_bits(spark):
    docs = frame(spark, [("a", '{"k": {"offset": 5000000000, "file_path": "p"}}'), ("b", "{broken"), ("c", "{}")], "agent string, d string")
    out = {r.agent: r for r in offsets.parse_checkpoint_documents(docs, "agent", "d").collect()}
    assert (out["a"].offset, out["a"].inode, out["a"].last_modified, out["a"].failed) == (5_000_000_000, 0, "", False)
    assert out["b"].failed and not out["c"].failed


def test_file_changes(spark):
    schema = "path string, size bigint, mtime bigint, content string"
    old = frame(spark, [("keep", 1, 1, "k"), ("grow", 1, 1, "g"), ("gone", 4, 1, "gone"), ("from", 4, 1, "move"),
                        ("twin1", 4, 1, "twin"), ("twin2", 4, 1, "twin")], schema)
    new = frame(spark, [("keep", 1, 1, "k"), ("grow", 2, 2, "gg"), ("new", 3, 1, "new"), ("to", 4, 9, "move"), ("twin3", 4, 1, "twin")], schema)
    out = {r.path: (r.event, r.from_path) for r in offsets.file_changes(old, new).collect()}
    assert out == {"grow": ("MODIFIED", None), "new": ("CREATED", None), "to": ("MOVED", "from"), "gone": ("DELETED", None),
                   "twin1": ("DELETED", None), "twin2": ("DELETED", None), "twin3": ("CREATED", None)}


@pytest.mark.parametrize("name", ["content", "digest"])
def test_a_moved_file_has_its_size_and_a_known_content(spark, name):
    schema = f"path string, size bigint, mtime bigint, {name} string"
    old = frame(spark, [("short", 3, 1, "grew"), ("unread", 4, 1, None), ("unsized", None, 1, "x"), ("from", 4, 1, "move")], schema)
    new = frame(spark, [("long", 4, 1, "grew"), ("unknown", 4, 1, None), ("sizeless", None, 1, "x"), ("to", 4, 1, "move")], schema)
    find = offsets.file_changes if name == "content" else offsets.listing_changes
    out = {r.path: (r.event, r.from_path) for r in find(old, new).collect()}
    assert out == {**{p: ("DELETED", None) for p in ("short", "unread", "unsized")}, **{p: ("CREATED", None) for p in ("long", "unknown", "sizeless")}, "to": ("MOVED", "from")}


def test_digests_of_wanted_files_only(spark):
    files = frame(spark, [(str(i), str(i)) for i in range(20)], "path string, content string")
    wanted = frame(spark, [(str(i), "CREATED" if i % 2 else "DELETED") for i in range(5)], "path string, event string")
    got = offsets._digests(files, files, wanted).sort("path").collect()
    assert [(r["path"], r["event"]) for r in got] == [(str(i), "CREATED" if i % 2 else "DELETED") for i in range(5)]


def test_globs(spark):
    paths = ["/a/x.log", "/a/b/x.log", "/a/b/c/x.log", "/a/xy.log", "/a/x.txt", "/b/x.log", "/a/[x].log", "/a/x+y.log"]
    files = frame(spark, [(p,) for p in paths], "path string")
    patterns = {"1": "/a/*.log", "2": "/a/**/x.log", "3": "/a/?.log", "4": "/?/x.log", "5": "/a/x.log", "6": "/a/[!x]*.log", "7": "/a/x+*"}
    out = offsets.match_files(files, frame(spark, list(patterns.items()), "task_id string, pattern string"))
    got = {}
    for r in out.collect():
        got.setdefault(r.task_id, set()).add(r.path)
    assert got == {"1": {"/a/x.log", "/a/xy.log", "/a/[x].log", "/a/x+y.log"}, "2": {"/a/b/x.log", "/a/b/c/x.log"}, "3": {"/a/x.log"},
                   "4": {"/a/x.log", "/b/x.log"}, "5": {"/a/x.log"}, "6": {"/a/[x].log"}, "7": {"/a/x+y.log"}}
    assert {r.path for r in offsets.match_files(files, frame(spark, [("1", "/a/*")], "task_id string, pattern string"), ["*.log"]).collect()} == {"/a/x.txt"}


def test_collect_totals_ignores_unterminated_tail(spark):
    df = frame(spark, [("t", "a\nb"), ("t", "c\n"), ("t", "é")], "task string, data string")
    r = offsets.collect_totals(df, ["task"], "data").first()
    assert (r.lines_collected, r.bytes_collected) == (2, 7)


def test_latest_checkpoint_drops_removed_keys(spark):
    log = frame(spark, [("a", 1, False, 5), ("a", 2, False, 9), ("b", 1, False, 1), ("b", 2, True, 1)], "k string, s bigint, gone boolean, offset bigint")
    assert offsets.latest_checkpoints(log, "k", "s", "gone", ["offset"]).collect() == [("a", 9)]


def test_last_rows_and_delta(spark):
    df = frame(spark, [("r", i, i * i) for i in range(2, 9)], "r string, s bigint, v bigint")
    assert sorted(x.s for x in offsets.last_rows(df, ["r"], ["s"], 3).collect()) == [6, 7, 8]
    assert [x.d for x in offsets.since_start(df, ["r"], "s", "v", "d").sort("s").collect()] == [i * i - 4 for i in range(2, 9)]


def test_last_rows_beyond_the_optimizers_limit(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'b', 'a') AS k", "id AS seq")
    got = offsets.last_rows(rows, ["k"], ["seq"], 5000)
    assert {r["k"]: (r["n"], r["low"]) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.min("seq").alias("low")).collect()} == {"a": (5000, 22501), "b": (5000, 15000)}


def test_repeated_checkpoint_keys_and_trailing_text(spark):
    rows = [("x", "k", 5, "/p", 1, 9, "2024"), ("x", "k", 7, "/p", 1, 9, "2025"), ("x", "k", 6, "/p", 1, 9, "2025")]
    df = spark.createDataFrame(rows, "agent string, key string, offset long, file_path string, inode long, file_size long, last_modified string")
    docs = offsets.checkpoint_documents(df, "agent", "key")
    assert [r["offset"] for r in offsets.parse_checkpoint_documents(docs, "agent", "document").collect()] == [7]
    junk = docs.withColumn("document", F.concat("document", F.lit(" junk")))
    assert [r["failed"] for r in offsets.parse_checkpoint_documents(junk, "agent", "document").collect()] == [True]


def test_checkpoint_documents_with_a_wrong_type_fail_whole(spark):
    texts = ['{"k": {"offset": 5}}', '{"k": {"offset": "5"}}', '{"k": {"offset": null}}', '{"k": {"file_path": 7}}', '{"k": 5}', '{"a": {"offset": 1}, "k": {"inode": []}}',
             '{"k": {"offset": 2.5, "inode": true, "last_modified": "x"}}', "{}", "[]", None, '{"k": {}}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, d string")
    rows = offsets.parse_checkpoint_documents(df, "n", "d").collect()
    assert {r.n for r in rows if r.failed} == {1, 2, 3, 4, 5, 8, 9} and all(r.key is None for r in rows if r.failed)
    got = {r.n: (r.key, r["offset"], r.inode, r.file_path, r.last_modified) for r in rows if not r.failed}
    assert got == {0: ("k", 5, 0, "", ""), 6: ("k", 2, 1, "", "x"), 7: (None, 0, 0, "", ""), 10: ("k", 0, 0, "", "")}
