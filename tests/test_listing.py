import os

import pytest
from pyspark.sql import functions as F
from test_streams import run

from rillworks.operators import offsets
from rillworks.sources import readers
from rillworks.sources.listing import Listings, listed, new_chunks
from rillworks.sources.tail import admitted


def put(root, **files):
    for name, data in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def told(df):
    return sorted(((r.path.split("/logs/")[1], r.event, r.from_path and r.from_path.split("/logs/")[1], r.start, r.stop) for r in df.collect()), key=str)


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_trees_of_any_shape_are_listed_whole(spark, tmp_path, at_once):
    root = tmp_path / "logs"
    deep = "/".join("d" * (1 + i % 3) for i in range(12))
    want = {f"{deep}/x.log", "top.log", *(f"wide/{i}/{j}.log" for i in range(40) for j in range(3)), "space here/é.log"}
    for name in want:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "empty").mkdir()
    rows = listed(spark, [str(root), str(root), str(tmp_path / "none")], str(tmp_path / "work"), at_once).collect()
    assert sorted(r.path.split("/logs/")[1] for r in rows) == sorted(want)
    assert all(r.size == os.path.getsize(r.path) and abs(r.mtime - os.path.getmtime(r.path) * 1e6) < 2 for r in rows)


def test_versions_changes_and_moves(spark, tmp_path):
    root, lists = tmp_path / "logs", Listings(spark, str(tmp_path / "lists"))
    assert lists.current() == 0 and lists.events().count() == 0
    put(root, a=b"aaa", b=b"bb", sub__c=b"cccc", twin1=b"same", twin2=b"same", skip__tmp=b"")
    assert lists.take([str(root)]) == 1
    before = spark.createDataFrame(readers.file_listing(spark, str(root)).collect())
    (root / "a").write_bytes(b"aaaXYZ")
    (root / "b").write_bytes(b"b")
    (root / "sub" / "c").rename(root / "moved")
    (root / "twin1").unlink()
    (root / "twin2").unlink()
    put(root, new=b"nnnnn", copy1=b"same")
    assert lists.take([str(root)]) == lists.current() == 2
    assert told(lists.events(1)) == sorted([
        ("a", "MODIFIED", None, 3, 6), ("b", "MODIFIED", None, 0, 1), ("copy1", "CREATED", None, 0, 4), ("moved", "MOVED", "sub/c", 4, 4),
        ("new", "CREATED", None, 0, 5), ("twin1", "DELETED", None, None, None), ("twin2", "DELETED", None, None, None)], key=str)
    plain = lambda p: p.removeprefix("file:")
    content = offsets.file_changes(before, readers.file_listing(spark, str(root))).collect()
    assert sorted((plain(r.path), r.event, r.from_path and plain(r.from_path)) for r in content) == sorted((r.path, r.event, r.from_path) for r in lists.events(1).collect())
    assert lists.take([str(root)]) == 3 and lists.events(2).count() == 0
    assert {r.path.split("/")[-1] for r in lists.files(1).collect()} >= {"c", "twin1"}


def test_digests_are_kept_for_files_that_stay(spark, tmp_path):
    root, lists = tmp_path / "logs", Listings(spark, str(tmp_path / "lists"))
    put(root, a=b"one", b=b"two")
    lists.take([str(root)])
    stat = os.stat(root / "a")
    (root / "a").write_bytes(b"ONE")
    os.utime(root / "a", ns=(stat.st_atime_ns, stat.st_mtime_ns))  # nothing tells that it changed: it is not read again
    lists.take([str(root)])
    digest = lambda v: lists.files(v).filter("path LIKE '%/a'").first().digest
    assert digest(1) == digest(2)
    lists.take([str(root)], digests=False)
    assert digest(3) == digest(1)


def test_patterns_and_a_listing_that_broke_off(spark, tmp_path):
    root, lists = tmp_path / "logs", Listings(spark, str(tmp_path / "lists"))
    put(root, app__a_log=b"1", app__b_tmp=b"2", other__c_log=b"3")
    patterns = spark.createDataFrame([("1", f"{root}/app/*"), ("2", f"{root}/app/a*")], "task_id string, pattern string")
    spark.createDataFrame([("/nowhere", 1, 1, None)], "path string, size bigint, mtime bigint, digest string").write.parquet(str(tmp_path / "lists" / "files" / "1"))
    assert lists.current() == 0
    assert lists.take([str(root)], patterns, ["*_tmp"]) == 1
    assert told(lists.events()) == [("app/a_log", "CREATED", None, 0, 1)]


def test_stream_of_changes_reads_what_is_new(spark, tmp_path):
    root, lists = tmp_path / "logs", Listings(spark, str(tmp_path / "lists"))
    put(root, a=b"0123456789", sub__b=b"bytes")
    lists.take([str(root)])
    stream = new_chunks(lists.stream(), "1001", split_bytes=4, row_bytes=3)
    out = run(stream, tmp_path, "out")
    put(root, a=b"0123456789more", sub__b=b"cut", c=b"see")
    lists.take([str(root)])
    (root / "c").unlink()  # gone before it is read
    out = run(stream, tmp_path, "out")
    text = lambda name, lo=0: b"".join(bytes(r.data) for r in out.filter(F.col("file_path").endswith(name)).sort("offset").collect())
    assert text("/a") == b"0123456789more" and text("/c") == b""
    assert sorted((r.offset, bytes(r.data)) for r in out.filter("file_path LIKE '%/b'").collect()) == [(0, b"byt"), (0, b"cut"), (3, b"e"), (4, b"s")]
    assert {r.task_id for r in out.collect()} == {"1001"} and run(stream, tmp_path, "out").count() == out.count()


def test_admission_deals_bytes_evenly_and_loses_none():
    sizes = {"big": 1000, "small": 3, "mid": 40}
    assert admitted({}, sizes, None) == {p: [n, n] for p, n in sizes.items()}
    first = admitted({}, sizes, 60)
    assert first == {"small": [3, 3], "mid": [28, 40], "big": [29, 1000]}
    position, batches = {}, 0
    while any(position.get(p, (0, 0))[0] < n for p, n in sizes.items()):
        last, position, batches = position, admitted(position, sizes, 60), batches + 1
        assert 0 < sum(v[0] - last.get(p, (0, 0))[0] for p, v in position.items()) <= 60
    assert batches == 18 and admitted(position, sizes, 60) == position
    assert admitted({"a": [5, 9]}, {"a": 7}, 3) == {"a": [3, 7]}  # rotated though it is larger than what was read
    assert admitted({}, {str(i): 9 for i in range(10)}, 4) == {str(i): [1, 9] for i in range(10)}
