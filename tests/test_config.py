import json

import pytest
from pyspark.sql import functions as F

from rillworks.operators import settings, tasks
from rillworks.plans import config_queries


def docs(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n int, d string")


def task(**changes):
    base = {"task_id": "1001", "log_path_pattern": "/tmp/a.log", "kafka_topic": "t", "properties": {"kafka_cluster_id": "c", "x": "y"}}
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def ids(df, *columns):
    return sorted(tuple(r[c] for c in ("n", *columns)) for r in df.collect())


def test_agent_documents(spark):
    df = docs(spark, {"tasks": [task(), task(task_id=""), task(log_path_pattern=...), task(task_id="2", kafka_topic=..., properties=...)]},
              {"tasks": [task(), task(task_id=5)]}, {"tasks": [task(properties={"a": 1})]}, {"tasks": [task(properties="text")]},
              {"tasks": []}, {}, "broken", {"tasks": [task(), 7]}, {"tasks": {"a": task()}}, {"tasks": [task(task_id=None)]})
    out = tasks.agent_tasks(df, "n", "d")
    assert ids(out, "task_id") == [(0, "1001"), (0, "2"), (3, "1001")]
    assert {(r.n, r.task_id): r.properties for r in out.collect()}[(0, "1001")] == {"kafka_cluster_id": "c", "x": "y"}


def test_documents_with_required_members(spark):
    df = docs(spark, {"tasks": [task(task_id="1"), task(task_id="1", kafka_topic="last"), task(task_id="2", kafka_topic=...), task(task_id="3")]},
              {"tasks": [task(task_id=1)]}, {"tasks": [task(properties={})]}, "broken", {"tasks": []}, {"tasks": [task(), "x"]})
    assert ids(tasks.required_tasks(df, "n", "d"), "task_id", "topic") == [(0, "1", "last"), (5, "1001", "t")]


def test_control_documents(spark):
    good = {"task_id": 5, "task_name": "a", "version": 2, "message_queue": {"topic": "q"}, "properties": {"k": [1]}}
    df = docs(spark, {"cversion": 9, "tasks": [good, {}]}, {"tasks": [{"task_id": "5"}]}, {"cversion": "9", "tasks": [good]},
              {"tasks": [{**good, "message_queue": 5}]}, {"tasks": [{**good, "message_queue": {"type": 5}}]}, "broken", {"tasks": [good]})
    out = tasks.control_tasks(df, "n", "d")
    assert ids(out, "cversion", "task_id", "version", "mq_type", "mq_topic", "properties") == [
        (0, 9, 0, 0, "", "", "{}"), (0, 9, 5, 2, "kafka", "q", '{"k":[1]}'), (6, 0, 5, 2, "kafka", "q", '{"k":[1]}')]


def test_diff(spark):
    schema = "task_id string, log_path_pattern string, kafka_topic string, properties map<string,string>"
    old = spark.createDataFrame([("gone", "p", "t", {}), ("same", "p", "t", {"a": "1", "b": "2"}), ("path", "p", "t", {}),
                                 ("topic", "p", "t", {}), ("props", "p", "t", {"a": "1"})], schema)
    new = spark.createDataFrame([("new", "p", "t", {}), ("same", "p", "t", {"b": "2", "a": "1"}), ("path", "q", "t", {}),
                                 ("topic", "p", "u", {}), ("props", "p", "t", {"a": "2"})], schema)
    out = {r.task_id: r.action for r in tasks.diff(old, new, ["task_id"]).collect()}
    assert out == {"gone": "stop", "new": "start", "same": "keep", "path": "restart", "topic": "restart", "props": "restart"}


def test_properties(spark):
    text = "# c\n! c\n\n  a = 1 \r\nb=x=y\nnothing\na= 2\n = novalue\nlist = a:1, ,b:2,\n"
    df = spark.createDataFrame([("h", text)], "host string, content string")
    out = {r.key: r.value for r in settings.parse_properties(df, "host", "content").collect()}
    assert out == {"a": "2", "b": "x=y", "": "novalue", "list": "a:1, ,b:2,"}


@pytest.mark.parametrize("text, number, flag, parts", [
    ("12", 12, False, ["12"]), (" 7x", 7, False, ["7x"]), ("-3", -3, False, ["-3"]), ("abc", 8, False, ["abc"]), ("99999999999", 8, False, ["99999999999"]),
    ("YES", 8, True, ["YES"]), ("True", 8, True, ["True"]), ("1", 1, True, ["1"]), ("off", 8, False, ["off"]), (" a , b,,", 8, False, ["a", "b"]), (None, 8, True, [])])
def test_typed_values(spark, text, number, flag, parts):
    v = F.col("v")
    r = spark.createDataFrame([(text,)], "v string").select(
        settings.as_int(v, 8).alias("i"), settings.as_bool(v, True).alias("b"), settings.as_list(v).alias("l")).first()
    assert (r.i, r.b, r.l) == (number, flag, parts)


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("b", 2, "z")], "t string, v bigint, p string")
    assert tasks.changed_since(rows, "t", "v", 2, ["p"]).collect() == [("a", 4, "y")]


def test_valid_empty_documents_are_not_failed(spark):
    docs = [(1, '{"tasks": []}'), (2, '{"tasks": [{"log_path_pattern": "/a"}]}'), (3, "{}"), (4, "nope"), (5, '{"tasks": []} x'), (6, '{"tasks": 5}'), (7, '{"tasks": [{"task_id": 5}]}'), (8, "[]"), (9, None)]
    got = {r["n"]: r["status"] for r in tasks.document_status(spark.createDataFrame(docs, "n int, d string"), "n", "d").collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "not_json", 5: "not_json", 6: "wrong_type", 7: "wrong_type", 8: "wrong_type", 9: "not_json"}


def test_layers_reach_hosts_without_a_file(spark):
    env = spark.createDataFrame([("a", "N", "env"), ("a", "N", "env2"), ("b", "N", ""), ("envonly", "N", "e"), ("a", "OTHER", "x"), (None, "N", "x")], "host string, name string, value string")
    files = spark.createDataFrame([("a", "n", "file"), ("a", "own", "1"), ("b", "m", "2")], "host string, key string, value string")
    hosts = spark.createDataFrame([("bare",), ("a",), (None,)], "host string")
    out = settings.effective(env, files, "host", {"N": "n"}, {"n": "dn", "m": "dm"}, hosts)
    got = sorted((r.host, r.key, r.value, r.layer) for r in out.collect())
    assert got == [("a", "m", "dm", "default"), ("a", "n", "env", "env"), ("a", "own", "1", "file"), ("b", "m", "2", "file"), ("b", "n", "dn", "default"),
                   ("bare", "m", "dm", "default"), ("bare", "n", "dn", "default"), ("envonly", "m", "dm", "default"), ("envonly", "n", "e", "env")]
    plain = settings.effective(env, files, "host", {}, {})
    assert sorted((r.host, r.key, r.layer) for r in plain.collect()) == [("a", "n", "file"), ("a", "own", "file"), ("b", "m", "file")]


def test_typed_settings_of_absent_keys_and_hosts(spark):
    rows = spark.createDataFrame([("a", "n", "12"), ("a", "p.x", "1"), ("a", "p.y", "2"), ("b", "n", "no"), ("b", "f", "off")], "host string, key string, value string")
    out = {r.host: r for r in settings.typed(rows, "host", {"n": ("int", 8), "f": ("bool", True), "t": ("text", "d"), "l": ("list", None)}, ["p."], spark.createDataFrame([("bare",)], "host string")).collect()}
    assert (out["a"].n, out["a"].f, out["a"].t, out["a"].l, out["a"]["p."]) == (12, True, "d", [], {"x": "1", "y": "2"})
    assert (out["b"].n, out["b"].f, out["b"]["p."]) == (8, False, {})
    assert (out["bare"].n, out["bare"].f, out["bare"].t, out["bare"].l) == (8, True, "d", [])


def test_layers_of_all_files_and_variables(spark):
    rows = {(r.host, r.key): (r.value, r.layer) for r in config_queries.config_layers(spark, "/root/testdata/sf0.001").collect()}
    customers = [(r.c_custkey, r.c_name) for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", "c_name").collect()]
    assert {h for h, _ in rows} == {n for _, n in customers} | {f"{n}-new" for k, n in customers if k % 10 == 0}
    for k, host in customers:
        assert rows[host, "zookeeper.hosts"][1] == "file"
        assert rows[host, "relay.id"] == ((f"relay-{k}", "file") if k % 5 == 0 else ("r-env", "env"))
        if k % 10 == 0:
            assert rows[f"{host}-new", "relay.id"] == ("relay-001", "default")
            assert rows[f"{host}-new", "server.io_threads"] == (("16", "env") if k % 20 == 0 else ("8", "default"))
