"""Task configuration documents: the three accepted shapes, differences and versions.

The documents are parsed row by row with built-in functions; a document is one value, so its tasks
are checked as an array and need no shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions import jsontext
from rillworks.functions.once import once

TASK_FIELDS = ["log_path_pattern", "kafka_topic", "properties"]


def _shape(element: Column, path: str) -> Column:
    """Type of a member, 'ABSENT' when it is not there."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(element, f"$.{path}", "variant")), F.lit("ABSENT"))


def _is(element: Column, path: str, *kinds: str) -> Column:
    shape = _shape(element, path)
    found = shape.isin(*kinds)
    return found | shape.startswith("OBJECT") if "OBJECT" in kinds else found


def _is_number(element: Column, path: str) -> Column:
    shape = _shape(element, path)
    return shape.isin("ABSENT", "BIGINT", "DOUBLE") | shape.startswith("DECIMAL")


def _text(element: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(element, f"$.{path}", "string"), F.lit(default))


def _number(element: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(element, f"$.{path}", "bigint"), F.lit(0))


def _is_object(element: Column) -> Column:
    return F.schema_of_variant(element).startswith("OBJECT")


def _with_tasks(documents: DataFrame, document: str) -> DataFrame:
    """Adds `_doc` (NULL when not JSON) and `_tasks` (NULL when not an array)."""
    parsed = jsontext.with_document(documents, F.col(document))
    return once(parsed, _tasks=F.try_variant_get("_doc", "$.tasks", "array<variant>"))


def agent_tasks(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, task_id, log_path_pattern, kafka_topic, properties). Missing members default to "", tasks
    without id or pattern are left out, and any member of a wrong type fails the whole document."""
    opened = _with_tasks(documents, document)
    sound = opened.filter(F.forall("_tasks", _valid))
    rows = sound.select(key, F.explode("_tasks").alias("_t"))
    t = F.col("_t")
    return rows.select(
        key, *[_text(t, f).alias(f) for f in ("task_id", "log_path_pattern", "kafka_topic")],
        F.coalesce(F.try_variant_get(t, "$.properties", "map<string, string>"),
                   F.create_map().cast("map<string, string>")).alias("properties"),
    ).filter("task_id <> '' AND log_path_pattern <> ''")


def _valid(e: Column) -> Column:
    """An object whose texts are strings or absent, and whose properties are strings."""
    values = F.map_values(F.try_variant_get(e, "$.properties", "map<string, variant>"))
    strings = F.forall(values, lambda v: F.coalesce(jsontext.is_string(v), F.lit(False)))
    texts = [_is(e, f, "STRING", "ABSENT") for f in ("task_id", "log_path_pattern", "kafka_topic")]
    return _is_object(e) & texts[0] & texts[1] & texts[2] & F.coalesce(strings, F.lit(True))


def document_status(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, status) of task documents: `ok`, `not_json`, or `wrong_type`. A document without tasks, or with none to collect, is ok."""
    opened = _with_tasks(documents, document)
    sound = F.when(F.col("_tasks").isNotNull(), F.forall("_tasks", _valid)).otherwise(~jsontext.has_member(F.col("_doc"), "tasks"))
    status = F.when(F.col("_doc").isNull(), "not_json").when((jsontext.kind(F.col("_doc")) == "OBJECT") & F.coalesce(sound, F.lit(False)), "ok").otherwise("wrong_type")
    return opened.select(key, status.alias("status"))


def failed_documents(documents: DataFrame, key: str, document: str) -> DataFrame:
    """Keys of documents that are no JSON or have a member of a wrong type."""
    return document_status(documents, key, document).filter("status <> 'ok'").select(key)


def required_tasks(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, task_id, log_path, topic, cluster_id). All members are required: the tasks before the first
    bad one are kept. A repeated id keeps its last task."""
    opened = _with_tasks(documents, document)

    def valid(e: Column) -> Column:
        return (_is(e, "task_id", "STRING") & _is(e, "log_path_pattern", "STRING")
                & _is(e, "kafka_topic", "STRING") & _is(e, "properties.kafka_cluster_id", "STRING"))

    marked = once(opened, _bad=F.array_position(F.transform("_tasks", valid), False))
    kept = F.when(F.col("_bad") > 0, F.slice("_tasks", F.lit(1), F.col("_bad").cast("int") - 1)).otherwise(F.col("_tasks"))
    rows = marked.select(key, F.posexplode(kept).alias("_pos", "_t"))
    t = F.col("_t")
    fields = F.struct("_pos", _text(t, "log_path_pattern").alias("log_path"), _text(t, "kafka_topic").alias("topic"),
                      _text(t, "properties.kafka_cluster_id").alias("cluster_id"))
    last = rows.groupBy(key, _text(t, "task_id").alias("task_id")).agg(F.max(fields).alias("_f"))
    return last.select(key, "task_id", "_f.log_path", "_f.topic", "_f.cluster_id")


def control_tasks(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, cversion, task_id BIGINT, task_name, log_path_pattern, version, mq_*, properties JSON text) of
    versioned documents. Members default; a member of a wrong type fails the whole document."""
    opened = _with_tasks(documents, document)
    texts = ["task_name", "log_path_pattern"]
    queue = ["type", "version", "cluster_id", "topic"]

    def valid(e: Column) -> Column:
        ok = _is_object(e) & _is_number(e, "task_id") & _is_number(e, "version")
        for f in texts:
            ok = ok & _is(e, f, "STRING", "ABSENT")
        ok = ok & _is(e, "message_queue", "OBJECT", "ABSENT")
        for f in queue:
            ok = ok & _is(e, f"message_queue.{f}", "STRING", "ABSENT")
        return ok

    doc = F.col("_doc")
    sound = opened.filter(doc.isNotNull() & _is_object(doc) & _is_number(doc, "cversion") & F.forall("_tasks", valid))
    rows = sound.select(key, _number(doc, "cversion").alias("cversion"), F.explode("_tasks").alias("_t"))
    t = F.col("_t")
    has_queue = _shape(t, "message_queue") != "ABSENT"
    mq = lambda f, default="": F.when(has_queue, _text(t, f"message_queue.{f}", default)).otherwise("")
    return rows.select(
        key, "cversion", _number(t, "task_id").alias("task_id"), *[_text(t, f).alias(f) for f in texts],
        _number(t, "version").alias("version"), mq("type", "kafka").alias("mq_type"), mq("version").alias("mq_version"),
        mq("cluster_id").alias("mq_cluster_id"), mq("topic").alias("mq_topic"),
        F.coalesce(F.to_json(F.try_variant_get(t, "$.properties", "variant")), F.lit("{}")).alias("properties"))


def comparable(properties: Column) -> Column:
    """A map as its entries in key order, for equality."""
    return F.array_sort(F.map_entries(properties))


def diff(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): stop, start, restart or keep, comparing all fields of the task."""
    packed = lambda df, name: df.select(*keys, F.struct(
        "log_path_pattern", "kafka_topic", comparable(F.col("properties")).alias("p")).alias(name))
    both = packed(current, "_old").join(packed(wanted, "_new"), keys, "full")
    action = (F.when(F.col("_new").isNull(), "stop").when(F.col("_old").isNull(), "start")
              .when(F.col("_old") == F.col("_new"), "keep").otherwise("restart"))
    return both.select(*keys, action.alias("action"))


def id_sets(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, membership): removed, added or kept ids."""
    side = lambda df, name: df.select(*keys, F.lit(name).alias("_side"))
    both = side(current, "old").unionByName(side(wanted, "new")).groupBy(*keys).agg(
        F.bool_or(F.col("_side") == "old").alias("_old"), F.bool_or(F.col("_side") == "new").alias("_new"))
    membership = F.when(~F.col("_new"), "removed").when(~F.col("_old"), "added").otherwise("kept")
    return both.select(*keys, membership.alias("membership"))


def changed_since(history: DataFrame, key: str, version: str, current: int, columns: list[str]) -> DataFrame:
    """Newest state of each task with a version above the caller's."""
    newer = history.filter(F.col(version) > current)
    last = newer.groupBy(key).agg(F.max_by(F.struct(version, *columns), version).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in [version, *columns]])
