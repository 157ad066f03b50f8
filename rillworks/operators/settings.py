"""Fleet settings: properties files of many hosts, typed values, layers, and the clusters they name."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDPOINT_KEYS = ["brokers", "hosts", "url"]


def parse_properties(files: DataFrame, host: str, content: str) -> DataFrame:
    """(host, key, value) of properties files: the first `=` splits, a later line wins; blank lines,
    comments and lines without `=` are skipped."""
    lines = files.select(host, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "_raw"))
    line = F.regexp_replace("_raw", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    at = F.instr("_line", "=")
    kept = lines.select(host, "line_no", line.alias("_line")).filter(
        (at > 0) & ~F.substring("_line", 1, 1).isin("#", "!"))
    trimmed = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    return (kept.select(host, "line_no", trimmed(F.substring("_line", F.lit(1), at - 1)).alias("key"),
                        trimmed(F.substring("_line", at + 1, F.length("_line"))).alias("value"))
            .groupBy(host, "key").agg(F.max_by("value", "line_no").alias("value")))


def as_int(value: Column, default: int) -> Column:
    """Leading integer of the text, the default when there is none or it does not fit 32 bits."""
    digits = F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(default))


def as_bool(value: Column, default: bool) -> Column:
    return F.coalesce(F.lower(value).isin("true", "yes", "1"), F.lit(default))


def as_list(value: Column, delimiter: str = ",") -> Column:
    trimmed = F.transform(F.split(value, f"\\{delimiter}", -1), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array())


def with_prefix(settings: DataFrame, prefix: str) -> DataFrame:
    """Settings under a prefix, with the prefix removed from the key."""
    return settings.filter(F.col("key").startswith(prefix)).withColumn(
        "key", F.substring("key", F.lit(len(prefix) + 1), F.length("key")))


def typed(settings: DataFrame, host: str, wanted: dict[str, tuple[str, object]], prefixes: list[str] | None = None,
          hosts: DataFrame | None = None) -> DataFrame:
    """One row per host: a column per wanted key, and a map (key without prefix -> value) per prefix, in one pass.

    `wanted` maps a key to (kind, default) with kind `int`, `bool`, `text` or `list`. A key that a host doesn't have, or whose number can't
    be read, has its default (a list: no parts). `hosts` names hosts that may have no settings at all; NULL hosts are left out."""
    rows = settings.select(host, "key", "value")
    if hosts is not None:
        rows = rows.unionByName(hosts.select(host, F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    read = {"int": as_int, "bool": as_bool, "text": lambda v, default: F.coalesce(v, F.lit(default)), "list": lambda v, _: as_list(v)}
    under = lambda prefix: F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("key").startswith(prefix), F.struct(
        F.substring("key", F.lit(len(prefix) + 1), F.length("key")).alias("key"), F.col("value").alias("value"))))))
    return rows.filter(F.col(host).isNotNull()).groupBy(host).agg(
        *[read[kind](of(key), default).alias(key) for key, (kind, default) in wanted.items()], *[under(p).alias(p) for p in prefixes or []])


def effective(environment: DataFrame, files: DataFrame, host: str, names: dict[str, str], defaults: dict[str, str],
              hosts: DataFrame | None = None) -> DataFrame:
    """(host, key, value, layer): environment over file over default, for every host that any of the tables names.

    Rows: environment (host, name, value), files (host, key, value), hosts (host); `names` maps variables to the keys they override,
    `defaults` keys to values. An empty variable counts as unset. Of several values of one layer the least counts.
    The settings of one host are one row on the way: they come from one file."""
    override = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    key = F.element_at(override, F.col("name")) if names else F.lit(None).cast("string")
    entry = lambda key, rank, value: F.struct(key.alias("key"), F.lit(rank).alias("rank"), value.alias("value"))
    set_there = (F.col("value") != "") & key.isNotNull()
    env = environment.select(host, F.when(set_there, entry(key, 1, F.col("value"))).alias("_e"))
    own = files.select(host, F.when(F.col("key").isNotNull(), entry(F.col("key"), 2, F.col("value"))).alias("_e"))
    rows = env.unionByName(own)
    if hosts is not None:
        rows = rows.unionByName(hosts.select(host), allowMissingColumns=True)
    base = F.array(*[entry(F.lit(k), 3, F.lit(v)) for k, v in defaults.items()]) if defaults else F.array()
    entries = F.col("_entries")
    held = rows.filter(F.col(host).isNotNull()).groupBy(host).agg(F.array_sort(F.concat(F.collect_list("_e"), base) if defaults else F.collect_list("_e")).alias("_entries"))
    first = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))
    layer = F.element_at(F.array(F.lit("env"), F.lit("file"), F.lit("default")), F.col("rank"))
    return held.select(host, F.inline(first)).select(host, "key", "value", layer.alias("layer"))


def clusters(settings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, cluster_id, version, endpoints, options) from `mq.<kind>.cluster.<id>.<attr>` settings."""
    part = lambda i: F.regexp_extract("key", r"^mq\.([^.]+)\.cluster\.([^.]+)\.(.+)$", i)
    named = settings.filter(F.col("key").startswith("mq.")).select(
        *keys, part(1).alias("kind"), part(2).alias("cluster_id"), part(3).alias("_attr"), "value").filter("_attr <> ''")
    option = F.when(F.col("_attr").startswith("props."), F.struct(
        F.substring("_attr", F.lit(7), F.length("_attr")).alias("key"), F.col("value").alias("value")))
    return named.groupBy(*keys, "kind", "cluster_id").agg(
        F.max(F.when(F.col("_attr") == "version", F.col("value"))).alias("version"),
        as_list(F.max(F.when(F.col("_attr").isin(*ENDPOINT_KEYS), F.col("value")))).alias("endpoints"),
        F.map_from_entries(F.array_sort(F.collect_list(option))).alias("options"))
