"""Writers: topics, one writer per cluster, and rolled files."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillworks.operators.routing import queue_rows

Writer = Callable[[DataFrame, dict], None]


def topic_writer(rows: DataFrame, cluster: dict) -> None:
    """Writes to the cluster's brokers; the topic column routes each row. Needs the Kafka connector."""
    options = {f"kafka.{k}": v for k, v in (cluster.get("options") or {}).items()}
    rows.select("topic", "key", "value", "headers").write.format("kafka").option(
        "kafka.bootstrap.servers", ",".join(cluster["endpoints"])).option("includeHeaders", "true").options(
        **options).save()


def file_writer(folder: str, batch_id: int | None = None) -> Writer:
    """Files per cluster and topic. With a batch number, a batch that runs again replaces its own files."""
    def write(rows: DataFrame, cluster: dict) -> None:
        target = f"{folder}/cluster_id={cluster['cluster_id']}" + ("" if batch_id is None else f"/batch={batch_id}")
        rows.drop("cluster_id").write.mode("append" if batch_id is None else "overwrite").partitionBy("topic").parquet(target)

    return write


def fan_out(routed: DataFrame, clusters: list[dict], writers: dict[str, Writer]) -> None:
    """One write per cluster, by the writer of its kind.

    The cluster list is configuration. The routed rows are computed once: they are kept (memory, then
    disk; lost parts are recomputed) while the writes run."""
    missing = sorted({c["kind"] for c in clusters} - set(writers))
    if missing:
        raise ValueError(f"no writer for cluster kinds: {', '.join(missing)}")
    rows = queue_rows(routed).persist()
    try:
        for cluster in clusters:
            writers[cluster["kind"]](rows.filter(F.col("cluster_id") == cluster["cluster_id"]), cluster)
    finally:
        rows.unpersist()


def rolled_files(lines: DataFrame, folder: str, time: str, max_records: int = 1_000_000) -> None:
    """Files per date and hour, a new one after `max_records` rows."""
    lines.withColumns({"date": F.to_date(time), "hour": F.hour(time)}).write.mode("append").option(
        "maxRecordsPerFile", max_records).partitionBy("date", "hour").parquet(folder)


def rolled_by_size(indexed: DataFrame, folder: str, keys: list[str]) -> None:
    """One file per roll index (see `offsets.roll_index`), so a hot key is written by many tasks."""
    parts = [*keys, "hour_index", "size_index"]
    indexed.repartition(*parts).write.mode("append").partitionBy(*parts).parquet(folder)
