"""All registered queries and their SQL counterparts."""

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from rillworks.operators.carried import BATCH_BYTES

_MODULES = ["audit_queries", "frame_queries", "offset_queries", "metric_queries", "config_queries", "log_queries"]


def prepare(spark: SparkSession) -> None:
    """Session settings the results depend on, and the size of what a Python worker gets at once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def _modules():
    return [import_module(f"rillworks.plans.{m}") for m in _MODULES]


def queries() -> dict:
    return {name: _prepared(q) for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
