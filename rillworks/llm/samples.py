"""Bounded samples of labelled rows, for fitting small models on the driver."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillworks.llm import shared


def sampled(labelled: DataFrame, rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """Rows of `rows` with the label of at most `per_label` keys of each label, those with the least key hashes.

    The keys are chosen from (key, label) alone, so texts are not sorted. A label's keys are dealt to shares,
    as many as there are shuffle partitions, and each share hands on at most `per_label` of them. What is joined to the rows has at most per_label times the number of
    labels rows, a bound that does not depend on the table. Keys with several labels are left out.
    """
    one = labelled.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_most")).filter(F.col(label) == F.col("_most")).drop("_most")
    place = F.xxhash64(key)
    dealt = one.withColumn("_share", shared.spread(shared.partitions(rows.sparkSession), key, label))
    few = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(label, "_share").orderBy(place, key))).filter(F.col("_rank") <= per_label)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(place, key))
    chosen = few.withColumn("_rank", rank).filter(F.col("_rank") <= per_label).drop("_rank", "_share")
    return rows.join(F.broadcast(chosen), key)


def learnable(labelled: DataFrame, key: str, label: str, train: Column) -> DataFrame:
    return labelled.filter(train & F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label)
