"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next stage's documents. All but the last return the columns of documents. NULL texts and texts without a
letter go in the first stage; NULL keys stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm import languages, leaks, near_copies, packing, repeats, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this the language model does not know the text: every known language would be a guess.
LEAST_BELIEF = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language; lang becomes the predicted one."""
    model = languages.fit(docs, shared.training("doc_id", 5))
    rows = languages.predict(docs, model)
    known = rows.filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("lang_score") >= LEAST_BELIEF))
    return known.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-copy group, whatever the keys: the one with the least key, then the least text hash.

    Rows that share a key but not a group stay, and rows without a key count in their groups like any other, after those with keys.
    """
    rows = near_copies.grouped(docs.select(COLUMNS))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")]))
    least = rows.groupBy("component").agg(F.min(F.struct(first.alias("order"), "number")).alias("_least")).select(F.col("_least.number").alias("number"))
    return rows.join(least, "number", "left_semi").select(COLUMNS)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document holds; n_chars follows the text."""
    rows = repeats.without_repeats(docs)
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold benchmark items."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 ids."""
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "before_space", with_ids=False)
    return packing.placed(parts).withColumnRenamed("key", "doc_id")


STAGES = [("language", language), ("near_copies", near_copies_out), ("repeats", repeats_out), ("benchmark", benchmark_out), ("packing", packed)]

#: SQL can't express language models, fingerprints, 50-word runs over whole corpora, and packing by search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir))
    return docs
